"""Vector code compression: product quantisation in whole numbers.

A vector is cut into equal consecutive parts, and each part position has a codebook. Rounds of
assigning every part to the nearest entry and replacing the entries by their parts' means run as RDD
treeAggregate over columnar NumPy blocks: within a block, distances of a part accumulate dimension by
dimension over all its vectors and entries, and np.add.at adds the parts to sums and counts of their
entries; these tensors, of a size that the number of vectors does not change, merge through a
reduction tree. Only they reach the driver. All numbers are whole, so the order of merging and lost
executors change nothing; int64 is used where a bound says that it holds, Python's numbers elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release, scratch
from tidemark.llm.vectors import LONG, matrix, nearest_long, vector_blocks, whole_vectors

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels whose sums are sent to every task; more are joined by a shuffle.
SENT_LABELS = 10_000
#: Levels of the reduction tree.
DEPTH = 3

Books = list[np.ndarray]


def borders(width: int, parts: int) -> list[int]:
    """Where the parts begin and end; they are equal where parts divides the width, else as near as can be."""
    return [p * width // parts for p in range(parts + 1)]


def _magnitude(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry for every row (ties to the lower index), and its squared distance."""
    fits = max(1, x.shape[1]) * (_magnitude(x) + _magnitude(book)) ** 2 < 2**62
    kind = np.int64 if fits else object
    x, book = x.astype(kind), book.astype(kind)
    distance = np.zeros((len(x), len(book)), kind)
    for j in range(x.shape[1]):
        away = x[:, j, None] - book[None, :, j]
        distance += away * away
    codes = distance.argmin(1)
    return codes, distance[np.arange(len(x)), codes]


def trained(blocks: DataFrame, books: Books, wide: int, rounds: int = ROUNDS) -> Books:
    """Codebooks after so many rounds over all blocks, from those given."""
    cuts = borders(wide, len(books))
    n, top = blocks.agg(F.sum("n"), F.max("top")).first()
    kind = np.int64 if n * (top + 1) < 2**62 else object
    entries = len(books[0])
    rows = blocks.select("n", "width", "kind", "data").rdd

    def zero() -> tuple[list[np.ndarray], np.ndarray]:
        return [np.zeros(b.shape, kind) for b in books], np.zeros((len(books), entries), np.int64)

    def add(total: tuple[list[np.ndarray], np.ndarray], row: T.Row) -> tuple[list[np.ndarray], np.ndarray]:
        sums, counts = total
        x = matrix(row.n, row.width, row.kind, row.data, wide)
        for p, book in enumerate(now):
            part = x[:, cuts[p] : cuts[p + 1]]
            codes, _ = nearest(part, book)
            np.add.at(sums[p], codes, part.astype(kind))
            np.add.at(counts[p], codes, 1)
        return sums, counts

    def merge(a: tuple[list[np.ndarray], np.ndarray], b: tuple[list[np.ndarray], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]

    now = books
    for _ in range(rounds):
        sums, counts = rows.treeAggregate(zero(), add, merge, depth=DEPTH)
        now = [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], b) for s, c, b in zip(sums, counts, now, strict=True)]
    return now


def books_digest(books: Books) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of all vectors. A component x counts as the whole number floor(scale * x).

    Codebooks start as the parts of the vectors with the `entries` smallest ids, ascending; equal ids are
    ordered by vector, and null ids come last. Returns per vector: the id, code (two hex digits per
    part), error (squared distance between the vector and its code), label_error (errors summed over rows of
    the same label, nulls together; both: beyond 63 bits the nearest long) and codebooks_sha256.

    Rows whose vector is null or has a null or non-finite component take no part. Shorter vectors
    count as padded with zeros to the longest. If the width is no multiple of `parts`, parts differ by one
    component at most; parts without components have code 00. With fewer vectors than entries
    there are as many entries as vectors. Repeated rows count as often as they stand. An empty table gives
    no rows. Other columns are ignored; at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    whole = whole_vectors(df, id_col, vector_col, scale, label=label_col)
    kinds = {c: whole.schema[c].dataType for c in ("id", "label")}
    spark = df.sparkSession
    blocks = vector_blocks(whole, "codes")
    wide = blocks.agg(F.max("width")).first()[0]
    result = T.StructType([T.StructField(id_col, kinds["id"]), *T._parse_datatype_string("code string, error long, label_error long, codebooks_sha256 string").fields])
    if wide is None:
        return spark.createDataFrame([], result)
    first = whole.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([r.v + [0] * (wide - len(r.v)) for r in first], np.int64).reshape(len(first), wide)
    cuts = borders(wide, parts)
    books = trained(blocks, [start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)], wide, rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = matrix(*[batch.column(c)[i].as_py() for c in ("n", "width", "kind", "data")], wide)
                found = [nearest(x[:, cuts[p] : cuts[p + 1]], book) for p, book in enumerate(books)]
                digits = np.array([codes for codes, _ in found], np.uint8).T
                text = np.ascontiguousarray(digits).tobytes().hex()
                error = sum(d.astype(object) for _, d in found)
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[i].values, pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()),
                    pa.array([nearest_long(e) for e in error], pa.int64()), batch.column("labels")[i].values,
                ], names=["id", "code", "error", "label"])
        release()

    schema = T.StructType([T.StructField("id", kinds["id"]), *T._parse_datatype_string("code string, error long").fields, T.StructField("label", kinds["label"])])
    coded = scratch(blocks.select("n", "width", "kind", "data", "ids", "labels").mapInArrow(assign, schema), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = scratch(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label"), "label_errors")
    side = F.broadcast(labels) if labels.count() <= SENT_LABELS else labels.hint("merge")
    joined = coded.join(side, coded["label"].eqNullSafe(labels["of_label"]), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int = 64) -> str:
    """DuckDB SQL for the same codes of vectors of one width: a table expression per round."""
    size = width // parts
    sql = f"""WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS MATERIALIZED (SELECT uid, p, v[p * {size} + 1:p * {size} + {size}] AS s FROM whole, (SELECT unnest(range({parts})) AS p)),
    book0 AS MATERIALIZED (SELECT p, i, s AS b FROM (SELECT uid, row_number() OVER (ORDER BY vec_id, v) - 1 AS i FROM whole QUALIFY i < {entries}) JOIN cut USING (uid))"""
    distance = f"list_sum(list_transform(range(1, {size + 1}), lambda j: (s[j] - b[j]) * (s[j] - b[j])))"
    for r in range(rounds + 1):
        sql += f""",
    code{r} AS MATERIALIZED (SELECT uid, p, min((d, i)) AS m FROM (SELECT uid, p, i, {distance}::BIGINT AS d FROM cut JOIN book{r} USING (p)) GROUP BY uid, p)"""
        if r < rounds:
            means = ", ".join(f"floor(sum(s[{j}])::DOUBLE / count(*))::BIGINT" for j in range(1, size + 1))
            sql += f""",
    book{r + 1} AS MATERIALIZED (SELECT p, i, coalesce(mean, b) AS b FROM book{r} LEFT JOIN (SELECT p, m[2] AS i, [{means}] AS mean FROM code{r} JOIN cut USING (uid, p) GROUP BY ALL) USING (p, i))"""
    return sql + f""",
    coded AS (SELECT uid, string_agg(lpad(lower(hex(m[2])), 2, '0'), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM code{rounds} GROUP BY uid),
    digest AS (SELECT sha256(string_agg(t, ',' ORDER BY p, i)) AS codebooks_sha256 FROM (SELECT p, i, array_to_string(b, ',') AS t FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole JOIN coded USING (uid), digest"""
