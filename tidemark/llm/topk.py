"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to whole numbers. Documents and queries are dealt into cells of bounded size by
their nearest of a few pivots, so that a cell holds vectors alike. Three passes follow. Every query cell
first meets one document cell of its pivot, which gives each query a bound that its k-th score can't fall
below. Then cells are compared by their extremes alone: a document cell that no query of a query cell can
find a good enough score in is not sent to it. Last, the pairs of cells that are left are searched, each
pair a unit of work, so no task holds more than a cell of either.

Within a cell the documents are reordered by pivots of their own and cut into ranges of BLOCK rows. A
block keeps the largest positive and the smallest negative weight of each term (dimension) and its rows
as forward index. A query's bound for a block is the sum over its terms of weight times block maximum.
Each query visits blocks by falling bound, a few at a time, scores them through the forward index, and
stops when the next bound is below its (k+1)-th score so far, or that of the first pass. Bounds and scores
are exact whole numbers, whatever their size, so nothing is lost; a window merges the cells' lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import scratch

SCALE = 256
BLOCK = 128
#: Blocks that a query visits before its bound is looked at again.
STRIDE = 4
CELL_DOCS = 8192
CELL_QUERIES = 2048
PIVOTS = 32
#: Cells whose extremes a task compares, of documents and of queries.
CELLS = 256
NO_ID = 2**63 - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a double; null for a vector that is null or has a
    null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to one width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """An order of the rows that brings rows with the same nearest pivot together."""
    if len(x) <= BLOCK:
        return np.arange(len(x))
    pivots = x[:: max(1, len(x) // PIVOTS)][:PIVOTS]
    return np.argsort((x @ pivots.T).argmax(1), kind="stable")


def _largest(x: np.ndarray) -> int:
    """The largest magnitude, as a number of any size."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def _exact(top: int) -> type:
    """A type in which sums of products up to `top` are exact."""
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def search_cell(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, floors: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of x for each row of q, ties to smaller ids: query row, document row and
    score of each hit, and the number of (query, block) pairs scored. Scores below a query's floor
    are not looked for."""
    top = _largest(x) * _largest(q) * max(1, x.shape[1])
    kind = _exact(top)
    order = _ordered(x.astype(np.float64))
    xs, qs = x[order].astype(kind), q.astype(kind)
    edges = np.arange(0, len(x), BLOCK)
    high = np.maximum.reduceat(np.maximum(xs, 0), edges)
    low = np.minimum.reduceat(np.minimum(xs, 0), edges)
    bounds = np.maximum(qs, 0) @ high.T + np.minimum(qs, 0) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    # one whole number orders hits by score, then by id
    base = len(x)
    wide = object if (top + 1) * (base + 1) >= 2**62 else np.int64
    rank = np.empty(base, np.int64)
    rank[np.argsort(ids[order], kind="stable")] = np.arange(base)[::-1]
    lowest = -(top + 1) * (base + 1) - 1
    floor = np.array([-(top + 1) if f is None else max(f, -(top + 1)) for f in floors or [None] * len(q)], dtype=object)
    floor = np.minimum(floor, top + 1).astype(wide)
    best = np.full((len(q), k), lowest, dtype=wide)
    active, scored = np.arange(len(q)), 0
    for at in range(0, len(edges), STRIDE):
        kth = best[active].min(1)
        least = np.maximum(floor[active], np.where(kth == lowest, -(top + 1), kth // base))
        active = active[bounds[active, visit[active, at]] >= least]
        if not len(active):
            break
        todo = visit[active, at : at + STRIDE]
        queries = np.repeat(active, todo.shape[1])
        blocks = todo.ravel()
        by = np.argsort(blocks, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(blocks[by]) != 0])
        for part in np.split(by, starts[1:]):
            rows, b = queries[part], blocks[part[0]]
            here = slice(edges[b], min(edges[b] + BLOCK, base))
            found = qs[rows] @ xs[here].T
            keys = (found if kind is object else found.astype(np.int64)).astype(wide) * base + rank[here]
            best[rows] = np.sort(np.concatenate([best[rows], keys], axis=1), axis=1)[:, -k:]
            scored += len(rows)
    query, place = np.nonzero((best != lowest) & (best // base >= floor[:, None]))
    key = best[query, place]
    by_rank = np.empty(base, np.int64)
    by_rank[rank] = order
    return query, by_rank[(key % base).astype(np.int64)], key // base, scored


def _columns(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of documents, and vectors of queries, of one width."""
    v, qv = left["v"].combine_chunks(), right["qv"].combine_chunks()
    v, qv = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (v, qv))
    width = int(max(np.diff(v.offsets.to_numpy()).max(), np.diff(qv.offsets.to_numpy()).max(), 1))
    return left["id"].to_numpy(), _matrix(v, width), _matrix(qv, width)


def _dealt(base: DataFrame, total: int, every: int, cell_docs: int, cell_queries: int) -> tuple[DataFrame, int]:
    """The vectors with dc, their cell, and qc, their cell as a query, and the number of cells.
    Cells hold vectors with one nearest pivot; pivots are those with the smallest hashes, at most
    PIVOTS, and only say who lies with whom."""
    pivots = [r.v for r in base.select("v").orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, total // cell_docs))).collect()]
    width = max([len(v) for v in pivots] + [1])
    matrix = np.array([list(v) + [0] * (width - len(v)) for v in pivots] or [[0]], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                v = part.column(part.schema.get_field_index("v"))
                x = _matrix(v, max(width, int(np.diff(v.offsets.to_numpy()).max(initial=0))))[:, :width]
                yield part.append_column("p", pa.array((x.astype(np.float64) @ matrix.T).argmax(1).astype(np.int32)))

    named = base.withColumn("p", F.lit(0)) if len(pivots) < 2 else scratch(base.mapInArrow(nearest, "id long, v array<long>, n long, p int"), "dealt")
    asks = F.col("id") % every == 0
    sizes = {r.p: (r.d, r.q) for r in named.groupBy("p").agg(F.count("*").alias("d"), F.count_if(asks).alias("q")).collect()}
    cells, first = [], []  # of documents and of queries, by pivot
    for p in range(max(len(pivots), 1)):
        first.append(tuple(sum(c[i] for c in cells) for i in (0, 1)))
        d, q = sizes.get(p, (0, 0))
        cells.append((max(1, -(-d // cell_docs)), max(1, -(-q // cell_queries))))
    of = lambda table, i: F.element_at(F.array(*[F.lit(row[i]) for row in table]), F.col("p") + 1)
    deal = lambda i, *by: (of(first, i) + F.pmod(F.xxhash64(*by), of(cells, i)).cast("int"))
    out = named.withColumns({"dc": deal(0, "id", "v"), "qc": F.when(asks, deal(1, "v", "id")), "home": of(first, 0) + F.pmod(F.xxhash64("v"), of(cells, 0)).cast("int")})
    return out, sum(c[0] for c in cells)


def _extremes(df: DataFrame, key: str, vector: str, floor: str | None = None) -> DataFrame:
    """key, high and low: the largest and smallest value of every dimension in a cell, 0 where a
    vector is shorter; and floor, the smallest of the cell, null where one is missing."""
    kind = pa.schema([(key, pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("floor", pa.int64())])

    def rows(held: dict[int, tuple[np.ndarray, np.ndarray, int | None]]) -> pa.RecordBatch:
        cells = list(held)
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *(pa.array([held[c][i] for c in cells], kind.field(1 + i).type) for i in (0, 1, 2))], schema=kind)

    def merged(held: dict[int, tuple[np.ndarray, np.ndarray, int | None]], cell: int, high: np.ndarray, low: np.ndarray, least: int | None) -> None:
        if cell in held:
            a, b, f = held[cell]
            n = max(len(a), len(high))
            pad = lambda x: np.pad(x, (0, n - len(x)))
            high, low, least = np.maximum(pad(a), pad(high)), np.minimum(pad(b), pad(low)), None if f is None or least is None else min(f, least)
        held[cell] = (high, low, least)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, int | None]] = {}
        for batch in batches:
            v, cells = batch.column(1), batch.column(0).to_numpy()
            x = _matrix(v, max(1, int(np.diff(v.offsets.to_numpy()).max(initial=1))))
            floors = batch.column(2).to_pylist()
            for cell in np.unique(cells).tolist():
                here = np.flatnonzero(cells == cell)
                own = [floors[i] for i in here]
                merged(held, cell, np.maximum(x[here].max(0), 0), np.minimum(x[here].min(0), 0), None if None in own else min(own))
            if len(held) > 2048:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def together(table: pa.Table) -> pa.Table:
        held: dict[int, tuple[np.ndarray, np.ndarray, int | None]] = {}
        for r in table.to_pylist():
            merged(held, r[key], np.array(r["high"], np.int64), np.array(r["low"], np.int64), r["floor"])
        return pa.Table.from_batches([rows(held)], kind)

    schema = f"{key} int, high array<long>, low array<long>, floor long"
    given = df.select(F.col(key).cast("int").alias(key), F.col(vector).alias("v"), (F.col(floor) if floor else F.lit(None)).cast("long").alias("floor"))
    return given.mapInArrow(partial, schema).groupBy(key).applyInArrow(together, schema)


def _promising(docs: DataFrame, asked: DataFrame, cells: int) -> DataFrame:
    """Pairs dc, qc of cells in which some query may reach its floor: by the sum over all dimensions
    of the largest product of the cells' extremes. The extremes meet in a grid of CELLS by CELLS."""
    grid = -(-cells // CELLS)
    boxes = _extremes(docs, "dc", "v").select("dc", "high", "low", F.floor(F.col("dc") / CELLS).cast("int").alias("i"))
    asks = _extremes(asked, "qc", "qv", "floor").select("qc", F.col("high").alias("qh"), F.col("low").alias("ql"), "floor", F.floor(F.col("qc") / CELLS).cast("int").alias("j"))
    most = (asked.agg(F.max("qc")).first()[0] or 0) // CELLS
    boxes = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("j"))
    asks = asks.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    kind = pa.schema([("dc", pa.int32()), ("qc", pa.int32())])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return kind.empty_table()
        lists = [t[c].combine_chunks() for t, c in ((left, "high"), (left, "low"), (right, "qh"), (right, "ql"))]
        lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
        width = max(int(np.diff(c.offsets.to_numpy()).max()) for c in lists)
        high, low, up, down = (_matrix(c, width) for c in lists)
        top = max(_largest(high), _largest(low)) * max(_largest(up), _largest(down)) * width
        high, low, up, down = (m.astype(_exact(top)) for m in (high, low, up, down))
        dc, qc = left["dc"].to_numpy(), right["qc"].to_numpy()
        out = []
        for n, floor in enumerate(right["floor"].to_pylist()):
            bound = np.maximum(np.maximum(up[n] * high, up[n] * low), np.maximum(down[n] * high, down[n] * low)).sum(1)
            out += [(int(d), int(qc[n])) for d in (dc if floor is None else dc[bound >= floor])]
        return pa.table({"dc": pa.array([d for d, _ in out], pa.int32()), "qc": pa.array([q for _, q in out], pa.int32())}, schema=kind)

    return boxes.groupBy("i", "j").cogroup(asks.groupBy("i", "j")).applyInArrow(met, "dc int, qc int")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", cell_docs: int = CELL_DOCS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: for every row whose id is divisible by query_every its k
    best other rows by inner product of the quantised vectors, ties to smaller ids.

    Rows whose vector is null or holds null or non-finite components take no part; a row with a
    null id is no query, and as a candidate ranks last among ties. Repeated rows are candidates
    for one another and each queries; they are pre-aggregated, so a hot row costs one. Vectors of
    unlike length are compared as if padded with zeros. A component or score beyond 64 bits counts as
    the nearest long; a k-th score of many such is a tie. An empty table gives no rows.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("v is not null")
    base = scratch(base.groupBy("id", "v").agg(F.count("*").alias("n")), "vectors")
    dealt, cells = _dealt(base, base.count(), query_every, cell_docs, cell_queries)
    docs = dealt.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "v", F.least("n", F.lit(k + 1)).cast("int").alias("n"), "dc")
    asked = dealt.where("qc is not null").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.xxhash64("v").alias("qh"), F.col("n").alias("qn"), "qc", "home")

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return floor_kind.empty_table()
        query, _, score, _ = search_cell(*_columns(left, right), k + 1)
        least: dict[int, list[int]] = {}
        for i, x in zip(query.tolist(), score.tolist(), strict=True):
            least.setdefault(i, []).append(int(x))
        known = {i: min(xs) for i, xs in least.items() if len(xs) > k and min(xs) >= -(2**63)}
        at = np.array(list(known), np.int64)
        return pa.table({"q": right["q"].to_numpy()[at], "qh": right["qh"].to_numpy()[at], "floor": pa.array([min(x, 2**63 - 1) for x in known.values()], pa.int64())}, schema=floor_kind)

    floor_kind = pa.schema([("q", pa.int64()), ("qh", pa.int64()), ("floor", pa.int64())])
    if cells > 1:
        # queries of a cell go home by their vectors; only home cells are sent, each once per query cell
        first = asked.select("q", "qv", "qh", "qc", F.col("home").alias("dc"))
        sent = docs.join(first.select(F.col("dc").alias("dc"), F.col("qc").alias("qc")).distinct().hint("merge"), "dc")
        known = sent.groupBy("dc", "qc").cogroup(first.groupBy("dc", "qc")).applyInArrow(floors, "q long, qh long, floor long")
        asked = scratch(asked.join(known.hint("merge"), ["q", "qh"], "left").drop("home"), "asked")
        pairs = scratch(_promising(docs, asked, cells), "cell-pairs")
        again = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])
        docs, asked = docs.join(pairs.hint("merge"), "dc"), asked.join(again.hint("merge"), "qc")
    else:
        docs = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(asked.agg(F.max("qc")).first()[0] or 0))).alias("qc"))
        asked = asked.drop("home").withColumns({"dc": F.lit(0), "floor": F.lit(None).cast("long")})
    schema = "q long, qh long, qn long, id long, score long, n int, own boolean"
    into = pa.schema([("q", pa.int64()), ("qh", pa.int64()), ("qn", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("n", pa.int32()), ("own", pa.bool_())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return into.empty_table()
        ids, x, y = _columns(left, right)
        query, row, score, _ = search_cell(ids, x, y, k + 1, right["floor"].to_pylist())
        q = right["q"].to_numpy()
        return pa.table({
            "q": q[query], "qh": right["qh"].to_numpy()[query], "qn": right["qn"].to_numpy()[query], "id": ids[row], "score": np.clip(score, -(2**63), 2**63 - 1).astype(np.int64),
            "n": left["n"].to_numpy()[row], "own": (ids[row] == q[query]) & (x[row] == y[query]).all(1),
        }, schema=into)

    hits = docs.groupBy("dc", "qc").cogroup(asked.groupBy("dc", "qc")).applyInArrow(cell, schema)
    hits = hits.withColumn("n", F.col("n") - F.col("own").cast("int")).where("n > 0")
    hits = hits.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("n", "own", "copy")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("q", "qh").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    ranked = ranked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("qn"))).alias("copy"))
    return ranked.select(F.col("q").alias("query_id"), "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")
