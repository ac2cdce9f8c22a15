"""Groups that depend on order, as tables: clusters of rules claimed in the order of tags (W8, N16), and k-means
with farthest-point seeds (A14, C2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators.cells import unit
from tidemark.scratch import written

MAX_ROUNDS = 50
#: Decimal places of the sums of vectors, which are exact and so do not depend on the order of rows.
PLACES = 12


def tag_facts(rules: DataFrame, id_col: str = "rule_id", tags_col: str = "tags", vector_col: str = "embedding") -> DataFrame:
    """tag, place (of its first occurrence, by rule and then by place in the rule), n rules, and similarity: the mean
    cosine over pairs of its rules with vectors, by sums, 0 without such a pair. A rule's tags and vector are in one row, so nothing is joined,
    and only sums are shuffled."""
    return _facts(_tagged(rules, id_col, tags_col, vector_col))


def _tagged(rules: DataFrame, id_col: str, tags_col: str, vector_col: str, *more: str) -> DataFrame:
    """id, tags (each once), u (the vector, of length 1) and what else is named, as a table: however tags and vectors are found, they are found once."""
    return written(rules.select(F.col(id_col).alias("id"), F.array_distinct(tags_col).alias("tags"), unit(F.col(vector_col)).alias("u"), *more), "tagged")


def _facts(tagged: DataFrame) -> DataFrame:
    own = F.coalesce(F.exists("u", lambda x: x != 0), F.lit(False)).cast("double")
    each = tagged.select("id", F.col("u").isNotNull().cast("long").alias("m"), own.alias("own"), F.posexplode("tags").alias("i", "tag"))
    counted = each.groupBy("tag").agg(F.min(F.struct("id", "i")).alias("place"), F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("own").alias("own"))
    held = tagged.where("u is not null and size(tags) > 0").select("tags", F.posexplode("u").alias("j", "x"))
    sums = held.select("j", "x", F.explode("tags").alias("tag")).groupBy("tag", "j").agg(F.sum("x").alias("x")).groupBy("tag").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.when(F.col("m") > 1, (F.col("q") - F.col("own")) / (F.col("m") * (F.col("m") - 1))).otherwise(0.0)
    return counted.join(sums, "tag", "left").select("tag", "place", "n", F.coalesce(mean, F.lit(0.0)).alias("similarity"))


def claimed_tags(rules: DataFrame, floor: float = 0.5, id_col: str = "rule_id", tags_col: str = "tags", vector_col: str = "embedding") -> DataFrame:
    """W8. tag and id: the cluster that each rule goes to. Tags are gone through in order of place; one with two rules or
    more, alike enough on the mean, takes its rules that no earlier tag took, if there are two.

    Settled in rounds over the table of rules and tags, without a loop over tags. A tag whose rules include
    two for which it is the earliest tag left is sure to take them; a tag with fewer than two rules left is out. The earliest
    tag left is always one or the other, so every round settles some; most settle in the first."""
    tagged = _tagged(rules, id_col, tags_col, vector_col)
    return _claimed(tagged, written(_facts(tagged), "tag-facts"), floor)


def _claimed(tagged: DataFrame, facts: DataFrame, floor: float) -> DataFrame:
    good = facts.where((F.col("n") >= 2) & (F.col("similarity") >= floor)).select("tag", "place")
    open_ = written(tagged.select("id", F.explode("tags").alias("tag")).join(good, "tag").withColumn("sure", F.lit(False)), "open-tags")
    taken = open_.select("tag", "id").limit(0)
    while not open_.isEmpty():
        earliest = open_.groupBy("id").agg(F.min_by(F.struct("tag", "sure"), "place").alias("e")).select("id", "e.tag", "e.sure")
        won = earliest.groupBy("tag").agg((F.max("sure") | (F.count("*") >= 2)).alias("won"))
        now = written(earliest.select("id", "tag").join(won.where("won").select("tag"), "tag", "left_semi"), "claims")
        taken = taken.unionByName(now.select("tag", "id"))
        rest = open_.join(now.select("id"), "id", "left_anti").join(now.select("tag", F.lit(True).alias("fresh")).distinct(), "tag", "left")
        rest = rest.withColumn("sure", F.col("sure") | F.coalesce("fresh", F.lit(False))).drop("fresh")
        many = rest.groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2").select("tag", F.lit(True).alias("many"))
        rest = rest.join(many, "tag", "left").where(F.col("sure") | F.col("many")).drop("many")
        open_ = written(rest.select("id", "tag", "place", "sure"), "open-tags")
    return taken


def tag_clusters(rules: DataFrame, floor: float = 0.5, id_col: str = "rule_id", tags_col: str = "tags", vector_col: str = "embedding", tokens_col: str = "tokens") -> DataFrame:
    """W8, N16. Per cluster its id and name, n rules, similarity, tokens apart and merged (six tenths, rounded up) and the saving
    in percent. The members are the rows of `claimed_tags`."""
    tagged = _tagged(rules, id_col, tags_col, vector_col, tokens_col)
    facts = written(_facts(tagged), "tag-facts")
    found = written(_claimed(tagged, facts, floor), "claimed")
    sized = found.join(tagged.select("id", F.col(tokens_col).alias("tokens")), "id").groupBy("tag").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    facts = facts.select("tag", "similarity")
    merged = F.ceil(F.col("tokens") * 0.6)
    name = F.concat(F.upper(F.substring("tag", 1, 1)), F.expr("substring(tag, 2)"), F.lit(" Rules"))
    share = F.when(F.col("tokens") > 0, F.floor((F.col("tokens") - merged) / F.col("tokens") * 100 + 0.5)).otherwise(0).cast("long")
    return sized.join(facts, "tag").select(F.concat(F.lit("cluster-"), F.substring(F.md5("tag"), 1, 8)).alias("cluster_id"), "tag", name.alias("name"), "n", "similarity", "tokens", merged.alias("merged"), share.alias("savings_percent"))


# k-means


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centroids)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centroids[None, :, j]) ** 2
    return out


def kmeans(vectors: DataFrame, k: int = 5, rounds: int = MAX_ROUNDS) -> np.ndarray:
    """A14. Centroids of vectors (id, v; v an array<double>): the first is the vector of the smallest id, each further one the
    vector farthest from those there are (ties to smaller ids), then at most `rounds` rounds of nearest centroid
    (ties to the first), with the mean of each between them: the centroids are those of the last round. It ends when no vector changes its centroid. A pass is a job; the driver
    holds k vectors, and sums of vectors are exact."""
    first = vectors.orderBy("id").select("id", "v").first()
    if first is None:
        return np.zeros((0, 0))
    centroids, used = np.array([first.v]), [first.id]
    top = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0.0
    places = min(PLACES, 17 - max(0, math.ceil(math.log10(top)) if top > 0 else 0) - 3)
    while len(centroids) < k:
        now = centroids

        def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    d = _squares(_rows(batch.column("v")), now).min(1)  # noqa: B023
                    at = np.flatnonzero(d == d.max())
                    best = min(at, key=lambda i: batch.column("id")[int(i)].as_py())
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(best, 1), pa.array([d[best]]), batch.column("v").slice(best, 1)], names=["id", "d", "v"])

        found = vectors.where(~F.col("id").isin(used)).select("id", "v").mapInArrow(farthest, f"id {vectors.schema['id'].dataType.simpleString()}, d double, v array<double>")
        best = found.orderBy(F.desc("d"), "id").limit(1).first()
        if best is None:
            break
        centroids, used = np.vstack([centroids, best.v]), [*used, best.id]
    before = None
    for _ in range(rounds - 1):
        now, last = centroids, before

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, counts, changed = np.zeros(now.shape, object), np.zeros(len(now), np.int64), 0  # noqa: B023
            for batch in batches:
                x = _rows(batch.column("v"))
                near = _squares(x, now).argmin(1)  # noqa: B023
                old = np.zeros(len(x), int) if last is None else _squares(x, last).argmin(1)  # noqa: B023
                changed += int((near != old).sum())
                part = np.zeros(now.shape, np.int64)  # noqa: B023
                np.add.at(part, near, np.rint(x * 10.0**places).astype(np.int64))
                total += part.astype(object)
                counts += np.bincount(near, minlength=len(now))  # noqa: B023
            c, j = np.indices(now.shape)  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array([int(v) for v in total.ravel()], pa.decimal128(38, 0)), pa.array(counts[c.ravel()]), pa.array(np.full(c.size, changed))], names=["c", "j", "s", "n", "changed"])

        sums = vectors.select("v").mapInArrow(assign, "c int, j int, s decimal(38,0), n long, changed long").groupBy("c", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("changed").alias("changed")).collect()
        if not sums or sums[0].changed == 0:
            break
        before, centroids = centroids, centroids.copy()
        for r in sums:
            if r.n:
                centroids[r.c, r.j] = float(r.s) / r.n / 10.0**places
    return centroids


def semantic_groups(chunks: DataFrame, k: int = 5, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """C2, A14. Adds group, topic_0 and so on, by `kmeans` over the vectors. With k chunks or fewer each is a group, in order of
    ids; chunks without a vector are in topic_0. Vectors have one length."""
    ordered = [r[0] for r in chunks.orderBy(id_col).select(id_col).limit(k + 1).collect()]
    if len(ordered) <= k:
        number = F.array_position(F.array(*[F.lit(i) for i in ordered]), F.col(id_col)) - 1 if ordered else F.lit(0)
        return chunks.withColumn("group", F.concat(F.lit("topic_"), number.cast("string")))
    given = chunks.where(F.size(vector_col) > 0).select(F.col(id_col).alias("id"), V.doubles(F.col(vector_col)).alias("v"))
    centroids = kmeans(written(given, "vectors"), k)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series([0 if v is None or not len(v) else int(_squares(np.asarray(v, float)[None], centroids).argmin()) for v in vectors], dtype="int32")

    return chunks.withColumn("group", F.concat(F.lit("topic_"), nearest(V.doubles(F.col(vector_col))).cast("string")))
