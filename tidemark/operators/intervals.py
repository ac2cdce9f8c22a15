"""Greedy duplicates in time (J10, Q21) without pairs: in order of priority an item is kept unless one within
the interval is kept already.

Time is cut into buckets as wide as the interval, so what an item is near to lies in its own bucket and the two
beside it, and two items of a bucket are always near. The best item of three buckets is kept for sure:
rounds of such local winners, each one aggregation by bucket and one join with at most three winners a
bucket, settle all but chains in which every bucket waits for the next. What is left then is cut at empty
buckets into islands, and each island is swept once in order of priority, a row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.scratch import written

#: Rounds go on while they settle at least this share of what is left.
WORTH = 0.25


def _beside(df: DataFrame) -> DataFrame:
    """The rows for their own bucket and the two beside it."""
    return df.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))


def kept_in_time(items: DataFrame, seconds: float = 60) -> DataFrame:
    """The items kept, of items (id, t in microseconds, score): best score first, ties to smaller ids; any two kept
    are at least `seconds` apart. Null times are kept, as nothing is near to them."""
    width = int(seconds * 1_000_000)
    given = items.where("t is not null").select("id", "t", F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")).alias("k"), F.floor(F.col("t") / width).cast("long").alias("bucket"))
    alive = written(given, "alive")
    kept = items.where("t is null").select("id", "t")
    n = alive.count()
    while n:
        best = alive.groupBy("bucket").agg(F.min("k").alias("k"), F.min_by("t", "k").alias("t"))
        around = _beside(best.select("bucket", "k")).groupBy("bucket").agg(F.min("k").alias("least"))
        won = written(best.join(around, "bucket").where(F.col("k") == F.col("least")).select("bucket", "k", "t"), "won")
        kept = kept.unionByName(won.select(F.col("k.i").alias("id"), "t"))
        near = _beside(won.select("bucket", "t")).groupBy("bucket").agg(F.collect_list("t").alias("near"))
        left = alive.join(near, "bucket", "left").where(F.col("near").isNull() | ~F.exists("near", lambda x: F.abs(x - F.col("t")) < width))
        alive = written(left.select("id", "t", "k", "bucket"), "alive")
        before, n = n, alive.count()
        if n > (1 - WORTH) * before:
            return kept.unionByName(_swept(alive, width))
    return kept


def _swept(alive: DataFrame, width: int) -> DataFrame:
    """Islands of buckets without an empty one between, each swept by one task in order of priority; it holds
    the kept times, at most one a bucket, not the rows."""
    buckets = alive.select("bucket").distinct()
    following = buckets.select((F.col("bucket") - 1).alias("bucket")).join(buckets, "bucket", "left_semi")
    ways, _ = graph.followed(following.select(F.col("bucket").alias("node"), (F.col("bucket") + 1).alias("next")))
    island = buckets.join(ways.select(F.col("node").alias("bucket"), "at"), "bucket", "left").select("bucket", F.coalesce("at", "bucket").alias("island"))
    order = ["island", "k"]
    ordered = alive.join(island, "bucket").repartition("island").sortWithinPartitions(*order).select("island", "id", "t", "bucket")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, taken = None, {}
        for batch in batches:
            keep = []
            for i, (now, t, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("island", "t", "bucket")], strict=True)):
                if now != here:
                    here, taken = now, {}
                if all(abs(taken.get(b + d, t + width) - t) >= width for d in (-1, 0, 1)):
                    taken[b] = t
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("id", "t")], names=["id", "t"])

    return ordered.mapInArrow(sweep, alive.select("id", "t").schema)


def dropped_in_time(items: DataFrame, seconds: float = 60) -> DataFrame:
    """J10, Q21. id and keeper of every item (id, t in microseconds, score) that is not kept: the keeper is the best
    of those kept within `seconds`."""
    width = int(seconds * 1_000_000)
    kept = written(kept_in_time(items, seconds), "kept")
    scored = kept.where("t is not null").join(items.select("id", "score"), "id").select(F.floor(F.col("t") / width).cast("long").alias("bucket"), F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"), "t").alias("k"))
    near = _beside(scored).groupBy("bucket").agg(F.collect_list("k").alias("near"))  # at most one a bucket, so three
    rest = items.where("t is not null").join(kept.select("id"), "id", "left_anti").withColumn("bucket", F.floor(F.col("t") / width).cast("long"))
    by = F.array_min(F.filter("near", lambda k: F.abs(k["t"] - F.col("t")) < width))
    return rest.join(near, "bucket").select("id", by["i"].alias("keeper"))
