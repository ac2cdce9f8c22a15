"""Mixing sources to target weights.

The words of a source's documents form one stream, cut into blocks of fixed length; the last may
be shorter. A source is given a target of words by weight, at most `repeats` times its size, and
the excess of those that reach it is shared among the rest by weight. For every output shard a
multinomial draw says how many slots each source gets in it; the draws become ranges of the
source's slots, clipped to what its target needs, and what the draws leave over is dealt in turn.
Slot j of a pass over a source holds block p(j), p being the Feistel permutation of that source
and pass, so a block is used at most once a pass. Slots and the documents' pieces of blocks meet by source and
block number. The slot in which a source reaches its target holds only the first words of its
block, so a source's words come within one word of its target.

Positions in a stream come from sums by bucket of a source, then within the bucket, so a source
with a third of all rows is spread over tasks. All draws are functions of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import packed, scratch, unpacked, words
from tidemark.llm.feistel import div, permute

BLOCK_WORDS = 256
SHARDS = 16
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
REPEATS = 2
KEY = 7
BUCKETS = 1024
#: Sources that are drawn among in one task.
GROUP = 4096
#: Slots made by one row when ranges of slots are spread over tasks.
RANGE = 4096


def numbered(sizes: DataFrame) -> DataFrame:
    """Adds source_no, the place of every source by code point, null last: ranges of sources are
    counted and each is numbered by itself, so no task holds all."""
    spread = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.repartitionByRange(spread, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = scratch(ranged, "ranges")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("source_no", F.col("offset") + F.col("inside")).drop("part", "inside", "offset")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """Adds source_no (by code point, null last), weight and target to a table of source and
    source_size. Weights repeat in order. target = min(repeats * size, level * weight), with the
    level at which the targets add up to share_percent of all sizes (at most repeats * 100). The
    level is found by sharing excess by weight until no source is above its limit: in each round two
    sums over the sources, and what is at its limit stays there."""
    if not 0 <= share_percent <= 100 * repeats:
        raise ValueError("share_percent must lie between 0 and 100 * repeats")
    given = F.array(*[F.lit(float(w)) for w in weights])
    known = scratch(numbered(sizes).withColumn("weight", F.element_at(given, (F.col("source_no") % len(weights)).cast("int") + 1)), "weighted")
    limit = F.col("source_size") * repeats
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        at = F.lit(False) if level is None else limit <= level * F.col("weight")
        taken, free, n = known.agg(F.sum(F.when(at, limit)), F.sum(F.when(~at, F.col("weight"))), F.count_if(at)).first()
        if n == full:
            break
        full = n
        if not free:
            level = float("inf")
            break
        level = (total * share_percent / 100 - (taken or 0)) / free
    return known.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def stream_positions(docs: DataFrame, id_col: str, text_col: str, source_col: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, source, source_key, size, row_hash, copy and start, the number of
    words of its source before it. Repeated rows are counted together and given places in turn."""
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), F.xxhash64(text_col).alias("row_hash"))
    base = base.groupBy("id", "source", "size", "row_hash").agg(F.count("*").alias("copies"))
    base = base.withColumns({
        "source_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
        "bucket": F.pmod(F.xxhash64("id", "row_hash"), F.lit(buckets)).cast("int"),
    })
    base = scratch(base, "sizes")
    weight = F.col("size") * F.col("copies")
    ahead = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets_at = base.groupBy("source_key", "bucket").agg(F.sum(weight).alias("n")).select("source_key", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("source_key", "bucket").orderBy(F.col("id").asc_nulls_first(), "row_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(buckets_at.hint("merge"), ["source_key", "bucket"])
    copies = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return copies.select("id", "source", "source_key", "size", "row_hash", "copy", (F.col("ahead") + F.col("inside") + F.col("copy") * F.col("size")).alias("start"))


def draw_slots(sources: DataFrame, shards: int, key: int) -> DataFrame:
    """Ranges of slots by shard and source: source_key, source_no, source_size, goal (words), shard,
    low, high. sources has these and n_slots. Every shard has the same number of slots and draws
    its counts by source from one multinomial, in two steps: of groups of GROUP sources on the driver,
    of the sources of a group in a task. Ranges end where a source has its slots, and what the draws
    leave is spread evenly over the shards."""
    offered = sources.where("n_slots > 0").withColumn("group", F.floor(F.col("source_no") / GROUP).cast("int"))
    held = sorted((r.group, int(r.n)) for r in offered.groupBy("group").agg(F.sum("n_slots").alias("n")).collect())
    total = sum(n for _, n in held)
    # a draw in two steps: counts of groups of sources, then of the sources in each
    rows = []
    for shard in range(shards if total else 0):
        drawn = np.random.Generator(np.random.PCG64([key, shard])).multinomial(-(-total // shards), [n / total for _, n in held])
        rows += [(shard, g, int(n), own) for (g, own), n in zip(held, drawn, strict=True)]
    counts = sources.sparkSession.createDataFrame(rows, "shard int, group int, group_drawn long, group_slots long")
    offered = offered.join(counts, "group")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no")
        first = rows.iloc[0]
        chance = rows["n_slots"].to_numpy() / rows["n_slots"].sum()
        rows["drawn"] = np.random.Generator(np.random.PCG64([key, int(first["shard"]), int(first["group"]), 1])).multinomial(int(first["group_drawn"]), chance)
        return rows

    kinds = "source_key string, source_no long, source_size long, goal long, n_slots long, shard int, group int, group_drawn long"
    drawn = offered.select(*[c.split()[0] for c in kinds.split(", ")]).groupBy("shard", "group").applyInPandas(draw, kinds + ", drawn long")
    by = W.partitionBy("source_key").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    ends = drawn.withColumn("end", F.least(F.sum("drawn").over(by), F.col("n_slots")))
    ends = ends.withColumns({"last": F.max("end").over(W.partitionBy("source_key")), "begin": F.coalesce(F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    rest = F.col("n_slots") - F.col("last")
    extra = lambda k: F.col("last") + div(rest * k, shards)
    keep = ["source_key", "source_no", "source_size", "goal", "shard"]
    main = ends.select(*keep, F.col("begin").alias("low"), F.col("end").alias("high"))
    more = ends.select(*keep, extra(F.col("shard")).alias("low"), extra(F.col("shard") + 1).alias("high"))
    return main.unionByName(more).where("low < high")


def mix_blocks(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(placements, documents). placements: a row for each part of a document in a slot of the mix:
    shard, source_key, slot, block, pass (0 for the first use of the block), id, row_hash, copy and
    the words first to last (exclusive) of the document. documents: a row per document with id,
    source, source_key, size, row_hash, copy, start, source_size and target.

    A null text has size 0 and takes no part; null is a source of its own, the last. Repeated rows
    have places of their own in the stream. An empty table, or one without words, gives no
    placements. Further columns are not looked at.
    """
    placed = scratch(stream_positions(docs, id_col, text_col, source_col), "places")
    sizes = placed.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = scratch(source_targets(sizes, weights, share_percent, repeats), "sources")
    block = F.lit(block_words).cast("long")
    blocks = div(F.col("source_size") + block - 1, block)
    goal = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * repeats)
    slots = sources.withColumns({"goal": goal, "n_slots": F.when(F.col("source_size") == 0, F.lit(0).cast("long")).otherwise(
        div(goal, F.col("source_size")) * blocks + F.least(blocks, div(goal % F.greatest(F.col("source_size"), F.lit(1)) + block - 1, block) + 1) * (goal % F.greatest(F.col("source_size"), F.lit(1)) > 0).cast("long")
    )})
    ranges = draw_slots(slots.select("source_key", "source_no", "source_size", "goal", "n_slots"), shards, key)
    chunks = ranges.select("*", F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(RANGE).cast("long"))).alias("at"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = chunks.repartition(spread, "source_key", "shard", "at").select(
        "source_key", "source_no", "source_size", "goal", "shard", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + RANGE, F.col("high")) - 1)).alias("slot")
    )
    each = each.withColumn("n_blocks", blocks).withColumns({"pass": div(F.col("slot"), F.col("n_blocks")), "j": F.col("slot") % F.col("n_blocks")})
    # a permutation of each source and pass
    own = F.xxhash64(F.col("source_key"), F.lit(key), F.col("pass"))
    each = each.withColumns({
        "block": permute(F.col("j"), F.col("n_blocks"), own),
        "short_at": permute(F.col("n_blocks") - 1, F.col("n_blocks"), own, inverse=True),
    })
    lacking = F.col("n_blocks") * block - F.col("source_size")
    length = block - F.when(F.col("block") == F.col("n_blocks") - 1, lacking).otherwise(F.lit(0))
    before = F.col("j") * block - F.when(F.col("j") > F.col("short_at"), lacking).otherwise(F.lit(0))
    take = F.least(length, F.col("goal") - F.col("pass") * F.col("source_size") - before)
    each = each.withColumn("take", take).where("take > 0").select("source_key", "shard", "slot", "pass", "block", "take")
    pieces = placed.where("size > 0").select("*", F.explode(F.sequence(div(F.col("start"), block), div(F.col("start") + F.col("size") - 1, block))).alias("block"))
    pieces = pieces.withColumns({"from": F.greatest(F.col("start"), F.col("block") * block), "to": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})
    met = each.hint("merge").join(pieces, ["source_key", "block"]).withColumn("to", F.least("to", F.col("block") * block + F.col("take"))).where(F.col("from") < F.col("to"))
    placements = met.select(
        "shard", "source_key", "slot", "block", "pass", "id", "row_hash", "copy",
        (F.col("from") - F.col("start")).alias("first"), (F.col("to") - F.col("start")).alias("last"),
    )
    return placements, placed.join(sources.select("source_key", "source_size", "target"), "source_key")


def mixed_sizes(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of mix_blocks with `taken`, the words that the mix takes of each, repeats
    counted; 0 for those it takes nothing of."""
    placements, documents = mix_blocks(docs, **options)
    row = ["source_key", "id", "row_hash", "copy"]
    taken = placements.groupBy(*row).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    matches = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in row]
    joined = documents.alias("d").join(taken.hint("merge").alias("t"), matches[0] & matches[1] & matches[2] & matches[3], "left")
    return joined.select("d.*", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix as documents: for every document and pass the words taken, in order, with the other
    columns of the document. A document taken whole keeps its text as it is; otherwise words are
    joined by one space. One taken in both passes gives two rows, one taken not at all none. A null
    or blank text has no words and gives no row; null is a source of its own; repeated rows are
    mixed as documents of their own; an empty table gives none; other columns keep any names."""
    own = {"id": id_col, "text": text_col, "source": source_col}
    given = packed(docs, **own)
    placements, documents = mix_blocks(given, id_col="id", text_col="text", source_col="source", **options)
    row = ["source_key", "id", "row_hash", "copy", "pass"]
    spans = placements.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"), F.sum(F.col("last") - F.col("first")).alias("taken"))
    given = given.withColumns({"row_hash": F.xxhash64("text"), "source_key": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))})
    # texts are shuffled for the join alone, and for numbers of copies only where rows repeat
    repeated = W.partitionBy("id", "row_hash", "source_key").orderBy(F.lit(0))
    once = documents.where("copy > 0").isEmpty()
    given = given.withColumn("copy", F.lit(0).cast("long") if once else (F.row_number().over(repeated) - 1).cast("long"))
    matches = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) if c == "id" else F.col(f"d.{c}") == F.col(f"s.{c}") for c in row[:-1]]
    joined = given.alias("d").join(spans.hint("merge").alias("s"), matches[0] & matches[1] & matches[2] & matches[3])
    joined = joined.select("d.*", "s.spans", "s.taken").withColumn("w", words(F.col("text")))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("w"), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), " ")
    joined = joined.withColumn("text", F.when(F.col("taken") == F.size("w"), F.col("text")).otherwise(cut))
    return joined.select(*unpacked(joined, docs.columns, **own))
