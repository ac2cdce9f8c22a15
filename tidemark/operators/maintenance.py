"""Maintenance jobs (R18, K8, K15, M3, M4, N17, Q21): each returns new tables and one row of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as N
from tidemark.operators import categories, graph, intervals, store
from tidemark.scratch import written


def recompute_decay(metadata: DataFrame, now: Column, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Decay of every chunk that is not archived anew; those then under the threshold are archived."""
    fresh = N.decay_score(now, F.col("created_at"), F.col("access_count"), F.col("last_accessed_at"), F.col("importance"))
    new = metadata.withColumn("decay_score", F.when(F.col("is_archived"), F.col("decay_score")).otherwise(fresh))
    out = store.archive_below(new, threshold)
    metrics = metadata.agg(F.count_if(~F.col("is_archived")).alias("updated")).join(store.archival_candidates(new, threshold).agg(F.count("*").alias("archived")), F.lit(True))
    return out, metrics


def hot_items(access_log: DataFrame, until: Column, hours: int = 24, limit: int = 50) -> DataFrame:
    """M4. The chunks most often read in the hours before a time."""
    recent = access_log.where((F.col("accessed_at") > until - F.make_dt_interval(hours=F.lit(hours))) & (F.col("accessed_at") <= until))
    return recent.groupBy("chunk_id").agg(F.count("*").alias("accesses")).orderBy(F.desc("accesses"), "chunk_id").limit(limit)


def promote(metadata: DataFrame, hot: DataFrame) -> DataFrame:
    """N17. Hot chunks with their importance raised."""
    flagged = metadata.join(hot.select("chunk_id", F.lit(True).alias("_hot")), "chunk_id", "left")
    return flagged.withColumn("importance", F.when(F.col("_hot"), N.promoted(F.col("importance"))).otherwise(F.col("importance"))).drop("_hot")


def consolidate(metadata: DataFrame, access_log: DataFrame, now: Column, archive_threshold: float = 0.15, seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Nightly: duplicates (created less than a minute apart; the better by decay is kept) archived and
    marked superseded, hot chunks promoted, weak ones archived. Returns metadata and new edges."""
    live = metadata.where(~F.col("is_archived"))
    dropped = written(intervals.dropped_in_time(live.select(F.col("chunk_id").alias("id"), F.unix_micros("created_at").alias("t"), F.col("decay_score").alias("score")), seconds), "dropped")
    gone = dropped.select(F.col("id").alias("chunk_id"), F.lit(True).alias("_gone"))
    new = metadata.join(gone, "chunk_id", "left").withColumn("is_archived", F.col("is_archived") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    new = store.archive_below(promote(new, hot_items(access_log, now)), archive_threshold)
    edges = dropped.select(F.col("keeper").alias("from_id"), F.col("id").alias("to_id"), F.lit("supersedes").alias("rel_type"), F.lit(0.8).alias("strength"))
    return new, edges


def mark_contradiction(pairs: DataFrame, strength: float = 0.7) -> DataFrame:
    """K15. Edges both ways between contradicting chunks a, b."""
    edges = pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("contradicts").alias("rel_type"), F.lit(strength).alias("strength"))
    return graph.with_reverse(edges)


def cleanup(metadata: DataFrame, now: Column, days: int = 180, weak: float = 0.1) -> DataFrame:
    """The chunks that a clean-up would remove: old and never read, or archived and weak. A dry run
    shows them; store.cascade_delete removes them."""
    old = store.old_unused(metadata, now, days).select("chunk_id", F.lit("unused").alias("reason"))
    faint = metadata.where(F.col("is_archived") & (F.col("decay_score") < weak)).select("chunk_id", F.lit("weak").alias("reason"))
    return old.unionByName(faint).groupBy("chunk_id").agg(F.max("reason").alias("reason"))


def consolidation_metrics(before: DataFrame, after: DataFrame, edges: DataFrame, access_log: DataFrame, now: Column) -> DataFrame:
    """R18. What consolidate did: chunks with decay, duplicates, hot items promoted, chunks archived."""
    live = before.agg(F.count_if(~F.col("is_archived")).alias("updated"), F.count_if(F.col("is_archived")).alias("was"), F.lit(1).alias("k"))
    late = after.agg(F.count_if(F.col("is_archived")).alias("is"), F.lit(1).alias("k"))
    rest = edges.agg(F.count("*").alias("duplicates"), F.lit(1).alias("k")).join(hot_items(access_log, now).agg(F.count("*").alias("promoted"), F.lit(1).alias("k")), "k")
    return live.join(late, "k").join(rest, "k").select("updated", "duplicates", "promoted", (F.col("is") - F.col("was")).alias("archived"))


def summarize(items: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R18. Weekly: the summaries of all categories anew (A6), and how many there are."""
    found = categories.summaries(items, metadata)
    return found, found.agg(F.count_if(F.col("items") > 0).alias("categories_updated"))


def reindex(metadata: DataFrame, edges: DataFrame, access_log: DataFrame, items: DataFrame, now: Column, days: int = 180) -> tuple[dict[str, DataFrame], DataFrame]:
    """R18. Monthly: old chunks that nobody reads archived, and what hangs on no known chunk removed.
    Returns the tables and one row: edges in all, isolated chunks, chunks archived, rows removed."""
    old = store.old_unused(metadata, now, days).where(~F.col("is_archived")).select("chunk_id")
    known = metadata.select("chunk_id")
    new = {
        "metadata": metadata.join(old.withColumn("_old", F.lit(True)), "chunk_id", "left").withColumn("is_archived", F.col("is_archived") | F.coalesce("_old", F.lit(False))).drop("_old"),
        "edges": edges.join(known.withColumnRenamed("chunk_id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("chunk_id", "to_id"), "to_id", "left_semi"),
        "access_log": access_log.join(known, "chunk_id", "left_semi"),
        "category_items": items.join(known, "chunk_id", "left_semi"),
    }
    one = lambda df, name: df.agg(F.count("*").alias(name), F.lit(1).alias("k"))
    out = one(edges, "relationships").join(one(graph.isolated(edges, metadata), "isolated"), "k").join(one(old, "archived"), "k")
    for name, df in (("edges", edges), ("access_log", access_log), ("category_items", items)):
        out = out.join(one(df, f"{name}_before"), "k").join(one(new[name], f"{name}_after"), "k")
    removed = sum((F.col(f"{n}_before") - F.col(f"{n}_after") for n in ("edges", "access_log", "category_items")), F.lit(0))
    return new, out.select("relationships", "isolated", "archived", removed.alias("orphans"))


def cleanup_metrics(metadata: DataFrame, weak: float = 0.1) -> DataFrame:
    """R18. What a clean-up finds: archived chunks, which it would delete, and weak ones not archived."""
    archived = F.count_if(F.col("is_archived"))
    return metadata.agg(archived.alias("archived"), F.count_if(~F.col("is_archived") & (F.col("decay_score") < weak)).alias("weak"), archived.alias("would_delete"))
