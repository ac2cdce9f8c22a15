"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memory_stats(metadata: DataFrame) -> DataFrame:
    """A1. Counts of all, active and archived chunks and means over the active, in one pass."""
    live = ~F.col("is_archived")
    mean = lambda c: F.coalesce(F.avg(F.when(live, F.col(c))), F.lit(0.0))
    return metadata.agg(
        F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(F.col("is_archived")).alias("archived"),
        mean("decay_score").alias("avg_decay"), mean("importance").alias("avg_importance"),
    )


def chunks_by_type(metadata: DataFrame) -> DataFrame:
    """A1."""
    return metadata.where(~F.col("is_archived")).groupBy("chunk_type").agg(F.count("*").alias("n"))


def access_stats(log: DataFrame, limit: int = 100) -> DataFrame:
    """A2. Per chunk the number of accesses and the last, most first."""
    return log.groupBy("chunk_id").agg(F.count("*").alias("accesses"), F.max("accessed_at").alias("last_access")).orderBy(F.desc("accesses"), "chunk_id").limit(limit)


def list_sources(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A7, A8 (Q37). Per source the exact number of documents and a preview of the first."""
    source = F.coalesce(F.col("source"), F.lit("unknown")).alias("source")
    return docs.groupBy(source).agg(F.count("*").alias("n"), F.substring(F.min_by("text", id_col), 1, 200).alias("preview"))


def confidence(chunks: DataFrame, iteration_col: str = "iteration") -> DataFrame:
    """A12. How sure the found chunks make: a tenth per chunk over 0.7, at most 0.9, and a tenth per
    round, at most 0.2, together at most 1."""
    strong = F.count_if(F.col("score") > 0.7)
    rounds = F.coalesce(F.max(iteration_col), F.lit(0))
    return chunks.agg(F.least(F.lit(1.0), F.least(strong / 10, F.lit(0.9)) + F.least(rounds * 0.1, F.lit(0.2))).alias("confidence"))


def complexity(chunks: DataFrame, text_col: str = "content", low: int = 50_000, high: int = 200_000) -> DataFrame:
    """A17. Characters of the context and its class."""
    total = F.coalesce(F.sum(F.length(text_col)), F.lit(0))
    return chunks.agg(total.alias("chars"), F.when(total < low, "simple").when(total < high, "moderate").otherwise("complex").alias("complexity"))


def aggregate(df: DataFrame, op: str, field: str | None = None, group: str | None = None) -> DataFrame:
    """A19. count, sum, avg, min, max, distinct or groupBy over a field, with a group if named."""
    if op == "distinct":
        return df.select(F.col(field).alias("value")).distinct()
    if op == "groupBy":
        return df.groupBy(field).agg(F.count("*").alias("value"))
    value = F.count("*") if op == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](field)
    return (df.groupBy(group) if group else df.groupBy()).agg(value.alias("value"))
