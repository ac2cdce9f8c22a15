"""Tables and their changes (K1-K21, P2-P7): every change is a function from tables to tables, and
the caller writes the result; nothing is changed during a lazy plan (Q6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What an upsert sets where a new row brings nothing (Q1).
METADATA_DEFAULTS = {"source": "unknown", "chunk_type": "documentation", "access_count": 0, "decay_score": 1.0, "is_archived": False, "importance": 0.5}


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """K1. Rows of both by key, the change winning; of several changes to a key the last by `order`."""
    both = existing.withColumns({"_v": F.lit(0), "_o": F.lit(None).cast("long")}).unionByName(changes.withColumns({"_v": F.lit(1), "_o": F.col(order).cast("long") if order else F.monotonically_increasing_id()}), allowMissingColumns=True)
    last = W.partitionBy(*keys).orderBy(F.desc("_v"), F.desc("_o"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_v", "_o")


def merge_metadata(existing: DataFrame, changes: DataFrame, mode: str = "merge", key: str = "chunk_id") -> DataFrame:
    """K6. Partial upsert. `merge`: a null in a change keeps what was there. `reference`: the columns
    with defaults are reset to them where a change says nothing (Q1), the others keep."""
    joined = existing.alias("e").join(changes.alias("c"), key, "full")

    def column(name: str) -> Column:
        new = F.col(f"c.{name}") if name in changes.columns else F.lit(None)
        default = F.lit(METADATA_DEFAULTS.get(name))
        changed = F.col("c._c").isNotNull()
        if mode == "reference" and name in METADATA_DEFAULTS:
            return F.when(changed, F.coalesce(new, default)).otherwise(F.col(f"e.{name}")).alias(name)
        return F.coalesce(new, F.col(f"e.{name}"), F.when(F.col("e._e").isNull(), default)).alias(name)

    joined = existing.withColumn("_e", F.lit(1)).alias("e").join(changes.withColumn("_c", F.lit(1)).alias("c"), key, "full")
    return joined.select(key, *[column(n) for n in existing.columns if n != key])


def delete(df: DataFrame, gone: DataFrame, keys: str | list[str]) -> DataFrame:
    """K2, K14. Rows whose key is not among the gone; unknown keys do no harm."""
    return df.join(gone, keys, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """K5, K10. Chunks and all that hangs on them: metadata, access log, items, edges at either end."""
    out = {name: delete(tables[name], gone.select("chunk_id"), "chunk_id") for name in ("metadata", "access_log", "category_items") if name in tables}
    if "edges" in tables:
        edges = tables["edges"]
        for end in ("from_id", "to_id"):
            edges = delete(edges, gone.select(F.col("chunk_id").alias(end)), end)
        out["edges"] = edges
    return out


def record_access(metadata: DataFrame, events: DataFrame) -> DataFrame:
    """K7. Metadata with counts raised and last access moved on by events (chunk_id, accessed_at)."""
    seen = events.groupBy("chunk_id").agg(F.count("*").alias("_n"), F.max("accessed_at").alias("_t"))
    joined = metadata.join(seen, "chunk_id", "left")
    return joined.withColumns({
        "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "_t"),
    }).drop("_n", "_t")


def archive_below(metadata: DataFrame, threshold: float) -> DataFrame:
    """K9. Chunks under the threshold archived."""
    return metadata.withColumn("is_archived", F.col("is_archived") | (F.col("decay_score") < threshold))


def archival_candidates(metadata: DataFrame, threshold: float) -> DataFrame:
    """P6, K9. Chunks that archiving would newly archive."""
    return metadata.where((F.col("decay_score") < threshold) & ~F.col("is_archived"))


def select_metadata(metadata: DataFrame, include_archived: bool = False, min_decay: float | None = None, chunk_types: list[str] | None = None) -> DataFrame:
    """P2. Chunks that fit all conditions, best decay first."""
    df = metadata if include_archived else metadata.where(~F.col("is_archived"))
    df = df if min_decay is None else df.where(F.col("decay_score") >= min_decay)
    df = df.where(F.col("chunk_type").isin(chunk_types)) if chunk_types else df
    return df.orderBy(F.desc("decay_score"), "chunk_id")


def old_unused(metadata: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """P7. Chunks older than so many days that nobody has read."""
    return metadata.where((F.col("created_at") < now - F.make_dt_interval(days=F.lit(days))) & (F.col("access_count") == 0))


def merge_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """K11. Upsert on both ends and type: the strength is replaced, metadata kept where none comes."""
    keys = ["from_id", "to_id", "rel_type"]
    joined = edges.withColumnsRenamed({"strength": "_s", "metadata": "_m"}).join(changes, keys, "full")
    return joined.select(*keys, F.coalesce("strength", "_s").alias("strength"), F.coalesce("metadata", "_m").alias("metadata"))


def merge_categories(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """K16 (Q4). Upsert of categories: empty texts keep what was there, the count is reset to 0 where
    none is given."""
    joined = categories.withColumn("_e", F.lit(1)).alias("e").join(changes.withColumn("_c", F.lit(1)).alias("c"), "id", "full")
    kept = lambda n: F.coalesce(F.nullif(F.col(f"c.{n}"), F.lit("")), F.col(f"e.{n}")).alias(n)
    count = F.when(F.col("_c").isNotNull(), F.coalesce("c.chunk_count", F.lit(0))).otherwise(F.col("e.chunk_count")).alias("chunk_count")
    return joined.select("id", F.coalesce("c.name", "e.name").alias("name"), kept("description"), kept("parent_id"), kept("summary"), count)


def assign_categories(items: DataFrame, changes: DataFrame) -> DataFrame:
    """K17. Upsert of category items by chunk and category; counts follow by category_counts (A4)."""
    return upsert(items, changes, ["chunk_id", "category"])


def mark_processed(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """K18. Upsert into the ledger of processed conversations."""
    return upsert(ledger, done, ["conversation_id"])


def recent_activity(log: DataFrame, limit: int = 100, *ties: str) -> DataFrame:
    """S13, K21. The newest entries of an append-only log, ties by the columns named."""
    return log.orderBy(F.desc("at"), *ties).limit(limit)


def add_chunks(tables: dict[str, DataFrame], docs: DataFrame) -> dict[str, DataFrame]:
    """K4. Documents (chunk_id, embedding and metadata columns) into the chunks and, as a partial
    upsert, into their metadata."""
    both = {name: [c for c in tables[name].columns if c in docs.columns] for name in ("chunks", "metadata")}
    return tables | {
        "chunks": upsert(tables["chunks"], docs.select(both["chunks"]), ["chunk_id"]),
        "metadata": merge_metadata(tables["metadata"], docs.select(both["metadata"])),
    }


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """K3. Rows of every table by name."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()])


def lookup(df: DataFrame, value: object, key: str = "chunk_id", ignore_case: bool = False) -> DataFrame:
    """P3. The row with a key, or none; the condition reaches the scan."""
    return df.where(F.lower(key) == str(value).lower() if ignore_case else F.col(key) == value)


def reset(df: DataFrame) -> DataFrame:
    """K19. The table without rows, to be written over it."""
    return df.limit(0)


def compact(spark: SparkSession, path: str, out: str, file_bytes: int = 256 << 20) -> int:
    """K20. A Parquet table written anew to `out` in files of about file_bytes each, by the size of
    what is there; returns their number. The caller puts it in the old one's place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    files = max(1, -(-held // file_bytes))
    spark.read.parquet(path).coalesce(files).write.mode("errorifexists").parquet(out)
    return files


def shaped(df: DataFrame, fields: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """P16. The fields of a result that are asked for and exist, and at most so many rows."""
    kept = [f for f in fields or df.columns if f in df.columns]
    return df.select(*kept) if max_rows is None else df.select(*kept).limit(max_rows)
