"""Categories (J16-J18, A4-A6, T5, T6, R13, X8): classification, counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as C


def definitions(spark: SparkSession, categories: Sequence[tuple[str, str, list[str]]] = tuple(C.CATEGORIES)) -> DataFrame:
    """The constant table of category, description and tags."""
    return spark.createDataFrame(list(categories), "category string, description string, tags array<string>")


def tag_scores(chunks: DataFrame, defs: DataFrame, tags_col: str = "content_tags") -> DataFrame:
    """J17 (Q22). Per chunk and category the share of the chunk's tags that hold a tag of the
    category or are held by one. The definitions are a fixed small table and are broadcast."""
    paired = chunks.where(F.size(tags_col) > 0).join(F.broadcast(defs), F.lit(True))
    hit = F.filter(tags_col, lambda t: F.exists("tags", lambda c: F.contains(t, c) | F.contains(c, t)))
    return paired.select("chunk_id", "category", (F.size(hit) / F.size(tags_col)).alias("tag_score"))


def keyword_scores(chunks: DataFrame, keywords: Sequence[tuple[str, str, float]] = tuple(C.KEYWORDS), text_col: str = "content", floor: float = C.MIN_RELEVANCE) -> DataFrame:
    """J18. Per chunk and category half the summed weights of its keywords in the text, at most 1,
    where that reaches the floor. The dictionary is looked up within each row: no join."""
    low = F.lower(F.col(text_col))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(c).alias("category"), F.lit(float(w)).alias("w"))) for k, c, w in keywords]))
    each = chunks.select("chunk_id", F.explode(hits).alias("h")).select("chunk_id", "h.category", "h.w")
    return each.groupBy("chunk_id", "category").agg(F.least(F.lit(1.0), F.sum("w") / 2).alias("keyword_score")).where(F.col("keyword_score") >= floor)


def classify(tags: DataFrame, words: DataFrame, floor: float = C.MIN_RELEVANCE, limit: int = C.MAX_CATEGORIES) -> DataFrame:
    """R13, W2. chunk_id, category, relevance, rank: tag scores of at least the floor, raised by 0.3
    of the keyword score (at most 1), or the keyword score alone; the best few of each chunk."""
    both = tags.where(F.col("tag_score") >= floor).join(words, ["chunk_id", "category"], "full")
    value = F.when(F.col("tag_score").isNull(), F.col("keyword_score")).otherwise(F.least(F.lit(1.0), F.col("tag_score") + 0.3 * F.coalesce("keyword_score", F.lit(0.0))))
    scored = both.select("chunk_id", "category", value.alias("relevance"))
    rank = W.partitionBy("chunk_id").orderBy(F.desc("relevance"), "category")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def category_counts(items: DataFrame) -> DataFrame:
    """A4."""
    return items.groupBy("category").agg(F.count("*").alias("chunk_count"))


def items_top(items: DataFrame, limit: int, by: str = "relevance") -> DataFrame:
    """T5, W2. The first items of each category by relevance, or by time of assignment."""
    order = W.partitionBy("category").orderBy(F.desc(by), "chunk_id")
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def category_stats(items: DataFrame, latest: int = 100) -> DataFrame:
    """A5. Per category the number of its latest items and their mean relevance."""
    return items_top(items, latest, "assigned_at").groupBy("category").agg(F.count("*").alias("items"), F.avg("relevance").alias("avg_relevance"))


def summaries(items: DataFrame, metadata: DataFrame, latest: int = 20) -> DataFrame:
    """A6. Per category the latest items' types with counts, most first, and their mean relevance as
    text."""
    recent = items_top(items, latest, "assigned_at").join(metadata.select("chunk_id", "chunk_type"), "chunk_id")
    kinds = recent.groupBy("category", "chunk_type").agg(F.count("*").alias("n"))
    parts = kinds.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "chunk_type", "n"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["chunk_type"], F.lit("(s)"))), ", ")
    means = recent.groupBy("category").agg(F.count("*").alias("items"), F.avg("relevance").alias("mean"))
    return parts.join(means, "category").select("category", "items", text.alias("breakdown"), F.format_number("mean", 2).alias("avg_relevance"))


def select_categories(spark: SparkSession, query: str, categories: DataFrame, limit: int = 3, min_items: int = 1) -> DataFrame:
    """R13 (Q23). Built-in categories with items by how the words of a question fit name (0.3),
    description (0.2) and tags (0.25 each word), at most 1."""
    words = [w for w in query.lower().split() if len(w) > 2]
    known = categories.where(F.col("chunk_count") >= min_items).join(F.broadcast(definitions(spark)), "category")

    def fit(q: Column) -> Column:
        name, about = F.contains("category", q), F.contains(F.lower("description"), q)
        tagged = F.exists("tags", lambda t: F.contains(t, q) | F.contains(q, t))
        return F.when(name, 0.3).otherwise(0.0) + F.when(about, 0.2).otherwise(0.0) + F.when(tagged, 0.25).otherwise(0.0)

    total = sum((fit(F.lit(w)) for w in words), F.lit(0.0))
    scored = known.withColumn("relevance", F.least(F.lit(1.0), total)).where("relevance > 0")
    return scored.select("category", "relevance", "chunk_count").orderBy(F.desc("relevance"), "category").limit(limit)


def listed(defs: DataFrame) -> DataFrame:
    """T6. Categories by name, in code points."""
    return defs.orderBy("category")


def category_summary(defs: DataFrame, counts: DataFrame, summaries: DataFrame, name: str) -> DataFrame:
    """R11. category, description, items and summary of the category of that name, whatever its case;
    no row if there is none, a null summary if none has been made."""
    found = defs.where(F.lower("category") == name.lower()).select("category", "description")
    met = found.join(counts, "category", "left").join(summaries.select("category", F.col("breakdown").alias("summary")), "category", "left")
    return met.select("category", "description", F.coalesce("chunk_count", F.lit(0)).alias("items"), "summary")
