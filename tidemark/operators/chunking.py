"""Chunkers and grouping strategies."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions import text as X
from tidemark.operators import topics
from tidemark.scratch import written


def estimated_tokens(word: str) -> int:
    """N15's fallback: a quarter of the length, rounded up."""
    return math.ceil(len(word) / 4)


def word_windows(text: str, size: int, overlap_percent: int, mode: str = "default", tokens: Callable[[str], int] = estimated_tokens) -> list[str]:
    """X2 (Q12, Q13). Windows of words whose token counts add up to at most `size`, each beginning
    with the last overlap_percent of the words of the one before. A share that rounds to no word
    means no overlap; in `reference` mode it means all words, so windows grow."""
    words = re.split(r"\s+", text)
    ends = list(itertools.accumulate(map(tokens, words), initial=0))  # tokens before each word
    out, first = [], 0
    for i in range(len(words)):
        if ends[i + 1] - ends[first] > size and i > first:
            out.append(" ".join(words[first:i]))
            share = (i - first) * overlap_percent // 100
            first = i - share if share or mode == "default" else first
    out.append(" ".join(words[first:]))
    return [w for w in out if w.strip()]


#: Characters after which a task hands over the windows that it has.
FLUSH_CHARS = 1 << 20


def windows_of(batches: Iterator[pa.Array], size: int, overlap_percent: int, mode: str = "default") -> Iterator[pa.Array]:
    """X2 over batches of texts, taken one at a time: windows of a batch are handed over piece by piece, so a task holds
    a batch of texts, and windows of about FLUSH_CHARS characters or of one text, however many texts a batch has."""
    for texts in batches:
        held, total = [], 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            held.append(word_windows(text, size, overlap_percent, mode) if text and text.strip() else [])
            total += len(text or "")
            if total >= FLUSH_CHARS or i + 1 == len(texts):
                yield pa.array(held, pa.list_(pa.string()))
                held, total = [], 0


def window_chunks(docs: DataFrame, size: int = 512, overlap_percent: int = 50, mode: str = "default", text_col: str = "text") -> DataFrame:
    """X2 over a table: chunks, an array per document. A stateful fold, so in Python, by batches."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from windows_of(batches, size, overlap_percent, mode)

    return docs.withColumn("chunks", cut(F.coalesce(F.col(text_col), F.lit(""))))


def chunk_documents(docs: DataFrame, size: int = 512, overlap_percent: int = 50, respect_boundaries: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """X3. id, index and content: sections at semantic boundaries, those over the size cut into
    windows of words; the index runs through the document."""
    parts = X.sections(F.coalesce(F.col(text_col), F.lit(""))) if respect_boundaries else F.array(F.col(text_col))
    each = docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("section", "part"))
    fits = F.ceil(F.length("part") / 4) <= size
    small = each.where(fits).select("id", "section", F.array(F.trim("part")).alias("chunks"))
    large = window_chunks(each.where(~fits), size, overlap_percent, text_col="part").select("id", "section", "chunks")
    chunks = small.unionByName(large).select("id", "section", F.posexplode("chunks").alias("part", "content")).where(F.trim("content") != "")
    order = W.partitionBy("id").orderBy("section", "part")
    return chunks.select(F.col("id").alias(id_col), (F.row_number().over(order) - 1).alias("index"), "content")


def uniform_groups(chunks: DataFrame, size: int = 10, order: str = "chunk_id", within: str | None = None) -> DataFrame:
    """C1, W6. Batches of a fixed number of chunks in order, batch_0, batch_1 and so on. `within`
    names a column that batches do not cross; without it the order is one run over all rows, from
    positions by range partition, so no task sorts the whole table."""
    if within:
        place = F.row_number().over(W.partitionBy(within).orderBy(order)) - 1
        return chunks.withColumn("group", F.concat(F.lit("batch_"), F.floor(place / size)))
    return global_positions(chunks, order).withColumn("group", F.concat(F.lit("batch_"), F.floor(F.col("position") / size))).drop("position")


def global_positions(df: DataFrame, order: str) -> DataFrame:
    """Adds position, the place of every row in the whole order of a column of any type, nulls first: ranges of it are dealt
    to tasks and counted, and each is numbered by itself, so no task sorts the whole table."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(spread, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn("position", F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_offset")


def keyword_groups(chunks: DataFrame, keywords: list[str], text_col: str = "content") -> DataFrame:
    """C3, U3. A chunk in the group of every keyword pattern that it matches, in _other if in none,
    in `all` if there are no keywords. Invalid patterns are skipped (Q36)."""
    if not keywords:
        return chunks.withColumn("group", F.lit("all"))
    tests = [F.when(F.col(text_col).rlike(f"(?i){k}"), F.lit(k)) for k in keywords if X.valid_pattern(k)]
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return chunks.withColumn("group", F.explode(F.when(F.size(found) == 0, F.array(F.lit("_other"))).otherwise(found)))


def structural_groups(chunks: DataFrame, source_col: str = "source") -> DataFrame:
    """C4."""
    return chunks.withColumn("group", X.normalised_source(F.col(source_col)))


def type_groups(chunks: DataFrame) -> DataFrame:
    """C5."""
    return chunks.withColumn("group", F.col("chunk_type"))


def importance_groups(chunks: DataFrame, thresholds: tuple[float, ...] = (0.7, 0.4)) -> DataFrame:
    """C6. high, medium, level_i for further thresholds, low."""
    names = ["high", "medium"] + [f"level_{i}" for i in range(2, len(thresholds))]
    level = F.lit("low")
    for name, at in reversed(list(zip(names, thresholds, strict=False))):
        level = F.when(F.col("importance") >= at, name).otherwise(level)
    return chunks.withColumn("group", level)


def traits(chunks: DataFrame) -> DataFrame:
    """The flags that the strategy choice asks for, in one aggregation."""
    return chunks.agg(
        F.count("*").alias("n"), F.bool_or((F.col("chunk_type") == "code") | F.col("content").rlike(r"(?s)```.*```")).alias("code"),
        F.countDistinct(X.normalised_source(F.col("source"))).alias("sources"), F.countDistinct("chunk_type").alias("types"),
        F.bool_or(F.size("embedding") > 0).alias("vectors"),
    )


def choose_strategy(flags: dict[str, object], query: str) -> tuple[str, object]:
    """C7. The grouping for a question over chunks with such traits, and its argument; the first
    rule that fits."""
    q = query.lower()
    asks = lambda p: re.search(p, q) is not None
    n = flags["n"] or 0
    if not n:
        return "uniform", None
    if flags["code"] and flags["sources"] > 1 and asks("code|implement|function|class|method"):
        return "structural", None
    if asks("how many|count|list|all|every|total|compare"):
        return "uniform", max(5, math.ceil(n / 10))
    if asks("error|fix|bug|issue|problem") and flags["types"] > 1:
        return "type", None
    if asks("pattern|example|how to|best practice"):
        return "keyword", ["pattern", "example", "best practice", "recommended"]
    if flags["vectors"] and n > 10:
        return "semantic", None
    return ("structural", None) if flags["sources"] > 1 else ("uniform", None)


def recommend_strategy(flags: dict[str, object], query: str | None = None) -> str:
    """C8. The shorter list of rules."""
    q = (query or "").lower()
    if not flags["n"]:
        return "uniform"
    if q and re.search("how many|count|list|all|every", q):
        return "uniform"
    if q and re.search("error|fix|bug|specific", q):
        return "keyword"
    if flags["sources"] > 1:
        return "structural"
    return "semantic" if flags["vectors"] and flags["n"] > 5 else "uniform"


def recommended(questions: DataFrame, flags: DataFrame) -> DataFrame:
    """C8 for a table of questions, with the one row of `traits`: adds strategy."""
    q = F.lower(F.coalesce("question", F.lit("")))
    first = F.when((F.col("n") == 0) | q.rlike("how many|count|list|all|every"), "uniform").when(q.rlike("error|fix|bug|specific"), "keyword")
    rest = F.when(F.col("sources") > 1, "structural").when(F.col("vectors") & (F.col("n") > 5), "semantic").otherwise("uniform")
    return questions.crossJoin(F.broadcast(flags.select("n", "sources", "vectors"))).withColumn("strategy", F.coalesce(first, rest)).drop("n", "sources", "vectors")


def adaptive_groups(chunks: DataFrame, query: str) -> DataFrame:
    """C7, applied."""
    name, argument = choose_strategy(traits(chunks).first().asDict(), query)
    if name == "structural":
        return structural_groups(chunks)
    if name == "type":
        return type_groups(chunks)
    if name == "keyword":
        return keyword_groups(chunks, argument)
    if name == "semantic":
        return topics.semantic_groups(chunks)
    return uniform_groups(chunks, argument or 10)
