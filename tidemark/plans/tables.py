"""The model's tables derived from a data folder, in Spark and as DuckDB SQL: embeddings stand for
chunks, events for the access log, and metadata and edges follow fixed rules on the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions import scoring as N

NOW_SECONDS = 1706745600  # 2024-02-01
START_SECONDS = 1704067200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW_SECONDS))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, embedding, source."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("src"), F.col("label")).alias("source"), "label")


def n_chunks(spark: SparkSession, sf_dir: str) -> int:
    """The number of chunks, at least 1, from the files' footers."""
    return max(1, table(spark, sf_dir, "embeddings").count())


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, accessed_at: users' ids modulo the number of chunks."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % n_chunks(spark, sf_dir)).alias("chunk_id"), F.col("ts").cast("timestamp").alias("accessed_at"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of all chunks, with decay as of now()."""
    seen = access_log(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_accessed_at"))
    types = F.array(*[F.lit(t) for t in C.CHUNK_TYPES])
    base = chunks(spark, sf_dir).select(
        "chunk_id", "source", F.element_at(types, (F.col("label") % 8 + 1).cast("int")).alias("chunk_type"),
        F.timestamp_seconds(F.lit(START_SECONDS) - F.col("chunk_id") % 365 * 86400).alias("created_at"), (F.col("chunk_id") % 100 / 100).alias("importance"),
        (F.col("chunk_id") % 11 == 0).alias("is_archived"), (F.col("chunk_id") % 20).alias("conversation_id"),
    )
    joined = base.join(seen, "chunk_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))
    return joined.withColumn("decay_score", N.decay_score(now(), F.col("created_at"), F.col("access_count"), F.col("last_accessed_at"), F.col("importance")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id, rel_type, strength: each chunk to (7 id + 3) modulo their
    number, and every third to the next."""
    n = n_chunks(spark, sf_dir)
    ids = chunks(spark, sf_dir).select(F.col("chunk_id").alias("from_id"))
    kinds = F.array(*[F.lit(k) for k in ("relates_to", "supersedes", "contradicts", "implements", "similar_to")])
    kind = F.element_at(kinds, (F.col("from_id") % 5 + 1).cast("int"))
    far = ids.select("from_id", ((F.col("from_id") * 7 + 3) % n).alias("to_id"), kind.alias("rel_type"), (F.col("from_id") % 10 / 10 + 0.1).alias("strength"))
    near = ids.where((F.col("from_id") % 3 == 0) & (F.col("from_id") < n - 1)).select("from_id", (F.col("from_id") + 1).alias("to_id"), F.lit("leads_to").alias("rel_type"), F.lit(0.6).alias("strength"))
    return far.unionByName(near).where("from_id <> to_id")


def category_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, category, relevance, assigned_at."""
    names = F.array(*[F.lit(c[0]) for c in C.CATEGORIES])
    return chunks(spark, sf_dir).select(
        "chunk_id", F.element_at(names, (F.col("label") % 10 + 1).cast("int")).alias("category"), (F.col("chunk_id") * 37 % 101 / 101).alias("relevance"),
        F.timestamp_seconds(F.lit(START_SECONDS) + F.col("chunk_id") * 7919 % 10007 * 60).alias("assigned_at"),
    )


# What a rule document says under its scope, by its id.
PHRASES = [
    "Always use typescript with strict types for api code.",
    "Never use any in typescript api code; prefer unknown over any.",
    "You must write tests for every api endpoint. See `testing.mdc` for more.",
    "You must not write tests for every api endpoint without fixtures.",
    "Prefer tabs over spaces in python app. Read @style.mdc and [more](docs/more.md)",
    "Prefer spaces over tabs in python app. Legacy code from 2019 is deprecated.",
    "Using react 16 with docker for web project, because it is fast",
    "Error: connection refused\nUse `retry` and\n```python\nretry(1)\n```\n#network",
]


def rules(spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """rule_id, source, title, content, tokens, last_modified and embedding (where a chunk has the id):
    each document as a rule, with a header and a scope. What is derived from these columns but the embedding comes before the
    vectors are joined, so texts that are not asked for otherwise are not shuffled."""
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Rule "), F.col("doc_id").cast("string"), F.lit(" for "), F.coalesce("lang", F.lit("all")))
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 8 + 1).cast("int"))
    content = F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n## Scope\n\n"), phrase)
    given = docs.select(F.col("doc_id").alias("rule_id"), "source", title.alias("title"), content.alias("content"), F.timestamp_seconds(F.lit(NOW_SECONDS) - (F.col("doc_id") % 800 * 86400 + 43200)).alias("last_modified"))
    vectors = chunks(spark, sf_dir).select(F.col("chunk_id").alias("rule_id"), "embedding")
    return given.withColumn("tokens", N.token_estimate(F.col("content"))).withColumns(derived).join(vectors, "rule_id", "left")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 1) -> list[float]:
    """The vector of one chunk, as a search is given it."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


_TYPES = ", ".join(f"'{t}'" for t in C.CHUNK_TYPES)
_CATEGORIES = ", ".join(f"'{c[0]}'" for c in C.CATEGORIES)
_PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)
_N = NOW_SECONDS * 1_000_000
_AGE = f"(({_N} - epoch_us(created_at)) / 86400000000.0)"
_SINCE = f"(({_N} - epoch_us(last_accessed_at)) / 86400000000.0)"
_ACCESS = f"CASE WHEN last_accessed_at IS NOT NULL AND {_SINCE} <= 7 THEN least(1.0, least(1.0, access_count / 5) * (1 + 0.5 * (1 - {_SINCE} / 7))) ELSE least(1.0, access_count / 5) END"

#: CTEs of the same tables for DuckDB; `WITH RECURSIVE` goes before them.
SQL = f"""chunks AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, 'src' || label AS source, label FROM embeddings),
access_log AS (SELECT user_id % (SELECT count(*) FROM embeddings) AS chunk_id, ts::TIMESTAMP AS accessed_at FROM events),
seen AS (SELECT chunk_id, count(*) AS access_count, max(accessed_at) AS last_accessed_at FROM access_log GROUP BY 1),
base_meta AS (SELECT chunk_id, source, ([{_TYPES}])[label % 8 + 1] AS chunk_type, make_timestamp(({START_SECONDS} - chunk_id % 365 * 86400) * 1000000) AS created_at,
    (chunk_id % 100) / 100 AS importance, chunk_id % 11 = 0 AS is_archived, chunk_id % 20 AS conversation_id, coalesce(s.access_count, 0) AS access_count, s.last_accessed_at
    FROM chunks LEFT JOIN seen s USING (chunk_id)),
meta AS (SELECT *, greatest(0.0, least(1.0, 0.3 / (1 + {_AGE} / 60) + 0.3 * ({_ACCESS}) + 0.4 * importance)) AS decay_score FROM base_meta),
edges AS (SELECT * FROM (
    SELECT chunk_id AS from_id, (chunk_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS to_id, (['relates_to', 'supersedes', 'contradicts', 'implements', 'similar_to'])[chunk_id % 5 + 1] AS rel_type, (chunk_id % 10) / 10 + 0.1 AS strength FROM chunks
    UNION ALL SELECT chunk_id, chunk_id + 1, 'leads_to', 0.6 FROM chunks WHERE chunk_id % 3 = 0 AND chunk_id < (SELECT count(*) FROM embeddings) - 1) WHERE from_id <> to_id),
sym AS (SELECT from_id AS src, to_id AS dst, rel_type, strength, from_id, to_id FROM edges UNION ALL SELECT to_id, from_id, rel_type, strength, from_id, to_id FROM edges),
items AS (SELECT chunk_id, ([{_CATEGORIES}])[label % 10 + 1] AS category, (chunk_id * 37 % 101) / 101 AS relevance, make_timestamp(({START_SECONDS} + chunk_id * 7919 % 10007 * 60) * 1000000) AS assigned_at FROM chunks),
rules AS (SELECT *, ceil(length(content) / 4)::BIGINT AS tokens FROM (SELECT d.doc_id AS rule_id, d.source, 'Rule ' || d.doc_id || ' for ' || coalesce(d.lang, 'all') AS title,
    '# Rule ' || d.doc_id || ' for ' || coalesce(d.lang, 'all') || chr(10) || chr(10) || coalesce(d.text, '') || chr(10) || chr(10) || '## Scope' || chr(10) || chr(10) || ([{_PHRASES}])[d.doc_id % 8 + 1] AS content,
    make_timestamp(({NOW_SECONDS} - (d.doc_id % 800 * 86400 + 43200)) * 1000000) AS last_modified, c.embedding FROM documents d LEFT JOIN chunks c ON c.chunk_id = d.doc_id))"""
