"""Queries of the registry over indexes, iterations and streams."""

from __future__ import annotations

import json
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.catalog import query, r6
from tidemark.catalog_more import _DUPLICATES, _TECH, _rules
from tidemark.functions import text as X
from tidemark.operators import cells, fields, graph, intervals, report, topics
from tidemark.plans import retrieval, tables
from tidemark.scratch import folder, written
from tidemark.sources import chats, files, stores
from tidemark.streaming import access, ingest

# vectors in cells


def _asked(docs: DataFrame) -> DataFrame:
    return docs.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def ann_topk(spark, d):
    """T2. The ten nearest of every chunk whose id is divisible by 50, from the cells that give a recall of 0.9."""
    docs = tables.chunks(spark, d)
    index = cells.built(docs)
    n_probe, recall, read = index.probes_for(_asked(docs), 10, 0.9)
    found = index.search_frame(_asked(docs), 10, n_probe)
    return found.select("query_id", F.col("id").alias("chunk_id"), r6("score"), "rank", F.lit(n_probe).alias("cells_visited"), F.lit(recall).alias("recall"), F.lit(read).alias("rows_read"))


@query("""SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT q.chunk_id AS query_id, c.chunk_id, list_cosine_similarity(c.embedding, q.embedding) AS score,
    row_number() OVER (PARTITION BY q.chunk_id ORDER BY list_cosine_similarity(c.embedding, q.embedding) DESC, c.chunk_id)::INT AS rank
    FROM chunks c, chunks q WHERE q.chunk_id % 50 = 0) WHERE rank <= 10""")
def knn_by_bounds(spark, d):
    """T1, T2, J5. The same, exact: cells that bounds rule out are not read."""
    docs = tables.chunks(spark, d)
    return cells.built(docs).exact_frame(_asked(docs), 10).select("query_id", F.col("id").alias("chunk_id"), r6("score"), "rank")


_SIMILAR = "links AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.embedding, b.embedding) AS s FROM chunks a JOIN chunks b ON a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.38)"


@query(f"+{_SIMILAR} SELECT a, b, round(s, 6) AS similarity FROM links")
def similar_by_cells(spark, d):
    """J6. Pairs of chunks by the join that prunes by angles."""
    return cells.similar_vectors(tables.chunks(spark, d), 0.38).pairs().select("a", "b", r6("similarity"))


@query(f"+{_SIMILAR}, ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), walk(a, b) AS (SELECT chunk_id, chunk_id FROM chunks UNION SELECT walk.a, ways.b FROM walk JOIN ways ON walk.b = ways.a) SELECT a AS chunk_id, min(b) AS component FROM walk GROUP BY 1")
def similar_components(spark, d):
    """J6, G6. The groups that such pairs make, from stars instead of pairs."""
    found = cells.similar_vectors(tables.chunks(spark, d), 0.38, as_links=True)
    return found.components().select(F.col("id").alias("chunk_id"), "component")


# chains


@query("""+newer AS (SELECT to_id AS old, min(from_id) AS new FROM edges WHERE rel_type = 'supersedes' GROUP BY 1),
    chain AS (SELECT old AS chunk_id, [old] AS c, false AS done FROM newer UNION ALL SELECT chunk_id, list_append(c, new), list_contains(c, new) FROM chain JOIN newer ON c[-1] = old WHERE NOT done)
    SELECT chunk_id, arg_max(c[-1], len(c)) AS latest, max(len(c)) - 1 AS depth, bool_or(done) AS cyclic FROM chain GROUP BY 1""")
def latest_versions(spark, d):
    """G5. Where the chain of every superseded chunk ends."""
    return graph.versions(tables.edges(spark, d)).select(F.col("node").alias("chunk_id"), "latest", "depth", "cyclic")


# conversations as a stream


@query("""WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations WHERE role IN ('user', 'assistant')), g AS (SELECT conv_id, x, max(text) FILTER (role = 'user') AS q, string_agg(text, '|' ORDER BY turn) FILTER (role = 'assistant') AS t, count(*) FILTER (role = 'assistant') AS a, max(x) OVER (PARTITION BY conv_id) AS l FROM n WHERE x > 0 GROUP BY conv_id, x)
    SELECT conv_id, x::BIGINT AS exchange, md5(q) AS question, md5(coalesce(t, '')) AS answers, a::INT AS n_answers FROM g WHERE a > 0 OR x < l""", with_tables=False)
def stream_exchanges(spark, d):
    """M1, M2, W3. All turns as a stream of files in three micro-batches, dealt by a hash, so that conversations come in
    pieces and out of order."""
    turns = tables.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    src, out = folder(spark, "turns"), folder(spark, "ingested")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns.repartition(n, F.xxhash64("conv_id", "turn")).write.parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    ingest.ingest(access.read_stream(spark, src, turns.schema, max(1, -(-files // 3))), out, folder(spark, "progress")).awaitTermination()
    return ingest.current(spark, out).select("conv_id", "exchange", F.md5("question").alias("question"), F.md5(F.array_join("answers", "|")).alias("answers"), "n_answers")


# duplicates in time


@query("""WITH RECURSIVE given AS (SELECT event_id AS id, epoch_us(ts) AS t, value AS score FROM events),
    cut AS (SELECT *, sum(g) OVER (ORDER BY t, id) AS island FROM (SELECT *, (t - lag(t, 1, -1000000000) OVER (ORDER BY t, id) >= 60000000)::INT AS g FROM given)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY score DESC, id) AS k FROM cut),
    walk(island, k, kept) AS (SELECT DISTINCT island, 0::BIGINT, []::STRUCT(id BIGINT, t BIGINT)[] FROM ranked
        UNION ALL SELECT r.island, r.k, CASE WHEN len(list_filter(kept, lambda x: abs(x.t - r.t) < 60000000)) > 0 THEN kept ELSE list_append(kept, {'id': r.id, 't': r.t}) END FROM walk JOIN ranked r ON r.island = walk.island AND r.k = walk.k + 1),
    final AS (SELECT island, arg_max(kept, k) AS kept FROM walk GROUP BY 1)
    SELECT id AS event_id, list_filter(kept, lambda x: abs(x.t - r.t) < 60000000)[1].id AS keeper FROM ranked r JOIN final USING (island) WHERE NOT list_contains(list_transform(kept, lambda x: x.id), id)""", with_tables=False)
def time_duplicates(spark, d):
    """J10, R18. Events less than a minute from a better one that stays."""
    items = tables.table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("score"))
    return intervals.dropped_in_time(items, 60).select(F.col("id").alias("event_id"), "keeper")


# clusters by tags, groups by vectors

_CLUSTERS = f"""told AS (SELECT rule_id AS id, tokens, embedding, list_sort(list_distinct({_TECH})) AS tags FROM rules),
    each AS (SELECT id, tokens, embedding, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM told),
    alike AS (SELECT x.tag, avg(list_cosine_similarity(x.embedding, y.embedding)) AS s FROM each x JOIN each y ON x.tag = y.tag AND x.id < y.id WHERE x.embedding IS NOT NULL AND y.embedding IS NOT NULL GROUP BY 1),
    good AS (SELECT tag, s, row_number() OVER (ORDER BY place) AS k FROM (SELECT tag, min((id, i)) AS place, count(*) AS n FROM each GROUP BY 1) JOIN alike USING (tag) WHERE n >= 2 AND s >= 0.001),
    bands AS (SELECT k, tag, any_value(s) AS s, list(id ORDER BY id) AS ids FROM good JOIN each USING (tag) GROUP BY 1, 2),
    walk(k, taken, fresh) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT k, CASE WHEN len(f) >= 2 THEN list_concat(taken, f) ELSE taken END, CASE WHEN len(f) >= 2 THEN f ELSE [] END
        FROM (SELECT b.k, w.taken, list_filter(b.ids, lambda x: NOT list_contains(w.taken, x)) AS f FROM walk w JOIN bands b ON b.k = w.k + 1)),
    members AS (SELECT tag, s, unnest(fresh) AS id FROM walk JOIN bands USING (k))"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d, tags=F.sort_array(X.tech_tags(F.col("content")))).select("rule_id", "tags", "tokens", "embedding")


@query(f"+{_CLUSTERS} SELECT tag, id AS rule_id FROM members")
def rule_cluster_members(spark, d):
    """W8. The cluster that every rule goes to; pairs of a tag are hardly alike here, so the floor is low."""
    return topics.claimed_tags(_tagged(spark, d), 0.001).select("tag", F.col("id").alias("rule_id"))


@query(f"""+{_CLUSTERS} SELECT 'cluster-' || md5(tag)[:8] AS cluster_id, tag, n, round(similarity, 6) AS similarity, tokens, ceil(tokens * 0.6)::BIGINT AS merged, floor((tokens - ceil(tokens * 0.6)) / tokens * 100 + 0.5)::BIGINT AS savings_percent
    FROM (SELECT tag, count(*) AS n, any_value(s) AS similarity, sum(tokens)::BIGINT AS tokens FROM members JOIN told USING (id) GROUP BY 1)""")
def rule_clusters(spark, d):
    """W8, N16, R14."""
    return topics.tag_clusters(_tagged(spark, d), 0.001).select("cluster_id", "tag", "n", r6("similarity"), "tokens", "merged", "savings_percent")


def _kmeans_sql(k: int = 5, rounds: int = topics.MAX_ROUNDS) -> str:
    """A round is a pair of tables; after the last change further rounds repeat it."""
    sql = "WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c1 AS MATERIALIZED (SELECT 0 AS c, v AS m FROM (SELECT v FROM v ORDER BY id LIMIT 1))"
    for i in range(1, k):
        sql += f", c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} UNION ALL SELECT {i}, v FROM (SELECT id, any_value(v) AS v, min(list_distance(v, m)) AS d FROM v, c{i} GROUP BY id ORDER BY d DESC, id LIMIT 1))"
    last = f"c{k}"
    for r in range(rounds):
        sql += f", a{r} AS MATERIALIZED (SELECT id, arg_min(c, (list_distance(v, m), c)) AS c FROM v, {last} GROUP BY id)"
        if r < rounds - 1:
            sql += f", m{r} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM {last} LEFT JOIN (SELECT c, list(x ORDER BY j) AS n FROM (SELECT c, j, avg(x) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{r} JOIN v USING (id)) GROUP BY 1, 2) GROUP BY 1) USING (c))"
            last = f"m{r}"
    return sql + f" SELECT id AS chunk_id, 'topic_' || c AS \"group\" FROM a{rounds - 1}"


@query(_kmeans_sql(), with_tables=False)
def semantic_groups(spark, d):
    """C2, A14. The topic of every chunk."""
    return topics.semantic_groups(tables.chunks(spark, d), 5).select("chunk_id", "group")


# many questions

_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '(?i)\s+(?:and|,)\s+'), lambda p: trim(p)), lambda p: p <> '')"
_MARKED = r"list_transform(list_filter(regexp_split_to_array(text, '\?+'), lambda p: trim(p) <> ''), lambda p: trim(p) || '?')"


def _hop(asked: str, top: int, round_: int) -> str:
    return f"SELECT item_id, chunk_id, score, {round_} * 1000000 + p * 1000 + r AS ord FROM (SELECT item_id, p, c.chunk_id, list_cosine_similarity(c.embedding, q.embedding) AS score, row_number() OVER (PARTITION BY item_id, p ORDER BY list_cosine_similarity(c.embedding, q.embedding) DESC, c.chunk_id) AS r FROM {asked} JOIN chunks q ON q.chunk_id = length(query) % (SELECT count(*) FROM embeddings), chunks c) WHERE r <= {top}"


@query(f"""+parts AS (SELECT item_id, unnest(l) AS query, unnest(range(len(l))) AS p FROM (SELECT item_id, CASE WHEN len({_PARTS}) > 1 AND len(list_filter({_PARTS}, lambda x: NOT contains(x, '?'))) = 0 THEN {_PARTS}
        WHEN length(text) - length(replace(text, '?', '')) > 1 THEN {_MARKED} ELSE [text] END AS l FROM benchmark)),
    hop0 AS MATERIALIZED ({_hop('parts', 2, 0)}),
    further AS (SELECT item_id, unnest(l) AS query, unnest(range(len(l))) AS p FROM (SELECT item_id, list_filter([CASE WHEN contains(lower(text), 'how') THEN 'What are the steps to ' || regexp_replace(text, '(?i)how\\s+', '') END,
        CASE WHEN contains(lower(text), 'why') THEN 'What are the reasons for ' || regexp_replace(text, '(?i)why\\s+', '') END], lambda x: x IS NOT NULL) AS l FROM benchmark WHERE item_id IN (SELECT item_id FROM hop0 GROUP BY 1 HAVING count(*) < 5))),
    hits AS (SELECT * FROM hop0 UNION ALL {_hop('further', 5, 1)}),
    best AS (SELECT item_id, chunk_id, arg_max(score, ord) AS score, min(ord) AS first FROM hits GROUP BY 1, 2)
    SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, first)::INT AS rank FROM best) WHERE rank <= 20""")
def recursive_queries(spark, d):
    """R6, R12. All benchmark items as questions; the vector of a question is that of the chunk its length names."""
    vectors = tables.chunks(spark, d).select(F.col("chunk_id").alias("of"), F.col("embedding").alias("vector"))
    n = tables.n_chunks(spark, d)
    embed = lambda asked: asked.withColumn("of", (F.length("query") % n).cast("long")).join(vectors, "of").drop("of")
    questions = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = retrieval.recursive_queries(tables.chunks(spark, d), questions, embed, k=2)
    return found.select(F.col("question_id").alias("item_id"), "chunk_id", r6("score"), "rank")


# metadata of any shape, lists of rules

_NESTED = "CASE WHEN event_id % 97 = 0 THEN props || '}' ELSE '{\"type\": \"' || event_type || '\", \"props\": ' || props || ', \"seen\": [' || user_id || ', {\"odd\": ' || (event_id % 2 = 1)::VARCHAR || '}, [], null]}' END"


@query(f"""WITH given AS (SELECT event_id, {_NESTED} AS text FROM events)
    SELECT event_id, '$' AS path, 'BROKEN' AS kind, text AS value FROM given WHERE NOT json_valid(text)
    UNION ALL SELECT event_id, fullkey, CASE type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE type END, CASE WHEN type = 'VARCHAR' THEN atom ->> '$' WHEN type = 'ARRAY' THEN '[]' WHEN type = 'NULL' THEN 'null' ELSE atom::VARCHAR END
    FROM (SELECT event_id, text FROM given WHERE json_valid(text)), json_tree(text) t WHERE type NOT IN ('OBJECT', 'ARRAY') OR fullkey = '$.seen[2]'""", with_tables=False)
def metadata_leaves(spark, d):
    """X31. All paths of nested metadata; every 97th text is broken."""
    events = tables.table(spark, d, "events")
    odd = F.when(F.col("event_id") % 2 == 1, "true").otherwise("false")
    nested = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "seen": ['), F.col("user_id").cast("string"), F.lit(', {"odd": '), odd, F.lit("}, [], null]}"))
    given = events.select("event_id", F.when(F.col("event_id") % 97 == 0, F.concat("props", F.lit("}"))).otherwise(nested).alias("text"))
    return fields.leaves(given, "event_id", "text").select(F.col("id").alias("event_id"), "path", "kind", "value")


@query("""SELECT rule_id, CASE WHEN n <= 50 THEN n END AS by_name, CASE WHEN c <= 50 THEN c END AS by_change, CASE WHEN t <= 50 THEN t END AS by_tokens FROM (SELECT rule_id, row_number() OVER (ORDER BY title COLLATE en, rule_id)::INT AS n,
    row_number() OVER (ORDER BY last_modified DESC, rule_id)::INT AS c, row_number() OVER (ORDER BY tokens DESC, rule_id)::INT AS t FROM rules) WHERE least(n, c, t) <= 50""")
def rules_in_order(spark, d):
    """T7. The first fifty rules in each of the three orders, with their ranks in it (beyond fifty: null)."""
    given = _rules(spark, d).select("rule_id", "title", "last_modified", "tokens")
    tops = []
    for by in ("name", "modified", "tokens"):
        top = report.listed(given, by).limit(50)
        tops.append(top.withColumn("rank", F.row_number().over(W.orderBy(*report.order_of(by), "rule_id"))).select("rule_id", F.lit(by).alias("by"), "rank"))
    ranks = tops[0].unionByName(tops[1]).unionByName(tops[2])
    pick = lambda by: F.max(F.when(F.col("by") == by, F.col("rank")))
    return ranks.groupBy("rule_id").agg(pick("name").alias("by_name"), pick("modified").alias("by_change"), pick("tokens").alias("by_tokens"))


@query(f"+{_DUPLICATES} SELECT rank, a, b, match_type FROM (SELECT a, b, match_type, row_number() OVER (ORDER BY round(similarity, 6) DESC, a, b)::INT AS rank FROM duplicates) WHERE rank <= 100")
def duplicates_in_order(spark, d):
    """T9. The hundred surest duplicates, with their ranks."""
    return report.first_pairs(_rules(spark, d, hash=report.facts()["hash"]), 100, 0.4).select("rank", "a", "b", "match_type")


# files written from the tables


def _chat_files(spark: SparkSession, d: str, n: int = 7) -> DataFrame:
    """path and content of chat databases with the turns of all conversations, dealt by id; the last is cut short."""

    def store(frame: pd.DataFrame) -> pd.DataFrame:
        base = sqlite3.connect(":memory:")
        base.execute(f"CREATE TABLE {stores.TABLE} (key TEXT PRIMARY KEY, value BLOB)")
        for conv, turns in frame.sort_values("turn").groupby("conv_id"):
            heads = [{"bubbleId": f"b{t}", "type": 1 if r == "user" else 2} for t, r in zip(turns["turn"], turns["role"], strict=True)]
            base.execute(f"INSERT INTO {stores.TABLE} VALUES (?, ?)", (f"{chats.HEAD}{conv}", json.dumps({"createdAt": 0, "fullConversationHeadersOnly": heads}).encode()))
            for t, r, x in zip(turns["turn"], turns["role"], turns["text"], strict=True):
                base.execute(f"INSERT INTO {stores.TABLE} VALUES (?, ?)", (f"{chats.BUBBLE}{conv}:b{t}", json.dumps({"type": 1 if r == "user" else 2, "text": x}).encode()))
        base.execute(f"INSERT INTO {stores.TABLE} VALUES ('other:1', 'x')")
        base.commit()
        number = int(frame["store"].iloc[0])
        content = base.serialize()
        return pd.DataFrame({"path": [f"state{number}.vscdb"], "content": [content[: len(content) // 2] if number == n - 1 else content]})

    turns = tables.table(spark, d, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", "role", "text", (F.col("conv_id") % n).alias("store"))
    return written(turns.groupBy("store").applyInPandas(store, "path string, content binary"), "stores")


@query("SELECT 'state' || conv_id % 7 || '.vscdb' AS store, conv_id::VARCHAR AS conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, md5(coalesce(text, '')) AS text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 7 <> 6", with_tables=False)
def chat_store_messages(spark, d):
    """S5, S6, S1. The messages of several chat databases in one read, of which one is damaged and counts as empty."""
    kv = written(stores.key_values(_chat_files(spark, d)), "key-values")
    at = kv.select("store", F.regexp_extract("key", f"^{chats.HEAD}(.*)$", 1).alias("conv_id")).where("conv_id <> ''")
    return chats.messages(kv).join(at, "conv_id").select("store", "conv_id", F.col("turn").cast("int").alias("turn"), "role", F.md5("text").alias("text"))


@query("""SELECT vec_id::VARCHAR AS chunk_id, 'src' || label AS source, len(embedding)::INT AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, json_object('source', 'src' || label)::VARCHAR AS metadata FROM embeddings WHERE label % 5 <> 4""", with_tables=False)
def saved_store_documents(spark, d):
    """S1. Chunks read from saved vector stores, one file a label; every fifth is broken off and counts as empty."""
    path = folder(spark, "saved")
    chunks = tables.chunks(spark, d).where("label is not null")
    part = F.struct(F.col("chunk_id").cast("string").alias("id"), F.concat(F.lit("text of "), F.col("source")).alias("content"), "embedding", F.struct("source").alias("metadata"))
    body = F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("chunk_id").cast("string"), F.lit('":'), F.to_json(part))), ",")
    saved = chunks.withColumn("cut", F.floor(F.col("chunk_id") / 4096)).groupBy("label", "cut").agg(F.concat(F.lit("{"), body, F.when(F.col("label") % 5 == 4, "").otherwise("}")).alias("value"))
    saved.select("value").repartition(F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = stores.saved_documents(stores.files_at(spark, path, "part-*"))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4)
    return found.select(F.col("id").alias("chunk_id"), fields.field(fields.parsed(F.col("metadata")), "$.source").alias("source"), F.size("embedding").alias("dimensions"), total.alias("total"), "metadata")


_LINE = "replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ')"


@query(f"SELECT 'lang=' || lang AS folder, md5({_LINE}) AS line FROM documents WHERE lang IS NOT NULL AND lang <> 'de'", with_tables=False)
def rule_files_read(spark, d):
    """S2, S3, S11, P14. Documents written as lines of text files by language, read as rule files, without the folder excluded."""
    path = folder(spark, "tree")
    line = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    tables.table(spark, d, "documents").where("lang is not null").select("lang", line.alias("value")).write.partitionBy("lang").text(path)
    found = files.read_rules(spark, path, ("**/part-*.txt",), ("**/lang=de/**",))
    return found.select(F.regexp_extract("path", "/(lang=[^/]*)/", 1).alias("folder"), F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("line")).select("folder", F.md5("line").alias("line"))
