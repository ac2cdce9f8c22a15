"""The subpackage's registered queries, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import codes, feistel, fingerprints, jaccard, licenses, mixing, oracles, packing, quality, sharding, substrings, tokens, topk, urls, whitening
from tidemark.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document, trusted rows being those labelled quality 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = quality.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams")
    return found.select(*columns, F.round("score", 3).alias("score"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `rows`: counts at most one apart."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses when words in 35-word windows that start elsewhere are removed."""
    return substrings.dedup_digests(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document, by sentence rules."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("license_sentences", "licenses", "unmatched")])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and what of it fits 4096 tokens."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 3-word shingles at a Jaccard of 0.9."""
    return jaccard.linked_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, share=(90, 100))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the pages: by the checksum of a domain (the last three labels of a host),
    `ads` holds a third of the domains for 30 to 89 days and some again for good, `malware` a fifth
    for good. The pages bring no list of their own; this one is a fixed rule on all their hosts."""
    domain = F.array_join(F.slice(F.split(urls.host_of(F.col("url")), "\\."), -3, 3), ".")
    three = F.size(F.split(urls.host_of(F.col("url")), "\\.")) >= 3
    hosts = pages.where(three).select(domain.alias("host")).distinct().withColumn("c", F.crc32("host"))
    row = lambda cond, name, action, day: F.when(cond, F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day.alias("day")))
    c = F.col("c")
    rows = F.array_compact(F.array(
        row(c % 3 == 0, "ads", "add", c % 300), row(c % 3 == 0, "ads", "remove", c % 300 + 30 + c % 60),
        row(c % 6 == 0, "ads", "add", c % 300 + 100), row(c % 5 == 0, "malware", "add", c % 290),
    ))
    each = hosts.select("host", F.explode(rows).alias("r"))
    return each.select("host", "r.list", "r.action", F.timestamp_seconds(F.lit(1704067200) + F.col("r.day") * 86400).alias("at"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a dated list active for every page when it was fetched; the fetch time is a fixed
    rule on page_id, as pages bring none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 365 * 86400 + F.col("page_id") * 31 % 86400)
    found = urls.filter_urls(pages.withColumn("fetched_at", fetched), dated_entries(pages))
    return found.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), F.array_join("matches", ",").alias("matches"), "blocked")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors projected on the 8 leading eigenvectors of their covariance, to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next one are."""
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 8 parts, 16 entries each, after 6 rounds."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_topk": op3_topk,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_whitening": op11_whitening,
    "op12_fingerprints": op12_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}

_WINDOWS = f"""
    grams5 AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM base)),
    repeats AS (SELECT doc_id, i FROM grams5 QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, (SELECT unnest(range({quality.WINDOW})) AS k) GROUP BY doc_id)"""

OP1_SQL = f"""
WITH {oracles.crc_table()},
    base AS (SELECT doc_id, text, {oracles.words('text')} AS w FROM documents),
    {_WINDOWS},
    features AS (SELECT doc_id, unnest(f) AS f, unnest(range(len(f))) AS i
        FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{quality.FEATURE}') AS f FROM documents)),
    sums AS (SELECT f, {oracles.crc32('f')} AS h FROM (SELECT DISTINCT f FROM features), crc_table),
    hashed AS (SELECT doc_id, i, h FROM features JOIN sums USING (f)),
    grams AS (SELECT doc_id, h % {quality.BUCKETS} AS b FROM hashed
        UNION ALL
        SELECT a.doc_id, (a.h * 1000003 + c.h) % 2147483647 % {quality.BUCKETS} FROM hashed a JOIN hashed c ON a.doc_id = c.doc_id AND c.i = a.i + 1),
    trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
    counts AS (SELECT b, count(*) AS r, count(t.doc_id) AS t FROM grams LEFT JOIN trusted t USING (doc_id) GROUP BY b),
    model AS (SELECT b, floor(1e6 * (ln(t + 1.0) - ln(r + 1.0) + ln(sum(r) OVER () + {quality.BUCKETS}) - ln(sum(t) OVER () + {quality.BUCKETS})) + 0.5)::BIGINT AS v FROM counts),
    scored AS (SELECT doc_id, count(*) AS n_grams, sum(v)::BIGINT AS total FROM grams JOIN model USING (b) GROUP BY doc_id),
    stats AS (SELECT base.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (SELECT len(l) - len(list_distinct(l)) FROM (SELECT list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len({oracles.words('x')}) > 0) AS l))::BIGINT AS n_dup_lines,
            coalesce(c.n, 0)::BIGINT AS n_repeat_words
        FROM base LEFT JOIN covered c USING (doc_id))
SELECT stats.*, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
    NOT base_failed AND (n_grams IS NULL OR total >= {quality.THRESHOLD} * n_grams) AS kept,
    coalesce(n_grams, 0) AS n_grams, round(total / n_grams, 3) AS score
FROM stats LEFT JOIN scored USING (doc_id)
"""

OP2_SQL = f"""
WITH RECURSIVE {oracles.crc_table()},
    base AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {oracles.crc32("coalesce(text, '')")} AS text_crc32,
        {oracles.crc32("coalesce(doc_id::VARCHAR, '')")} AS salt FROM documents, crc_table),
    numbered AS (SELECT *, row_number() OVER (ORDER BY (salt * 48271 + text_crc32) % 2147483647 % {sharding.BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM base),
    {feistel.oracle_cycle('(SELECT count(*) FROM documents)', sharding.KEY)}
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {sharding.N_SHARDS})::INT AS shard, (y // {sharding.N_SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN cycle USING (x)
"""

OP3_SQL = f"""
WITH vectors AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.uid, q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
        FROM vectors q JOIN vectors d ON q.uid <> d.uid WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

OP4_SQL = f"""
WITH base AS (SELECT row_number() OVER () AS uid, doc_id, {oracles.words('text')} AS w FROM documents),
    windows AS (SELECT uid, i, md5(array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ')) AS h FROM (SELECT uid, w, unnest(range(1, len(w) - {substrings.WINDOW - 2})) AS i FROM base)),
    again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
    covered AS (SELECT DISTINCT uid, i + k AS j FROM (SELECT uid, i FROM windows SEMI JOIN again USING (h)), (SELECT unnest(range({substrings.WINDOW})) AS k)),
    words AS (SELECT uid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM base),
    kept AS (SELECT uid, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS s FROM words ANTI JOIN covered USING (uid, j) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM base LEFT JOIN kept USING (uid)
"""

OP10_SQL = f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS uid, doc_id, {oracles.words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    sets AS (SELECT uid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM base),
    items AS (SELECT uid, md5(unnest(s)) AS g FROM sets),
    shared AS (SELECT x.uid AS a, y.uid AS b, count(*) AS c FROM items x JOIN items y ON x.g = y.g AND x.uid < y.uid GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sets x ON x.uid = a JOIN sets y ON y.uid = b WHERE 100 * c >= 90 * (len(x.s) + len(y.s) - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    walk(a, b) AS (SELECT a, a FROM ways UNION SELECT walk.a, ways.b FROM walk JOIN ways ON walk.b = ways.a),
    least AS (SELECT walk.a AS uid, min(doc_id) AS component_id FROM walk JOIN sets ON sets.uid = walk.b GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN least USING (uid)
"""

_HOST = r"nullif(rtrim(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), '(:[0-9]*)?$', ''), '.'), '')"

OP9_SQL = f"""
WITH {oracles.crc_table()},
    given AS (SELECT page_id, {_HOST} AS host, 1704067200 + page_id * 7919 % 365 * 86400 + page_id * 31 % 86400 AS s FROM pages),
    domains AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS d FROM given WHERE len(string_split(host, '.')) >= 3),
    sums AS (SELECT d, {oracles.crc32('d')} AS c FROM domains, crc_table),
    entries AS (
        SELECT d, 'ads' AS list, 'add' AS action, c % 300 AS day FROM sums WHERE c % 3 = 0
        UNION ALL SELECT d, 'ads', 'remove', c % 300 + 30 + c % 60 FROM sums WHERE c % 3 = 0
        UNION ALL SELECT d, 'ads', 'add', c % 300 + 100 FROM sums WHERE c % 6 = 0
        UNION ALL SELECT d, 'malware', 'add', c % 290 FROM sums WHERE c % 5 = 0),
    last_entries AS (SELECT page_id, list, d, arg_max(action, (day, action)) AS action
        FROM given JOIN entries ON (host = d OR ends_with(host, '.' || d)) AND 1704067200 + day * 86400 <= s GROUP BY ALL),
    found AS (SELECT page_id, array_to_string(list_sort(list(list || ':' || d)), ',') AS matches FROM last_entries WHERE action = 'add' GROUP BY page_id)
SELECT page_id, host, s AS fetched_s, coalesce(matches, '') AS matches, matches IS NOT NULL AS blocked FROM given LEFT JOIN found USING (page_id)
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op3_topk": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_license_scan": licenses.oracle(),
    "op9_url_filter": OP9_SQL,
    "op10_ngram_jaccard": OP10_SQL,
    "op13_vector_codes": codes.oracle(),
}
