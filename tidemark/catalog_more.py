"""Further queries of the registry: rules, text, knowledge, table changes, retrieval plans and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import _BOOST, _COS, _FINAL3, _HASH, _KNN, _final6, _scored, query, r6
from tidemark.functions import answers as A
from tidemark.functions import constants as C
from tidemark.functions import scoring as N
from tidemark.functions import text as X
from tidemark.functions import vector as V
from tidemark.operators import categories, chunking, conversations, graph, knowledge, maintenance, report, rules, store
from tidemark.plans import retrieval, tables
from tidemark.plans.tables import NOW_SECONDS
from tidemark.scratch import written
from tidemark.sources import chats


def _q(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


def _any(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def _joined(lists: list[str]) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


def _rules(spark: SparkSession, d: str, **derived: Column) -> DataFrame:
    return tables.rules(spark, d, **derived)


NL = "chr(10)"

# texts of rules


@query("""+lines AS (SELECT rule_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT rule_id, string_split(content, chr(10)) AS l FROM rules)),
    n AS (SELECT *, sum(regexp_matches(line, '^#{1,2}\\s+')::INT) OVER (PARTITION BY rule_id ORDER BY i) AS section FROM lines)
    SELECT rule_id, section::BIGINT AS section, trim(regexp_replace(arg_min(line, i), '^#{1,2}\\s+', '')) AS title, (min(i) + 1)::INT AS first_line, (max(i) + 1)::INT AS last_line FROM n WHERE section > 0 GROUP BY 1, 2""")
def rule_sections(spark, d):
    """W7, X16."""
    return rules.rule_sections(_rules(spark, d).select("rule_id", "content"))


_PARTS = r"""{0}_parts AS (SELECT id, unnest(p) AS p, unnest(range(len(p))) AS i FROM (SELECT id, regexp_split_to_array(t, '\n\n+') AS p FROM {0})),
    {0}_cut AS (SELECT id, i, CASE WHEN len(regexp_extract_all(p, '(?m)^#{{1,6}}\s+')) > 1 THEN string_split(regexp_replace(p, '(?m)^(#{{1,6}}\s+)', chr(1) || '\1', 'g'), chr(1)) ELSE [p] END AS c FROM {0}_parts),
    {0}_pieces AS (SELECT id, i, k, s FROM (SELECT id, i, unnest(c) AS s, unnest(range(len(c))) AS k FROM {0}_cut) WHERE trim(regexp_replace(s, '\s', ' ', 'g')) <> '')"""


@query(f"+t AS (SELECT rule_id AS id, content AS t FROM rules), {_PARTS.format('t')} SELECT id AS rule_id, md5(string_agg(s, chr(1) ORDER BY i, k)) AS sections, count(*) AS n FROM t_pieces GROUP BY 1")
def text_sections(spark, d):
    """X1."""
    cut = X.sections(F.col("content"))
    return _rules(spark, d).select("rule_id", F.md5(F.array_join(cut, "\x01")).alias("sections"), F.size(cut).cast("long").alias("n"))


# windows of words by tokens: w holds id, words and the tokens of the first 1, 2, ... words
_WINDOWS = r"""{0}_words AS (SELECT id, w, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[1:i], lambda x: ceil(length(x) / 4)))) AS p FROM (SELECT id, regexp_split_to_array(t, '[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+') AS w FROM {0})),
    {0}_windows AS (SELECT id, 0 AS f, greatest(0, len(list_filter(p, lambda x: x <= {1})) - 1) AS e, len(w) AS n FROM {0}_words
        UNION ALL SELECT x.id, x.f, greatest(x.m, len(list_filter(y.p, lambda z: z <= {1} + CASE WHEN x.f = 0 THEN 0 ELSE y.p[x.f] END)) - 1), n
        FROM (SELECT id, e + 1 - (e - f + 1) * {2} // 100 AS f, e + 1 AS m, n FROM {0}_windows WHERE e + 1 < n) x JOIN {0}_words y USING (id)),
    {0}_chunks AS (SELECT id, e, array_to_string(w[f + 1:e + 1], ' ') AS content FROM {0}_windows JOIN {0}_words USING (id))"""


@query(f"+t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {_WINDOWS.format('t', 256, 25)} SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY e) - 1)::INT AS index, md5(content) AS h FROM t_chunks WHERE trim(content) <> ''")
def word_windows(spark, d):
    """X2."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.window_chunks(docs, 256, 25).select("doc_id", F.posexplode("chunks").alias("index", "c")).select("doc_id", "index", F.md5("c").alias("h"))


@query(f"""+t AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL), {_PARTS.format('t')},
    small AS (SELECT id, i, k, 0 AS e, trim(s) AS content FROM t_pieces WHERE ceil(length(s) / 4) <= 256),
    u AS (SELECT (id, i, k) AS id, s AS t FROM t_pieces WHERE ceil(length(s) / 4) > 256), {_WINDOWS.format('u', 256, 25)},
    every AS (SELECT * FROM small UNION ALL SELECT id[1], id[2], id[3], e, content FROM u_chunks)
    SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY i, k, e) - 1)::INT AS index, md5(content) AS h FROM every WHERE trim(content) <> ''""")
def window_chunks(spark, d):
    """X3."""
    found = chunking.chunk_documents(tables.table(spark, d, "documents"), 256, 25)
    return found.select("doc_id", "index", F.md5("content").alias("h"))


@query(r"SELECT rule_id, len(regexp_extract_all(content, '(?s)```(\w*)\n(.*?)```', 1))::INT AS n, array_to_string(regexp_extract_all(content, '(?s)```(\w*)\n(.*?)```', 1), ',') AS languages, md5(array_to_string(regexp_extract_all(content, '(?s)```(\w*)\n(.*?)```', 2), ',')) AS code FROM rules")
def code_blocks(spark, d):
    """S10."""
    blocks = conversations.code_blocks(F.col("content"))
    part = lambda name: F.array_join(F.transform(blocks, lambda b: b[name]), ",")
    return _rules(spark, d).select("rule_id", F.size(blocks).alias("n"), part("language").alias("languages"), F.md5(part("code")).alias("code"))


_TAGS = ", ".join(f"CASE WHEN regexp_matches(lower({{0}}), {_q(p)}) THEN '{name}' END" for name, p in C.TURN_TAGS.items())


@query(f"SELECT rule_id, array_to_string(list_filter([{_TAGS.format('content')}], lambda x: x IS NOT NULL), ',') AS tags FROM rules")
def turn_tags(spark, d):
    """X9."""
    return _rules(spark, d).select("rule_id", F.array_join(X.named_tags(F.col("content")), ",").alias("tags"))


_ENTITY_LIST = ", ".join(f"CASE WHEN regexp_matches(lower(content), {_q(p)}) THEN '{kind}:{value}' END" for p, kind, value in C.ENTITY_PATTERNS)


@query(f"SELECT rule_id, array_to_string(list_filter([{_ENTITY_LIST}], lambda x: x IS NOT NULL), ',') AS entities FROM rules")
def entities(spark, d):
    """X12."""
    found = F.transform(X.entities(F.col("content")), lambda e: F.concat(e["type"], F.lit(":"), e["value"]))
    return _rules(spark, d, entities=F.array_join(found, ",")).select("rule_id", "entities")


_REASON = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({{0}}, '(?i){lead}\\s+(.+?)(?:\\.|$)', 1)), '')" for lead in ("because", "the reason is", "this is because")) + ", {0}[1:200])"
_PATTERN_NAME = r"""CASE WHEN len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: length(w) > 3 AND NOT regexp_matches(w, '(?i)^(how|what|can|the|this|that)$'))) > 0
    THEN array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: length(w) > 3 AND NOT regexp_matches(w, '(?i)^(how|what|can|the|this|that)$'))[1:3], lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' Pattern' ELSE 'Code Pattern' END"""


@query(rf"""SELECT rule_id, regexp_matches(lower(content), {_q(C.ERROR_QUESTION)}) AS is_error, regexp_matches(lower(content), {_q(C.DECISION_QUESTION)}) AS is_decision,
    nullif(regexp_extract(content, '(?i)(?:error|exception):\s*(.+?)(?:\n|$)', 1), '') AS error, md5({_REASON.format('content')}) AS reasoning, {_PATTERN_NAME.format('title')} AS pattern FROM rules""")
def question_kinds(spark, d):
    """X10, X11."""
    c = F.col("content")
    return _rules(spark, d).select(
        "rule_id", X.is_error_question(c).alias("is_error"), X.is_decision_question(c).alias("is_decision"), X.error_message(c).alias("error"),
        F.md5(X.reasoning(c)).alias("reasoning"), X.pattern_name(F.col("title")).alias("pattern"),
    )


@query(r"SELECT rule_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:50] AS slug, coalesce(nullif(trim(regexp_extract(content, '(?m)^#\s+(.+)$', 1)), ''), source) AS title FROM rules")
def rule_titles(spark, d):
    """X16."""
    return _rules(spark, d).select("rule_id", X.slug(F.col("title")).alias("slug"), X.title_of(F.col("content"), F.col("source")).alias("title"))


_DEPENDS = _joined([f"regexp_extract_all(content, {_q(p)}, 1)" for p in (r"@([\w./-]+\.(?:mdc|md))", r"\[[^\]]*\]\(([^)]+\.(?:mdc|md))\)", r"(?i)see\s+`?([\w./-]+\.(?:mdc|md))`?", r"(?i)extends:\s*([\w./-]+)")])
_CODE = _joined([f"regexp_extract_all(content, {_q(p)}, 1)" for p in (r"```(\w+)", r"`([^`]+)`")])


@query(f"SELECT rule_id, array_to_string(list_sort(list_distinct({_DEPENDS})), ',') AS depends_on, array_to_string(list_sort(list_distinct({_CODE})), ',') AS code FROM rules")
def rule_references(spark, d):
    """X18, X21."""
    listed = lambda c: F.array_join(F.sort_array(c), ",")
    return _rules(spark, d).select("rule_id", listed(X.dependencies(F.col("content"))).alias("depends_on"), listed(X.code_references(F.col("content"))).alias("code"))


_DIRECTIVES = f"list_transform({_joined([f'regexp_extract_all(content, {_q(p)})' for p in C.DIRECTIVES])}, lambda x: trim(x))"


@query(f"SELECT rule_id, len({_DIRECTIVES})::INT AS n, md5(array_to_string({_DIRECTIVES}, '|')) AS directives FROM rules")
def rule_directives(spark, d):
    """X23."""
    found = X.directives(F.col("content"))
    return _rules(spark, d).select("rule_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("directives"))


_PREFER = f"""prefer AS (SELECT rule_id, lower(t) AS topic, arg_max(lower(w), i) AS wanted FROM (SELECT rule_id, unnest(t) AS t, unnest(w) AS w, unnest(range(len(t))) AS i
    FROM (SELECT rule_id, regexp_extract_all(content, {_q(C.PREFERENCE)}, 2) AS t, regexp_extract_all(content, {_q(C.PREFERENCE)}, 1) AS w FROM rules)) GROUP BY 1, 2)"""


@query(f"+{_PREFER} SELECT * FROM prefer")
def rule_preferences(spark, d):
    """X23."""
    return _rules(spark, d).select("rule_id", F.explode(X.preferences(F.col("content"))).alias("topic", "wanted"))


_STOPS = "[" + ", ".join(_q(w) for w in A.STOP_WORDS) + "]"
_KEYWORDS = _joined([r"regexp_extract_all(content, '```(\w+)', 1)"] + [f"regexp_extract_all(content, {_q('(?i)' + p)}, 1)" for p in A.KEYWORD_PLACES] + [r"regexp_extract_all(content, '#(\w{2,})', 1)"])


@query(f"SELECT rule_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_KEYWORDS}, lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({_STOPS}, w)))), ',') AS keywords FROM rules")
def content_keywords(spark, d):
    """X17."""
    return _rules(spark, d).select("rule_id", F.array_join(F.sort_array(A.content_keywords(F.col("content"))), ",").alias("keywords"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS h FROM pages", with_tables=False)
def escaped_pages(spark, d):
    """X32."""
    return tables.table(spark, d, "pages").select("page_id", F.md5(X.escaped_html(F.col("html"))).alias("h"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_object('k', json_extract_string(props, '$.k'))::VARCHAR AS again FROM events", with_tables=False)
def metadata_json(spark, d):
    """X31. Metadata read from JSON and written again."""
    events = tables.table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("m"))
    return events.select("event_id", "m.k", F.to_json("m").alias("again"))


# reports on rules

_TECH = _joined([f"regexp_extract_all(lower(content), {_q(p)})" for p in C.TECH_PATTERNS])
_LONG_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\W+'), lambda w: length(w) > 3)"
_CONFLICTS = f"""{_PREFER},
    told AS (SELECT r.rule_id, list_sort(list_distinct({_TECH})) AS tags, list_sort({_DIRECTIVES}) AS d, coalesce(p, []) AS p
        FROM rules r LEFT JOIN (SELECT rule_id, list(topic || '=' || wanted ORDER BY topic) AS p FROM prefer GROUP BY 1) USING (rule_id)),
    class AS (SELECT tags, d, p, min(rule_id) AS id FROM told GROUP BY 1, 2, 3 HAVING len(tags) > 0 AND (len(d) > 0 OR len(p) > 0)),
    near AS (SELECT x.id AS a, y.id AS b FROM class x JOIN class y ON x.id < y.id WHERE len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags))) >= 0.3),
    against AS (SELECT a, b, count(*) AS n FROM (SELECT a, b, lower(dx) AS x, lower(dy) AS y FROM near JOIN (SELECT id AS a, unnest(d) AS dx FROM class) USING (a) JOIN (SELECT id AS b, unnest(d) AS dy FROM class) USING (b))
        WHERE ((contains(x, 'always') AND contains(y, 'never')) OR (contains(x, 'never') AND contains(y, 'always')) OR (contains(x, 'must ') AND contains(y, 'must not')) OR (contains(x, 'must not') AND contains(y, 'must ')))
        AND len(list_distinct(list_intersect({_LONG_WORDS.format('x')}, {_LONG_WORDS.format('y')}))) > 2 GROUP BY 1, 2),
    differ AS (SELECT a, b, count(*) AS n FROM near JOIN prefer u ON u.rule_id = a JOIN prefer v ON v.rule_id = b AND u.topic = v.topic AND u.wanted <> v.wanted GROUP BY 1, 2),
    conflicts AS (SELECT a, b, coalesce(g.n, 0)::INT AS contradictions, coalesce(h.n, 0)::INT AS preference_conflicts, CASE WHEN g.n > 0 THEN 'direct_contradiction' ELSE 'preference_conflict' END AS conflict_type
        FROM near LEFT JOIN against g USING (a, b) LEFT JOIN differ h USING (a, b) WHERE g.n > 0 OR h.n > 0)"""


def _conflicts(given: DataFrame, counted: bool = False) -> DataFrame:
    return rules.class_conflicts(rules.classes(given), counted=counted)


def _sayings() -> dict[str, Column]:
    """What conflicts read of a rule, to be found before vectors are joined."""
    return {"tags": X.tech_tags(F.col("content"))} | rules.sayings()


@query(f"+{_CONFLICTS} SELECT * FROM conflicts")
def rules_conflicts(spark, d):
    """J7-J9 over all rules: conflicts between the first of each class of rules that say the same."""
    return _conflicts(_rules(spark, d, **_sayings()))


_WORD_SET = r"list_distinct(regexp_split_to_array(lower({0}), '[\s\x0B]+'))"
_SHARED = f"len(list_intersect({_WORD_SET.format('ca')}, {_WORD_SET.format('cb')}))"
_DUPLICATES = f"""hashed AS (SELECT rule_id, content, embedding, {_HASH.replace('text', 'content')} AS hash FROM rules),
    firsts AS (SELECT hash, min(rule_id) AS a FROM hashed GROUP BY 1),
    close AS (SELECT x.rule_id AS a, y.rule_id AS b, list_cosine_similarity(x.embedding, y.embedding) AS s, x.content AS ca, y.content AS cb
        FROM hashed x JOIN hashed y ON x.rule_id < y.rule_id WHERE x.rule_id IN (SELECT a FROM firsts) AND y.rule_id IN (SELECT a FROM firsts) AND x.embedding IS NOT NULL AND y.embedding IS NOT NULL AND list_cosine_similarity(x.embedding, y.embedding) >= 0.4),
    matched AS (SELECT a, rule_id AS b, 1.0::DOUBLE AS similarity, 'exact' AS match_type FROM hashed JOIN firsts USING (hash) WHERE a <> rule_id
        UNION ALL SELECT a, b, s, CASE WHEN s > 0.95 THEN 'near_exact' WHEN {_SHARED} / len({_WORD_SET.format('ca')}) > 0.9 OR {_SHARED} / len({_WORD_SET.format('cb')}) > 0.9 THEN 'subset' ELSE 'semantic' END FROM close),
    duplicates AS (SELECT *, CASE WHEN match_type IN ('exact', 'near_exact') THEN 'keep_newer' WHEN match_type = 'subset' THEN 'keep_specific' ELSE 'merge' END AS recommendation FROM matched)"""


@query(f"+{_DUPLICATES} SELECT a, b, round(similarity, 6) AS similarity, match_type, recommendation FROM duplicates")
def rule_duplicates(spark, d):
    """J6, X20, X22, T9."""
    return report.duplicate_pairs(_rules(spark, d, **report.facts()), 0.4).select("a", "b", r6("similarity"), "match_type", "recommendation")


_MERGES = f"""{_DUPLICATES},
    merges AS (SELECT a, b, similarity AS confidence, x.tokens + y.tokens AS before, ceil(length('## ' || x.title || {NL} || {NL} || x.content || {NL} || {NL} || '---' || {NL} || {NL} || '## ' || y.title || {NL} || {NL} || y.content) / 4)::BIGINT AS after
        FROM duplicates JOIN rules x ON x.rule_id = a JOIN rules y ON y.rule_id = b WHERE recommendation = 'merge' AND similarity >= 0.45)"""


@query(f"+{_MERGES} SELECT a, b, round(confidence, 6) AS confidence, before, after FROM merges")
def rule_merges(spark, d):
    """R14, X33, T9."""
    return report.merges(report.sized_pairs(_rules(spark, d, **report.facts()), 0.4), 0.45).select("a", "b", r6("confidence"), "before", "after")


_OUTDATED = r"""outdated AS (SELECT rule_id FROM rules WHERE rule_id % 800 + 0.5 > 365 OR len(list_filter(regexp_extract_all(content, '\b(20[0-2][0-9])\b', 1), lambda y: 2024 - y::INT >= 2)) > 0
    OR (regexp_matches(content, '(?i)\b(deprecated|legacy|obsolete)\b') AND NOT regexp_matches(content, '(?i)\b(migrat|upgrad|replac)\b')))"""
_PLAN = """plan AS (SELECT 1 AS stage, 'delete' AS type, -CASE WHEN x.last_modified < y.last_modified THEN x.tokens ELSE y.tokens END AS impact, true AS auto FROM duplicates JOIN rules x ON x.rule_id = a JOIN rules y ON y.rule_id = b WHERE match_type = 'exact'
    UNION ALL SELECT 2, 'merge', after - before, confidence > 0.9 FROM merges WHERE confidence > 0.8 UNION ALL SELECT 3, 'review', 0, false FROM conflicts UNION ALL SELECT 4, 'update', 0, false FROM outdated)"""


#: The same with every rule for itself: all pairs of rules in conflict.
_ALL_CONFLICTS = _CONFLICTS.replace("min(rule_id) AS id FROM told GROUP BY 1, 2, 3 HAVING", "rule_id AS id FROM told WHERE")


def _findings(spark: SparkSession, d: str, counted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Duplicates, merges, conflicts and outdated rules, found once and written, as plan and report read them several times. Texts are
    searched before vectors are joined, and not shuffled."""
    pairs = report.sized_pairs(_rules(spark, d, **report.facts()), 0.4)
    conflicts = written(_conflicts(_rules(spark, d, **_sayings()), counted), "conflicts")
    old = _rules(spark, d, signs=rules.signs_of_age(tables.now())).where(F.size("signs") > 0)
    return pairs, report.merges(pairs, 0.45), conflicts, written(old.select("rule_id"), "outdated")


@query(f"+{_MERGES}, {_ALL_CONFLICTS}, {_OUTDATED}, {_PLAN} SELECT stage, type, auto, count(*) AS n, sum(impact)::BIGINT AS token_impact FROM plan GROUP BY 1, 2, 3")
def rules_plan(spark, d):
    """R14. The plan's actions by stage: all pairs of rules in conflict are reviewed, counted by classes of rules that say the same."""
    return report.plan(*_findings(spark, d, counted=True), _rules(spark, d)).groupBy("stage", "type", "auto").agg(F.sum("n").alias("n"), F.sum("token_impact").alias("token_impact"))


@query(f"""+{_MERGES}, {_CONFLICTS}, {_OUTDATED}, {_PLAN},
    saved AS (SELECT greatest(0, (SELECT coalesce(sum(before - after), 0) FROM merges) + (SELECT coalesce(sum(least(x.tokens, y.tokens)), 0) FROM duplicates JOIN rules x ON x.rule_id = a JOIN rules y ON y.rule_id = b WHERE recommendation LIKE 'keep%'))::BIGINT AS s),
    base AS (SELECT count(DISTINCT source) AS files, count(*) AS n, sum(tokens)::BIGINT AS t FROM rules),
    found AS (SELECT (SELECT count(*) FROM duplicates) AS duplicates, (SELECT count(*) FROM merges) AS merges, (SELECT count(*) FROM conflicts) AS conflicts, (SELECT count(*) FROM outdated) AS outdated, (SELECT count(*) FROM plan) AS actions)
    SELECT files, n AS rules, t AS tokens_before, t - s AS tokens_after, floor(s / t * 100 + 0.5)::BIGINT AS savings_percent, duplicates, merges, conflicts, outdated, actions, ceil(actions * 0.5)::BIGINT AS minutes,
    CASE WHEN conflicts > 0 THEN 'high' WHEN duplicates > 5 THEN 'medium' ELSE 'low' END AS risk FROM base, saved, found""")
def rules_report(spark, d):
    """R14, A9, A10."""
    return report.report(_rules(spark, d), *_findings(spark, d))


@query("SELECT rank, rule_id, tokens FROM (SELECT row_number() OVER (ORDER BY tokens DESC, rule_id)::INT AS rank, rule_id, tokens FROM rules) WHERE rank <= 20")
def rules_listed(spark, d):
    """T7. The twenty largest rules."""
    return report.listed(_rules(spark, d), "tokens").limit(20).select(F.expr("row_number() over (order by tokens desc, rule_id)").alias("rank"), "rule_id", "tokens")


@query("SELECT rule_id, tokens AS tokens_before, tokens * (rule_id % 10 + 5) // 14 AS tokens_after FROM rules WHERE tokens >= 100 AND tokens * (rule_id % 10 + 5) // 14 < 0.9 * tokens")
def rewrites_accepted(spark, d):
    """P13. Rewrites of long rules, here by a fixed rule on the id."""
    long = report.rewrite_candidates(_rules(spark, d), 100)
    return report.accepted_rewrites(long.select("rule_id", F.col("tokens").alias("tokens_before"), F.expr("tokens * (rule_id % 10 + 5) div 14").alias("tokens_after")))


@query(f"""+{_DUPLICATES}, ordered AS (SELECT row_number() OVER (ORDER BY round(similarity, 6) DESC, a, b) AS k, x.source AS p, y.source AS q FROM duplicates JOIN rules x ON x.rule_id = a JOIN rules y ON y.rule_id = b WHERE x.source IS NOT NULL AND y.source IS NOT NULL),
    walk(k, taken) AS (SELECT 0::BIGINT, MAP([]::VARCHAR[], []::VARCHAR[]) UNION ALL SELECT o.k, CASE WHEN taken[p] IS NOT NULL AND taken[q] IS NOT NULL THEN taken WHEN taken[p] IS NOT NULL THEN map_concat(taken, MAP([q], [taken[p]]))
        WHEN taken[q] IS NOT NULL THEN map_concat(taken, MAP([p], [taken[q]])) ELSE map_concat(taken, MAP(list_distinct([p, q]), list_transform(list_distinct([p, q]), lambda x: least(p, q)))) END FROM walk JOIN ordered o ON o.k = walk.k + 1)
    SELECT unnest(map_keys(taken)) AS path, unnest(map_values(taken)) AS component FROM walk WHERE k = (SELECT max(k) FROM walk)""")
def rule_path_groups(spark, d):
    """R15."""
    given = _rules(spark, d, hash=report.facts()["hash"])
    exact, near = report.found_pairs(given, 0.4)
    return report.path_groups(exact.unionByName(near), given)


# answers and questions

_BARE = "trim(text, ' ' || chr(9) || chr(13) || chr(10))"
_PROBLEM = f"CASE WHEN {_any(_BARE, A.PLAN_SIGNS)} THEN 'plan' WHEN length({_BARE}) < 20 THEN 'short' WHEN NOT {_any('text', [A.SUBSTANCE])} THEN 'no statement' END"
_SIGNALS = f"answers AS (SELECT conv_id, turn, {_any('text', A.FINAL_SIGNS)} AS tag, {_any('text', A.SURE_SIGNS)} AS sure, NOT {_any('text', A.MORE_SIGNS)} AS over, {_PROBLEM} AS problem FROM (SELECT conv_id, turn, ([{', '.join(_q(s) for s in ('FINAL(', 'I believe it was ', 'Let me check further: ', ''))}])[turn % 4 + 1] || text AS text FROM conversations))"


@query(f"+{_SIGNALS} SELECT conv_id, turn, tag, sure, over, problem, (tag::INT + sure::INT + over::INT + (problem IS NULL)::INT) >= 2 AS stop FROM answers")
def answer_signals(spark, d):
    """X28, E4. Signs that an answer is final, over turns with fixed openings."""
    opening = F.element_at(F.array(*[F.lit(s) for s in ("FINAL(", "I believe it was ", "Let me check further: ", "")]), (F.col("turn") % 4 + 1).cast("int"))
    turns = tables.table(spark, d, "conversations").select("conv_id", "turn", F.concat(opening, F.col("text")).alias("text"))
    signals = A.termination_signals(F.col("text"))
    return turns.select(
        "conv_id", "turn", signals["explicit_tag"].alias("tag"), signals["confidence_statement"].alias("sure"), signals["no_more_actions"].alias("over"),
        A.answer_problem(F.col("text")).alias("problem"), A.should_stop(signals).alias("stop"),
    )


@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview FROM conversations", with_tables=False)
def turn_previews(spark, d):
    """X30."""
    return tables.table(spark, d, "conversations").select("conv_id", "turn", A.preview(F.col("text")).alias("preview"))


_QUESTIONS = "questions AS (SELECT item_id, ([" + ", ".join(_q(s) for s in ("what is ", "how does the API login fail? and why ", "is it \"so\"? Really? ", "UserService query, ")) + "])[item_id % 4 + 1] || text || CASE WHEN item_id % 2 = 1 THEN '?' ELSE '' END AS q FROM benchmark)"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    opening = F.element_at(F.array(*[F.lit(s) for s in ("what is ", "how does the API login fail? and why ", 'is it "so"? Really? ', "UserService query, ")]), (F.col("item_id") % 4 + 1).cast("int"))
    return tables.table(spark, d, "benchmark").select("item_id", F.concat(opening, F.col("text"), F.when(F.col("item_id") % 2 == 1, "?").otherwise("")).alias("q"))


_PARTS_AND = r"list_filter(list_transform(regexp_split_to_array(q, '(?i)\s+(?:and|,)\s+'), lambda p: trim(p)), lambda p: p <> '')"


@query(rf"""WITH {_QUESTIONS}, split AS (SELECT item_id, q, {_PARTS_AND} AS p FROM questions)
    SELECT item_id, len(parts)::INT AS n, md5(array_to_string(parts, '|')) AS parts FROM (SELECT item_id, CASE WHEN len(p) > 1 AND len(list_filter(p, lambda x: NOT contains(x, '?'))) = 0 THEN p
    WHEN length(q) - length(replace(q, '?', '')) > 1 THEN list_transform(list_filter(regexp_split_to_array(q, '\?+'), lambda x: trim(x) <> ''), lambda x: trim(x) || '?') ELSE [q] END AS parts FROM split)""", with_tables=False)
def question_parts(spark, d):
    """X5."""
    parts = X.decomposed(F.col("q"))
    return _questions(spark, d).select("item_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("parts"))


_ASKED = _joined([f"list_transform(regexp_extract_all(q, {_q('(?i)' + p)}), lambda w: lower(w))" for p in A.QUERY_TERMS] + ["regexp_extract_all(q, '\"([^\"]+)\"', 1)", r"regexp_extract_all(q, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b')"])


@query(f"WITH {_QUESTIONS} SELECT item_id, array_to_string(list_sort(list_distinct({_ASKED})), ',') AS keywords FROM questions", with_tables=False)
def question_keywords(spark, d):
    """X27."""
    return _questions(spark, d).select("item_id", F.array_join(F.sort_array(A.question_keywords(F.col("q"))), ",").alias("keywords"))


# knowledge

_CODE_LINE = "value = compute(1, 2, 3)  # " + "x" * 40
_TALK = f"""talk AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN ([{', '.join(_q(s) for s in ('Why this error? ', 'Which way is best? ', 'Make nicer forms ', ''))}])[conv_id % 4 + 1] || text
    ELSE text || CASE WHEN conv_id % 2 = 0 THEN {NL} || '```python' || {NL} || '{_CODE_LINE}' || {NL} || '```' ELSE '' END END AS text FROM conversations),
    met AS (SELECT conv_id, turn, text AS q, a FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM talk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


def _talk(spark: SparkSession, d: str) -> DataFrame:
    opening = F.element_at(F.array(*[F.lit(s) for s in ("Why this error? ", "Which way is best? ", "Make nicer forms ", "")]), (F.col("conv_id") % 4 + 1).cast("int"))
    code = F.when(F.col("conv_id") % 2 == 0, F.lit(f"\n```python\n{_CODE_LINE}\n```")).otherwise("")
    said = F.when(F.col("role") == "user", F.concat(opening, F.col("text"))).otherwise(F.concat(F.col("text"), code))
    return tables.table(spark, d, "conversations").select("conv_id", "turn", "role", said.alias("text"))


@query(rf"""WITH {_TALK}, code AS (SELECT *, list_filter(regexp_extract_all(a, '(?s)```(\w*)\n(.*?)```', 2), lambda c: length(c) >= 50)[1] AS code FROM met WHERE trim(a) <> ''),
    found AS (SELECT conv_id, turn, q, a, 'solution' AS kind, q[1:500] AS title, a[1:1000] AS body, 0.6 AS confidence FROM code WHERE regexp_matches(lower(q), {_q(C.ERROR_QUESTION)})
    UNION ALL SELECT conv_id, turn, q, a, 'decision', q[1:200], a[1:500], 0.5 FROM code WHERE regexp_matches(lower(q), {_q(C.DECISION_QUESTION)})
    UNION ALL SELECT conv_id, turn, q, a, 'pattern', {_PATTERN_NAME.format('q')}, code, 0.5 FROM code WHERE code IS NOT NULL)
    SELECT conv_id, turn, kind, md5(title) AS title, md5(body) AS body, confidence::DOUBLE AS confidence, array_to_string(list_filter([{_TAGS.format("(q || ' ' || a)")}], lambda x: x IS NOT NULL), ',') AS tags,
    md5(concat_ws({NL} || {NL}, CASE kind WHEN 'solution' THEN '# Problem' || {NL} ELSE '# ' || title END, CASE WHEN kind = 'solution' AND title <> '' THEN '## Question' || {NL} || title END,
        CASE kind WHEN 'solution' THEN '## Solution' || {NL} || body WHEN 'decision' THEN '## Decision' || {NL} || body ELSE '## Implementation' || {NL} || '```' || {NL} || body || {NL} || '```' END,
        CASE WHEN tags <> '' THEN '## Tags' || {NL} || replace(tags, ',', ', ') END)) AS content
    FROM (SELECT *, array_to_string(list_filter([{_TAGS.format("(q || ' ' || a)")}], lambda x: x IS NOT NULL), ',') AS tags FROM found)""", with_tables=False)
def extracted_knowledge(spark, d):
    """What conversations teach, and the text it is stored as."""
    found = conversations.knowledge(_talk(spark, d))
    content = A.formatted_knowledge(F.col("kind"), F.col("title"), F.col("body"), F.col("tags"))
    return found.select("conv_id", "turn", "kind", F.md5("title").alias("title"), F.md5("body").alias("body"), "confidence", F.array_join("tags", ",").alias("tags"), F.md5(content).alias("content"))


def _items(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Extracted items of all kinds, by fixed rules on the turns of conversations."""
    given = tables.table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.substring("text", 1, 80).alias("head"), F.expr("substring(text, 81)").alias("rest"), (F.col("turn") % 10 / 10).alias("confidence"),
    )
    listed = lambda cond, *xs: F.when(cond, F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>"))
    odd, third = F.col("turn") % 2 == 1, F.col("conv_id") % 3 == 0
    change = F.struct(F.lit("py").alias("language"), F.when(third, "old").otherwise("").alias("before"), F.lit("new").alias("after"), F.when(~third, "why").alias("explanation"))
    common = {"tags": listed(third, "x", "y"), "context": F.col("rest")}
    own = {
        "solution": {"problem": F.col("head"), "error_message": F.when(third, "boom"), "solution": F.col("rest"), "code_changes": F.when(odd, F.array(change, change)).otherwise(F.array_remove(F.array(change), change)), "files_affected": listed(third, "a.py", "b.py")},
        "pattern": {"name": F.concat(F.lit("P"), F.col("turn").cast("string")), "description": F.col("head"), "use_case": F.col("rest"), "language": F.lit("py"), "implementation": F.concat("head", "rest", "rest"), "idx": F.col("turn"), "related_patterns": F.array(F.concat(F.lit("P"), (F.col("turn") + 1).cast("string")), F.concat(F.lit("P"), F.col("turn").cast("string")))},
        "decision": {"topic": F.col("head"), "decision": F.col("rest"), "reasoning": F.col("head"), "alternatives": listed(odd, "b", "c"), "tradeoffs": listed(third, "slow")},
        "standard": {"category": F.col("head"), "rule": F.col("rest"), "examples": listed(odd, "one", "two"), "counter_examples": listed(third, "no"), "rationale": F.when(third, "sound")},
        "preference": {"aspect": F.col("head"), "preference": F.col("rest"), "correction": F.when(odd, "not so")},
    }
    return {kind: given.where(F.col("turn") % 5 == n).select("id", "conv_id", "confidence", *[c.alias(name) for name, c in (own[kind] | common).items()]) for n, kind in enumerate(knowledge.KINDS)}


_GAP = f"{NL} || {NL}"
_ITEMS = f"""given AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, text[1:80] AS head, text[81:] AS rest, (turn % 10) / 10 AS c, turn % 2 = 1 AS odd, conv_id % 3 = 0 AS third FROM conversations),
    bits AS (SELECT *, CASE WHEN third THEN '## Tags' || {NL} || 'x, y' END AS tags,
        CASE WHEN third THEN 'Before:' || {NL} || '```py' || {NL} || 'old' || {NL} || '```' || {_GAP} ELSE '' END || 'After:' || {NL} || '```py' || {NL} || 'new' || {NL} || '```' || CASE WHEN third THEN '' ELSE {_GAP} || 'why' END AS change FROM given),
    made AS (SELECT id, conv_id, c, 'solution' AS chunk_type, 0.6 + CASE WHEN third THEN 0.1 ELSE 0 END + CASE WHEN odd THEN 0.1 ELSE 0 END + CASE WHEN third THEN 0.05 ELSE 0 END + CASE WHEN c > 0.8 THEN 0.1 ELSE 0 END AS importance,
        concat_ws({_GAP}, '# Problem' || {NL} || head, CASE WHEN third THEN '## Error' || {NL} || '```' || {NL} || 'boom' || {NL} || '```' END, '## Solution' || {NL} || rest, CASE WHEN odd THEN '## Code Changes' || {NL} || change || {_GAP} || change END, CASE WHEN third THEN '## Files' || {NL} || 'a.py, b.py' END, tags) AS content FROM bits WHERE turn % 5 = 0
    UNION ALL SELECT id, conv_id, c, 'pattern', 0.65 + CASE WHEN length(head || rest || rest) > 200 THEN 0.1 ELSE 0 END + 0.05 + CASE WHEN c > 0.8 THEN 0.1 ELSE 0 END,
        concat_ws({_GAP}, '# P' || turn, '## Description' || {NL} || head, '## Use Case' || {NL} || rest, '## Implementation' || {NL} || '```py' || {NL} || head || rest || rest || {NL} || '```', '## Related Patterns' || {NL} || 'P' || (turn + 1) || ', P' || turn, tags) FROM bits WHERE turn % 5 = 1
    UNION ALL SELECT id, conv_id, c, 'decision', 0.7 + CASE WHEN odd THEN 0.1 ELSE 0 END + CASE WHEN third THEN 0.05 ELSE 0 END + CASE WHEN c > 0.8 THEN 0.1 ELSE 0 END,
        concat_ws({_GAP}, '# Decision: ' || head, '## Decision' || {NL} || rest, '## Reasoning' || {NL} || head, CASE WHEN odd THEN '## Alternatives Considered' || {NL} || '- b' || {NL} || '- c' END, CASE WHEN third THEN '## Tradeoffs' || {NL} || '- slow' END, '## Context' || {NL} || rest, tags) FROM bits WHERE turn % 5 = 2
    UNION ALL SELECT id, conv_id, c, 'standard', 0.75 + CASE WHEN odd THEN 0.1 ELSE 0 END + CASE WHEN third THEN 0.05 ELSE 0 END + CASE WHEN c > 0.8 THEN 0.05 ELSE 0 END,
        concat_ws({_GAP}, '# Standard: ' || head, '## Rule' || {NL} || rest, CASE WHEN odd THEN '## Examples' || {NL} || '- one' || {NL} || '- two' END, CASE WHEN third THEN '## Counter-Examples (Don''t Do)' || {NL} || '- no' END, CASE WHEN third THEN '## Rationale' || {NL} || 'sound' END, tags) FROM bits WHERE turn % 5 = 3
    UNION ALL SELECT id, conv_id, c, 'preference', 0.7, concat_ws({_GAP}, '# Preference: ' || head, '## Preferred Approach' || {NL} || rest, CASE WHEN odd THEN '## Correction' || {NL} || 'not so' END, '## Context' || {NL} || rest) FROM bits WHERE turn % 5 = 4)"""


@query(f"WITH {_ITEMS} SELECT 'know-' || id AS chunk_id, conv_id, 'cursor-chat:' || conv_id AS source, chunk_type, round(least(1.0, importance)::DOUBLE, 6) AS importance, c::DOUBLE AS confidence, md5(content) AS content FROM made", with_tables=False)
def knowledge_chunks(spark, d):
    """R17, X13, N11."""
    return knowledge.chunks(_items(spark, d)).select("chunk_id", "conv_id", "source", "chunk_type", r6("importance"), "confidence", F.md5("content").alias("content"))


@query(f"""WITH {_ITEMS}, patterns AS (SELECT conv_id, turn, id FROM given WHERE turn % 5 = 1)
    SELECT 'know-' || x.id AS from_id, 'know-' || y.id AS to_id, 'implements' AS rel_type, 0.5::DOUBLE AS strength FROM given x JOIN patterns y USING (conv_id) WHERE x.turn % 5 = 0
    UNION ALL SELECT 'know-' || x.id, 'know-' || y.id, 'relates_to', 0.7::DOUBLE FROM patterns x JOIN patterns y ON x.conv_id = y.conv_id AND y.turn IN (x.turn + 1, x.turn) WHERE x.id <> y.id""", with_tables=False)
def knowledge_links(spark, d):
    """R17, J14, J15."""
    return knowledge.edges(_items(spark, d))


@query("SELECT a.id AS from_id, b.id AS to_id, 'relates_to' AS rel_type, 0.7::DOUBLE AS strength FROM (SELECT *, source || '-' || chunk_type AS conv, importance AS i FROM (SELECT 'know-' || chunk_id AS id, * FROM meta)) a JOIN (SELECT source || '-' || chunk_type AS conv, access_count % 7 AS name, arg_min('know-' || chunk_id, chunk_id) AS id FROM meta GROUP BY 1, 2) b ON a.conv = b.conv AND b.name = (a.access_count + 1) % 7 WHERE a.id <> b.id")
def related_patterns(spark, d):
    """J15 over chunks: the first of each name within a group, by a rule on the access counts."""
    m = tables.metadata(spark, d)
    named = m.select(F.col("chunk_id").cast("string").alias("id"), F.concat_ws("-", "source", "chunk_type").alias("conv_id"), F.col("chunk_id").alias("idx"), (F.col("access_count") % 7).cast("string").alias("name"), F.array(((F.col("access_count") + 1) % 7).cast("string")).alias("related_patterns"))
    return knowledge.related_pattern_edges(named)


@query(f"WITH {_ITEMS} SELECT conv_id, count_if(turn % 5 = 0)::BIGINT AS solutions, count_if(turn % 5 = 1)::BIGINT AS patterns, count_if(turn % 5 = 2)::BIGINT AS decisions, count_if(turn % 5 = 3)::BIGINT AS standards, count_if(turn % 5 = 4)::BIGINT AS preferences, count(*) AS items FROM given GROUP BY 1", with_tables=False)
def knowledge_counts(spark, d):
    """A18."""
    return knowledge.counts(_items(spark, d))


def _chat_store(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a table of keys and JSON values, as a chat application keeps them."""
    turns = tables.table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(0)
    head = F.to_json(F.struct((F.lit(NOW_SECONDS * 1000) + F.col("conv_id")).alias("lastUpdatedAt"), F.transform(F.array_sort("h"), lambda x: F.struct(x["turn"].cast("string").alias("bubbleId"), x["type"].alias("type"))).alias("fullConversationHeadersOnly")))
    heads = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", kind.alias("type"))).alias("h")).select(F.concat(F.lit(chats.HEAD), F.col("conv_id").cast("string")).alias("key"), head.alias("value"))
    rich = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.col("text"))).alias("children"))).alias("children")).alias("root")))
    plain = F.when(F.col("turn") % 3 > 0, F.col("text"))
    bubble = F.to_json(F.struct(kind.alias("type"), plain.alias("text"), F.when(plain.isNull(), rich).alias("richText")))
    bubbles = turns.select(F.concat(F.lit(chats.BUBBLE), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("key"), bubble.alias("value"))
    return heads.unionByName(bubbles)


@query(f"SELECT conv_id::VARCHAR AS conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, CASE WHEN role IN ('user', 'assistant') THEN role END AS role, md5(CASE WHEN turn % 3 > 0 AND text <> '' THEN text ELSE text || {NL} END) AS text FROM conversations", with_tables=False)
def chat_messages(spark, d):
    """Messages of a chat store, a third of them as rich text."""
    return chats.messages(_chat_store(spark, d)).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("SELECT conv_id::VARCHAR AS conv_id, count(*)::INT AS n_messages, count(*) OVER () AS conversations FROM conversations GROUP BY conv_id", with_tables=False)
def chat_conversations(spark, d):
    """S5, S8."""
    kv = _chat_store(spark, d)
    return chats.conversations(kv).select("conv_id", "n_messages", F.lit(chats.conversation_count(kv)).cast("long").alias("conversations"))


# table changes


@query("SELECT event_id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id LIMIT 100", with_tables=False)
def recent_activity(spark, d):
    """S13, K21."""
    log = tables.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return store.recent_activity(log, 100, "event_id").select("event_id", F.unix_micros("at").alias("at"))


@query("SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'twice' WHEN chunk_id % 2 = 0 THEN 'once' ELSE source END AS source FROM chunks UNION ALL SELECT chunk_id + 3000000, 'new' FROM chunks WHERE chunk_id % 5 = 0")
def vector_upsert(spark, d):
    """K1. Changes to every second and every third chunk, the later one winning, and new chunks."""
    c = tables.chunks(spark, d).select("chunk_id", "source")
    change = lambda df, source, at, shift=0: df.select((F.col("chunk_id") + shift).alias("chunk_id"), F.lit(source).alias("source"), F.lit(at).alias("at"))
    new = change(c.where("chunk_id % 2 = 0"), "once", 1).unionByName(change(c.where("chunk_id % 3 = 0"), "twice", 2)).unionByName(change(c.where("chunk_id % 5 = 0"), "new", 1, 3_000_000))
    return store.upsert(c, new, ["chunk_id"], "at").select("chunk_id", "source")


@query("SELECT from_id, to_id, rel_type FROM edges WHERE NOT (rel_type = 'supersedes' AND to_id % 2 = 0)")
def edge_delete(spark, d):
    """K2, K14."""
    e = tables.edges(spark, d).select("from_id", "to_id", "rel_type")
    return store.delete(e, e.where("rel_type = 'supersedes' and to_id % 2 = 0"), ["from_id", "to_id", "rel_type"])


@query("SELECT 'chunks' AS t, count(*) AS n FROM chunks UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'access_log', count(*) FROM access_log UNION ALL SELECT 'ledger', 0")
def store_counts(spark, d):
    """K3, K19."""
    return store.counts({"chunks": tables.chunks(spark, d), "edges": tables.edges(spark, d), "access_log": tables.access_log(spark, d), "ledger": store.reset(tables.access_log(spark, d))})


@query("SELECT chunk_id, CASE WHEN chunk_id % 4 = 0 THEN 'code' ELSE chunk_type END AS chunk_type, round(importance, 6) AS importance, true AS has_vector FROM meta UNION ALL SELECT chunk_id + 2000000, 'code', 0.5, true FROM meta WHERE chunk_id % 4 = 0")
def chunks_added(spark, d):
    """K4."""
    c = tables.chunks(spark, d).select("chunk_id", "embedding", "source")
    some = c.where("chunk_id % 4 = 0").withColumn("chunk_type", F.lit("code"))
    m = tables.metadata(spark, d).select("chunk_id", "source", "chunk_type", "importance")
    out = store.add_chunks({"chunks": c, "metadata": m}, some.unionByName(some.withColumn("chunk_id", F.col("chunk_id") + 2000000)))
    vectors = out["chunks"].select("chunk_id", F.col("embedding").isNotNull().alias("has_vector"))
    return out["metadata"].join(vectors, "chunk_id").select("chunk_id", "chunk_type", r6("importance"), "has_vector")


@query("SELECT a AS from_id, b AS to_id, 'contradicts' AS rel_type, 0.7::DOUBLE AS strength FROM (SELECT from_id AS a, to_id AS b FROM edges WHERE rel_type = 'leads_to' UNION ALL SELECT to_id, from_id FROM edges WHERE rel_type = 'leads_to')")
def contradiction_edges(spark, d):
    """K15."""
    pairs = tables.edges(spark, d).where("rel_type = 'leads_to'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return maintenance.mark_contradiction(pairs).select("from_id", "to_id", "rel_type", "strength")


_NAMES = "(SELECT category AS id, count(*) AS n FROM items GROUP BY 1)"


@query(f"SELECT id, id AS name, CASE WHEN length(id) % 2 = 0 THEN 'changed' ELSE 'old' END AS description, 'said' AS summary, CASE WHEN length(id) % 2 = 0 THEN 0 ELSE n END AS chunk_count FROM {_NAMES}")
def category_upsert(spark, d):
    """K16."""
    counts = categories.category_counts(tables.category_items(spark, d))
    old = counts.select(F.col("category").alias("id"), F.col("category").alias("name"), F.lit("old").alias("description"), F.lit(None).cast("string").alias("parent_id"), F.lit("said").alias("summary"), "chunk_count")
    new = old.where("length(id) % 2 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit("changed").alias("description"), "parent_id", F.lit("").alias("summary"), F.lit(None).cast("long").alias("chunk_count"))
    return store.merge_categories(old, new).select("id", "name", "description", "summary", "chunk_count")


@query("SELECT chunk_id, category, round(CASE WHEN chunk_id % 3 = 0 THEN 1.0 ELSE relevance END, 6) AS relevance FROM items UNION ALL SELECT chunk_id, 'extra', 1.0 FROM items WHERE chunk_id % 3 = 0")
def item_assignment(spark, d):
    """K17."""
    items = tables.category_items(spark, d).select("chunk_id", "category", "relevance")
    some = items.where("chunk_id % 3 = 0").withColumn("relevance", F.lit(1.0))
    return store.assign_categories(items, some.unionByName(some.withColumn("category", F.lit("extra")))).select("chunk_id", "category", r6("relevance"))


@query("SELECT conv_id AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 9 ELSE count(*) END AS message_count FROM conversations WHERE conv_id % 3 > 0 OR conv_id % 2 = 0 GROUP BY 1", with_tables=False)
def ledger_upsert(spark, d):
    """K18."""
    turns = tables.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.count("*").alias("message_count"))
    return store.mark_processed(turns.where("conversation_id % 3 > 0"), turns.where("conversation_id % 2 = 0").withColumn("message_count", F.lit(9).cast("long")))


@query("SELECT chunk_id, chunk_type FROM meta WHERE chunk_id = 42")
def chunk_lookup(spark, d):
    """P3."""
    return store.lookup(tables.metadata(spark, d), 42).select("chunk_id", "chunk_type")


@query("SELECT 'from' AS direction, from_id, to_id FROM edges WHERE from_id = 17 UNION ALL SELECT 'to', from_id, to_id FROM edges WHERE to_id = 17 UNION ALL SELECT 'both', from_id, to_id FROM edges WHERE from_id = 17 OR to_id = 17")
def chunk_edges(spark, d):
    """P4."""
    e = tables.edges(spark, d)
    parts = [graph.touching(e, 17, way).select(F.lit(way).alias("direction"), "from_id", "to_id") for way in ("from", "to", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT rule_id FROM rules WHERE regexp_matches(content, '(?i)typescript') AND regexp_matches(content, '(?i)never')")
def content_filter(spark, d):
    """P8, P9."""
    return retrieval.keyword_filter(_rules(spark, d), ["typescript", "never"], match_all=True).select("rule_id")


@query(f"SELECT chunk_id, round(greatest(0.0, least(1.0, 2 * {_COS})), 6) AS confidence FROM chunks WHERE 2 * {_COS} >= 0.1")
def confidence_filter(spark, d):
    """P11."""
    return _scored(spark, d).select("chunk_id", N.clamped(2 * F.col("score")).alias("confidence")).where("confidence >= 0.1").select("chunk_id", r6("confidence"))


@query("SELECT chunk_id, chunk_type FROM meta ORDER BY chunk_id LIMIT 25")
def shaped_result(spark, d):
    """P16."""
    return store.shaped(tables.metadata(spark, d).orderBy("chunk_id"), ["chunk_id", "chunk_type", "unknown"], 25)


# retrieval and graph

_LIVE = "SELECT chunk_id FROM meta WHERE is_archived"


@query(f"""+seeds AS (SELECT chunk_id FROM chunks WHERE chunk_id IN (5, 17, 120)), g AS (SELECT * FROM sym WHERE strength >= 0.3 AND dst NOT IN ({_LIVE})),
    l1 AS (SELECT DISTINCT chunk_id AS seed, dst AS node FROM seeds JOIN g ON src = chunk_id WHERE dst <> chunk_id),
    l2 AS (SELECT DISTINCT seed, dst AS node FROM l1 JOIN g ON g.src = l1.node WHERE dst <> seed AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.seed = l1.seed AND x.node = g.dst))
    SELECT seed, node, 1 AS depth FROM l1 UNION ALL SELECT seed, node, 2 FROM l2""")
def bfs_of_live_chunks(spark, d):
    """J13, G1."""
    seeds = spark.createDataFrame([(5,), (17,), (120,)], "chunk_id long")
    archived = tables.metadata(spark, d).where("is_archived").select("chunk_id")
    return graph.traverse(tables.edges(spark, d), seeds, archived=archived).select("seed", "node", "depth")


@query("SELECT chunk_id FROM chunks WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0")
def union_of_variables(spark, d):
    """U2."""
    c = tables.chunks(spark, d).select("chunk_id")
    return retrieval.union_distinct({"even": c.where("chunk_id % 2 = 0"), "third": c.where("chunk_id % 3 = 0"), "_hidden": c})


@query("SELECT chunk_id, round(list_distance(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS distance FROM chunks")
def euclidean_distances(spark, d):
    """N2."""
    q = F.array(*[F.lit(float(x)) for x in tables.query_vector(spark, d)])
    return tables.chunks(spark, d).select("chunk_id", r6(V.euclidean(F.col("embedding"), q), "distance"))


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, round(length(text) / 4 * 0.15 + 500 / 4 * 0.60, 6) AS millionths FROM documents", with_tables=False)
def llm_costs(spark, d):
    """N13, N14."""
    docs = tables.table(spark, d, "documents")
    return docs.select("doc_id", N.token_estimate(F.col("text")).alias("tokens"), r6(N.cost_estimate(F.length("text"), F.lit(500)) * 1e6, "millionths"))


_PARTS6 = ", ".join(f"('{p}', {w})" for p, w in C.SIX_WEIGHTS.items())
_RECENT = f"CASE WHEN last_accessed_at IS NULL THEN 0.0 ELSE 1 / (1 + ({NOW_SECONDS * 1_000_000} - epoch_us(last_accessed_at)) / 86400000000.0 / 7) END"


@query(f"""+{_KNN.format(k=50)}, parts(part, weight) AS (VALUES {_PARTS6}), hit AS (SELECT * FROM knn50 JOIN meta USING (chunk_id)),
    v AS (SELECT chunk_id, part, weight, CASE part WHEN 'similarity' THEN score WHEN 'decay' THEN decay_score WHEN 'importance' THEN importance WHEN 'recency' THEN {_RECENT} WHEN 'graph' THEN 0.0 ELSE ({_BOOST}) - 1 END AS value FROM hit, parts)
    SELECT chunk_id, part, round(value, 6) AS value, round(weight * value, 6) AS contribution FROM v""")
def score_parts(spark, d):
    """N18."""
    hits = retrieval.knn.knn(tables.chunks(spark, d), tables.query_vector(spark, d), 50)
    scored = retrieval.hybrid_scores(hits, tables.metadata(spark, d), None, tables.now())
    signals = {"similarity": "score", "decay": "decay_score", "importance": "importance", "recency": "recency", "graph": "graph_boost", "type": "type_boost"}
    return N.score_parts(scored, signals).select("chunk_id", "part", r6("value"), r6("contribution"))


@query('SELECT chunk_id, chunk_type AS "group" FROM meta')
def type_groups(spark, d):
    """C5."""
    return chunking.type_groups(tables.metadata(spark, d)).select("chunk_id", "group")


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with type and text."""
    text = tables.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return tables.chunks(spark, d).join(tables.metadata(spark, d).select("chunk_id", "chunk_type"), "chunk_id").join(text, "chunk_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


@query("SELECT chunk_id, 'batch_' || ((row_number() OVER (ORDER BY chunk_id) - 1) // (SELECT greatest(5, ceil(count(*) / 10)::BIGINT) FROM chunks)) AS \"group\" FROM chunks")
def adaptive_groups(spark, d):
    """C7. The grouping for a question that asks for all: a tenth to a batch."""
    return chunking.adaptive_groups(_described(spark, d), "list all of it").select("chunk_id", "group")


@query("""+flags AS (SELECT count(*) AS n, count(DISTINCT source) AS sources, bool_or(len(embedding) > 0) AS vectors FROM chunks)
    SELECT item_id, CASE WHEN n = 0 OR regexp_matches(lower(text), 'how many|count|list|all|every') THEN 'uniform' WHEN regexp_matches(lower(text), 'error|fix|bug|specific') THEN 'keyword'
        WHEN sources > 1 THEN 'structural' WHEN vectors AND n > 5 THEN 'semantic' ELSE 'uniform' END AS strategy FROM benchmark, flags""")
def strategy_advice(spark, d):
    """C8. What is advised for every benchmark item as a question over all chunks."""
    items = tables.table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return chunking.recommended(items, chunking.traits(_described(spark, d))).select("item_id", "strategy")


@query(f"""+{_KNN.format(k=30)} SELECT chunk_id FROM knn30 JOIN meta USING (chunk_id) WHERE NOT is_archived ORDER BY {_FINAL3} DESC, chunk_id LIMIT 10""")
def tiered_items(spark, d):
    """R5. Items where the summaries do not suffice."""
    hits = retrieval.enhanced_search(tables.chunks(spark, d), tables.metadata(spark, d), tables.query_vector(spark, d), 10)
    return retrieval.tiered("how do I fix this error", [{"summary": "short"}], hits)["items"].select("chunk_id")


@query(f"""+{_KNN.format(k=45)}, es AS (SELECT chunk_id, score FROM knn45 JOIN meta USING (chunk_id) WHERE NOT is_archived AND decay_score >= 0.1 AND chunk_type IN ('decision') ORDER BY {_FINAL3} DESC, chunk_id LIMIT 15)
    SELECT chunk_id, round({_final6('0.0', f'({_BOOST}) * 1.1')}, 6) AS final_score FROM es JOIN meta USING (chunk_id) WHERE {_final6('0.0', f'({_BOOST}) * 1.1')} >= 0.3
    ORDER BY {_final6('0.0', f'({_BOOST}) * 1.1')} DESC, chunk_id LIMIT 5""")
def recall_decision(spark, d):
    """R10."""
    found = retrieval.past_solutions(tables.chunks(spark, d), tables.metadata(spark, d), None, tables.query_vector(spark, d), tables.now(), types=("decision",))
    return found.select("chunk_id", r6("final_score"))


@query(f"+{_KNN.format(k=20)} SELECT chunk_id FROM knn20")
def retrieval_controller(spark, d):
    """R12. A filter, then an answer: the results are all that the named tables hold."""
    plan = iter([{"action": "filter", "pattern": "e", "into": "some"}, {"action": "answer", "text": "so"}])
    found = retrieval.controller(_described(spark, d), "what", lambda q: tables.query_vector(spark, d), lambda q, env: next(plan))
    return found["results"].select("chunk_id")


@query("SELECT category, rank FROM (SELECT category, row_number() OVER (ORDER BY category)::INT AS rank FROM (VALUES " + ", ".join(f"('{c[0]}')" for c in C.CATEGORIES) + ") v(category))", with_tables=False)
def categories_listed(spark, d):
    """T6."""
    return categories.listed(categories.definitions(spark)).select("category", F.expr("row_number() over (order by category)").alias("rank"))


@query("""+recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY assigned_at DESC, chunk_id) AS r FROM items) JOIN meta USING (chunk_id) WHERE r <= 20 AND category = 'database'), kinds AS (SELECT chunk_type, count(*) AS n FROM recent GROUP BY 1)
    SELECT 'database' AS category, '""" + next(c[1] for c in C.CATEGORIES if c[0] == "database") + """' AS description, (SELECT count(*) FROM items WHERE category = 'database') AS items, (SELECT string_agg(n || ' ' || chunk_type || '(s)', ', ' ORDER BY n DESC, chunk_type) FROM kinds) AS summary""")
def category_summary(spark, d):
    """R11."""
    items = tables.category_items(spark, d)
    return categories.category_summary(categories.definitions(spark), categories.category_counts(items), categories.summaries(items, tables.metadata(spark, d)), "Database")


# jobs

_OLD = f"created_at < make_timestamp({NOW_SECONDS - 180 * 86400}000000) AND access_count = 0"


@query("SELECT count(DISTINCT category) AS categories_updated FROM items")
def job_summarize(spark, d):
    """R18."""
    return maintenance.summarize(tables.category_items(spark, d), tables.metadata(spark, d))[1]


@query(f"""SELECT (SELECT count(*) FROM edges) AS relationships, (SELECT count(*) FROM meta WHERE chunk_id NOT IN (SELECT from_id FROM edges) AND chunk_id NOT IN (SELECT to_id FROM edges)) AS isolated, (SELECT count(*) FROM meta WHERE {_OLD} AND NOT is_archived) AS archived,
    (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT chunk_id FROM meta) OR to_id NOT IN (SELECT chunk_id FROM meta)) + (SELECT count(*) FROM access_log WHERE chunk_id NOT IN (SELECT chunk_id FROM meta)) + (SELECT count(*) FROM items WHERE chunk_id NOT IN (SELECT chunk_id FROM meta)) AS orphans""")
def job_reindex(spark, d):
    """R18."""
    return maintenance.reindex(tables.metadata(spark, d), tables.edges(spark, d), tables.access_log(spark, d), tables.category_items(spark, d), tables.now())[1]


@query("SELECT count_if(is_archived)::BIGINT AS archived, count_if(NOT is_archived AND decay_score < 0.1)::BIGINT AS weak, count_if(is_archived)::BIGINT AS would_delete FROM meta")
def job_cleanup(spark, d):
    """R18."""
    return maintenance.cleanup_metrics(tables.metadata(spark, d))


@query(f"""+live AS (SELECT chunk_id, epoch_us(created_at) AS t, decay_score FROM meta WHERE NOT is_archived), best AS (SELECT t, arg_min(chunk_id, (-decay_score, chunk_id)) AS keeper FROM live GROUP BY 1),
    gone AS (SELECT chunk_id FROM live JOIN best USING (t) WHERE chunk_id <> keeper), hot AS (SELECT chunk_id FROM access_log WHERE accessed_at > make_timestamp({NOW_SECONDS - 86400}000000) AND accessed_at <= make_timestamp({NOW_SECONDS}000000) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)
    SELECT (SELECT count(*) FROM live) AS updated, (SELECT count(*) FROM gone) AS duplicates, (SELECT count(*) FROM hot) AS promoted, (SELECT count(*) FROM meta WHERE NOT is_archived AND (chunk_id IN (SELECT chunk_id FROM gone) OR decay_score < 0.15)) AS archived""")
def job_consolidate(spark, d):
    """R18, J10, Q21. Chunks are made at midnights, so those of one day are each other's duplicates."""
    m, log = tables.metadata(spark, d), tables.access_log(spark, d)
    after, links = maintenance.consolidate(m, log, tables.now())
    return maintenance.consolidation_metrics(m, after, links, log, tables.now())


# vectors from texts


@query()
def embedded_texts(spark, d):
    """E1. The deterministic embedder over whole texts; held against its own function in the tests."""
    from tidemark.functions import embedding

    docs = tables.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return embedding.embedded(docs, F.col("text")).select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
