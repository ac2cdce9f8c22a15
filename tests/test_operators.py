"""Operators on small fixtures: graph shapes, upserts, chunkers, rules, conversations, streams."""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import embedding, scoring, text, vector
from tidemark.operators import chunking, conversations, graph, knn, maintenance, report, rules, store
from tidemark.plans import retrieval, safeguards, schedule
from tidemark.sources import chats, config, files, pages
from tidemark.streaming import access


def value(spark, column, **inputs):
    return spark.createDataFrame([tuple(inputs.values())], list(inputs)).select(column.alias("v")).first().v if inputs else spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    assert value(spark, vector.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_unlike_lengths(spark):
    assert value(spark, vector.cosine(F.col("a"), F.col("b"), "zero"), a=[1.0], b=[1.0, 2.0]) == 0
    assert value(spark, vector.euclidean(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) == math.inf
    with pytest.raises(Exception, match="unlike length"):
        value(spark, vector.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0])


NOW = datetime(2024, 2, 1)


def test_decay_falls_with_age_and_is_half_at_half_life(spark):
    rows = [(i, NOW - timedelta(days=d), 0, None, 0.5) for i, d in enumerate((0, 30, 60, 120))]
    df = spark.createDataFrame(rows, "id int, created_at timestamp, access_count int, last_accessed_at timestamp, importance double")
    got = df.select("id", scoring.age_factor(F.lit(NOW), F.col("created_at")).alias("a"), scoring.decay_score(F.lit(NOW), *[F.col(c) for c in df.columns[1:]]).alias("s")).orderBy("id").collect()
    assert [r.a for r in got][2] == pytest.approx(0.5)
    assert [r.s for r in got] == sorted((r.s for r in got), reverse=True)
    assert got[0].s == pytest.approx(0.3 + 0.2)


def test_metadata_upserts(spark):
    old = spark.createDataFrame([(1, "a", "code", 0.9), (2, "b", "code", 0.8)], "chunk_id int, source string, chunk_type string, importance double")
    new = spark.createDataFrame([(1, "pattern"), (3, None)], "chunk_id int, chunk_type string")
    merged = {r.chunk_id: r for r in store.merge_metadata(old, new).collect()}
    assert (merged[1].source, merged[1].chunk_type, merged[1].importance) == ("a", "pattern", 0.9)
    assert (merged[3].source, merged[3].importance) == ("unknown", 0.5)
    reset = {r.chunk_id: r for r in store.merge_metadata(old, new, "reference").collect()}
    assert (reset[1].source, reset[1].importance, reset[2].importance) == ("unknown", 0.5, 0.8)


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "x", 0)], "id int, v string, o int")
    new = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "w", 1)], "id int, v string, o int")
    assert {(r.id, r.v) for r in store.upsert(old, new, ["id"], "o").collect()} == {(1, "z"), (2, "w")}


@pytest.fixture
def chain(spark):
    return spark.createDataFrame([(1, 2, "relates_to", 0.5), (2, 3, "relates_to", 0.5), (3, 4, "relates_to", 0.5), (4, 4, "relates_to", 0.5)], "from_id long, to_id long, rel_type string, strength double")


def test_traversal(spark, chain):
    seed = spark.createDataFrame([(1,)], "chunk_id long")
    got = {r.node: (r.depth, list(r.path)) for r in graph.traverse(chain, seed, 2).collect()}
    assert got == {2: (1, [1]), 3: (2, [1, 2])}
    assert {r.node for r in graph.traverse(chain, seed, 1).collect()} == {2}
    assert graph.traverse(chain, seed, 3, min_strength=0.6).count() == 0
    assert {r.node for r in graph.traverse(chain, seed, 3, archived=spark.createDataFrame([(3,)], "chunk_id long")).collect()} == {2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(edges, "from_id long, to_id long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 102)} == {100}


def test_supersession_cycle_ends_with_the_recurring_id(spark):
    edges = spark.createDataFrame([(2, 1, "supersedes", 0.8), (3, 2, "supersedes", 0.8), (1, 3, "supersedes", 0.8)], "from_id long, to_id long, rel_type string, strength double")
    got = graph.supersession_chains(edges, spark.createDataFrame([(1,), (9,)], "chunk_id long"))
    assert {r.chunk_id: list(r.chain) for r in got.collect()} == {1: [1, 2, 3, 1], 9: [9]}


def test_graph_stats_halve_totals_only(spark, chain):
    meta = spark.createDataFrame([(i, False) for i in range(1, 7)], "chunk_id long, is_archived boolean")
    r = graph.graph_stats(chain, meta).first()
    assert (r.total_relationships, r.isolated_chunks) == (3, 2)
    assert graph.edges_by_type(chain, meta).first().n == 7
    assert [(r.component, r["size"]) for r in graph.clusters(chain, meta, 3).collect()] == [(1, 4)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=15), st.lists(st.integers(0, 3), min_size=10, max_size=10))
def test_greedy_keepers(spark, pairs, scores):
    pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    order = sorted(range(10), key=lambda i: (-scores[i], i))
    kept, dropped = [], {}
    for i in order:
        owner = next((k for k in kept if (min(i, k), max(i, k)) in pairs), None)
        if owner is None:
            kept.append(i)
        else:
            dropped[i] = owner
    p = spark.createDataFrame(list(pairs), "a int, b int")
    s = spark.createDataFrame(list(enumerate(scores)), "id int, score int")
    assert {r.id: r.keeper for r in knn.greedy_keepers(p, s).collect()} == dropped


def test_word_windows():
    assert chunking.word_windows("", 10, 50) == []
    words = " ".join(f"w{i}" for i in range(100))
    got = chunking.word_windows(words, 10, 50)
    assert got[0].split()[5:] == got[1].split()[:5]
    assert [w for c in chunking.word_windows(words, 10, 0) for w in c.split()] == words.split()
    assert len(chunking.word_windows(words, 10, 0, "reference")[1].split()) > 10


def test_sections(spark):
    got = value(spark, text.sections(F.col("t")), t="# A\nx\n# B\ny\n\n\nplain\n\n   ")
    assert got == ["# A\nx\n", "# B\ny", "plain"]


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 190, 191, 1000])
def test_char_chunks_cover(spark, n):
    t = "".join(chr(97 + i % 26) for i in range(n))
    got = value(spark, text.char_chunks(F.col("t"), 100, 10), t=t)
    assert (got[0] + "".join(c[10:] for c in got[1:]) if got else "") == t


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(1, "one two\n\n" + "word " * 400), (2, None), (3, " ")], "doc_id int, text string")
    got = chunking.chunk_documents(docs, 100, 10).orderBy("doc_id", "index").collect()
    assert [r["index"] for r in got] == list(range(len(got))) and {r.doc_id for r in got} == {1} and got[0].content == "one two"


def test_strategies():
    flags = {"n": 20, "code": True, "sources": 2, "types": 2, "vectors": True}
    assert chunking.choose_strategy(flags, "implement a class")[0] == "structural"
    assert chunking.choose_strategy(flags, "how many are there") == ("uniform", 5)
    assert chunking.choose_strategy(flags, "fix it")[0] == "type"
    assert chunking.choose_strategy(flags, "tell me")[0] == "semantic"
    assert chunking.recommend_strategy({**flags, "sources": 1}) == "semantic"
    assert chunking.choose_strategy({**flags, "n": 0}, "x") == ("uniform", None)


def test_exchanges(spark):
    turns = [(1, 0, "assistant", "z"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "system", "s"), (1, 4, "assistant", "c"), (1, 5, "assistant", "d"), (1, 6, "user", "e")]
    got = conversations.exchanges(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("exchange").collect()
    assert [(r.question, list(r.answers)) for r in got] == [("a", []), ("b", ["c", "d"])]


def test_knowledge(spark):
    code = "```python\n" + "x = 1\n" * 20 + "```"
    turns = [(1, 0, "user", "Why this error: boom\nhelp"), (1, 1, "assistant", "Because of python. " + code)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.kind: r for r in conversations.knowledge(df).collect()}
    assert set(got) == {"solution", "pattern"} and got["solution"].tags == ["python"]
    assert conversations.exchange_chunks(df).first().importance == pytest.approx(0.65)
    assert value(spark, text.error_message(F.col("t")), t="an error: boom\nx") == "boom"
    assert value(spark, text.reasoning(F.col("t")), t="Yes because it is. No") == "it is"
    assert value(spark, text.pattern_name(F.col("t")), t="how make nice forms here now") == "Make Nice Forms Pattern"


def test_rules(spark):
    a = "Always use strict types in project modules. Prefer tabs over spaces."
    b = "Never use strict types in project modules. prefer dots over spaces."
    docs = spark.createDataFrame([(1, a), (2, b), (3, "nothing")], "rule_id int, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    r = rules.conflicts(docs, pairs).collect()
    assert [(x.a, x.b, x.contradictions, x.preference_conflicts, x.conflict_type) for x in r] == [(1, 2, 1, 1, "direct_contradiction")]


def test_conflicts_of_all_classes(spark):
    """All pairs of rules of like tags, wherever in the text these stand; rules that say the same are one."""
    no, yes = "Never use strict types in project modules. ", "Always use strict types in project modules. "
    filler = "words that say nothing at all here. " * 9
    texts = [yes + filler + "python docker", "nothing", no + filler + "python docker", yes + "mysql", "python", no + filler + "docker", no + "python docker redis", yes + filler, no + "python docker"]
    df = spark.createDataFrame(list(enumerate(texts)), "rule_id long, content string").withColumn("tags", text.tech_tags(F.col("content")))
    tags = [set(re.findall("python|docker|mysql|redis", t)) for t in texts]
    alike = [(a, b) for a in range(8) for b in range(a + 1, 8) if tags[a] | tags[b] and len(tags[a] & tags[b]) / len(tags[a] | tags[b]) >= 0.3]
    wanted = [(a, b) for a, b in alike if {texts[a].split()[0], texts[b].split()[0]} == {"Always", "Never"}]
    assert wanted == [(0, 2), (0, 5), (0, 6)]
    found = rules.classes(df)
    assert {r.rule_id: r.n for r in found.collect()} == {i: 2 if i == 2 else 1 for i in range(8)}
    assert sorted((r.a, r.b) for r in rules.class_conflicts(found).collect()) == wanted


def test_tag_pairs_of_whole_texts(spark):
    opening, filler = "the same opening of all that has forty letters ", "words that say nothing at all here. " * 9
    texts = [opening + filler + "python docker", "nothing", filler + "python docker redis", opening + "mysql", opening, "docker python", filler * 30 + "mysql", None]
    df = spark.createDataFrame(list(enumerate(texts)), "rule_id long, content string").withColumn("tags", text.tech_tags(F.col("content")))
    tags = [set(re.findall("python|docker|mysql|redis", t or "")) for t in texts]
    both = [(a, b, tags[a] & tags[b], tags[a] | tags[b]) for a in range(8) for b in range(a + 1, 8)]
    wanted = [(a, b, round(len(x) / len(y), 6)) for a, b, x, y in both if y and len(x) / len(y) >= 0.6]
    assert wanted == [(0, 2, 0.666667), (0, 5, 1.0), (2, 5, 0.666667), (3, 6, 1.0)]
    assert sorted((r.a, r.b, round(r.jaccard, 6)) for r in rules.tag_pairs(df, 0.6).collect()) == wanted
    sets = rules.tag_sets(df)
    assert sorted((r.node, r.n) for r in sets.collect()) == [(0, 2), (2, 1), (3, 2)]
    assert [(r.a, r.b) for r in rules.tag_set_pairs(sets, 0.6).collect()] == [(0, 2)]


def test_long_supersession_chain(spark):
    edges = spark.createDataFrame([(i + 1, i, "supersedes", 1.0) for i in range(70)], "from_id long, to_id long, rel_type string, strength double")
    r = graph.supersession_chains(edges, spark.createDataFrame([(0,)], "chunk_id long")).first()
    assert list(r.chain) == list(range(71)) and r.latest == 70


HEADS = ["---\ntitle: a b\ntags: [x, 'y', \"z w\"]\nn: 007\nf: -1.50\nt: true\nq: \"in\"\ne:\n---\nbody", "none", "---\r\na: 1\r\na: 2\r\n---\r\nx", "---\nlist: []\ns: say \"hi\" \\ there\n---"]


@pytest.mark.parametrize("content", HEADS)
def test_frontmatter_as_columns(spark, content):
    r = rules.with_frontmatter(spark.createDataFrame([(content,)], "content string")).first()
    assert json.loads(r.frontmatter) == rules.parse_frontmatter(content) and r.body == re.sub(r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "", content)


QUESTIONS = ["what is a? and why b?", "what is a", "a? b? ", "x and y", "one, two? ", "why?, how? and when?", "??", ""]


@pytest.mark.parametrize("question", QUESTIONS)
def test_question_parts(spark, question):
    assert list(value(spark, text.decomposed(F.col("t")), t=question)) == text.decompose(question)


def test_report(spark):
    rows = [(1, "s", "A", "same text", 3, datetime(2024, 1, 2), [1.0, 0.0]), (2, "s", "B", "Same  text", 3, datetime(2024, 1, 1), [1.0, 0.0]), (3, "t", "C", "other words here", 4, NOW, [0.9, 0.1]), (4, "u", "D", "far", 1, NOW, None)]
    df = spark.createDataFrame(rows, "rule_id long, source string, title string, content string, tokens long, last_modified timestamp, embedding array<double>")
    pairs = report.duplicates(df, 0.85)
    assert [(r.a, r.b, r.match_type, r.recommendation) for r in pairs.collect()] == [(1, 2, "exact", "keep_newer"), (1, 3, "near_exact", "keep_newer")]
    none = spark.createDataFrame([], "a long, b long")
    actions = report.plan(pairs, report.merge_candidates(pairs, df), none, df.limit(0), df).collect()
    assert [(a.type, list(a.rule_ids), a.token_impact, a.auto) for a in actions] == [("delete", [2], -3, True)]
    row = report.report(df, pairs, report.merge_candidates(pairs, df), none, df.limit(0)).first()
    assert (row.files, row.rules, row.tokens_before, row.tokens_after, row.duplicates, row.actions, row.minutes, row.risk) == (3, 4, 11, 5, 2, 1, 1, "low")
    assert [r.path for r in report.path_groups(pairs, df).orderBy("path").collect()] == ["s", "t"]
    assert [r.rule_id for r in report.listed(df, "name").collect()] == [1, 2, 3, 4] and [r.rule_id for r in report.listed(df, "tokens").collect()] == [3, 1, 2, 4]


def test_merger():
    one, two = ({"rule_id": i, "title": f"T{i}", "content": "c" * 40, "tokens": 10, "frontmatter": {"tags": [str(i)]}} for i in (1, 2))
    good = report.Merger(lambda p: 'Here: ```json\n{"title": "M", "content": "short"}\n```')
    assert good.merge([one, two]) == {"ok": True, "title": "M", "content": "short", "frontmatter": {"tags": ["1", "2"]}, "before": 20, "after": 2}
    assert good.rewrite(one)["after"] == 2 and good.merge([one])["content"] == one["content"] and not good.merge([])["ok"]
    for bad in (lambda p: "no json", lambda p: "{}", lambda p: 1 / 0):
        assert report.Merger(bad).merge([one, two]) == {"ok": False, "title": "", "content": "", "frontmatter": {}, "before": 20, "after": 20}
        assert report.Merger(bad).rewrite(one)["content"] == one["content"]


def test_backups(tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.md").write_text(folder)
    paths = [str(tmp_path / f / "r.md") for f in "aba"]
    into = files.backup_files(paths, str(tmp_path / "kept"), "2024-01-01T00:00:00.1")
    import pathlib

    assert sorted(p.read_text() for p in pathlib.Path(into).iterdir()) == ["a", "b"] and ":" not in into


def test_compact(spark, tmp_path):
    spark.range(100).repartition(20).write.parquet(str(tmp_path / "t"))
    assert store.compact(spark, str(tmp_path / "t"), str(tmp_path / "u")) == 1
    assert spark.read.parquet(str(tmp_path / "u")).count() == 100 and len(list((tmp_path / "u").glob("*.parquet"))) == 1


def test_schedule():
    start = datetime(2024, 1, 31, 2, 30)  # a Wednesday
    assert [schedule.next_run(j, start) for j in ("decay", "consolidate", "summarize", "reindex")] == [datetime(2024, 1, 31, 3, 30), datetime(2024, 1, 31, 3), datetime(2024, 2, 4, 4), datetime(2024, 2, 1, 5)]
    plan = schedule.Schedule({"decay": lambda: 1, "consolidate": lambda: 1 / 0}, start)
    assert plan.tick(datetime(2024, 1, 31, 3)) == ["consolidate"] and plan.tick(datetime(2024, 1, 31, 4)) == ["decay"]
    assert isinstance(plan.results[0][2], ZeroDivisionError) and plan.results[1][2] == 1 and plan.due["consolidate"] == datetime(2024, 2, 1, 3)


def test_calls_by_several_threads():
    calls = safeguards.CachedCalls(lambda p: p.upper(), lambda: 0.0, limit=40, concurrency=8)
    with pytest.raises(RuntimeError):
        calls.ask_all([str(i) for i in range(200)])
    assert calls.made == 40
    keyed = safeguards.CachedCalls(str.upper, lambda: 0.0, per_key=1)
    assert keyed.ask("a", "k") == "A" and keyed.ask("b", "other") == "B" and keyed.ask("a", "k") == "A"
    with pytest.raises(RuntimeError):
        keyed.ask("c", "k")


def test_strategies_and_ends():
    assert [safeguards.strategy(c, "moderate") for c in ("none", "limited", "good", "excellent")] == ["iterative", "iterative", "iterative", "recursive"]
    signs = {"explicit_tag": True, "confidence_statement": False, "no_more_actions": True, "answer_valid": False}
    assert safeguards.Termination().decide(signs) == (True, "2 signals", 0.5) and not safeguards.Termination(3).decide(signs)[0]
    assert safeguards.Termination(out_of_budget=True).decide(signs) == (True, "budget", 1.0)
    breaker = safeguards.CircuitBreaker(lambda: 0.0, failures=1)
    with pytest.raises(ZeroDivisionError):
        safeguards.run_guarded(lambda: 1 / 0, breaker)
    with pytest.raises(RuntimeError):
        safeguards.run_guarded(lambda: "x", breaker)


def test_cascade_delete_beyond_a_million(spark, monkeypatch):
    from tidemark import catalog

    ids = spark.createDataFrame([(7_000_000,), (7_000_001,), (14,)], "chunk_id long")
    edges = spark.createDataFrame([(7_000_007, 1), (1, 2), (2, 21)], "from_id long, to_id long")
    for name in ("metadata", "access_log", "category_items"):
        monkeypatch.setattr(catalog.tables, name, lambda s, d: ids)
    monkeypatch.setattr(catalog.tables, "edges", lambda s, d: edges)
    got = {r.t: r.n for r in catalog.QUERIES["cascade_delete"](spark, "").collect()}
    assert got == {"metadata": 1, "access_log": 1, "category_items": 1, "edges": 1}


def test_outdated(spark):
    rows = [(1, "react 16 in 2019, deprecated", NOW), (2, "fine", NOW - timedelta(days=400)), (3, "fine", NOW), (4, "legacy but migrat", NOW)]
    df = spark.createDataFrame(rows, "rule_id int, content string, last_modified timestamp")
    got = {r.rule_id: (round(r.confidence, 2), r.action) for r in rules.outdated(df, F.lit(NOW), [("React", r"\breact\s+(\d+)", 19.0), ("bad", "(", 1.0)]).collect()}
    assert got == {1: (0.8, "update"), 2: (0.4, "review")}


def test_frontmatter():
    assert rules.parse_frontmatter('---\na: 1\nb: [x, "y"]\nc:\nd: true\ne: "q"\n---\nbody') == {"a": 1, "b": ["x", "y"], "c": 0, "d": True, "e": "q"}
    assert rules.parse_frontmatter("no") == {}
    assert rules.merge_frontmatter([{"tags": ["a"], "priority": 1}, {"tags": ["b", "a"], "priority": 3, "alwaysApply": True, "description": "d"}]) == {"tags": ["a", "b"], "priority": 3, "alwaysApply": True, "description": "d"}


def test_sections_of_rules(spark):
    df = spark.createDataFrame([("r", "intro\n# One\na\n## Two\nb\n### Three\nc")], "rule_id string, content string")
    assert [(r.title, r.first_line, r.last_line) for r in rules.rule_sections(df).orderBy("section").collect()] == [("One", 2, 3), ("Two", 4, 7)]


def test_questions():
    assert text.decompose("what is a? and why b?") == ["what is a?", "why b?"]
    assert text.decompose("what is a") == ["what is a"]
    assert text.follow_ups("how to x", 0) == ["What are the steps to to x"]
    assert text.follow_ups("how to x", 5) == []
    assert text.sufficient("overview of x", ["y" * 101])[0] and not text.sufficient("fix the bug", ["y" * 600])[0]


def test_tiers_and_controller(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0], f"text {i} " + "x" * 60_000, "s") for i in range(5)], "chunk_id long, embedding array<double>, content string, source string")
    moves = iter([{"action": "filter", "pattern": "text [12]", "into": "some"}, {"action": "peek"}, {"action": "answer", "text": "done", "variable": "some"}])
    got = retrieval.controller(docs, "q", lambda t: [1.0, 1.0], lambda q, env: next(moves))
    assert got["answer"] == "done" and got["steps"] == ["filter", "peek", "answer"] and got["results"].count() == 5


def test_safeguards():
    clock = iter(range(1000)).__next__
    b = safeguards.Budget(100)
    assert b.allows(75) and not b.allows(76) and b.allows(100, final=True)
    breaker = safeguards.CircuitBreaker(lambda: 0.0)
    for _ in range(3):
        breaker.record(False)
    assert not breaker.allows()
    calls = []
    c = safeguards.CachedCalls(lambda p: calls.append(p) or p.upper(), clock, limit=1)
    assert c.ask("a") == "A" and c.ask("a") == "A" and calls == ["a"]
    with pytest.raises(RuntimeError):
        c.ask("b")
    assert safeguards.model_limits("gpt-4o-mini", [("gpt-4", 1), ("gpt-4o", 2)]) == 1


def test_settings():
    assert config.load({"top_k": 5}, {"TIDEMARK_TOP_K": "7"}).top_k == 7
    for bad in ({"similarity_weight": 0.9}, {"archive_threshold": 2.0}, {"nope": 1}):
        with pytest.raises(ValueError):
            config.load(bad, {})


def test_files(spark, tmp_path):
    (tmp_path / "a" / "references").mkdir(parents=True)
    (tmp_path / "a" / "SKILL.md").write_text("---\nname: alpha\ndescription: first\n---\nbody")
    (tmp_path / "a" / "references" / "r.md").write_text("more")
    (tmp_path / "b.bin").write_text("no")
    assert files.read_tree(spark, str(tmp_path)).count() == 2
    r = files.read_skills(spark, str(tmp_path)).first()
    assert (r.name, r.description) == ("alpha", "first") and r.content.endswith("more")
    assert files.read_rules(spark, str(tmp_path)).count() == 2


def test_chats(spark):
    head = {"createdAt": 1000, "lastUpdatedAt": 2000, "fullConversationHeadersOnly": [{"bubbleId": "b", "type": 1}, {"bubbleId": "a", "type": 2}]}
    rich = {"root": {"children": [{"type": "paragraph", "children": [{"text": "deep"}]}]}}
    kv = [("composerData:c", json.dumps(head)), ("bubbleId:c:a", json.dumps({"type": 2, "richText": json.dumps(rich), "codeBlocks": [{"content": "x", "filename": "m.py"}]})), ("bubbleId:c:b", json.dumps({"type": 1, "text": "hi"})), ("other", "{}")]
    df = spark.createDataFrame(kv, "key string, value string")
    assert chats.conversation_count(df) == 1 and chats.conversations(df).first().n_messages == 2
    got = chats.messages(df).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hi"), ("assistant", "deep\n")] and got[1].code_blocks[0].language == "python"


def test_pages(spark):
    html = "<html><head><title> T </title></head><body><script>x</script><p>a &amp; b</p><p>c<br>d</p></body></html>"
    assert value(spark, pages.html_text(F.col("h")), h=html) == "a & b\nc\nd"


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    got = embedding.embedded(df, F.col("t")).orderBy("id").collect()
    assert got[0].embedding == pytest.approx(embedding.hash_embed("a")) and len(got[1].embedding) == 384


def test_consolidate(spark):
    rows = [(1, NOW, 0.9, 0.5, False), (2, NOW + timedelta(seconds=30), 0.5, 0.5, False), (3, NOW + timedelta(days=1), 0.1, 0.5, False)]
    meta = spark.createDataFrame(rows, "chunk_id long, created_at timestamp, decay_score double, importance double, is_archived boolean")
    log = spark.createDataFrame([(1, NOW)], "chunk_id long, accessed_at timestamp")
    new, edges = maintenance.consolidate(meta, log, F.lit(NOW))
    assert {r.chunk_id: (r.is_archived, round(r.importance, 2)) for r in new.collect()} == {1: (False, 0.55), 2: (True, 0.5), 3: (True, 0.5)}
    assert [(r.from_id, r.to_id) for r in edges.collect()] == [(1, 2)]


def test_sliding_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("accessed_at", T.TimestampType())])
    spark.createDataFrame([(1, NOW), (1, NOW + timedelta(minutes=30))], schema).write.parquet(str(tmp_path / "log"))
    q = access.sliding_counts(access.read_stream(spark, str(tmp_path / "log"), schema), lateness="1 hour").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.max("accesses")).first()[0] == 2
