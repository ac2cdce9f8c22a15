"""Duplicates in time, clusters by tags, k-means, many questions and metadata against plain loops."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fields, intervals, report, topics
from tidemark.plans import retrieval

ITEMS = "id long, t long, score double"
MINUTE = 60_000_000


def loop_dropped(rows, width=MINUTE):
    keep, out = [], {}
    for i, t, s in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[2], r[0])):
        near = [k for k in keep if abs(k[1] - t) < width]
        if near:
            out[i] = near[0][0]
        else:
            keep.append((i, t))
    return out


def times(seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3000 * 1_000_000), rng.choice([0.1, 0.5, rng.random()])) for i in range(150)]
    return rows + [(900, None, 1.0), (901, -5, 0.2), (902, -5, 0.2), (903, MINUTE, 0.9), (904, 0, 0.9), (905, MINUTE - 1, 0.8)]


@pytest.mark.parametrize("rows", [times(1), times(2), [(i, i * 1000, float(i % 7)) for i in range(400)], [(i, i * MINUTE // 2, float(i)) for i in range(60)], []], ids=["some", "others", "one minute", "chain", "none"])
def test_duplicates_in_time_equal_the_loop(spark, rows):
    got = intervals.dropped_in_time(spark.createDataFrame(rows, ITEMS)).collect()
    assert {r.id: r.keeper for r in got} == loop_dropped(rows) and len(got) == len(loop_dropped(rows))


def test_a_full_minute_is_settled_in_a_round(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(intervals, "_swept", lambda *a: swept.append(a))
    rows = [(i, i * 1000, float(i % 7)) for i in range(2000)]
    kept = intervals.kept_in_time(spark.createDataFrame(rows, ITEMS)).collect()
    assert [r.id for r in kept] == [6] and not swept


# clusters

RULES = "rule_id long, tags array<string>, tokens long, embedding array<double>"


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def loop_clusters(rows, floor):
    groups, clustered, out = {}, set(), {}
    for row in sorted(rows):
        for tag in dict.fromkeys(row[1] or []):
            groups.setdefault(tag, []).append(row)
    for tag, members in groups.items():
        vectors = [r[3] for r in members if r[3] is not None]
        pairs = [cosine(a, b) for i, a in enumerate(vectors) for b in vectors[i + 1 :]]
        mean = sum(pairs) / len(pairs) if pairs else 0.0
        fresh = [r for r in members if r[0] not in clustered]
        if len(members) < 2 or mean < floor or len(fresh) < 2:
            continue
        total = sum(r[2] for r in fresh)
        out[tag] = ({r[0] for r in fresh}, round(mean, 9), total, math.ceil(total * 0.6))
        clustered |= {r[0] for r in fresh}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_tag_clusters_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    tags = [f"t{i}" for i in range(14)]
    rows = [(i, rng.sample(tags, rng.randint(0, 4)), rng.randint(0, 90), None if i % 9 == 0 else [0.0] * 3 if i % 13 == 0 else [1.0 + rng.random() * (3 if i % 2 else -1), rng.random(), rng.random() - 0.5]) for i in range(28)]
    rows += [(100, None, 5, None), (101, ["lonely"], 5, [1.0, 0.0, 0.0]), (102, ["p", "q"], 1, [1.0, 0.0, 0.0]), (103, ["p", "r"], 1, [1.0, 0.1, 0.0]), (104, ["q", "r"], 1, [1.0, 0.0, 0.1])]
    wanted = loop_clusters(rows, 0.5)
    df = spark.createDataFrame(rows, RULES)
    got = {}
    for r in topics.claimed_tags(df).collect():
        got.setdefault(r.tag, set()).add(r.id)
    assert got == {t: w[0] for t, w in wanted.items()}
    facts = {r.tag: (r.n, round(r.similarity, 9), r.tokens, r.merged) for r in topics.tag_clusters(df).collect()}
    assert facts == {t: (len(w[0]), *w[1:]) for t, w in wanted.items()}


# k-means


def loop_kmeans(x, k, rounds=50):
    centroids = [x[0]]
    used = {0}
    while len(centroids) < min(k, len(x)):
        d = [-1 if i in used else min(((v - c) ** 2).sum() for c in centroids) for i, v in enumerate(x)]
        used.add(int(np.argmax(d)))
        centroids.append(x[int(np.argmax(d))])
    c, a = np.array(centroids), np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.array([((v - c) ** 2).sum(1).argmin() for v in x])
        if (new == a).all():
            break
        a = new
        c = np.array([x[a == j].mean(0) if (a == j).any() else c[j] for j in range(len(c))])
    return a


@pytest.mark.parametrize("seed", range(2))
def test_topics_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((90, 7)) * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)
    got = {r.chunk_id: r.group for r in topics.semantic_groups(df, 4).collect()}
    assert got == {i: f"topic_{c}" for i, c in enumerate(loop_kmeans(x, 4))}


def test_topics_of_few_and_of_none(spark):
    schema = "chunk_id long, embedding array<double>"
    few = spark.createDataFrame([(5, [1.0]), (3, None), (9, [2.0])], schema)
    assert {r.chunk_id: r.group for r in topics.semantic_groups(few, 3).collect()} == {3: "topic_0", 5: "topic_1", 9: "topic_2"}
    assert topics.semantic_groups(spark.createDataFrame([], schema), 3).count() == 0
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(10, None), (11, [])]
    assert {r.group for r in topics.semantic_groups(spark.createDataFrame(rows, schema), 3).collect()} == {"topic_0"}


# many questions


def test_many_questions_equal_one_by_one(spark):
    rng = random.Random(4)
    vectors = {i: [rng.random() - 0.3 for _ in range(5)] for i in range(40)}
    docs = spark.createDataFrame([(i, v, f"src{i % 9}") for i, v in vectors.items()], "chunk_id long, embedding array<double>, source string")
    questions = {1: "how is it done?", 2: "what is first? and why second?", 3: "plain", 4: "Why? How? When?", 5: "show me how and why it works", 6: ""}
    embed = lambda text: vectors[len(text) % 40]
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "of long, vector array<double>")
    batched = lambda asked: asked.withColumn("of", (F.length("query") % 40).cast("long")).join(table, "of").drop("of")
    given = spark.createDataFrame([*questions.items(), (7, None)], "question_id long, question string")
    for options in ({"k": 2}, {"k": 10, "sources": ["src1"], "min_confidence": 0.2}):
        got = {}
        for r in retrieval.recursive_queries(docs, given, batched, **options).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append((r.chunk_id, round(r.score, 9)))
        for q, text in questions.items():
            one, _ = retrieval.recursive_query(docs, text, embed, **options)
            by_score = lambda hits: sorted(hits, key=lambda h: (-h[1], h[0]))  # noqa: E731  equal scores differ in the last bit
            assert by_score(got[q]) == by_score([(r.chunk_id, round(r.score, 9)) for r in one.collect()]), (q, options)


# metadata


def loop_leaves(value, path="$"):
    kinds = {str: "STRING", bool: "BOOLEAN", int: "BIGINT", type(None): "VOID"}
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from loop_leaves(v, f"{path}.{k}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from loop_leaves(v, f"{path}[{i}]")
    else:
        kind = {dict: "OBJECT", list: "ARRAY"}.get(type(value)) or kinds[type(value)]
        yield path, kind, value if isinstance(value, str) else json.dumps(value)


TEXTS = ['{"a": {"b": [1, "x", {"c": null}], "e": {}}, "t": true, "l": []}', "[]", "3", '"s"', "null", "{broken", '{"k": 1}}', "1, 2", "1][2", "", None, '{"é": "ü"}']


def test_leaves_of_any_shape(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    wanted = set()
    for i, text in enumerate(TEXTS):
        if text is not None:
            try:
                wanted |= {(i, *leaf) for leaf in loop_leaves(json.loads(text))}
            except ValueError:
                wanted.add((i, "$", "BROKEN", text))
    assert {tuple(r) for r in fields.leaves(df, "id", "text").collect()} == wanted
    got = df.select(fields.field(fields.parsed(F.col("text")), "$.a.b[0]", "int").alias("x")).where("x is not null").collect()
    assert [r.x for r in got] == [1]


def test_updates_of_some_keys(spark):
    old = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}'), (2, None), (3, '{"x": "y"}')], "id long, meta string")
    new = spark.createDataFrame([(1, '{"b": null, "d \\"q\\"": [1]}'), (2, '{"n": 0}'), (4, "{broken")], "id long, meta string")
    got = {r.id: json.loads(r.meta) for r in fields.merged(old, new, "id", "meta").collect()}
    assert got == {1: {"a": 1, "b": None, 'd "q"': [1]}, 2: {"n": 0}, 3: {"x": "y"}, 4: {}}


def test_names_in_the_order_of_the_locale(spark):
    names = ["zebra", "Apple", "apple", "éclair", "eclair", "Zebra", "egg", "Äpfel"]
    rows = [(i, n, i, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "rule_id long, title string, tokens long, last_modified long")
    assert [r.title for r in report.listed(df, "name").collect()] == ["Äpfel", "apple", "Apple", "eclair", "éclair", "egg", "zebra", "Zebra"]
    assert [r.rule_id for r in report.listed(df, "tokens").collect()] == list(range(7, -1, -1))
