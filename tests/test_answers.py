"""Keywords, answers, templates and the registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import answers
from tidemark.plans.registry import Parameter, Registry, Tool


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


def test_keywords(spark):
    text = "```python\nx```\nusing React with the Vue in shop app #tag_one #x code"
    assert one(spark, answers.content_keywords(F.col("t")), text) == ["python", "react", "shop", "tag_one"]
    assert answers.query_keywords('Why does "my file" break the API of UserStore? error Error') == ["error", "api", "my file", "UserStore"]


def test_signals(spark):
    got = one(spark, answers.termination_signals(F.col("t")), "ANSWER: based on the context the value is 12 here")
    assert (got.explicit_tag, got.confidence_statement, got.no_more_actions, got.answer_valid) == (True, True, True, True)
    assert one(spark, answers.should_stop(answers.termination_signals(F.col("t"))), "Let me look") is False
    assert [one(spark, answers.answer_problem(F.col("t")), t) for t in ("  I will look at the files first", "it is", "nothing to say about these things", "the result is what it was before")] == ["plan", "short", "no statement", None]


def test_actions():
    assert answers.parse_action('x ```json\n{"type": "peek", "params": {"n": 1}}\n``` y')["type"] == "peek"
    assert answers.parse_action('so {"type": "filter"} then')["type"] == "filter"
    assert answers.parse_action('{"type": "dance"}')["params"]["value"] == '{"type": "dance"}'
    assert answers.parse_action("plain")["params"] == {"value": "plain"}


def test_templates(spark):
    df = spark.createDataFrame([("pattern", "Name", "x = 1", ["a", "b"]), ("decision", "T", "D", [])], "kind string, title string, body string, tags array<string>")
    got = [r.v for r in df.select(answers.formatted_knowledge(F.col("kind"), F.col("title"), F.col("body"), F.col("tags")).alias("v")).collect()]
    assert got == ["# Name\n\n## Implementation\n```\nx = 1\n```\n\n## Tags\na, b", "# T\n\n## Decision\nD"]
    assert one(spark, answers.preview(F.col("t"), 3), "abcd") == "abc..."


def test_registry():
    r = Registry()
    r.register(Tool("add", "math", lambda a, b=1: a + b, {"a": Parameter(int, required=True), "b": Parameter(int, default=2, choices=(2, 3))}))
    assert r.execute("add", a=1) == 3 and r.by_category() == {"math": 1}
    for bad in ({}, {"a": "x"}, {"a": 1, "b": 9}, {"a": 1, "c": 1}):
        with pytest.raises(ValueError):
            r.execute("add", **bad)
    n = r.submit("add", a=1, b=3)
    assert r.jobs[n][2].result() == 4 and r.recent() == [(n, "add", "completed")]
    r.forget(-1)
    assert r.recent() == [] and r.tools["add"].schema()["required"] == ["a"]
