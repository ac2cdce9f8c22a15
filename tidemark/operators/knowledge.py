"""Extracted knowledge as chunks and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.answers import fenced
from tidemark.operators import conversations

KINDS = ("solution", "pattern", "decision", "standard", "preference")


def _some(c: str | Column) -> Column:
    """Whether an array has entries."""
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _part(name: str, body: Column, there: Column | None = None) -> Column:
    headed = F.concat(F.lit(f"## {name}\n"), body)
    return headed if there is None else F.when(there, headed)


def _bullets(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")


def _commas(name: str, c: str) -> Column:
    return _part(name, F.array_join(c, ", "), _some(c))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _changes() -> Column:
    def one(c: Column) -> Column:
        before = F.when(F.coalesce(c["before"], F.lit("")) != "", F.concat(F.lit("Before:\n"), fenced(c["before"], c["language"]), F.lit("\n\n"))).otherwise("")
        why = F.when(F.coalesce(c["explanation"], F.lit("")) != "", F.concat(F.lit("\n\n"), c["explanation"])).otherwise("")
        return F.concat(before, F.lit("After:\n"), fenced(c["after"], c["language"]), why)

    return F.array_join(F.transform("code_changes", one), "\n\n")


def content_parts(kind: str) -> list[Column]:
    """X13. The parts of a chunk's text by kind, null where an item brings nothing for them."""
    heading = lambda lead, c: F.concat(F.lit(lead), F.col(c))
    return {
        "solution": lambda: [
            heading("# Problem\n", "problem"), _part("Error", fenced(F.col("error_message")), _given("error_message")), _part("Solution", F.col("solution")),
            _part("Code Changes", _changes(), _some("code_changes")), _commas("Files", "files_affected"), _commas("Tags", "tags"),
        ],
        "pattern": lambda: [
            heading("# ", "name"), _part("Description", F.col("description")), _part("Use Case", F.col("use_case")),
            _part("Implementation", fenced(F.col("implementation"), F.col("language"))), _commas("Related Patterns", "related_patterns"), _commas("Tags", "tags"),
        ],
        "decision": lambda: [
            heading("# Decision: ", "topic"), _part("Decision", F.col("decision")), _part("Reasoning", F.col("reasoning")), _part("Alternatives Considered", _bullets("alternatives"), _some("alternatives")),
            _part("Tradeoffs", _bullets("tradeoffs"), _some("tradeoffs")), _part("Context", F.col("context")), _commas("Tags", "tags"),
        ],
        "standard": lambda: [
            heading("# Standard: ", "category"), _part("Rule", F.col("rule")), _part("Examples", _bullets("examples"), _some("examples")),
            _part("Counter-Examples (Don't Do)", _bullets("counter_examples"), _some("counter_examples")), _part("Rationale", F.col("rationale"), _given("rationale")), _commas("Tags", "tags"),
        ],
        "preference": lambda: [
            heading("# Preference: ", "aspect"), _part("Preferred Approach", F.col("preference")), _part("Correction", F.col("correction"), _given("correction")), _part("Context", F.col("context")),
        ],
    }[kind]()


def importance(kind: str) -> Column:
    """N11 of an item of a kind."""
    sure = F.col("confidence") > 0.8
    present = {
        "solution": lambda: {"error": _given("error_message"), "code": _some("code_changes"), "files": _some("files_affected"), "sure": sure},
        "pattern": lambda: {"long": F.length("implementation") > 200, "related": _some("related_patterns"), "sure": sure},
        "decision": lambda: {"alternatives": _some("alternatives"), "tradeoffs": _some("tradeoffs"), "sure": sure},
        "standard": lambda: {"examples": F.coalesce(F.size("examples"), F.lit(0)) > 1, "counters": _some("counter_examples"), "sure": sure},
        "preference": dict,
    }[kind]()
    return conversations.knowledge_importance(kind, **present)


def chunks(items: dict[str, DataFrame]) -> DataFrame:
    """R17. chunk_id, conv_id, source, chunk_type, importance, confidence and content of the items of
    all kinds: tables by kind with id, conv_id, confidence and the kind's own columns."""
    one = lambda kind, df: df.select(
        F.concat(F.lit("know-"), "id").alias("chunk_id"), "conv_id", F.concat(F.lit("cursor-chat:"), F.col("conv_id").cast("string")).alias("source"), F.lit(kind).alias("chunk_type"),
        importance(kind).alias("importance"), "confidence", F.concat_ws("\n\n", *content_parts(kind)).alias("content"),
    )
    return reduce(DataFrame.unionByName, [one(kind, df) for kind, df in items.items()])


def related_pattern_edges(patterns: DataFrame) -> DataFrame:
    """J15. For every name that a pattern calls related the first pattern of the conversation with that
    name, itself excepted: relates_to at 0.7. patterns: id, conv_id, idx (its place), name, related_patterns."""
    named = patterns.groupBy("conv_id", "name").agg(F.min_by("id", "idx").alias("to_id"))
    asked = patterns.select("conv_id", F.col("id").alias("from_id"), F.explode("related_patterns").alias("name"))
    met = asked.join(named, ["conv_id", "name"]).where("from_id <> to_id")
    return met.select(_chunk("from_id"), _chunk("to_id"), F.lit("relates_to").alias("rel_type"), F.lit(0.7).alias("strength"))


def _chunk(c: str) -> Column:
    return F.concat(F.lit("know-"), c).alias(c)


def edges(items: dict[str, DataFrame]) -> DataFrame:
    """R17, J14, J15. Edges among a conversation's solutions and patterns."""
    both = [items[k].select(F.col("id").alias("item_id"), "conv_id", F.lit(k).alias("kind")) for k in ("solution", "pattern")]
    implements = conversations.knowledge_edges(both[0].unionByName(both[1])).select(_chunk("from_id"), _chunk("to_id"), "rel_type", "strength")
    return related_pattern_edges(items["pattern"]).unionByName(implements)


def counts(items: dict[str, DataFrame]) -> DataFrame:
    """A18. Items of every kind by conversation, and together."""
    all_items = reduce(DataFrame.unionByName, [df.select("conv_id", F.lit(kind).alias("kind")) for kind, df in items.items()])
    by = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS]
    return all_items.groupBy("conv_id").agg(*by, F.count("*").alias("items"))
