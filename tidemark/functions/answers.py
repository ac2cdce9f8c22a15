"""Keywords and model answers (X13, X17, X27-X30): what a text is about, whether an answer is one, and
the templates of extracted knowledge."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_borders

# Where keywords stand in a rule, and words that are none.
KEYWORD_PLACES = [r"\busing\s+(\w+)", r"\bwith\s+(\w+)", r"\bin\s+(\w+)\s+(?:project|app|code)", r"\bfor\s+(\w+)\s+(?:project|development)"]
STOP_WORDS = [
    "the", "and", "for", "with", "this", "that", "from", "have", "will", "your", "code", "file", "files", "when", "should", "must", "always", "never",
    "use", "using", "make", "sure", "all", "any", "are", "not",
]
# Terms that a question is searched for.
QUERY_TERMS = [
    r"\b(error|exception|bug|issue|problem)\b", r"\b(function|method|class|component|module)\b", r"\b(api|endpoint|route|handler)\b",
    r"\b(database|query|sql|mongodb)\b", r"\b(auth|authentication|authorization|login)\b", r"\b(test|testing|unit|integration)\b",
]
# Signs that an answer is final, that it is sure, that it wants more, and that it is a plan.
FINAL_SIGNS = [r"\bFINAL\s*\(", r"\bFINAL_VAR\s*\(", r"\bANSWER\s*:", r'"type"\s*:\s*"answer"']
SURE_SIGNS = [r"\b(I am confident|I believe|The answer is|Based on the context)", r"\b(sufficient information|enough information|can conclude)", r"\b(definitively|conclusively|clearly shows)"]
MORE_SIGNS = [r'"type"\s*:\s*"(peek|filter|chunk|subQuery|search)"', r"\b(let me|I will|I need to|next I should)\b", r"\b(examine|investigate|look at|check)\b.*\b(more|further|additional)\b"]
PLAN_SIGNS = [r"^(I will|Let me|I should|I need to|First,|Next,|Then,)", r"^(To answer this|To find out|To determine)", r"^(Looking at|Examining|Checking)"]
SUBSTANCE = r"\b(is|are|was|were|can|could|should|would|found|discovered|determined)\b"
ACTIONS = ("peek", "filter", "chunk", "subQuery", "store", "answer", "search")


def content_keywords(text: Column) -> Column:
    """X17. Fence languages, words in telling places and hashtags, lower case, without stop words and
    words under three letters."""
    fences = F.regexp_extract_all(text, F.lit(r"```(\w+)"), F.lit(1))
    placed = [F.regexp_extract_all(text, F.lit("(?i)" + ascii_borders(p)), F.lit(1)) for p in KEYWORD_PLACES]
    tags = F.regexp_extract_all(text, F.lit(r"#(\w{2,})"), F.lit(1))
    found = F.transform(F.flatten(F.array(fences, *placed, tags)), lambda w: F.lower(w))
    return F.filter(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS])), lambda w: F.length(w) > 2)


def query_keywords(query: str) -> list[str]:
    """X27. Technical terms, quoted strings and CamelCase names of a question, each once."""
    found = [m[0].lower() for p in QUERY_TERMS for m in re.finditer(p, query, re.I | re.A)]
    found += re.findall(r'"([^"]+)"', query) + re.findall(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", query)
    return list(dict.fromkeys(found))


def question_keywords(text: Column) -> Column:
    """X27 as a column."""
    terms = [F.transform(F.regexp_extract_all(text, F.lit("(?i)" + ascii_borders(p)), F.lit(0)), lambda w: F.lower(w)) for p in QUERY_TERMS]
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(ascii_borders(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b")), F.lit(0))
    return F.array_distinct(F.flatten(F.array(*terms, quoted, camel)))


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{ascii_borders(p)})" for p in patterns))


def termination_signals(answer: Column) -> Column:
    """X28. Struct of explicit_tag, confidence_statement, no_more_actions and answer_valid."""
    return F.struct(_any(answer, FINAL_SIGNS).alias("explicit_tag"), _any(answer, SURE_SIGNS).alias("confidence_statement"), (~_any(answer, MORE_SIGNS)).alias("no_more_actions"), (answer_problem(answer).isNull()).alias("answer_valid"))


def answer_problem(answer: Column) -> Column:
    """X28. Why a text is no answer (a plan, too short, without a statement), null if it is one."""
    bare = F.btrim(answer, F.lit(" \t\r\n"))
    return F.when(_any(bare, PLAN_SIGNS), "plan").when(F.length(bare) < 20, "short").when(~_any(answer, [SUBSTANCE]), "no statement")


def should_stop(signals: Column, needed: int = 2) -> Column:
    """E4. Whether at least so many signals speak for the end."""
    names = ("explicit_tag", "confidence_statement", "no_more_actions", "answer_valid")
    return sum((signals[n].cast("int") for n in names), F.lit(0)) >= needed


def parse_action(response: str) -> dict[str, object]:
    """X29. The action in a model's response: fenced JSON, JSON, the outermost braces, else the whole
    response as the answer. Fenced or plain JSON must name a known action."""
    fenced = re.search(r"```json\s*(.*?)\s*```", response, re.S)
    whole = {"type": "answer", "params": {"value": response}}
    for text, checked in ((fenced[1] if fenced else response, True), ((re.search(r"\{.*\}", response, re.S) or [""])[0], False)):
        try:
            found = json.loads(text.strip())
        except ValueError:
            continue
        if not isinstance(found, dict) or checked and found.get("type") not in ACTIONS:
            return whole
        return {"type": found.get("type") or "answer", "params": found.get("params") or ({} if checked else {"value": response}), "reasoning": found.get("reasoning")}
    return whole


def preview(text: Column, length: int = 100) -> Column:
    """X30. The beginning of a text, with dots where it goes on."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def markdown(title: Column, parts: dict[str, Column]) -> Column:
    """X13. A title and headed parts; parts that are null or empty are left out."""
    headed = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c)) for name, c in parts.items()]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *headed)


def fenced(code: Column, language: Column | None = None) -> Column:
    """A code block of a template; null for no code."""
    return F.concat(F.lit("```"), F.coalesce(language, F.lit("")) if language is not None else F.lit(""), F.lit("\n"), code, F.lit("\n```"))


def formatted_knowledge(kind: Column, title: Column, body: Column, tags: Column) -> Column:
    """X13. The content of an extracted item by its kind."""
    listed = F.array_join(tags, ", ")
    return (
        F.when(kind == "solution", markdown(F.lit("Problem\n"), {"Question": title, "Solution": body, "Tags": listed}))
        .when(kind == "decision", markdown(title, {"Decision": body, "Tags": listed}))
        .when(kind == "pattern", markdown(title, {"Implementation": fenced(body), "Tags": listed}))
        .otherwise(markdown(title, {"Details": body, "Tags": listed}))
    )


def outermost_json(answer: str) -> str:
    """X29. The text of a fenced JSON block, else from the first opening brace to the last closing."""
    fenced_block = re.search(r"```json\s*(.*?)\s*```", answer, re.S)
    braces = re.search(r"\{.*\}", answer, re.S)
    return fenced_block[1] if fenced_block else braces[0] if braces else answer
