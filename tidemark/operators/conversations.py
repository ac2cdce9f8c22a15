"""Conversations (S5-S8, J3, J14, J15, W3, W4, A15, A16, N11, X9-X14, R16, R17): exchanges, chunks,
extracted knowledge and its edges. Turns are conv_id, turn, role and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import text as X


#: Turns of a conversation that are put in order by one task.
BUCKET = 1024


def exchanges(turns: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """W3 (Q30). conv_id, exchange, question, answers and their number: a user turn with the
    assistant turns up to the next. What stands before the first user turn and other roles are
    left out; a last user turn without answer is dropped, an earlier one is kept. User turns are counted in
    ranges of turns, offset by the counts before, so a conversation with a third of all turns is many tasks."""
    given = turns.where(F.col("role").isin("user", "assistant")).withColumns({"_range": F.floor(F.col("turn") / bucket), "_asks": (F.col("role") == "user").cast("long")})
    before = W.partitionBy("conv_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    counts = given.groupBy("conv_id", "_range").agg(F.sum("_asks").alias("n")).select("conv_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    run = W.partitionBy("conv_id", "_range").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    numbered = given.join(counts, ["conv_id", "_range"]).withColumn("exchange", F.col("_before") + F.sum("_asks").over(run)).where("exchange > 0")
    answer = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    grouped = numbered.groupBy("conv_id", "exchange").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.sort_array(F.collect_list(answer)).alias("a"),
    )
    last = given.groupBy("conv_id").agg(F.sum("_asks").alias("last"))
    kept = grouped.join(last, "conv_id").where((F.size("a") > 0) | (F.col("exchange") < F.col("last")))
    return kept.select("conv_id", "exchange", "question", F.transform("a", lambda x: x["text"]).alias("answers"), F.size("a").alias("n_answers"))


def adjacent_pairs(turns: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """W4. User turns followed at once by an assistant turn. The last turn of a range is followed by the first of the next
    range that has any."""
    given = turns.withColumn("_range", F.floor(F.col("turn") / bucket))
    ranges = W.partitionBy("conv_id").orderBy("_range")  # a row per range
    firsts = given.groupBy("conv_id", "_range").agg(F.min_by(F.struct("role", "text"), "turn").alias("_first"))
    firsts = firsts.select("conv_id", "_range", F.lead("_first").over(ranges).alias("_next"))
    order = W.partitionBy("conv_id", "_range").orderBy("turn")
    inside = F.lead(F.struct("role", "text")).over(order)
    seen = given.join(firsts, ["conv_id", "_range"]).withColumn("_then", F.coalesce(inside, F.col("_next")))
    return seen.where("role = 'user' and _then.role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("_then.text").alias("answer"))


def previews(turns: DataFrame, length: int = 200) -> DataFrame:
    """S5. Per conversation its turns, and the beginning of the first."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.substring(F.min_by("text", "turn"), 1, length).alias("preview"))


def search(turns: DataFrame, query: str, newest: int = 100) -> DataFrame:
    """S7. Of the newest conversations those with the query in a turn, whatever its case."""
    recent = turns.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(newest)
    hit = turns.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("conv_id").distinct()
    return recent.join(hit, "conv_id", "left_semi")


def unprocessed(conversations: DataFrame, ledger: DataFrame) -> DataFrame:
    """J3."""
    return conversations.join(ledger.select("conv_id"), "conv_id", "left_anti")


def exchange_importance(answer_chars: Column, has_code: Column, agentic: Column, files: Column) -> Column:
    """N11. 0.5 and what code, length, agency and files add, at most 1."""
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    value = 0.5 + one(has_code, 0.15) + one(answer_chars > 2000, 0.1) + one(answer_chars > 5000, 0.05) + one(agentic, 0.1) + one(files > 0, 0.05) + one(files > 5, 0.05)
    return F.least(F.lit(1.0), value)


def code_importance(code: Column, filename: Column) -> Column:
    """N11."""
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), 0.6 + one(F.length(code) > 200, 0.1) + one(F.length(code) > 500, 0.1) + one(F.coalesce(filename, F.lit("")) != "", 0.1))


def code_blocks(text: Column) -> Column:
    """S10. Fenced blocks of a text as structs of language and code."""
    langs, codes = (F.regexp_extract_all(text, F.lit(r"(?s)```(\w*)\n(.*?)```"), F.lit(i)) for i in (1, 2))
    return F.zip_with(langs, codes, lambda a, b: F.struct(a.alias("language"), b.alias("code")))


def exchange_chunks(turns: DataFrame, min_chars: int = 50, max_chars: int = 2000) -> DataFrame:
    """R16. Chunks of exchanges of at least min_chars: content (question and answers in a template,
    cut to max_chars), importance, entities, and an id that is a hash of its place."""
    return chunks_of(exchanges(turns), min_chars, max_chars)


def chunks_of(found: DataFrame, min_chars: int = 50, max_chars: int = 2000) -> DataFrame:
    """R16. The same from exchanges (conv_id, exchange, question, answers), as a stream gives them."""
    given = found.withColumn("answer", F.array_join("answers", "\n\n"))
    body = F.concat(F.lit("## User\n"), F.col("question"), F.lit("\n\n## Assistant\n"), F.col("answer"))
    sized = given.where(F.length("question") + F.length("answer") >= min_chars)
    blocks = code_blocks(F.col("answer"))
    return sized.select(
        F.substring(F.sha2(F.concat_ws(":", "conv_id", "exchange", F.lit("exchange")), 256), 1, 16).alias("chunk_id"), "conv_id", "exchange",
        X.truncated(body, max_chars).alias("content"), exchange_importance(F.length("answer"), F.size(blocks) > 0, F.lit(False), F.lit(0)).alias("importance"),
        X.entities(body).alias("entities"),
    )


def rollup(turns: DataFrame) -> DataFrame:
    """A15, A16. Per conversation counts of turns by role, characters, and turns with code."""
    code = F.col("text").contains("```")
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum(F.length("text")).alias("n_chars"), F.count_if(code).alias("n_code"),
    )


def knowledge(turns: DataFrame) -> DataFrame:
    """X10, X11. What adjacent pairs teach: a row per kind (solution, decision, pattern) with title,
    body, tags and confidence."""
    pairs = adjacent_pairs(turns).where(F.trim("answer") != "")
    tags = X.named_tags(F.concat_ws(" ", "question", "answer"))
    code = F.get(F.filter(code_blocks(F.col("answer")), lambda b: F.length(b["code"]) >= 50), 0)["code"]
    row = lambda kind, title, body, sure: F.struct(F.lit(kind).alias("kind"), title.alias("title"), body.alias("body"), F.lit(sure).alias("confidence"))
    q, a = F.col("question"), F.col("answer")
    kinds = F.array_compact(F.array(
        F.when(X.is_error_question(q), row("solution", F.substring(q, 1, 500), F.substring(a, 1, 1000), 0.6)),
        F.when(X.is_decision_question(q), row("decision", F.substring(q, 1, 200), F.substring(a, 1, 500), 0.5)),
        F.when(code.isNotNull(), row("pattern", X.pattern_name(q), code, 0.5)),
    ))
    return pairs.select("conv_id", "turn", F.explode(kinds).alias("k"), tags.alias("tags")).select("conv_id", "turn", "k.*", "tags")


def knowledge_importance(kind: str, **present: Column) -> Column:
    """N11. Importance of an extracted item from what it brings: columns true where it does."""
    # Bases and bonuses by kind.
    base = {"solution": 0.6, "pattern": 0.65, "decision": 0.7, "standard": 0.75, "preference": 0.7}[kind]
    bonus = {
        "solution": {"error": 0.1, "code": 0.1, "files": 0.05, "sure": 0.1}, "pattern": {"long": 0.1, "related": 0.05, "sure": 0.1},
        "decision": {"alternatives": 0.1, "tradeoffs": 0.05, "sure": 0.1}, "standard": {"examples": 0.1, "counters": 0.05, "sure": 0.05}, "preference": {},
    }[kind]
    value = F.lit(base)
    for name, x in bonus.items():
        if name in present:
            value = value + F.when(present[name], x).otherwise(0.0)
    return F.least(F.lit(1.0), value)


def knowledge_edges(items: DataFrame) -> DataFrame:
    """J14, J15 (Q32). Every solution of a conversation implements its patterns at strength 0.5.
    items: item_id, conv_id, kind. A conversation's own items only, so groups stay small."""
    left = items.where("kind = 'solution'").select("conv_id", F.col("item_id").alias("from_id"))
    right = items.where("kind = 'pattern'").select("conv_id", F.col("item_id").alias("to_id"))
    return left.join(right, "conv_id").select("from_id", "to_id", F.lit("implements").alias("rel_type"), F.lit(0.5).alias("strength"))
