"""Composite retrieval (R1-R10, R12, U1, U2, W5, P5, P8-P10, P12, P15): lazy plans over tables, and
small driver loops where a step depends on what the last found."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as C
from tidemark.functions import scoring as N
from tidemark.functions import text as X
from tidemark.operators import aggregates, cells, graph, knn
from tidemark.scratch import written

Embed = Callable[[str], Iterable[float]]


def search(docs: DataFrame, vector: Iterable[float], k: int = 10, sources: list[str] | None = None) -> DataFrame:
    """R1."""
    return knn.knn(docs, vector, k, {"source": sources} if sources else None)


def enriched(hits: DataFrame, metadata: DataFrame, include_archived: bool) -> DataFrame:
    """J1, J2, P15 (Q8). Hits with their metadata: those without it are dropped, or with archived ones
    wanted kept with decay 1 and importance 0.5."""
    extra = [c for c in metadata.columns if c not in hits.columns or c == "chunk_id"]
    joined = hits.join(metadata.select(*extra), "chunk_id", "left" if include_archived else "inner")
    return joined.withColumns({"decay_score": F.coalesce("decay_score", F.lit(1.0)), "importance": F.coalesce("importance", F.lit(0.5))})


def enhanced_search(docs: DataFrame, metadata: DataFrame, vector: Iterable[float], k: int = 10, min_decay: float | None = None, types: list[str] | None = None, include_archived: bool = False) -> DataFrame:
    """R3, P5 (Q7). The 3k nearest, joined to metadata, filtered, ranked by three signals, the best k.
    The filters stand above the first limit and must not move below it."""
    hits = enriched(knn.knn(docs, vector, 3 * k).select("chunk_id", "score"), metadata, include_archived)
    hits = hits if include_archived else hits.where(~F.col("is_archived"))
    hits = hits if min_decay is None else hits.where(F.col("decay_score") >= min_decay)
    hits = hits.where(F.col("chunk_type").isin(types)) if types else hits
    final = N.three_signals(F.col("score"), F.col("decay_score"), F.col("importance"))
    return hits.withColumn("final_score", final).orderBy(F.desc("final_score"), "chunk_id").limit(k)


def search_with_events(docs: DataFrame, metadata: DataFrame, vector: Iterable[float], now: Column, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """R2 (Q6). The 2k nearest ranked by three signals, the best k; and the access events that the
    search makes, for the caller to write."""
    hits = enriched(knn.knn(docs, vector, 2 * k).select("chunk_id", "score"), metadata, True)
    final = N.three_signals(F.col("score"), F.col("decay_score"), F.col("importance"))
    best = hits.withColumn("final_score", final).orderBy(F.desc("final_score"), "chunk_id").limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("final_score"), "chunk_id"))
    return best, best.select("chunk_id", now.alias("accessed_at"), rank.alias("result_rank"))


def hybrid_scores(hits: DataFrame, metadata: DataFrame, boosts: DataFrame | None, now: Column, preferred: list[str] | None = None) -> DataFrame:
    """R4. Hits (chunk_id, score) by six signals: similarity, decay, importance, recency, graph, type."""
    extra = [c for c in metadata.columns if c != "score"]
    df = hits.select("chunk_id", "score").join(metadata.select(*extra), "chunk_id", "left")
    df = df.join(boosts, "chunk_id", "left") if boosts is not None else df.withColumn("graph_boost", F.lit(0.0))
    df = df.withColumns({
        "decay_score": F.coalesce("decay_score", F.lit(1.0)), "importance": F.coalesce("importance", F.lit(0.5)), "graph_boost": F.coalesce("graph_boost", F.lit(0.0)),
        "recency": N.recency_score(now, F.col("last_accessed_at")), "type_boost": N.type_boost(F.col("chunk_type"), preferred),
    })
    final = N.six_signals(F.col("score"), F.col("decay_score"), F.col("importance"), F.col("recency"), F.col("graph_boost"), F.col("type_boost"))
    return df.withColumn("final_score", final)


def past_solutions(docs: DataFrame, metadata: DataFrame, edges: DataFrame | None, vector: Iterable[float], now: Column, k: int = 5, min_score: float = 0.3, types: tuple[str, ...] = ("solution",)) -> DataFrame:
    """R7, R10, P12. Solutions (or other types) found by enhanced search over 3k, ranked by six
    signals with the found ones as graph seeds, those of at least min_score, the best k."""
    hits = enhanced_search(docs, metadata, vector, 3 * k, 0.1, list(types))
    boosts = graph.graph_boosts(edges, hits.select("chunk_id")) if edges is not None else None
    scored = hybrid_scores(hits, metadata, boosts, now, list(types))
    return scored.where(F.col("final_score") >= min_score).orderBy(F.desc("final_score"), "chunk_id").limit(k)


def similar_issues(docs: DataFrame, metadata: DataFrame, edges: DataFrame, vector: Iterable[float], now: Column, k: int = 5) -> DataFrame:
    """R8. Chunks related by strength 0.4 or more to the three best hits, three of each, k in all."""
    hits = enhanced_search(docs, metadata, vector, 3 * k, 0.05, ["solution", "pattern", "decision"])
    top = hybrid_scores(hits, metadata, None, now).orderBy(F.desc("final_score"), "chunk_id").limit(3)
    near = graph.symmetric(edges).where("strength >= 0.4").join(top.select(F.col("chunk_id").alias("src"), "final_score"), "src")
    best = near.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("strength"), "dst"))).where("r <= 3")
    return best.groupBy(F.col("dst").alias("chunk_id")).agg(F.max("strength").alias("strength")).orderBy(F.desc("strength"), "chunk_id").limit(k)


def project_patterns(metadata: DataFrame, items: DataFrame | None, category: str | None = None, k: int = 10) -> DataFrame:
    """R9, J4, T4. Patterns and standards, of a category if named, by importance and decay."""
    df = metadata.where(F.col("chunk_type").isin("pattern", "standard", "decision") & ~F.col("is_archived"))
    df = df.join(items.where(F.col("category") == category).select("chunk_id"), "chunk_id", "left_semi") if category else df
    return df.withColumn("rank_score", 0.6 * F.col("importance") + 0.4 * F.col("decay_score")).orderBy(F.desc("rank_score"), "chunk_id").limit(k)


def merge_hops(hops: DataFrame) -> DataFrame:
    """U1, W5 (Q15). Per id the last score seen at the place where it was first seen; by score, ties
    by that place. hops: chunk_id, score, ord."""
    return hops.groupBy("chunk_id").agg(F.max_by("score", "ord").alias("score"), F.min("ord").alias("first")).orderBy(F.desc("score"), "first")


def recursive_query(docs: DataFrame, question: str, embed: Embed, max_iterations: int = 5, min_confidence: float = 0.7, k: int = 10, follow_k: int = 5, limit: int = 20, sources: list[str] | None = None) -> tuple[DataFrame, list[dict[str, object]]]:
    """R6, X5, X6, A12. Multi-hop search: sub-questions, then follow-ups while too little is known.
    Each hop is one job over the documents; what the loop holds is bounded by k and the rounds.
    Returns the merged hits and a trace of the hops."""
    spark, rows, trace, order = docs.sparkSession, [], [], 0

    def hop(query: str, top: int, round_: int) -> None:
        nonlocal order
        for hit in search(docs, embed(query), top, sources).select("chunk_id", "score").collect():
            rows.append((hit.chunk_id, hit.score, order, round_))
            order += 1
        trace.append({"query": query, "iteration": round_, "hits": sum(r[3] == round_ for r in rows)})

    for part in X.decompose(question):
        hop(part, k, 0)
    for round_ in range(1, max_iterations + 1):
        asked = X.follow_ups(question, len(rows))
        if not asked:
            break
        for query in asked:
            hop(query, follow_k, round_)
        strong = sum(r[1] > 0.7 for r in rows)
        if min(min(strong / 10, 0.9) + min(0.1 * round_, 0.2), 1.0) >= min_confidence:
            break
    kind = docs.schema["chunk_id"].dataType.simpleString()
    found = spark.createDataFrame(rows, f"chunk_id {kind}, score double, ord long, iteration int")
    return merge_hops(found).limit(limit), trace


def recursive_queries(docs: DataFrame, questions: DataFrame, embed: Callable[[DataFrame], DataFrame], max_iterations: int = 5, min_confidence: float = 0.7, k: int = 10, follow_k: int = 5, limit: int = 20, sources: list[str] | None = None) -> DataFrame:
    """R6, R12, X5, X6, A12 for a table of questions (question_id, question): what recursive_query gives for each,
    as question_id, chunk_id, score, rank and rounds. embed adds `vector` to a table with `query`.

    A state table holds, per question, the hits and the strong hits so far and whether it is open. A round is one blocked
    search for the follow-ups of all open questions, and an aggregation that closes those that know enough or
    have nothing to ask; the driver only learns whether any is open. Null questions, and ids that recur, are left out."""
    given = questions.where("question is not null and question_id is not null").groupBy("question_id").agg(F.min("question").alias("question"))
    docs = docs.where(F.col("source").isin(sources)) if sources else docs
    vectors = written(docs.where("embedding is not null").select(F.col("chunk_id").alias("id"), cells.unit(F.col("embedding")).alias("u")), "vectors")

    def hop(asked: DataFrame, top: int, round_: int) -> DataFrame:
        told = embed(asked).select(F.struct("question_id", "position").alias("query_id"), cells.unit(F.col("vector")).alias("q"))
        hits = cells.blocked_search(vectors, written(told, "asked"), top)
        return written(hits.select("query_id.question_id", F.col("id").alias("chunk_id"), "score", F.struct(F.lit(round_).alias("round"), "query_id.position", "rank").alias("ord")), "hop")

    def counted(hits: DataFrame) -> DataFrame:
        return hits.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.7).alias("m"))

    hits = hop(given.select("question_id", F.posexplode(X.decomposed(F.col("question"))).alias("position", "query")), k, 0)
    state = given.join(counted(hits), "question_id", "left").select("question_id", "question", F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("m", F.lit(0)).alias("strong"), F.lit(0).alias("rounds"), F.lit(True).alias("open"))
    for round_ in range(1, max_iterations + 1):
        state = written(state.withColumn("open", F.col("open") & (F.col("rows") < 5) & (F.size(X.followed_up(F.col("question"))) > 0)), "questions")
        asked = state.where("open").select("question_id", F.posexplode(X.followed_up(F.col("question"))).alias("position", "query"))
        if asked.isEmpty():
            break
        found = hop(asked, follow_k, round_)
        hits = hits.unionByName(found)
        more = state.join(counted(found), "question_id", "left")
        rows, strong = F.col("rows") + F.coalesce("n", F.lit(0)), F.col("strong") + F.coalesce("m", F.lit(0))
        sure = F.least(F.least(strong / 10, F.lit(0.9)) + min(0.1 * round_, 0.2), F.lit(1.0)) >= min_confidence
        state = more.select("question_id", "question", rows.alias("rows"), strong.alias("strong"), F.when(F.col("open"), round_).otherwise(F.col("rounds")).alias("rounds"), (F.col("open") & ~sure).alias("open"))
    merged = hits.groupBy("question_id", "chunk_id").agg(F.max_by("score", "ord").alias("score"), F.min("ord").alias("first"))
    best = W.partitionBy("question_id").orderBy(F.desc("score"), "first")
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.join(state.select("question_id", "rounds"), "question_id").select("question_id", "chunk_id", "score", "rank", "rounds")


def keyword_filter(chunks: DataFrame, keywords: list[str], match_all: bool = False, case_sensitive: bool = False, text_col: str = "content") -> DataFrame:
    """P8, P9. Chunks that match any, or all, of the patterns; an invalid pattern raises."""
    for k in keywords:
        re.compile(k)
    tests = [F.col(text_col).rlike(k if case_sensitive else f"(?i){k}") for k in keywords]
    return chunks.where(reduce((lambda a, b: a & b) if match_all else (lambda a, b: a | b), tests)) if tests else chunks


def prefilter(chunks: DataFrame, keywords: list[str], limit: int = 50) -> DataFrame:
    """P10. The most important chunks that hold a keyword; of all, if none does."""
    found = keyword_filter(chunks, keywords) if keywords else chunks
    found = chunks if keywords and found.isEmpty() else found
    return found.orderBy(F.desc("importance"), "chunk_id").limit(limit)


def union_distinct(variables: Mapping[str, DataFrame]) -> DataFrame:
    """U2. All rows of the variables whose names do not begin with an underscore, each id once."""
    kept = [df for name, df in variables.items() if not name.startswith("_")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept).dropDuplicates(["chunk_id"])


def controller(docs: DataFrame, question: str, embed: Embed, act: Callable[[str, dict[str, DataFrame]], dict[str, object]], k: int = 20, max_iterations: int = 10) -> dict[str, object]:
    """R12 (Q28). Search, then either answer at once (simple context) or let `act` (a model, or a
    rule) choose among peek, filter, chunk, search, store and answer, over named DataFrames. With n
    rounds at most n - 1 actions run."""
    env = {"context": search(docs, embed(question), k)}
    size = aggregates.complexity(env["context"]).first()
    steps: list[str] = []
    for round_ in range(max_iterations):
        if size.complexity == "simple" or round_ + 1 >= max_iterations:
            break
        choice = act(question, env)
        steps.append(choice["action"])
        if choice["action"] == "answer":
            return {"answer": choice.get("text"), "steps": steps, "results": union_distinct(env)}
        source = env.get(choice.get("variable", "context"), env["context"])
        if choice["action"] == "filter":
            pattern = choice["pattern"]
            env[choice["into"]] = source.where(F.col("content").rlike(f"(?i){pattern}")) if X.valid_pattern(pattern) else source.limit(0)
        elif choice["action"] == "search":
            env[choice["into"]] = search(docs, embed(choice["query"]), k)
        elif choice["action"] == "store":
            env[choice["into"]] = source
        elif choice["action"] == "peek":
            env[f"_{choice.get('into', 'peek')}"] = source.limit(int(choice.get("n", 5)))
    return {"answer": None, "steps": steps, "results": union_distinct(env)}


def tiered(query: str, categories: list[dict[str, object]], hits: DataFrame, max_items: int = 10, require_items: bool = False) -> dict[str, object]:
    """R5. Category summaries alone where they suffice, with items where they do not quite, else items."""
    texts = [c.get("summary") for c in categories]
    enough, why = X.sufficient(query, texts)
    if enough and not require_items:
        return {"tier": "summary", "reason": why, "summaries": texts, "items": None}
    items = hits.orderBy(F.desc("final_score"), "chunk_id").limit(max_items)
    return {"tier": "both" if categories else "items", "reason": why, "summaries": texts, "items": items}
