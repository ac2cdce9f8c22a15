"""Decay and ranking scores (N3-N10, N12-N17) as Column expressions. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as C

DAY_MICROS = 86_400_000_000.0


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_MICROS)


def age_factor(now: Column, created_at: Column, half_life: float = C.HALF_LIFE_DAYS) -> Column:
    """N3."""
    return 1 / (1 + days_between(now, created_at) / half_life)


def access_factor(now: Column, access_count: Column, last_accessed_at: Column) -> Column:
    """N4."""
    base = F.least(F.lit(1.0), access_count / C.EXPECTED_ACCESSES)
    since = days_between(now, last_accessed_at)
    boosted = F.least(F.lit(1.0), base * (1 + (C.RECENCY_FACTOR - 1) * (1 - since / C.RECENCY_DAYS)))
    return F.when(last_accessed_at.isNotNull() & (since <= C.RECENCY_DAYS), boosted).otherwise(base)


def decay_score(now: Column, created_at: Column, access_count: Column, last_accessed_at: Column, importance: Column, weights: tuple[float, float, float] = C.DECAY_WEIGHTS) -> Column:
    """N5, clamped to 0..1."""
    score = weights[0] * age_factor(now, created_at) + weights[1] * access_factor(now, access_count, last_accessed_at) + weights[2] * importance
    return clamped(score)


def clamped(x: Column) -> Column:
    """P11."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def three_signals(similarity: Column, decay: Column, importance: Column, weights: tuple[float, float, float] = C.THREE_WEIGHTS) -> Column:
    """N7."""
    return weights[0] * similarity + weights[1] * decay + weights[2] * importance


def recency_score(now: Column, last_accessed_at: Column) -> Column:
    """N9."""
    return F.when(last_accessed_at.isNull(), 0.0).otherwise(1 / (1 + days_between(now, last_accessed_at) / C.RECENCY_DAYS))


def type_boost(chunk_type: Column, preferred: list[str] | None = None) -> Column:
    """N10."""
    known = F.create_map(*[F.lit(x) for pair in C.TYPE_BOOSTS.items() for x in pair])
    boost = F.coalesce(F.try_element_at(known, chunk_type), F.lit(1.0))
    return boost * F.when(chunk_type.isin(preferred), C.PREFERRED_FACTOR).otherwise(1.0) if preferred else boost


def six_signals(similarity: Column, decay: Column, importance: Column, recency: Column, graph: Column, boost: Column) -> Column:
    """N8."""
    w = C.SIX_WEIGHTS
    return (
        w["similarity"] * similarity + w["decay"] * decay + w["importance"] * importance
        + w["recency"] * recency + w["graph"] * graph + w["type"] * (boost - 1)
    )


def jaccard(a: Column, b: Column) -> Column:
    """N12. Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    """N14 (and the fallback of N15): a quarter of the length, rounded up."""
    return F.ceil(F.length(text) / 4)


def cost_estimate(chars_in: Column, chars_out: Column, in_per_million: float = 0.15, out_per_million: float = 0.60) -> Column:
    """N13."""
    return chars_in / 4 * in_per_million / 1e6 + chars_out / 4 * out_per_million / 1e6


def rounded(x: Column) -> Column:
    """Half up for either sign (Q34)."""
    return F.floor(x + 0.5)


def promoted(importance: Column, step: float = 0.05) -> Column:
    """N17."""
    return F.least(F.lit(1.0), importance + step)


def simulate_decay(items: DataFrame, days: int, accesses: DataFrame) -> DataFrame:
    """N6. item, day and score for days 0..days: the decay of items (item, importance) created on day
    0, with accesses (item, day) counted as they come."""
    daily = accesses.groupBy("item", "day").agg(F.count("*").alias("n"))
    grid = items.select("item", "importance", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("day"))
    run = W.partitionBy("item").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    seen = grid.join(daily, ["item", "day"], "left").withColumns({
        "count": F.coalesce(F.sum("n").over(run), F.lit(0)), "last": F.max(F.when(F.col("n") > 0, F.col("day"))).over(run),
    })
    start = F.timestamp_seconds(F.lit(0))
    at = lambda d: F.timestamp_seconds(d * 86400)
    return seen.select("item", "day", decay_score(at(F.col("day")), start, F.col("count"), at(F.col("last")), F.col("importance")).alias("score"))


def explain(row: dict[str, float]) -> str:
    """N18. A score's parts as text."""
    w = C.SIX_WEIGHTS
    parts = [f"{name}: {row[name]:.3f} x {w[name]:.2f} = {row[name] * w[name]:.3f}" for name in w if name in row]
    return f"final {row['final_score']:.3f}\n" + "\n".join(parts)


def score_parts(scored: DataFrame, signals: dict[str, str], weights: dict[str, float] = C.SIX_WEIGHTS) -> DataFrame:
    """N18 over a table: a row per chunk and part of its score with weight, value and contribution.
    signals: the column of each part; the type counts by what its boost adds."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(w).alias("weight"), (F.col(signals[p]) - (1.0 if p == "type" else 0.0)).alias("value")) for p, w in weights.items()])
    each = scored.select("chunk_id", F.explode(parts).alias("s")).select("chunk_id", "s.*")
    return each.withColumn("contribution", F.col("weight") * F.col("value"))
