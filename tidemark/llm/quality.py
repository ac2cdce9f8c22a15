"""Quality rules: a hashed n-gram log-likelihood ratio between two multinomials, one of trusted
target documents and one of the raw corpus, normalised by length, decides every document against
a fixed threshold, after plain rules on words, symbols and repetition.

Features are the unigrams and bigrams of lower-cased runs of letters, digits and underscores, and
of runs of other visible characters, hashed to a fixed number of buckets. The model is one number
per bucket, log((target + s) / (target total + s * buckets)) - log((raw + s) / ...), kept in whole
millionths so that sums agree whatever the order. A document's score is the mean over its n-grams.

Native: DataFrame functions only. Two passes over the texts, no shuffle of texts: the first counts
buckets (map-side combined), the second scores in place with the model as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PRIME, SEPARATORS, packed, unpacked, words

BUCKETS = 10_000
SMOOTHING = 1.0
#: Trusted rows the target multinomial is fitted on, at most: those with the smallest hashed ids.
MAX_TRUSTED = 200_000
#: Mean log-likelihood ratio, in millionths per n-gram, that a document must reach.
THRESHOLD = -250_000
FEATURE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def feature_hashes(text: Column) -> Column:
    """Checksums of the features of a text, in order."""
    features = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(FEATURE), F.lit(0))
    return F.transform(features, lambda f: F.crc32(f))


def gram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the unigrams, then of the bigrams, of a column of feature checksums."""
    n = F.size(hashes)
    ones = F.transform(hashes, lambda h: (h % buckets).cast("int"))
    twos = F.zip_with(
        F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: ((a * 1000003 + b) % PRIME % buckets).cast("int"),
    )
    return F.concat(ones, twos)


def fit_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED, id_col: str = "doc_id", text_col: str = "text") -> list[int] | None:
    """The model: millionths of log-likelihood ratio by bucket, or None where no trusted document
    has a feature. trusted has the ids of target documents (repeats and nulls do no harm); at most
    max_trusted of them, those with the smallest hashed ids, are used, so the broadcast is bounded.
    The raw counts cover every document. Returns one number per bucket to the driver."""
    chosen = trusted.select(F.col(id_col).alias("_trusted")).where("_trusted is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("_trusted"), "_trusted").limit(max_trusted)
    hashes = docs.select(F.col(id_col).alias("_id"), feature_hashes(F.col(text_col)).alias("h"))
    flagged = hashes.join(F.broadcast(chosen), F.col("_id") == F.col("_trusted"), "left")
    grams = flagged.select(F.col("_trusted").isNotNull().cast("int").alias("target"), F.explode(gram_buckets(F.col("h"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    if not sum(target):
        return None
    lead = math.log(sum(raw) + smoothing * buckets) - math.log(sum(target) + smoothing * buckets)
    return [math.floor(1e6 * (math.log(t + smoothing) - math.log(r + smoothing) + lead) + 0.5) for r, t in zip(raw, target, strict=True)]


def _repeated(values: Column, same: str) -> Column:
    """Entries of a sorted array of structs whose field `same` equals a neighbour's."""
    return F.filter(
        values,
        lambda e, i: F.coalesce(F.get(values, i - 1)[same] == e[same], F.lit(False)) | F.coalesce(F.get(values, i + 1)[same] == e[same], F.lit(False)),
    )


def with_base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to the documents, which
    must not have these names. Windows of words are compared by hash first, and windows whose
    hashes meet are compared as text, so the count is exact."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SEPARATORS)) != "")
    df = docs.withColumns({"_w": words(F.col(text_col)), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(bare)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_g": F.when(F.size("_w") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)])
        )).otherwise(F.array().cast("array<bigint>")),
    })
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(none))
    df = df.withColumn("_m", _repeated(F.col("_s"), "h"))
    df = df.withColumn("_t", F.sort_array(F.transform("_m", lambda e: F.struct(F.array_join(F.slice(F.col("_w"), e["i"] + 1, F.lit(WINDOW)), " ").alias("g"), e["i"].alias("i")))))
    df = df.withColumn("_p", F.sort_array(F.transform(_repeated(F.col("_t"), "g"), lambda e: e["i"])))
    gaps = F.zip_with(
        F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))),
        lambda later, first: F.least(later - first, F.lit(WINDOW)),
    )
    covered = F.when(F.size("_p") == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g))
    return df.withColumn("n_repeat_words", _fixed(covered.cast("long"))).drop("_w", "_lines", "_g", "_s", "_m", "_t", "_p")


def _fixed(c: Column) -> Column:
    """The column, tied to something that is no function of the row: so the optimizer does not move
    a filter on it below the projections, where every count would be inlined for each of its uses."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def kept_documents(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The documents that quality_verdicts keeps, with their own columns, whatever their names."""
    own = {"id": id_col, "text": text_col}
    given = packed(docs, **own)
    found = quality_verdicts(given, trusted.withColumnRenamed(id_col, "id"), id_col="id", text_col="text", **options).where("kept")
    return found.select(*unpacked(found, docs.columns, **own))


def quality_verdicts(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the base counts, base_failed, n_grams, score (mean ratio in millionths,
    null without n-grams or model), and kept.

    base_failed: under 10 words, or over 20 % of the words in 5-word windows that occur twice or
    more. kept: false if base_failed, else score_sum >= threshold * n_grams in whole numbers; a
    document without n-grams or a corpus without trusted documents is decided by the base rules.
    A null or empty text fails the base rules. Repeated rows are decided alike and each returned.
    An empty table gives no rows. Input columns named like an output are replaced.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "score", "kept", "_w", "_lines", "_g", "_s", "_m", "_t", "_p", "_h", "_b", "_sum"}
    df = docs.drop(*[c for c in docs.columns if c in added])
    ratios = fit_ratios(df, trusted, buckets, smoothing, max_trusted, id_col, text_col)
    df = with_base_counts(df, text_col)
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    if ratios is None:
        return df.withColumns({"n_grams": F.lit(0).cast("long"), "score": F.lit(None).cast("double"), "kept": _fixed(~F.col("base_failed"))})
    model = F.from_json(F.lit(str(ratios)), "array<bigint>")
    df = df.withColumn("_h", feature_hashes(F.col(text_col))).withColumn("_b", gram_buckets(F.col("_h"), buckets))
    df = df.withColumns({"n_grams": F.size("_b").cast("long"), "_sum": F.aggregate("_b", F.lit(0).cast("long"), lambda s, b: s + F.get(model, b))})
    return df.withColumns({
        "score": F.when(F.col("n_grams") > 0, F.col("_sum") / F.col("n_grams")),
        "kept": _fixed(~F.col("base_failed") & ((F.col("n_grams") == 0) | (F.col("_sum") >= threshold * F.col("n_grams")))),
    }).drop("_h", "_b", "_sum")
