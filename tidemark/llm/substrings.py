"""Exact substring dedup by recompression.

Recompression (see recompress.py) parses every text into symbols named by content, and each window
of `window` words is put under one symbol that the window alone determines, so that equal windows
have the same symbol at the same place. The symbol with CONTEXT words on either side is the
window's signature. Signatures that occur once reveal that none of their windows repeats. For the
others, the stretch that all windows of a symbol cover is compared by a 128-bit hash: where it
occurs again, all its windows do. What remains, the ends of repeats, is decided window by window
in the same manner, against one copy of each stretch found whole.

About one row per ten words is written and shuffled for the signatures, and the texts themselves twice:
to the ranges that are looked at window by window, and to what is removed.
Hot keys (a signature, window or text that many rows share) are never dealt to one task: keys with more
than 1/20,000 of the rows, hence at most 20,000, are broadcast and their rows stay where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, packed, passing, release, scratch, unpacked, words
from tidemark.llm.recompress import CONTEXT, LONGEST, Hasher, anchors

WINDOW = 35
#: Words that a worker parses at once.
PART_WORDS = 150_000
KEY = ["k1", "k2"]
#: A key is hot with more rows than HOT_ROWS and than all rows / HOT_KEYS.
HOT_ROWS = 1000
HOT_KEYS = 20_000


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch in parts of bounded size: rows, both hashes of all words, and the place of each text's
    first word."""
    place = batch.schema.get_field_index("w")
    ends = batch.column(place).offsets.to_numpy()
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_WORDS, side="right")) - 1)
        part = batch.slice(at, to - at)
        held = part.column(place).flatten()
        first = ends[at : to + 1].astype(np.int64) - ends[at]
        yield part, *(held.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)), first
        at = to


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents with k1 and k2, a 128-bit key of the text that copies share."""
    return docs.withColumns({"k1": F.xxhash64(text_col), "k2": F.xxhash64(F.lit("other"), text_col)})


def _hashed(text_col: str) -> Column:
    """Two hashes of every word, of which no one follows from the other."""
    return F.transform(words(F.col(text_col)), lambda w: F.struct(F.xxhash64(w), F.xxhash64(F.lit("other"), w))).alias("w")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """Rows sig, k1, k2, first, last, u1, u2: each symbol that names windows, the first and last of
    them, and a hash of all the words they cover. sig is null for windows of long runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, others, first in _parts(batch):
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                one, two = Hasher(hashes), Hasher(others, 1)
                start, end, low, high = anchors(hashes, doc, first, window, one)
                known = start >= 0
                sig = np.zeros(len(start), np.uint64)
                sig[known] = one(start[known] - CONTEXT, end[known] + CONTEXT)
                row = doc[low] if len(low) else low
                offset = first[:-1][row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(sig.view(np.int64), mask=~known), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                    pa.array((low - offset).astype(np.int32)), pa.array((high - offset).astype(np.int32)), _signed(one(low, high + window)), _signed(two(low, high + window)),
                ], ["sig", *KEY, "first", "last", "u1", "u2"])
        release()

    given = docs.select(*KEY, _hashed(text_col))
    return given.mapInArrow(work, "sig long, k1 long, k2 long, first int, last int, u1 long, u2 long")


def window_hashes(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """Rows u1, u2, k1, k2, first, weight: the hash of every window in the ranges of a text. docs
    has ranges, an array of (first, last, weight)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, others, first in _parts(batch):
                spans = part.column(part.schema.get_field_index("ranges"))
                row = np.repeat(np.arange(len(part)), np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                low, high, weight = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                lengths = high - low + 1
                place = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                row = np.repeat(row, lengths)
                at = place + first[row]
                one, two = Hasher(hashes), Hasher(others, 1)
                yield pa.RecordBatch.from_arrays([
                    _signed(one(at, at + window)), _signed(two(at, at + window)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                    pa.array(place.astype(np.int32)), pa.array(np.repeat(weight, lengths).astype(np.int32)),
                ], ["u1", "u2", *KEY, "first", "weight"])
        release()

    given = docs.select(*KEY, _hashed(text_col), "ranges")
    return given.mapInArrow(work, "u1 long, u2 long, k1 long, k2 long, first int, weight int")


def _frequent(counts: DataFrame, key: list[str]) -> DataFrame:
    """The hot ones of a table of keys with their counts n. There are at most HOT_KEYS, as each has
    more than that part of all rows: they may be broadcast. A row for a key of zeros, with n null
    unless that is hot, keeps the plan the same where nothing is hot."""
    limit = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    zeros = counts.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(k) for k in key], F.lit(None).cast("long").alias("n"))
    return F.broadcast(counts.where(F.col("n") > limit).select(*key, "n").unionByName(zeros).groupBy(*key).agg(F.max("n").alias("n")))


def _times(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a written table with n, how often their key occurs; null for once. Rows with a hot
    key get it by broadcast, the others by a join in which no key is hot."""
    counts = scratch(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "times")
    split = rows.join(_frequent(counts, key), key, "left")
    rest = split.where("n is null").drop("n").join(counts.hint("merge"), key, "left")
    return split.where("n is not null").unionByName(rest)


def repeated_spans(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """k1, k2 and spans, a sorted array of (first, end) in words: all words of a text that lie in a
    window whose words also start elsewhere. docs has k1 and k2, and one row at least of each text."""
    spark = docs.sparkSession
    with passing(spark):
        with passing(spark):
            signed = scratch(signatures(docs, window, text_col), "signed")
            named = _times(signed.where("sig is not null"), ["sig"]).where("n is not null")
            shared = scratch(named.unionByName(signed.where("sig is null").withColumn("n", F.lit(None).cast("long"))).withColumnRenamed("n", "sig_n"), "shared", keep=True)
        marked = scratch(_times(shared, ["u1", "u2"]).withColumn("sig", F.coalesce("sig", F.lit(0))), "stretches", keep=True)
    whole, rest = marked.where("n is not null"), marked.where("n is null")
    found = whole.select(*KEY, "first", (F.col("last") + window).alias("end")).distinct()
    # windows of the rest are looked up among themselves and in one copy of each stretch found
    # whole that has their signature; such a copy stands for two. For a hot signature, all that is
    # found whole is looked at, without asking whether the rest has it too
    one_copy = whole.groupBy("u1", "u2").agg(F.min(F.struct(*KEY, "first", "last", "sig", "sig_n")).alias("s")).select("s.*")
    busy = F.coalesce(F.col("sig_n") > HOT_ROWS, F.lit(True))
    one_copy = one_copy.where(busy).unionByName(one_copy.where(~busy).join(rest.where(~busy).select("sig").distinct().hint("merge"), "sig", "left_semi").select(*one_copy.columns))
    looked = rest.select(*KEY, "first", "last", F.lit(1).alias("weight")).unionByName(one_copy.select(*KEY, "first", "last", F.lit(2).alias("weight")))
    looked = looked.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "weight")).alias("ranges"))
    # of a text with copies only stretches found whole are looked up, and one copy will do; the join has
    # brought copies together
    met = docs.join(looked.hint("merge"), KEY).dropDuplicates(list(KEY))
    each = scratch(window_hashes(met, window, text_col), "windows")
    ends = _again(each).select(*KEY, "first", (F.col("first") + window).alias("end"))
    return found.unionByName(ends).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))


def _again(each: DataFrame) -> DataFrame:
    """The windows of weight 1 whose words occur again, rows with hot words apart."""
    key = ["u1", "u2"]
    counts = scratch(each.groupBy(*key).agg(F.sum("weight").alias("n"), F.min("weight").alias("least")).where("n > 1 and least = 1").select(*key, "n"), "times")
    split = each.where("weight = 1").join(_frequent(counts, key), key, "left")
    rest = split.where("n is null").drop("n").join(counts.select(*key).hint("merge"), key, "left_semi")
    return split.where("n is not null").drop("n").unionByName(rest)


def _kept(w: Column, spans: Column) -> Column:
    """The words outside the sorted spans."""
    step: Callable[[Column, Column], Column] = lambda s, r: F.struct(
        F.greatest(s["at"], r["end"]).alias("at"),
        F.when(r["first"] > s["at"], F.concat(s["keep"], F.array(F.struct(s["at"].alias("low"), r["first"].alias("high"))))).otherwise(s["keep"]).alias("keep"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<low:int,high:int>>").alias("keep"))
    held = F.aggregate(spans, start, step, lambda s: F.concat(s["keep"], F.array(F.struct(s["at"].alias("low"), F.size(w).alias("high")))))
    return F.flatten(F.transform(held, lambda r: F.slice(w, r["low"] + 1, r["high"] - r["low"])))


def with_spans(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """The documents with k1, k2 and spans, null where nothing is removed. All words of a text that
    occurs again are repeated; so the copies of hot texts need no look-up, and one of each stands for
    them where others are compared."""
    if window < 2 * CONTEXT + 2 * LONGEST:
        raise ValueError(f"window must have at least {2 * CONTEXT + 2 * LONGEST} words")
    bounded_batches(docs.sparkSession)
    given, there = keyed(docs, text_col), F.col(text_col).isNotNull()
    counts = scratch(given.where(there).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"), "texts")
    split = given.join(_frequent(counts, KEY), KEY, "left")
    cold, copies = split.where(F.col("n").isNull() & there).drop("n"), split.where(F.col("n").isNotNull() | ~there).drop("n")
    one = scratch(copies.where(there).select(*KEY, text_col).dropDuplicates(), "hot-texts")
    known = cold.select(*KEY, text_col).unionByName(one).unionByName(one)
    found = cold.join(repeated_spans(known, window, text_col).hint("merge"), KEY, "left")
    n_words = F.size(words(F.col(text_col)))
    whole = F.when(n_words >= window, F.array(F.struct(F.lit(0).alias("first"), n_words.alias("end"))))
    return found.unionByName(copies.withColumn("spans", whole))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents with the words left as their text, and n_removed. Every word in a window of
    `window` words that starts anywhere else is removed, all copies alike; windows are judged on
    the input. The words left are joined by one space; a text that loses nothing stays as it is.

    A null text stays null, an empty one empty; both lose nothing. Texts of any length are taken
    whole. Repeated rows of at least `window` words lose all their words, as each window occurs
    again. An empty table gives no rows. Further columns stay, whatever their names, but for one
    named n_removed, which is replaced.
    """
    own = {"text": text_col}
    found = with_spans(packed(docs, **own), window, "text")
    same = F.col("spans").isNull()
    out = found.withColumn("w", words(F.col("text"))).withColumn("kept", F.when(same, F.col("w")).otherwise(_kept(F.col("w"), F.col("spans"))))
    out = out.withColumns({"n_removed": (F.size("w") - F.size("kept")).cast("long"), "text": F.when(same, F.col("text")).otherwise(F.array_join("kept", " "))})
    return out.select(*unpacked(out, [c for c in docs.columns if c != "n_removed"], **own), "n_removed")


def dedup_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (of the words left, joined by one space) of every
    document, as dedup_substrings leaves it."""
    found = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window, "text")
    found = found.select("id", "spans", words(F.col("text")).alias("w"))
    found = found.select("id", "w", F.when(F.col("spans").isNull(), F.col("w")).otherwise(_kept(F.col("w"), F.col("spans"))).alias("kept"))
    return found.select(
        F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"), (F.size("w") - F.size("kept")).cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept", " "), 256).alias("kept_sha256"),
    )
