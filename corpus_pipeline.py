"""The training-data pipeline over documents: quality rules, near-duplicate removal, substring
dedup, mixing by source, and packing. Every stage writes its rows as Parquet in the shared folder and
returns them read again, so a lost executor costs a part of one stage, and the tables made on the way
are removed with the end of the stage that made them. A stage's own table is there for the next one: when
that has ended, and the frame that the stage returned is held no more, the stage after it removes it as it begins, unless
it reads it. Who holds on to a frame made from that one must hold that one too.

All stages take nulls in any column: a null, empty or blank text fails the quality rules, so the later
stages see it only when called by themselves, where it stays through dedup, is taken by no mix (it has
no words) and packs as the end id alone. Repeated rows are near copies of one another, of which one
stays; in the mix and the packing they are documents of their own. An empty table gives an empty
table. Texts are read whole. Columns besides those of documents go through all stages but the last."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, quality, substrings
from tidemark.llm.common import passing, removed, scratch, table

#: What the stages of every session have written and not yet removed: the stage's place, its frame and the folder.
_tables: list[tuple[int, weakref.ref[DataFrame], str]] = []


def _written(spark: SparkSession, name: str, docs: DataFrame, rows: Callable[[], DataFrame]) -> DataFrame:
    """A stage's rows as a table, without the tables that they were made from. Tables of stages before the last one
    that nobody holds, and docs does not read, are removed first."""
    place = [n for n, _ in STAGES].index(name)
    read = {f.rpartition("/")[0] for f in docs.inputFiles()}
    for old in [t for t in _tables if t[0] < place - 1 and t[1]() is None and t[2] not in read]:
        _tables.remove(old)
        removed(spark, old[2])
    with passing(spark):
        made = scratch(rows(), name, keep=True)
    for file in made.inputFiles()[:1]:
        _tables.append((place, weakref.ref(made), file.rpartition("/")[0]))
    return made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; trusted are those labelled quality 1. Null, empty
    and short texts go; repeated rows share a verdict."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _written(spark, "quality_rules", docs, lambda: quality.kept_documents(docs, trusted))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard of 0.8 or more): that
    with the smallest id. Texts without words are nobody's copies and stay."""
    return _written(spark, "ngram_jaccard", docs, lambda: jaccard.one_of_each(docs).select(*docs.columns))


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where it is a column, as the length of the text that is left."""
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs).select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words in 35-word windows that start anywhere else. All documents
    stay, one that loses all its words with an empty text."""
    return _written(spark, "substring_dedup", docs, lambda: _with_length(substrings.dedup_substrings(docs), docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents: a row for each pass that takes words of one, none for a
    text without words. A null source is a source of its own."""
    return _written(spark, "source_mixing", docs, lambda: _with_length(mixing.mixed_documents(docs), docs.columns))


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids packed into sequences, a row per piece; a null or empty text is the
    end id alone."""
    return _written(spark, "lexical_packing", docs, lambda: packing.pack_documents(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("lexical_packing", lexical_packing),
]
#: SQL can express neither the recompression, the random draws nor the tokenizer; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
