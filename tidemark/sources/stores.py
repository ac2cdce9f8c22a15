"""Stores that are single files (S1, S5, S6): chat databases and saved vector stores, several in one read. Each file is a
unit of work; files come through Spark's readers, so any store that Spark reads will do, up to the 2 GB of a binary value."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fields
from tidemark.sources.chats import BUBBLE, HEAD

# Fixed value: the table of a chat database.
TABLE = "cursorDiskKV"
#: Rows handed on at once.
ROWS = 1000
STORED = "store string, key string, value string, problem string"


def _stored(files: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    where = " OR ".join("(key >= ? AND key < ?)" for _ in prefixes) or "1"
    # a prefix as a range of keys, which the table's index answers
    bounds = [b for p in prefixes for b in (p, p[:-1] + chr(ord(p[-1]) + 1))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(store: str, found: list[tuple], problem: str | None = None) -> pa.RecordBatch:
            text = [v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(v) for _, v in found]
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([store] * n, pa.string()), pa.array([k for k, _ in found], pa.string()), pa.array(text, pa.string()), pa.array([problem] * n, pa.string())], names=["store", "key", "value", "problem"])

        for batch in batches:
            for i in range(len(batch)):
                store, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                base = sqlite3.connect(":memory:")
                try:
                    base.deserialize(content or b"")
                    cursor = base.execute(f"SELECT key, value FROM {TABLE} WHERE {where}", bounds)
                    # a store counts whole or not at all: damage may show only behind its first rows
                    if (told := base.execute("PRAGMA quick_check").fetchone()) != ("ok",):
                        raise sqlite3.DatabaseError(str(told))
                    while found := cursor.fetchmany(ROWS):
                        yield rows(store, found)
                except sqlite3.Error as e:
                    yield rows(store, [(None, None)], str(e)[:200])
                finally:
                    base.close()

    return files.select("path", "content").mapInArrow(read, STORED)


def key_values(files: DataFrame, prefixes: Sequence[str] = (HEAD, BUBBLE)) -> DataFrame:
    """S5, S6. store, key and value of chat databases (path, content), of keys with one of the prefixes: what `chats` reads. The
    prefixes are asked of the database itself. A damaged file gives no rows (see `damaged`)."""
    return _stored(files, prefixes).where("problem is null").drop("problem")


def damaged(files: DataFrame) -> DataFrame:
    """The databases that can't be read, and why: store, problem. Spark passes over files without a byte; they give no rows at all."""
    return _stored(files, (HEAD,)).where("problem is not null").select("store", "problem")


def files_at(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and content of all files below a folder whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_chat_stores(spark: SparkSession, path: str, glob: str = "*.vscdb", prefixes: Sequence[str] = (HEAD, BUBBLE)) -> DataFrame:
    """S5, S6. All chat databases below a folder in one read."""
    return key_values(files_at(spark, path, glob), prefixes)


def saved_documents(files: DataFrame) -> DataFrame:
    """S1. store, id, content, embedding and metadata (JSON text) of saved vector stores (path, content): each an object of documents
    by id. A file that is no JSON object counts as an empty store."""
    text = F.decode("content", "UTF-8")
    whole = files.select(F.col("path").alias("store"), fields.parsed(text).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = whole.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "id", "d"))
    return each.select("store", "id", fields.field(F.col("d"), "$.content").alias("content"), fields.field(F.col("d"), "$.embedding", "array<double>").alias("embedding"), F.to_json(fields.field(F.col("d"), "$.metadata", "variant")).alias("metadata"))
