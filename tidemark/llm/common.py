"""Pieces that several operators share: words, reading tables, scratch tables, the model-file path."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator: space and the control characters tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"
#: The Mersenne prime 2^31 - 1; products of two residues fit a long.
PRIME = 2147483647


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, in order; an empty array where the text is null or has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR_RUN))


def packed(docs: DataFrame, **own: str) -> DataFrame:
    """The columns of docs that `own` names, under the names given, and all others as fields of one
    struct `rest`: whatever they are called, they clash with nothing that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own.values()]
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()], (F.struct(*rest) if rest else F.lit(0)).alias("rest"))


def unpacked(df: DataFrame, columns: list[str], **own: str) -> list[Column]:
    """The columns of a table that `packed` took apart, in their order."""
    names = {c: n for n, c in own.items()}
    return [(df[names[c]] if c in names else df["rest"].getField(c)).alias(c) for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the setting is absent,
    a local session gets a folder of its own; on a cluster that is an error, as executors would each
    write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        _at_exit(spark, found)
    return found


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that is no longer needed, if it is there."""
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(removed, spark, path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch tables made inside and removes them at its end, but for those to be kept,
    which fall to the block around it, or to the end of the driver. What is made outside, by this
    or another thread, stays. A result computed later must not read a table of a block that ended:
    write it with keep=True as the last thing inside."""
    around = _owner.get()
    own: list[str] = []
    token = _owner.set((own, around))
    try:
        yield
    finally:
        _owner.reset(token)
        for path in own:
            removed(spark, path)


def release() -> None:
    """Gives a Python worker's free memory back at the end of a task; workers wait long for others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Limits what is handed to a Python worker at once, for this session: texts may be long, and
    the default of 64 MB is held several times on the way."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextlib.contextmanager
def bounded(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """The same for what is written inside; the session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    bounded_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as each write ends, not when the driver happens to collect its
    garbage; the session's own setting comes back at the end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: The innermost block of `passing` here, and those around it.
_owner: contextvars.ContextVar[tuple[list[str], object] | None] = contextvars.ContextVar("owner", default=None)


def scratch(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again. Cuts the lineage:
    a lost executor costs a re-read, not the recomputation of what stands before. Its shuffle files go with the write. The table goes
    with the block of `passing` that it is made in, or with the one around that if it is to be kept;
    without such a block, when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    owner = _owner.get()
    if keep and owner is not None:
        owner = owner[1]
    if owner is None:
        _at_exit(spark, path)
    else:
        owner[0].append(path)
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
