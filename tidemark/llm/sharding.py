"""Sharding: a Feistel permutation of global row numbers gives a reproducible shuffle in which a
row's shard and slot are computed, not drawn.

Rows get gapless global numbers without a global sort: rows that agree in all columns are counted
as one group, groups fall into a fixed number of buckets by a hash of their content, a bucket's
offset is the sum of the buckets before it, and a window numbers the groups within each bucket.
The permutation p of row number r gives shard p mod n and slot p div n, so shard sizes differ by
one row at most and slots have no gaps.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import PRIME, packed, scratch, unpacked
from tidemark.llm.feistel import div, permute

#: Buckets of the numbering; bounds the offsets table that is broadcast.
BUCKETS = 4096
N_SHARDS = 16
KEY = 20240601


def number_rows(groups: DataFrame, order: list[str], id_col: str, crc_col: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds first_row, the global number of each group's first copy, and n_rows, the total.
    groups has a row per distinct row and its number of copies in `copies`."""
    salt = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    groups = groups.withColumn("bucket", ((salt * 48271 + F.col(crc_col)) % PRIME % buckets).cast("int"))
    groups = scratch(groups, "row-groups")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.groupBy("bucket").agg(F.sum("copies").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(W.partitionBy()).alias("n_rows")
    )
    inside = W.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    return (
        groups.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("first_row", F.col("offset") + F.col("inside"))
        .drop("bucket", "inside", "offset")
    )


def _row_hash(docs: DataFrame, text_col: str) -> Column:
    """Hash of a row's columns; maps can't be hashed and are left out."""
    hashed = [F.col(f"`{n}`") for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind and n != text_col]
    return F.xxhash64(F.col(text_col), *hashed)


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 1), text_crc32, row_hash (of
    all columns), row_number, position (its place in the shuffle), shard and slot.

    A null text has size 1 and checksum 0; a null id is an ordinary value. Repeated rows each get
    a slot of their own. An empty table gives no rows. Further columns only enter row_hash (map
    columns are left out); names that clash with the outputs do no harm, as only the id and the
    text are carried on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        _row_hash(docs, text_col).alias("row_hash"),
    )
    columns = ["id", "text_crc32", "size", "row_hash"]
    numbered = number_rows(base.groupBy(*columns).agg(F.count("*").alias("copies")), columns, "id", "text_crc32", buckets)
    copies = numbered.select("*", F.explode(F.sequence(F.col("first_row"), F.col("first_row") + F.col("copies") - 1)).alias("row_number"))
    placed = copies.withColumn("position", permute(F.col("row_number"), F.col("n_rows"), key))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "row_hash", "row_number", "position",
        (F.col("position") % n_shards).cast("int").alias("shard"), div(F.col("position"), n_shards).alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, and their shard and slot, ready to be written with
    partitionBy("shard") and sorted by slot. Rows meet their places by a hash of all their columns
    but maps; a row that occurs n times takes n places.

    A null text or id is an ordinary value. Repeated rows, and rows that differ in a map only, each
    get a place of their own. An empty table gives no rows. Columns named shard or slot are replaced;
    all others stay, whatever their names and kinds.
    """
    own = {"id": id_col, "text": text_col}
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    places = assign_shards(docs, n_shards, key, id_col, text_col).select(F.col(id_col).alias("id"), "row_hash", F.col("text_crc32").alias("crc"), "shard", "slot")
    number = lambda by: (F.row_number().over(W.partitionBy("id", "row_hash", "crc").orderBy(by))).alias("copy")
    places = places.select("*", number("slot"))
    given = packed(docs.select("*", _row_hash(docs, text_col).alias("the row's hash")), **own, row_hash="the row's hash")
    given = given.withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    given = given.select("*", number(F.lit(0)))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) if c == "id" else F.col(f"d.{c}") == F.col(f"p.{c}") for c in ("id", "row_hash", "crc", "copy")]
    joined = given.alias("d").join(places.alias("p"), same[0] & same[1] & same[2] & same[3]).select("d.*", "p.shard", "p.slot")
    return joined.select(*unpacked(joined, columns, **own), "shard", "slot")
