"""Metadata of any shape as VARIANT (X31, K6): parsed once, asked by path, listed with all its paths, merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import written


def _sound(json: Column) -> Column:
    """Whether a text is JSON from its beginning to its end: the parser stops after the first value, so what follows shows
    only inside a list, or an object, round the text."""
    return F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), json, F.lit("}"))).isNotNull()


def parsed(json: Column) -> Column:
    """X31. A JSON text as VARIANT; null for null, and for what is no JSON. (Where the two differ, see `broken`.)"""
    return F.when(_sound(json), F.try_parse_json(json))


def broken(json: Column) -> Column:
    """Whether there is a text that is no JSON, or names a key twice in an object."""
    return json.isNotNull() & ~_sound(json)


def field(value: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path ($.a.b[0]) as a type; null where there is none, or it is not of that type."""
    return F.try_variant_get(value, path, kind)


def leaves(df: DataFrame, id_col: str, json_col: str, depth: int = 16) -> DataFrame:
    """X31. One row per id and path that holds no object or list with entries: path, kind (its type) and value (its JSON
    text, a string without quotes). A text that is no JSON is one row of path $ and kind BROKEN with the
    text itself; null gives none. An empty object or list is a row. Below `depth` levels a rest is one row of its JSON."""
    given = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("text")).where("text is not null")
    v = F.col("v")
    out = given.where(broken(F.col("text"))).select("id", F.lit("$").alias("path"), F.lit("BROKEN").alias("kind"), F.col("text").alias("value"))
    level = given.select("id", F.lit("$").alias("path"), parsed(F.col("text")).alias("v")).where("v is not null")
    for step in range(depth + 1):
        typed = written(level.withColumn("kind", F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)), "level")
        filled = F.col("kind").isin("OBJECT", "ARRAY") & ~F.to_json(v).isin("{}", "[]") & F.lit(step < depth)
        text = F.when(F.col("kind") == "VOID", "null").when(F.col("kind").isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
        out = out.unionByName(typed.where(~filled).select("id", "path", "kind", text.alias("value")))
        deeper = typed.where(filled)
        if deeper.isEmpty():
            break
        inside = deeper.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "entry"))
        part = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = inside.select("id", F.concat("path", part).alias("path"), F.col("entry").alias("v"))
    return out


def _members(df: DataFrame, id_col: str, json_col: str, order: int) -> DataFrame:
    given = df.select(F.col(id_col).alias("id"), parsed(F.col(json_col)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    inside = given.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "entry"))
    return inside.select("id", "key", F.to_json("entry").alias("entry"), F.lit(order).alias("place"))


def merged(old: DataFrame, new: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """K6. Metadata after an update that names some of its keys: those come from `new`, others stay, JSON nulls included.
    Ids of either side; what is no object counts as empty. Keys come in order."""
    both = _members(old, id_col, json_col, 0).unionByName(_members(new, id_col, json_col, 1))
    last = both.groupBy("id", "key").agg(F.max_by("entry", "place").alias("entry"))
    quoted = lambda key: F.substr(F.to_json(F.array(key)), F.lit(2), F.length(F.to_json(F.array(key))) - 2)
    text = F.transform(F.sort_array(F.collect_list(F.struct("key", "entry"))), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["entry"]))
    found = last.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("json"))
    ids = old.select(F.col(id_col).alias("id")).unionByName(new.select(F.col(id_col).alias("id"))).distinct()
    return ids.join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("json", F.lit("{}")).alias(json_col))
