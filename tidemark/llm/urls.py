"""URL filters over time: dated list entries become validity intervals, and an as-of join tells
for every capture which entries were active when it was fetched.

An entry says that a list adds or removes a host at a time; an entry on a host holds for its
subdomains. Intervals run from an addition to the next removal. The as-of join is an equi-join:
intervals are spread over the time buckets that they touch between the first and last capture,
a capture looks up each suffix of its host in the bucket of its fetch time, and exact times are
compared after that. A host with a third of all captures is so cut by time, and the join leaves
the rest of its skew to be split.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Days in a time bucket of the join.
BUCKET_DAYS = 16


def host_of(url: Column) -> Column:
    """The host of a URL: lower case, without user, port, or a dot at the end; null if there is none."""
    after = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(after, r"^.*@", ""), r"(:[0-9]*)?$", "")
    return F.nullif(F.rtrim(bare, F.lit(".")), F.lit(""))


def suffixes(host: Column, least: int = 1) -> Column:
    """A host and the domains above it, down to those of `least` labels."""
    labels = F.split(host, "\\.")
    places = F.when(F.size(labels) >= least, F.sequence(F.lit(1), F.size(labels) - least + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, host, valid_from and valid_to (exclusive, null while still listed) from dated entries
    with list, host, action (add or remove) and at. Repeated additions while listed and removals
    while not listed change nothing; of entries at one time the removal comes last. Entries with
    a null in a column are left out."""
    sound = entries.select("list", F.lower("host").alias("host"), "action", F.col("at").cast("timestamp").alias("at")).dropna().where(F.col("action").isin("add", "remove")).distinct()
    key = W.partitionBy("list", "host").orderBy("at", "action")
    turns = sound.withColumn("before", F.lag("action").over(key)).where(F.col("action") != F.coalesce("before", F.lit("remove")))
    return turns.withColumn("valid_to", F.lead("at").over(key)).where("action = 'add'").select("list", "host", F.col("at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def filter_urls(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, host, fetched_at, matches (an array of list:domain, sorted) and blocked, for every capture.

    A capture whose URL is null or has no host, or whose time is null, matches nothing. Repeated
    rows each return a row. Empty tables give no rows, or no matches. Entries may repeat, contradict
    or overlap; see validity_intervals. Further columns are not looked at.
    """
    day = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / 86400 / bucket_days)
    given = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    # captures of one host and time are alike: one row each goes through the join
    seen = given.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    span = seen.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).first()
    none = F.array().cast("array<string>")
    if span.a is None:
        return given.select(F.col("id").alias(id_col), "host", "fetched_at", none.alias("matches"), F.lit(False).alias("blocked"))
    low, high = F.lit(span.a), F.lit(span.b)
    active = validity_intervals(entries).where((F.col("valid_from") <= high) & (F.col("valid_to").isNull() | (F.col("valid_to") > low)))
    active = active.select("*", F.explode(F.sequence(day(F.greatest("valid_from", low)), day(F.least(F.coalesce("valid_to", high), high)))).alias("bucket")).withColumnRenamed("host", "domain")
    # no entry has fewer labels: top-level domains, which all captures share, are not looked up in vain
    least = active.agg(F.min(F.size(F.split("domain", "\\.")))).first()[0] or 1
    probes = seen.select("host", "fetched_at", day(F.col("fetched_at")).alias("bucket"), F.explode(suffixes(F.col("host"), least)).alias("domain"))
    met = probes.join(active.hint("merge"), ["domain", "bucket"]).where((F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    found = met.groupBy("host", "fetched_at").agg(F.sort_array(F.collect_set(F.concat("list", F.lit(":"), "domain"))).alias("matches"))
    out = given.join(found.hint("merge"), ["host", "fetched_at"], "left")
    return out.select(F.col("id").alias(id_col), "host", "fetched_at", F.coalesce("matches", none).alias("matches"), F.col("matches").isNotNull().alias("blocked"))
