"""What lies on disk while operators run: shuffle files and tables that are needed no more are gone."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.common import passing, scratch, shared_dir, table

DATA = "/root/testdata/sf0.001"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_write_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.collect_list("id").alias("ids"))
    with passing(spark):
        made = scratch(df, "grouped")  # the frame is held, so no collector of garbage takes its files
        for _ in range(50):
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
        assert made.count() == 7
    assert spark.conf.get(CLEANUP, None) == setting


def test_prefixes_are_kept_once(spark):
    """Of prefixes and bitmaps one table is left when the components are handed over: that of the classes."""
    docs, here = table(spark, DATA, "documents"), Path(shared_dir(spark).removeprefix("file://"))
    before = set(here.iterdir())
    with passing(spark):
        found = jaccard.linked_components(docs)
        assert sum("prefix" in spark.read.parquet(str(f)).columns for f in set(here.iterdir()) - before) == 1
        assert found.count() == docs.count()
