"""Texts, vectors and tables on which a query and its SQL were once apart."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_rounds import loop_kmeans
from tidemark.functions import text as X
from tidemark.operators import rules, topics


def compared(spark, tmp_path, name, **given):
    """Rows of a query and of its SQL over tables given as rows and schema."""
    con = duckdb.connect()
    for table, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"select {columns} from ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=str)


def test_outdated_refs_by_the_signs_of_its_sql(spark, tmp_path):
    texts = ["seit 2005 so", "the year 2005", "legacy, we migrat soon", "nichts", None, "obsolete in 2005", "says the, deprecated"]
    rows = [(i + offset, t) for offset in (0, 400) for i, t in enumerate(texts)]
    got, wanted = compared(spark, tmp_path, "outdated_refs", documents=(rows, "doc_id long, text string"))
    assert got == wanted
    assert 0 not in {g[0] for g in got} and (2, 0.5) in got and (400, 0.4) in got


def test_extracted_knowledge_names_letters_without_a_single_capital(spark, tmp_path):
    asked = ["ßtük größe wörter", "ᾳbcd ﬁxen ΐota", "ŉabc ΑΒΓΣ İÜĞŞ", "eins\x0bzwei drei", "ǆabc ᾀbcd straSSE"]
    answer = "so\n```py\n" + "x" * 60 + "\n```"
    rows = [(4 * i + 3, t, *said) for i, q in enumerate(asked) for t, said in enumerate([("user", q), ("assistant", answer)])]
    got, wanted = compared(spark, tmp_path, "extracted_knowledge", conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert len(got) == len(asked) and got == wanted


def test_upper_and_lower_one_by_one_as_duckdb(spark):
    con = duckdb.connect()
    letters = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in "ƛɤᲉᲊꟋꟌꟍꟚꟛꟜ"]  # newer than DuckDB's table
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", X.upper_one(F.col("c")), X.lower_one(F.col("c"))).collect()
    wanted = con.execute("select c, upper(c), lower(c) from (select unnest(?) as c)", [letters]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(wanted)


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_topics_after_few_rounds(spark, rounds):
    x = np.random.default_rng(5).standard_normal((200, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    c = topics.kmeans(df, 5, rounds)
    assert (np.array([((v - c) ** 2).sum(1).argmin() for v in x]) == loop_kmeans(x, 5, rounds)).all()


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.9])
def test_set_pairs_by_groups_are_whole(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 130, 300):
        for _ in range(6):
            base = set(rng.sample(range(900), size))
            rows.append(base)
            for gone in (1, 2, size // 20, size // 10, size // 8, size // 5):  # to the edge of the threshold and beyond
                rows.append(base - set(rng.sample(sorted(base), min(gone, size - 1))))
                rows.append(base | set(rng.sample(range(900, 1900), gone)))
                rows.append((base - set(rng.sample(sorted(base), min(gone // 2, size - 1)))) | set(rng.sample(range(900, 1900), gone - gone // 2)))
    kinds = {tuple(sorted(f"w{x}" for x in r)): i for i, r in reversed(list(enumerate(rows)))}
    df = spark.createDataFrame([(i, sorted(f"w{x}" for x in r)) for i, r in enumerate(rows)], "rule_id long, tags array<string>").repartition(3)
    wanted = {}
    held = [(i, set(k)) for k, i in kinds.items()]
    for i, x in held:
        for j, y in held:
            if i < j and len(x & y) / len(x | y) >= threshold:
                wanted[i, j] = round(len(x & y) / len(x | y), 9)
    got = {(r.a, r.b): round(r.jaccard, 9) for r in rules.tag_set_pairs(rules.tag_sets(df), threshold).collect()}
    assert len(wanted) > 300 and got == wanted


def test_set_candidates_are_few(spark):
    """Sets of half of all words, no two of them alike: words meet in nearly all pairs, groups in few."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [f"w{x}" for x in rng.sample(range(800), 250)]) for i in range(300)], "rule_id long, tags array<string>")
    assert rules._met_by_groups(rules.tag_sets(df), 0.8).count() < 300


@pytest.mark.parametrize("name", ["rules_report", "rules_plan"])
def test_reports_find_pairs_once(spark, name):
    """What is found is read from tables, not worked out anew by each of its readers."""
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Generate" not in plan
