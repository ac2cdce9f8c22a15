"""The pipeline, stage by stage, against brute force on the small data; and the SQL of the queries."""

from __future__ import annotations

import types
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import jaccard, mixing, packing, queries, sharding
from tidemark.llm.common import passing, scratch, shared_dir, table
from tests.llm.test_llm_operators import brute_components, brute_dedup, brute_targets, words_of

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        rows = docs.collect()
        if name == "lexical_packing":  # see test_last_stages_and_run
            break
        assert docs.columns == columns and all(r.n_chars == len(r.text) for r in rows)
        out = [(r.doc_id, r.text, r.source) for r in rows]
        if name == "quality_rules":
            verdicts = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, DATA).collect()}
            assert Counter(out) == Counter(x for x in given if verdicts[x[0]])
        elif name == "ngram_jaccard":
            assert sorted(x[0] for x in out) == sorted({c for _, _, c in brute_components(given, 5, 80, 100)})
        elif name == "substring_dedup":
            assert Counter((i, " ".join(words_of(t))) for i, t, _ in out) == Counter((w[0], " ".join(w[4])) for w in brute_dedup(given))
        else:
            sizes = Counter()
            for _, t, s in given:
                sizes[s] += len(words_of(t))
            taken = Counter()
            for _, t, s in out:
                taken[s] += len(words_of(t))
            assert all(abs(taken[s] - x) <= 1 for s, x in brute_targets(sizes, (3, 1, 2), 1.5).items())
        given = out


def test_a_run_leaves_other_results_alone(spark):
    docs = table(spark, DATA, "documents")
    waiting = sharding.assign_shards(docs), jaccard.linked_components(docs)
    with passing(spark):
        scratch(docs, "gone")
        kept = scratch(docs, "kept", keep=True)
    corpus_pipeline.quality_rules(spark, docs, DATA)
    assert {df.count() for df in waiting} == {docs.count()} == {kept.count()}


def test_scratch_blocks(spark, monkeypatch):
    """A block's tables go with it, those kept with the block around."""
    df = spark.range(3).toDF("x")
    with passing(spark):
        with passing(spark):
            gone, kept = scratch(df, "gone"), scratch(df, "kept", keep=True)
            assert gone.count() == 3
        assert kept.count() == 3
        with pytest.raises(Exception, match="(?i)does not exist|FILE_NOT_EXIST"):
            gone.collect()
    with pytest.raises(Exception, match="(?i)does not exist|FILE_NOT_EXIST"):
        kept.collect()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    session = types.SimpleNamespace(conf=Conf(), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)


ODD = "doc_id long, text string, lang string, source string, n_chars long, w string, spans string, kept string"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "w", None, "k"), (1, "", "en", None, 0, None, "s", "k"), (1, "", "en", None, 0, None, "s", "k"), (2, " ".join(f"w{i}" for i in range(30000)), None, "s", None, None, None, None)] + [(3, "a b c " * 20, "en", "s", 1, "w", "x", "y")] * 3])
def test_stages_on_odd_tables(spark, rows):
    """Nulls, empty and very long texts, repeated rows, an empty table, further columns with names
    that operators use themselves."""
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        found = out.collect()
        if name == "lexical_packing":
            assert sum(r.length for r in found) == sum(len(packing.token_ids(r[1], packing.default_vocabulary_path())) for r in rows)
            continue
        assert out.columns == docs.columns
        ids = sorted(str(r.doc_id) for r in found)
        wanted = {"quality_rules": {"2"}, "ngram_jaccard": {"None", "1", "2", "3"}, "substring_dedup": {"None", "1", "2", "3"}, "source_mixing": {"2", "3"}}[name]
        assert set(ids) == (wanted if rows else set())
        if name == "substring_dedup":
            assert all(r.text == "" for r in found if r.doc_id == 3) and len(found) == len(rows)
        if name == "ngram_jaccard" and rows:
            assert ids.count("3") == 1 and ids.count("1") == 2


def test_last_stages_and_run(spark):
    """run() gives what the stages in turn give, and each token id of each mixed row once."""
    docs, out = table(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs := stage(spark, docs, DATA))
    given, mixed, packed = (df.collect() for df in out[-3:])
    texts = {r.doc_id: Counter(words_of(r.text)) for r in given}
    assert len(texts) == len(given) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert not any(Counter(words_of(r.text)) - texts[r.doc_id] for r in mixed)
    wanted = Counter()
    for r in mixed:
        ids = packing.token_ids(r.text, packing.default_vocabulary_path()).tolist()
        wanted.update((r.doc_id, len(ids), at, x) for at, x in enumerate(ids))

    def held(rows):
        return Counter((r.doc_id, r.doc_tokens, r.start + k, x) for r in rows for k, x in enumerate(r.ids))

    assert all(r.length == len(r.ids) for r in packed) and held(packed) == wanted
    assert held(corpus_pipeline.run(spark, DATA).collect()) == wanted


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    plain = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_the_mix_shuffles_texts_once_where_no_row_repeats(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    twice = mixing.mixed_documents(docs.unionByName(docs))
    assert "row_number" in twice._jdf.queryExecution().optimizedPlan().toString()
    assert set(Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs, share_percent=200).collect()).values()) == {2}


def test_tables_that_no_stage_needs_go(spark):
    """A stage's table is there for the next one, and as long as somebody holds it; then a later stage removes it."""
    import pathlib

    there = lambda name: len(list(pathlib.Path(shared_dir(spark).removeprefix("file://")).glob(f"tidemark-{name}-*")))
    docs = table(spark, DATA, "documents").limit(40)
    before = there("quality_rules")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA)
    rows = kept.count()
    passed = corpus_pipeline.source_mixing(spark, corpus_pipeline.quality_rules(spark, docs, DATA), DATA)
    assert kept.count() == rows and there("quality_rules") <= before + 2
    corpus_pipeline.lexical_packing(spark, passed, DATA).count()
    assert kept.count() == rows and there("quality_rules") == 1
    few = kept.limit(3)
    del kept
    assert corpus_pipeline.lexical_packing(spark, few, DATA).count() >= 3
    corpus_pipeline.lexical_packing(spark, passed, DATA).count()
    assert there("quality_rules") == 0 and there("source_mixing") > 0 and passed.count() > 0
