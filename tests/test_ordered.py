"""Order-dependent and iterative operators against plain loops on random inputs."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import graph

EDGES = "from_id long, to_id long, rel_type string, strength double"


def superseded(spark, pairs):
    return spark.createDataFrame([(new, old, "supersedes", 0.8) for old, new in pairs], EDGES)


def loop_chain(newer, seed):
    chain, seen = [seed], {seed}
    while chain[-1] in newer:
        chain.append(newer[chain[-1]])
        if chain[-1] in seen:
            break
        seen.add(chain[-1])
    return chain


@pytest.mark.parametrize("seed", range(2))
def test_chains_and_versions_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, rng.randrange(60)) for a in range(60) for _ in range(rng.choice((0, 1, 1, 2)))]
    pairs += [(70, 71), (71, 72), (72, 70), (73, 70), (74, 74), (75, 74), (80, 81), (81, 82)]
    newer = {}
    for old, new in pairs:
        newer[old] = min(new, newer.get(old, new))
    edges = superseded(spark, pairs)
    seeds = spark.createDataFrame([(i,) for i in range(90)], "chunk_id long")
    got = {r.chunk_id: (r.chain, r.latest) for r in graph.supersession_chains(edges, seeds).collect()}
    assert got == {i: (c := loop_chain(newer, i), c[-1]) for i in range(90)}
    found = {r.node: (r.latest, r.depth, r.cyclic) for r in graph.versions(edges).collect()}
    assert found == {i: ((c := loop_chain(newer, i))[-1], len(c) - 1, c[-1] in c[:-1]) for i in newer}


def test_a_long_chain_takes_few_rounds(spark):
    n = 5000
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "node long, next long")
    state, levels = graph.followed(links)
    assert len(levels) < 16
    assert {(r.at, r.steps + r.node, r.open) for r in state.collect()} == {(n, n, False)}


def test_chains_of_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    seeds = spark.createDataFrame([(1,)], "chunk_id long")
    assert graph.versions(none).count() == 0
    assert [tuple(r) for r in graph.supersession_chains(none, seeds).collect()] == [(1, [1], 1)]


def loop_claims(pairs):
    clusters, taken = [], set()
    for _, x, y in sorted(pairs):
        if x in taken and y in taken:
            continue
        cluster = next((c for c in clusters if x in c["all"] or y in c["all"]), None)
        if cluster is None:
            cluster = {"name": min(x, y), "all": set()}
            clusters.append(cluster)
        cluster["all"] |= {x, y}
        taken |= {x, y}
    return {n: c["name"] for c in clusters for n in c["all"]}


@pytest.mark.parametrize("seed", range(2))
def test_pairs_claim_in_order(spark, seed):
    rng = random.Random(seed)
    pairs = [(k, rng.randrange(40), rng.randrange(40)) for k in range(rng.choice((15, 40, 120)))]
    got = graph.claimed(spark.createDataFrame(pairs, "rank int, x long, y long")).collect()
    assert {r.node: r.cluster for r in got} == loop_claims(pairs) and len(got) == len({r.node for r in got})
