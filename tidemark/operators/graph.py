"""Relationship graph (K12-K15, P4, J12, J13, U5, U6, G1-G7, A3, A13). Edges are from_id, to_id,
rel_type and strength."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as C
from tidemark.scratch import kept, written


def with_reverse(edges: DataFrame) -> DataFrame:
    """K12. Edges of types that hold both ways also stored in reverse."""
    other = {"from_id": "to_id", "to_id": "from_id"}
    back = edges.where(F.col("rel_type").isin(*C.BIDIRECTIONAL)).select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def reverse_type(kind: Column) -> Column:
    """G7. The type seen from the other end."""
    known = F.create_map(*[F.lit(x) for pair in C.REVERSE.items() for x in pair])
    return F.when(kind.isin(*C.BIDIRECTIONAL), kind).otherwise(F.coalesce(F.try_element_at(known, kind), kind))


def symmetric(edges: DataFrame) -> DataFrame:
    """U6. src, dst, rel_type, strength and edge (ids for ties), each edge from both ends."""
    named = edges.withColumn("edge", F.struct("from_id", "to_id", "rel_type"))
    one = named.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "rel_type", "strength", "edge")
    return one.unionByName(named.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "rel_type", "strength", "edge"))


def touching(edges: DataFrame, chunk_id: object, direction: str = "both") -> DataFrame:
    """P4."""
    out, into = F.col("from_id") == chunk_id, F.col("to_id") == chunk_id
    return edges.where({"from": out, "to": into, "both": out | into}[direction])


def related_ids(edges: DataFrame, chunk_id: object) -> DataFrame:
    """U5. Ids at the other end of a chunk's edges, each once."""
    return symmetric(edges).where(F.col("src") == chunk_id).select(F.col("dst").alias("related_id")).distinct()


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int = C.GRAPH_DEPTH, min_strength: float = C.MIN_STRENGTH, types: list[str] | None = None, archived: DataFrame | None = None) -> DataFrame:
    """G1, J12, J13. Breadth-first from every seed at once: seed, node, depth, path (from the seed,
    without the node), rel_type and strength of the edge that first reached it. Of several first
    edges the one of the earliest found node counts, then the smallest edge (Q16). At most max_depth
    joins; a node is reached once per seed. archived: ids (chunk_id) that are not entered."""
    graph = symmetric(edges)
    graph = graph.where(F.col("strength") >= min_strength) if min_strength else graph
    graph = graph.where(F.col("rel_type").isin(types)) if types else graph
    if archived is not None:
        graph = graph.join(archived.select(F.col("chunk_id").alias("dst")), "dst", "left_anti")
    front = seeds.select(F.col("chunk_id").alias("seed"), F.col("chunk_id").alias("node"), F.array().cast(f"array<{seeds.schema['chunk_id'].dataType.simpleString()}>").alias("path"), F.array().cast("array<struct<from_id:bigint,to_id:bigint,rel_type:string>>").alias("trail"))
    seen, found = front.select("seed", "node"), []
    for depth in range(1, max_depth + 1):
        step = front.join(graph, F.col("node") == F.col("src")).select(
            "seed", F.col("dst").alias("next"), F.array_append("path", F.col("node")).alias("path"), F.array_append("trail", F.col("edge")).alias("trail"), "rel_type", "strength",
        )
        step = step.join(seen.withColumnRenamed("node", "next"), ["seed", "next"], "left_anti")
        first = step.groupBy("seed", "next").agg(F.min_by(F.struct("path", "trail", "rel_type", "strength"), "trail").alias("s"))
        front = first.select("seed", F.col("next").alias("node"), "s.path", "s.trail", "s.rel_type", "s.strength")
        found.append(front.select("seed", "node", F.lit(depth).alias("depth"), "path", "rel_type", "strength"))
        seen = seen.unionByName(front.select("seed", "node"))
        front = front.select("seed", "node", "path", "trail")
    return reduce(DataFrame.unionByName, found)


def graph_boosts(edges: DataFrame, seeds: DataFrame, max_depth: int = C.GRAPH_DEPTH, min_strength: float = C.MIN_STRENGTH) -> DataFrame:
    """A13. For every node reached the largest strength / (1 + depth) over the seeds."""
    reached = traverse(edges, seeds, max_depth, min_strength)
    return reached.groupBy(F.col("node").alias("chunk_id")).agg(F.max(F.col("strength") / (1 + F.col("depth"))).alias("graph_boost"))


def find_related(edges: DataFrame, chunk_id: object, types: list[str] | None = None, min_strength: float = C.MIN_STRENGTH, depth: int = 2, limit: int | None = None) -> DataFrame:
    """G2, T8. Related chunks with strength, depth and whether they are reached over others; sorted
    by strength only where a limit asks for it."""
    seed = edges.sparkSession.createDataFrame([(chunk_id,)], "chunk_id long")
    found = traverse(edges, seed, depth, min_strength, types).select(F.col("node").alias("related_id"), "rel_type", "strength", "depth", (F.col("depth") > 1).alias("is_transitive"))
    return found.orderBy(F.desc("strength"), "related_id").limit(limit) if limit else found


def contradictions(edges: DataFrame, chunk_id: object) -> DataFrame:
    """G3 (Q17). Edges that speak against a chunk: contradicts and invalidated_by at either end,
    supersedes where the chunk is the target."""
    either = F.col("rel_type").isin("contradicts", "invalidated_by") & ((F.col("from_id") == chunk_id) | (F.col("to_id") == chunk_id))
    replaced = (F.col("rel_type") == "supersedes") & (F.col("to_id") == chunk_id)
    other = F.when(F.col("from_id") == chunk_id, F.col("to_id")).otherwise(F.col("from_id"))
    return edges.where(either | replaced).select(other.alias("other_id"), "rel_type", "strength")


def followed(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Where following links (node, next; one per node) ends, by pointer doubling: every round each node
    takes over where its target has come to, so a way of n steps takes about log n rounds, and a
    node's row has a fixed size. Returns node, at, steps and open, and for every round k the table of node
    and at after exactly 2^k steps. A way that ends has open false: `at` has no link. The others lead to
    cycles: when a round begins with as many steps as there are open ways, ways that end do so in it, and
    what is still open then has gone more steps than there are such nodes, so that all `at` lie on
    cycles, and each node of a cycle is the `at` of one."""
    first = links.join(links.select(F.col("node").alias("next"), F.lit(True).alias("open")), "next", "left")
    state = written(first.select("node", F.col("next").alias("at"), F.lit(1).cast("long").alias("steps"), F.coalesce("open", F.lit(False)).alias("open")), "ways")
    levels, length, last = [], 1, False
    while True:
        levels.append(state.where(F.col("steps") == length).select("node", "at"))
        going = state.where("open").count()
        if going == 0 or last:
            return state, levels
        last = length >= going
        target = state.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("open").alias("open2"))
        gone = state.where("open").join(target, "at").select("node", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("open2").alias("open"))
        state = written(state.where("not open").unionByName(gone), "ways")
        length *= 2


def _newer(edges: DataFrame) -> DataFrame:
    """node and next: of the chunks that supersede it the one with the smallest id."""
    return edges.where("rel_type = 'supersedes'").groupBy(F.col("to_id").alias("node")).agg(F.min("from_id").alias("next"))


def _versions(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    state, levels = followed(links)
    ends = state.where("not open").select("node", F.col("at").alias("latest"), F.col("steps").alias("depth"), F.lit(False).alias("cyclic"))
    if state.where("open").isEmpty():
        return ends, levels
    rings = written(state.where("open").select(F.col("at").alias("node")).distinct(), "rings")
    # the ring of a node: the smallest id round it, by the same doubling
    ring = written(links.join(rings, "node").select("node", F.col("next").alias("at"), F.col("node").alias("ring")), "ring")
    n, length = rings.count(), 1
    while length < n:
        target = ring.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("ring").alias("ring2"))
        ring = written(ring.join(target, "at").select("node", F.col("at2").alias("at"), F.least("ring", "ring2").alias("ring")), "ring")
        length *= 2
    sizes = ring.groupBy("ring").agg(F.count("*").alias("size"))
    on_ring = written(ring.join(sizes, "ring").select("node", "size"), "ring-sizes")
    # ways to a ring end where they meet it
    tails = links.join(state.where("open").select("node"), "node", "left_semi").join(rings, "node", "left_anti")
    met, _ = followed(tails)
    through = met.select("node", F.col("at").alias("latest"), "steps").unionByName(on_ring.select("node", F.col("node").alias("latest"), F.lit(0).cast("long").alias("steps")))
    looped = through.join(on_ring.withColumnRenamed("node", "latest"), "latest").select("node", "latest", (F.col("steps") + F.col("size")).alias("depth"), F.lit(True).alias("cyclic"))
    return ends.unionByName(looped), levels


def versions(edges: DataFrame) -> DataFrame:
    """G5. node, latest, depth and cyclic of every chunk that another supersedes: where following the chunk that
    first supersedes each ends, and after how many steps. In a cycle the way ends at the first chunk that
    recurs. About log2 of the longest chain rounds; no row grows with a chain."""
    return _versions(_newer(edges))[0]


def supersession_chains(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """G5 (Q20). chain, for every seed the ids from it over the chunk that first supersedes it, and
    so on, until none does or one recurs; the recurring one ends the chain. Depths come from `versions`, places
    by doubling: a row at a place gives the one 2^k further on, so only chains that are asked for are written out."""
    found, levels = _versions(_newer(edges))
    asked = seeds.select("chunk_id").join(found.withColumnRenamed("node", "chunk_id"), "chunk_id", "left")
    rows = written(asked.select("chunk_id", F.coalesce("latest", "chunk_id").alias("latest"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.lit(0).cast("long").alias("place"), F.col("chunk_id").alias("node")), "places")
    for k in reversed(range(len(levels))):
        further = rows.where(F.col("place") + 2**k <= F.col("depth")).join(levels[k], "node")
        rows = rows.unionByName(further.select("chunk_id", "latest", "depth", (F.col("place") + 2**k).alias("place"), F.col("at").alias("node")))
    chain = F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda p: p["node"])
    return rows.groupBy("chunk_id").agg(chain.alias("chain"), F.first("latest").alias("latest"))


def claimed(pairs: DataFrame) -> DataFrame:
    """R15. node and cluster, from pairs (rank, x, y) taken in order of rank, x before y: a pair of which
    both are taken does nothing, of which one is taken brings the other into its cluster, and else
    founds a cluster. A node's first pair settles where it goes: to its partner, if that was in a pair before,
    else it founds. So first pairs are links, and clusters are where the links end: no loop over pairs. A cluster
    is named by the smaller founder."""
    ends = pairs.select(F.col("x").alias("node"), F.struct("rank", "x", "y").alias("p")).unionByName(pairs.select(F.col("y").alias("node"), F.struct("rank", "x", "y").alias("p")))
    first = written(ends.groupBy("node").agg(F.min("p").alias("p")).withColumn("other", F.when(F.col("node") == F.col("p.x"), F.col("p.y")).otherwise(F.col("p.x"))), "first-pairs")
    theirs = first.select(F.col("node").alias("other"), F.col("p").alias("p2"))
    known = first.join(theirs, "other").select("node", "other", (F.col("p") == F.col("p2")).alias("founds"))
    # of two founders the greater leads to the smaller, which leads nowhere
    links = known.where(~F.col("founds") | (F.col("other") < F.col("node"))).select("node", F.col("other").alias("next"))
    ways, _ = followed(links)
    return first.select("node").join(ways.select("node", "at"), "node", "left").select("node", F.coalesce("at", "node").alias("cluster"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """G6 (Q19). node and component, its smallest id: undirected components by hooking every
    component to its smallest neighbour and jumping over parents, each round in the shared folder. A path of n nodes takes about log n rounds."""
    links = kept(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a <> b").distinct())
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    labels = kept((ends if nodes is None else ends.unionByName(nodes.select(F.col("chunk_id").alias("node")))).distinct().withColumn("component", F.col("node")))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        for _ in range(2):
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("g"))
            parent = parent.join(up, "p", "left").select("c", F.coalesce("g", "p").alias("p"))
        parent = kept(parent)
        labels = kept(labels.join(parent, labels["component"] == parent["c"], "left").select("node", F.coalesce("p", "component").alias("component")))
        low = parent.select(F.col("c").alias("a"), F.col("p").alias("pa"))
        high = parent.select(F.col("c").alias("b"), F.col("p").alias("pb"))
        links = kept(links.join(low, "a").join(high, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    return labels


def clusters(edges: DataFrame, metadata: DataFrame, min_size: int = 3) -> DataFrame:
    """G6. component and size of components with a chunk that is not archived, largest first."""
    found = components(edges, metadata.where("not is_archived")).join(metadata.select(F.col("chunk_id").alias("node"), "is_archived"), "node", "left")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"), F.bool_or(~F.coalesce("is_archived", F.lit(True))).alias("live"))
    return sizes.where((F.col("size") >= min_size) & F.col("live")).select("component", "size").orderBy(F.desc("size"), "component")


def degrees(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """A3. Edges at either end of every known chunk that has any."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("chunk_id"))
    return ends.join(metadata.select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("connections"))


def graph_stats(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """A3 (Q18). total (half the sum of degrees, rounded down), average over connected chunks, and
    isolated chunks."""
    counted = metadata.select("chunk_id").join(degrees(edges, metadata), "chunk_id", "left")
    total = F.floor(F.coalesce(F.sum("connections"), F.lit(0)) / 2)
    connected = F.count("connections")
    return counted.agg(
        total.alias("total_relationships"), F.when(connected > 0, total / connected).otherwise(0.0).alias("avg_relationships"), (F.count("*") - connected).alias("isolated_chunks"),
    )


def edges_by_type(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """A3 (Q18). Per type the edges seen from known chunks at either end, not halved."""
    ends = edges.select("rel_type", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("chunk_id"))
    return ends.join(metadata.select("chunk_id"), "chunk_id", "left_semi").groupBy("rel_type").agg(F.count("*").alias("n"))


def hubs(edges: DataFrame, metadata: DataFrame, limit: int = 10) -> DataFrame:
    """A3. The most connected chunks."""
    return degrees(edges, metadata).orderBy(F.desc("connections"), "chunk_id").limit(limit)


def isolated(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """A3. Chunks without edges."""
    return metadata.select("chunk_id").join(degrees(edges, metadata), "chunk_id", "left_anti")


def sampled_depth(edges: DataFrame, metadata: DataFrame, sample: int = 5, max_depth: int = 10) -> DataFrame:
    """A3. The deepest node reached from the first five connected chunks."""
    seeds = degrees(edges, metadata).orderBy("chunk_id").limit(sample)
    return traverse(edges, seeds.select("chunk_id"), max_depth).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def rank_within(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """W2. The first rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= limit)
