"""Exact n-gram Jaccard self-join with set-relation skipping, and the components of its links.

A document is the set of its k-word shingles. Documents with equal sets are one node. Shingles are
put in one global order, those with a rare word first, by counts of hashed words over the whole
corpus; two linked sets share a shingle among the first |x| - ceil(t|x|) + 1 of each. The inverted
lists over these prefixes hold node, size and position.

Short lists give all their pairs. Long lists are never paired out. They are cut into blocks by size
class and position; a set skips the blocks whose positions leave too little to overlap, and meets
only one pivot of each other block. Sets linked to one pivot are in one component, so only sets of
different components in one list need more: pivots from the other end of each block, and last the
sets outside a list's main component against the list. There the answers known for a pivot are
reused: if p is a pivot with known distances to x and y, then d(x, y) lies between |d(x,p) - d(y,p)|
and d(x,p) + d(y,p), which decides most pairs without looking at the sets.

Before sets are compared, a pair must pass a parity bitmap: the number of differing bits never
exceeds the size of the symmetric difference. Sets are rebuilt, once, only for nodes that pass.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SEPARATORS, bounded_batches, packed, passing, release, scratch, unpacked
from tidemark.llm.components import components, joined
from tidemark.llm.recompress import mixed

#: Defaults of near-duplicate stages; op10's contract sets its own.
SHINGLE = 5
THRESHOLD = (80, 100)
WORD_BUCKETS = 1 << 16
#: Longs of the parity bitmap, 64 bits each.
BITMAP = 16
#: Lists of at most so many nodes give all pairs.
SHORT = 8
#: Positions in a block of a long list.
POSITIONS = 16
#: Entries of a list that a task compares with as many others.
GRID = 2048
PART_TEXTS = 64


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


@functools.cache
def _memory() -> _Words:
    return _Words()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case; bytes.split cuts at exactly space and \\t-\\r."""
    found = text.lower().split()
    return np.fromiter(map(_memory().__getitem__, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each place of a shingle, in order; of the whole sequence if it has under k words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = mixed(hashes[: n - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = mixed(out * np.uint64(3) + hashes[i : n - width + 1 + i])
    return out


def word_counts(docs: DataFrame, text_col: str, buckets: int = WORD_BUCKETS) -> np.ndarray:
    """How often words of each hash bucket occur in the whole corpus; `buckets` numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, len(batch), PART_TEXTS):
                found = [word_hashes(t) for t in batch.column(0).slice(at, PART_TEXTS).to_pylist()]
                total += np.bincount((np.concatenate(found) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        _memory().clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counted = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("t")).mapInArrow(work, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def node_rows(docs: DataFrame, counts: np.ndarray, k: int, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n (set size), k1, k2 (a 128-bit hash of the set), prefix (its first shingles in the global
    order) and bits (its parity bitmap) of every document."""
    num, den = share
    rank = np.minimum(counts, np.iinfo(np.int32).max).astype(np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PART_TEXTS):
                part = batch.slice(at, PART_TEXTS)
                sizes, one, two, prefixes, bitmaps = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    hashes = word_hashes(text) if text else np.zeros(0, np.uint64)
                    places = shingle_hashes(hashes, k)
                    found, where = np.unique(places, return_index=True)
                    n = len(found)
                    sizes.append(n)
                    key = set_keys(found)
                    one.append(key[0])
                    two.append(key[1])
                    if (den - num) * n < num:  # so small a set is linked with equal ones only
                        prefixes.append(None)
                        bitmaps.append(None)
                        continue
                    by_word = rank[(hashes % np.uint64(len(rank))).astype(np.int64)]
                    width = min(k, len(hashes))
                    rarest = by_word[: len(places)].copy()
                    for i in range(1, width):
                        np.minimum(rarest, by_word[i : len(places) + i], out=rarest)
                    first = n - -(-num * n // den) + 1
                    prefixes.append(found[np.lexsort((found, rarest[where]))[:first]].view(np.int64))
                    odd = np.bincount((found % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
                    bitmaps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(bitmaps, pa.list_(pa.int64())),
                ], ["id", "text_hash", "n", "k1", "k2", "prefix", "bits"])
        _memory().clear()
        release()

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("text_hash"))
    return given.mapInArrow(work, "id long, text_hash long, n long, k1 long, k2 long, prefix array<long>, bits array<long>")


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set of shingle hashes, as two signed longs."""
    if not len(found):
        return 0, 0
    both = np.array([mixed(found).sum(dtype=np.uint64), mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """node and items, the sorted shingle hashes, of documents with a binary text t; only of those
    whose set has the key k1, k2 (an id may stand for several texts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PART_TEXTS):
                part = batch.slice(at, PART_TEXTS)
                sets = [np.unique(shingle_hashes(word_hashes(t or b""), k)) for t in part.column(3).to_pylist()]
                own = pa.array([set_keys(x) == key for x, key in zip(sets, zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "items"]).filter(own)
        _memory().clear()
        release()

    return docs.select("node", "k1", "k2", "t").mapInArrow(work, "node long, items array<long>")


def _allowed(n: Column, m: Column, share: tuple[int, int]) -> Column:
    """Largest symmetric difference of linked sets of n and m items: inter / union >= num / den
    means (den + num) * d <= (den - num) * (n + m)."""
    num, den = share
    return F.floor((n + m) * (den - num) / (den + num) + 1e-9)


def _reachable(n: Column, i: Column, m: Column, j: Column, share: tuple[int, int]) -> Column:
    """Whether sets of n and m items that share a shingle at positions i and j of the global order,
    and none before it, can overlap enough: 2 * overlap = n + m - d."""
    overlap = 1 + F.least(n - i, m - j) - 1
    return (2 * overlap >= n + m - _allowed(n, m, share)) & (F.abs(n - m) <= _allowed(n, m, share))


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct unordered pairs a > b of a table of a and b; with a column p, p as well."""
    more = [c for c in df.columns if c == "p"]
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), *more).distinct()


def _bits_apart(x: str, y: str) -> Column:
    """Differing bits of two parity bitmaps; never more than the sets' symmetric difference."""
    return functools.reduce(operator.add, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITMAP)])


def _alike(pairs: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose parity bitmaps differ in no more bits than linked sets may in items."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return pairs.join(left, "a").join(right, "b").where(_bits_apart("ba", "bb") <= _allowed(F.col("na"), F.col("nb"), share)).select(*pairs.columns)


def _measured(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b, d (size of the symmetric difference) and linked, from the sets themselves."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    d = (F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))).cast("long")
    return both.select("a", "b", d.alias("d"), (d <= _allowed(F.size("x"), F.size("y"), share)).alias("linked"))


def _with_sets(pairs: DataFrame, sets: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table of sets with those of the pairs' nodes that it lacks; mostly it lacks none."""
    lacking = _nodes(pairs).join(sets.select("node"), "node", "left_anti")
    lacking = scratch(lacking, "lacking")
    return sets if lacking.isEmpty() else sets.unionByName(build(lacking))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of the lists with the component of their node, lists of one component left out."""
    named = scratch(lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    several = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    return named.join(several, "token", "left_semi")


def _met(lists: DataFrame, largest: bool, share: tuple[int, int]) -> DataFrame:
    """Pairs of a set and the pivot of a block that it does not skip and that is of another
    component. The pivot is the entry of the smallest component, or of the largest."""
    entry = F.struct("comp", "node", "n", "pos")
    block = ["token", "cls", "at"]
    blocks = lists.groupBy(*block).agg((F.max if largest else F.min)(entry).alias("p"), F.min("pos").alias("low"), F.min("n").alias("least"), F.max("n").alias("most"))
    blocks = blocks.select("token", "p", "low", "least", "most", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"))
    probe = lists.select("token", "cls", "node", "n", "pos", "comp").join(blocks, ["token", "cls"])
    # the most that any entry of the block could overlap, against the least that it would need
    room = F.least(F.col("n") - F.col("pos"), F.col("most") - F.col("low"))
    probe = probe.where(2 * room >= F.col("n") + F.col("least") - _allowed(F.col("n"), F.col("least"), share))
    probe = probe.where((F.col("comp") != F.col("p.comp")) & _reachable(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), share))
    return _pairs(probe.select(F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("p.node").alias("p")))


def _left(lists: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of sets of different components in one list, one of them outside its main component,
    whose bitmaps allow a link. The bitmaps go with the entries and are compared in the join, so
    pairs that they rule out are never made."""
    sizes = lists.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    # a long list is cut into a grid of parts of about GRID entries, which meet in tasks of their own
    main = main.select("token", F.col("m.comp").alias("main"), F.ceil(F.col("all") / GRID).alias("parts"), F.ceil((F.col("all") - F.col("m.c")) / GRID).alias("few_parts"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    entries = lists.join(main, "token").join(nodes.select("node", "bits"), "node")
    few = entries.where("comp <> main").select(F.col("token").alias("t"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("comp").alias("ca"), F.col("bits").alias("ba"), "cls", part("few_parts").alias("own"), "parts")
    few = few.select("*", every("parts").alias("other")).drop("parts")
    few = few.select("*", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("near")).drop("cls")
    entries = entries.select("token", "cls", "node", "n", "pos", "comp", "bits", part("parts").alias("part"), "few_parts").select("*", every("few_parts").alias("few_part")).drop("few_parts")
    apart = _bits_apart("ba", "bits") <= _allowed(F.col("na"), F.col("n"), share)
    same = (F.col("t") == F.col("token")) & (F.col("near") == F.col("cls")) & (F.col("own") == F.col("few_part")) & (F.col("other") == F.col("part"))
    found = few.join(entries, same & (F.col("ca") != F.col("comp")) & _reachable(F.col("na"), F.col("i"), F.col("n"), F.col("pos"), share) & apart)
    return _pairs(found.select("a", F.col("node").alias("b")))


def _derived(pairs: DataFrame, answers: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs with `verdict`: true or false where the distances of both sets to a common pivot
    decide it, else null. answers: x, p, d, the distances of sets to the pivots that they met."""
    size = nodes.select(F.col("node").alias("x"), "n")
    one = answers.select(F.col("x").alias("a"), "p", F.col("d").alias("da"))
    two = answers.select(F.col("x").alias("b"), "p", F.col("d").alias("db"))
    met = pairs.join(one, "a").join(two, ["b", "p"]).groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("high"), F.max(F.abs(F.col("da") - F.col("db"))).alias("low"))
    sized = pairs.join(met, ["a", "b"], "left").join(size.withColumnsRenamed({"x": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"x": "b", "n": "nb"}), "b")
    most = _allowed(F.col("na"), F.col("nb"), share)
    return sized.select("a", "b", F.when(F.col("high") <= most, True).when(F.col("low") > most, False).alias("verdict"))


def _named(classes: DataFrame) -> DataFrame:
    """Classes of equal sets with node, a number of their own: their smallest id, or a hash where
    they have none or another class has the same."""
    hashed = -1 - F.pmod(F.col("k1"), F.lit(2**62))
    shared = classes.where("least is not null").groupBy("least").agg(F.count("*").alias("c")).where("c > 1").select("least", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return classes.withColumn("node", F.coalesce("least", hashed))
    return classes.join(shared, "least", "left").withColumn("node", F.when(F.col("shared"), hashed).otherwise(F.coalesce("least", hashed))).drop("shared")


def _labels(docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """node and comp of every class of equal sets that is linked with another."""
    num, den = share
    ids = classes.select("k1", "k2", "node", "least")
    nodes = classes.where("prefix is not null").select("node", "n", "prefix", "bits")
    base = math.log(den / num) * 1.0001
    entries = nodes.select("node", "n", F.floor(F.log(F.col("n").cast("double")) / base).cast("int").alias("cls"), F.posexplode("prefix").alias("pos", "token"))
    common = entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    entries = scratch(entries.join(common, "token").withColumn("at", F.floor(F.col("pos") / POSITIONS).cast("int")), "entries")
    lists = entries.where(F.col("df") > SHORT)
    slim = nodes.select("node", "n", "bits")

    member = F.struct(F.col("node").alias("x"), F.col("n").alias("m"), F.col("pos").alias("i"))
    small = entries.where(F.col("df") <= SHORT).groupBy("token").agg(F.collect_list(member).alias("e"))
    small = small.select(F.explode("e").alias("l"), "e").select("l", F.explode("e").alias("r")).where("l.x > r.x")
    small = small.where(_reachable(F.col("l.m"), F.col("l.i"), F.col("r.m"), F.col("r.i"), share))
    short = scratch(_alike(_pairs(small.select(F.col("l.x").alias("a"), F.col("r.x").alias("b"))), slim, share), "pairs")

    def build(wanted: DataFrame) -> DataFrame:
        """Sets of nodes, from one document of each: that with the smallest id."""
        keys = ids.join(wanted, "node").select("k1", "k2", "node")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
        of_node = rows.join(keys, ["k1", "k2"]).groupBy("node").agg(F.min("id").alias("id"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
        found = texts.join(of_node.hint("merge"), texts["id"].eqNullSafe(of_node["id"])).select("node", "k1", "k2", "t")
        again = rows.join(of_node.select("id", "node"), rows["id"].eqNullSafe(of_node["id"])).groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
        found = shingle_sets(found, k)
        return scratch(found if again.isEmpty() else found.dropDuplicates(["node"]), "sets")

    # the first pivots need no components: each set is its own
    alone = lists.withColumn("comp", F.col("node"))
    met = scratch(_alike(_met(alone, False, share), slim, share), "met")
    first = short.unionByName(met.select("a", "b")).distinct()
    sets = build(_nodes(first))
    known = scratch(_measured(first, sets, share), "known")
    labels = scratch(components(known.where("linked")), "labels")
    fresh = _met(_labelled(lists, labels), True, share)
    fresh = scratch(_alike(fresh.join(known.select("a", "b"), ["a", "b"], "left_anti"), slim, share), "met")
    sets = _with_sets(fresh, sets, build)
    more = scratch(_measured(fresh.select("a", "b").distinct(), sets, share), "known")
    labels = joined(labels, more.where("linked"))
    known = known.unionByName(more)
    last = _left(_labelled(lists, labels), slim, share).join(known.select("a", "b"), ["a", "b"], "left_anti")
    asked = met.unionByName(fresh).join(known, ["a", "b"])
    answers = asked.select(F.when(F.col("a") == F.col("p"), F.col("b")).otherwise(F.col("a")).alias("x"), "p", "d")
    answers = answers.unionByName(asked.select(F.col("p").alias("x"), "p", F.lit(0).cast("long").alias("d"))).distinct()
    last = scratch(_derived(last, answers, slim, share), "last")
    undecided = last.where("verdict is null").select("a", "b")
    sets = _with_sets(undecided, sets, build)
    linked = _measured(undecided, sets, share).where("linked").select("a", "b")
    return joined(labels, linked.unionByName(last.where("verdict").select("a", "b")))


def _rows_in_components(docs: DataFrame, k: int, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n, comp (null for an empty set) and component_id of every document."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold whole numbers")
    bounded_batches(docs.sparkSession)
    counts = word_counts(docs, text_col)
    with passing(docs.sparkSession):  # prefixes and bitmaps stay with the classes only
        full = scratch(node_rows(docs, counts, k, share, id_col, text_col), "set-rows")
        rows = scratch(full.select("id", "text_hash", "n", "k1", "k2"), "keys", keep=True)
        # equal sets are one node
        classes = full.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.min(F.struct("n", "prefix", "bits")).alias("s"))
        classes = scratch(_named(scratch(classes.select("k1", "k2", "least", "s.*"), "classes")), "nodes", keep=True)
    ids = classes.select("k1", "k2", "node", "least")
    with passing(docs.sparkSession):
        labels = scratch(_labels(docs, rows, classes, k, share, id_col, text_col), "labels", keep=True)
    found = ids.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = found.join(least, "comp").select("k1", "k2", "comp", "component_id")
    out = rows.where("n > 0").join(labels, ["k1", "k2"]).select("id", "text_hash", "n", "comp", "component_id")
    alone = rows.where("n = 0").select("id", "text_hash", "n", F.lit(None).cast("long").alias("comp"), F.col("id").alias("component_id"))
    return out.unionByName(alone)


def linked_components(docs: DataFrame, k: int = SHINGLE, share: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every document: the smallest id reachable by links, where
    two documents link when den * |intersection| >= num * |union| of their sets of k-word shingles.

    A text of under k words has one shingle, all its words; a null, empty or blank text has none
    and links with nothing. Repeated rows are linked with each other, each giving a row; one id
    with several texts is several documents. A null id takes part, but component_id is the smallest
    id that is not null, null if there is none. Ids of other kinds than whole numbers are refused
    with a TypeError. An empty table gives no rows. No list, block or
    component is cut off at any size.
    """
    found = _rows_in_components(docs, k, share, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, share: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each component: that with the smallest id, and of several texts
    of that id one. Texts without words are linked with nothing and all stay, null ones too. Of
    repeated rows one stays. An empty table gives no rows. Further columns stay, whatever their names."""
    own = {"id": id_col, "text": text_col}
    found = _rows_in_components(docs, k, share, id_col, text_col).where("comp is not null")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("f")).select(F.col("f.id").alias("id"), F.col("f.text_hash").alias("hash"))
    first = first.distinct().hint("merge")
    given = packed(docs, **own).withColumn("hash", F.xxhash64("text"))
    blank = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SEPARATORS)) == ""
    met = given.where(~blank).alias("d").join(first.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.hash") == F.col("f.hash")), "left_semi")
    # repeated rows of the chosen document: one of them
    again = met.groupBy("id", "hash").agg(F.count("*").alias("c")).where("c > 1")
    kept = met if again.isEmpty() else met.dropDuplicates(["id", "hash"])
    kept = kept.unionByName(given.where(blank))
    return kept.select(*unpacked(kept, docs.columns, **own))
