"""Document fingerprints by locally consistent parsing.

A text is parsed in levels, from its code points up. On each level, runs of one symbol become one
symbol; deterministic coin tossing then gives each symbol a label from the lowest bit in which it
differs from its left neighbour, and repeats that on the labels until at most six values are left.
Neighbours never have the same label, so local maxima stand 2 to a few symbols apart: phrases begin
there, and a phrase's name, a hash of its symbols' names in order, is a symbol of the next level. Where a
phrase begins depends on four symbols before it and one behind, so equal substrings have equal
phrases inside, whatever stands around them and at whatever offset. The last level has one symbol,
the root, which names the whole text.

A fingerprint is the root and the KEPT smallest hashes of all phrase names from level FIRST_LEVEL on.
The likeness of two fingerprints is 1 if their roots are equal, else the share of common hashes
among the smallest of their union, which estimates the Jaccard similarity of the phrase sets.

All texts of a batch are parsed at once with NumPy; a batch is bounded in bytes, and a text longer
than that is a batch of its own and needs about 60 bytes per code point while it is parsed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, release, scratch

KEPT = 64
#: Phrases of the first level are mostly parts of common words.
FIRST_LEVEL = 2
#: Code points parsed at once, unless a single text has more.
BATCH_CHARS = 1 << 17
SALTS = 1024

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LABELS = 128


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tossed(left: int, own: int) -> int:
    """Twice the place of the lowest bit in which a label differs from its left neighbour, plus that bit."""
    low = (left ^ own) & -(left ^ own)
    return 2 * (low.bit_length() - 1) + (own & low > 0) if low else 0


_TOSS = np.array([_tossed(left, own) for left in range(_LABELS) for own in range(_LABELS)], np.uint8)


def _lowest(away: np.ndarray) -> np.ndarray:
    """The place of the lowest set bit, which is the exponent of that power of two as a float."""
    low = away & (~away + away.dtype.type(1))
    if away.dtype == np.uint32:
        return ((low.astype(np.float32).view(np.uint32) >> np.uint32(23)) - np.uint32(127)).astype(np.uint8)
    return ((low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)).astype(np.uint8)


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Four rounds of coin tossing; the first symbol of a text takes its own lowest bit each time."""
    out = np.empty(len(symbols), np.uint8)
    place = _lowest(symbols[1:] ^ symbols[:-1])
    out[1:] = place * 2 + ((symbols[1:] >> place) & symbols.dtype.type(1)).astype(np.uint8)
    out[first] = symbols[first] & symbols.dtype.type(1)
    for _ in range(3):
        own = out[first] & 1
        out[1:] = _TOSS.take((out[:-1].astype(np.uint16) << 7) | out[1:])
        out[first] = own
    return out


def _lengths(starts: np.ndarray, end: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1] = end - starts[-1]
    return out


def phrases(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and the places of the texts' first."""
    begins = np.empty(len(symbols), bool)
    begins[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    begins[first] = True
    at = np.flatnonzero(begins)
    single = symbols[at]
    own = single.astype(np.uint64)
    if len(at) < len(symbols):
        length = _lengths(at, len(symbols))
        many = np.flatnonzero(length > 1)
        own[many] = mixed(own[many] ^ mixed(length[many].astype(np.uint64) * _STEP))
        first = np.searchsorted(at, first)
    tossed = labels(single, first)
    cut = np.zeros(len(own), bool)
    cut[1:-1] = (tossed[1:-1] > tossed[:-2]) & (tossed[1:-1] > tossed[2:])
    cut[first[1:] - 1] = False  # the last symbol of a text begins no phrase
    cut[first] = True
    starts = np.flatnonzero(cut)
    length = _lengths(starts, len(own))
    place = np.arange(1, len(own) + 1) - np.repeat(starts, length)
    names = np.add.reduceat(mixed(own + place.astype(np.uint64) * _STEP), starts)
    return mixed(names ^ (length * 64 + level).astype(np.uint64)), np.searchsorted(starts, first)


Print = tuple[int, np.ndarray]
EMPTY: Print = (0, np.empty(0, np.uint32))


def fingerprints(texts: list[str]) -> list[Print]:
    """Root and smallest hashes of every text, all parsed together. An empty text has root 0 and no hashes."""
    found: list[Print] = [EMPTY] * len(texts)
    there = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(there):
        return found
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(texts[i]) for i in there])
    first = np.cumsum(sizes) - sizes
    roots = np.zeros(len(texts), np.uint64)
    keys, level, text = [], 0, there
    while len(text):
        level += 1
        symbols, first = phrases(symbols, first, level)
        sizes = _lengths(first, len(symbols))
        done = sizes == 1
        roots[text[done]] = symbols[first[done]]
        of = np.repeat(text, sizes)
        if level >= FIRST_LEVEL:
            keys.append((of.astype(np.uint64) << np.uint64(32)) | (symbols >> np.uint64(32)))
        elif done.any():  # a text too short for that level still has its root
            keys.append((text[done].astype(np.uint64) << np.uint64(32)) | (symbols[first[done]] >> np.uint64(32)))
        symbols = symbols[~np.repeat(done, sizes)]
        text, sizes = text[~done], sizes[~done]
        first = np.cumsum(sizes) - sizes
    pool = np.sort(np.concatenate(keys))
    pool = pool[np.r_[True, pool[1:] != pool[:-1]]]
    edges = np.searchsorted(pool, there.astype(np.uint64) << np.uint64(32))
    for i, a, b in zip(there, edges, [*edges[1:], len(pool)], strict=True):
        found[i] = (int(roots[i]), pool[a : min(b, a + KEPT)].astype(np.uint32))
    return found


def shown(print_: Print) -> str:
    """A fingerprint as text: the root in 16 hex digits, then 8 for every hash, ascending."""
    return f"{print_[0]:016x}" + print_[1].astype(">u4").tobytes().hex()


def read(text: str) -> Print:
    """The fingerprint of its text form."""
    return int(text[:16], 16), np.frombuffer(bytes.fromhex(text[16:]), ">u4").astype(np.uint32)


def likeness(a: Print, b: Print) -> float:
    """From 0 to 1: 1 for equal roots, else the share of the union's smallest hashes that both have."""
    if a[0] == b[0]:
        return 1.0
    both = np.sort(np.concatenate([a[1], b[1]]))
    twice = both[1:] == both[:-1]
    fresh = np.flatnonzero(np.r_[True, ~twice])[:KEPT]
    if not len(a[1]) or not len(b[1]):
        return 0.0
    last = both[fresh[-1]]
    return int((both[1:][twice] <= last).sum()) / len(fresh)


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FACTS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(texts: list[str], following: list[str], prints: list[Print], next_prints: list[Print]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_prints = fingerprints(changed)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array([shown(p) for p in prints], pa.string()), pa.array([shown(p) for p in changed_prints], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(prints, changed_prints, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(prints, next_prints, strict=True)], pa.float64()),
    ]


def _texts(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most BATCH_CHARS code points, or one text."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > BATCH_CHARS:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, and of each text edited with the beginning of the next document.

    The next document is the one with the next smaller id; the one with the smallest is followed by
    that with the largest. Null ids come last in that order; documents of one id are ordered by
    a hash of their texts. A single document follows itself. Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.

    Null texts count as empty; the fingerprint of an empty text is 16 zeros, and its likeness to
    another text is 0, to an empty one 1. Bytes that are no UTF-8 are read as U+FFFD. Repeated rows give
    a result each. An empty table gives no rows. Other columns are ignored.

    The texts are shuffled once, to ranges of ids, and read in order; a range's first document and
    the last of the range before it meet in a second, small step.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("salt")]  # the salt spreads equal rows over ranges
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.withColumn("salt", F.monotonically_increasing_id() % SALTS).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")
    id_field = T.StructField("id", base.schema["id"].dataType)
    facts = T._parse_datatype_string(_FACTS).fields
    schema = T.StructType([*T._parse_datatype_string("kind int, part int, text binary").fields, id_field, *facts])
    names = [f.name for f in schema.fields]
    blank = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def border(kind: int, ids: pa.Array, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text.encode()], pa.binary()), ids, *blank], names=names)

        last = None
        for batch in batches:
            texts, ids = _texts(batch.column("text")), batch.column("id")
            for a, b in _groups([len(t) for t in texts]):
                prints = fingerprints(texts[a:b])
                if last is None:
                    yield border(1, ids.slice(a, 1), texts[a])
                    last, skip = (texts[a], prints[0], ids.slice(a, 1)), 1
                else:
                    skip = 0
                before = [last[0], *texts[a + skip : b - 1]] if not skip else texts[a : b - 1]
                before_prints = [last[1], *prints[skip:-1]] if not skip else prints[:-1]
                if b - a > skip:
                    out = _results(texts[a + skip : b], before, prints[skip:], before_prints)
                    size = b - a - skip
                    yield pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), pa.array([part] * size, pa.int32()), pa.nulls(size, pa.binary()), ids.slice(a + skip, size), *out], names=names)
                last = (texts[b - 1], prints[-1], ids.slice(b - 1, 1))
        if last is not None:
            yield border(2, last[2], last[0])
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pair = _texts(batch.column("text").slice(i, 1)) + _texts(batch.column("before").slice(i, 1))
                prints = fingerprints(pair)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), *_results(pair[:1], pair[1:], prints[:1], prints[1:])], names=["id", *[f.name for f in facts]])
        release()

    with bounded(spark):
        found = scratch(ranged.mapInArrow(scan, schema), "fingerprints")
        parts = [r.part for r in found.where("kind = 2").select("part").orderBy("part").collect()]  # a number per range
        follows = spark.createDataFrame([(p, parts[i - 1]) for i, p in enumerate(parts)], "part int, before_part int")
        tails = found.where("kind = 2").select(F.col("part").alias("before_part"), F.col("text").alias("before"))
        heads = found.where("kind = 1").select("part", "id", "text").join(follows, "part").join(tails, "before_part").select("id", "text", "before")
        firsts = scratch(heads.mapInArrow(meet, T.StructType([id_field, *facts])), "first-fingerprints")
    columns = [f.name for f in facts]
    return found.where("kind = 0").select("id", *columns).unionByName(firsts).select(F.col("id").alias(id_col), *columns)
