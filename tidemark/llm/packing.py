"""Packing by lexical retrieval: an inverted index with BM25 weights, in shards, returns the unused
neighbours of a seed, which fill its window greedily.

A document is its token ids and an end id. Stretches of a whole window go into sequences of their
own; the rest of each document, less than a window, is an item. Document frequencies, the number of
items and their mean length are counted over the whole corpus. Items are dealt to shards by content:
sorted by two idf-weighted minima of hashed terms (two items share the first with a chance that is
their weighted Jaccard), cut into ranges, and each range into shards of at most `shard_items` items.
So items alike lie together, copies side by side, a large group of them is spread over many tasks,
and a task holds one shard at a time. In a shard the first unused item seeds a window; the items that
share any of its terms follow by falling BM25 score, then any unused item in order, and the last is
cut where the window is full, its rest staying unused. So only the last window of a shard may lack
tokens; as a sequence needs no padding at a power of two, that window is cut into such lengths.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, release, scratch

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's one special token; tokenizers reads it in texts as this id.
SPECIAL = {"<|endoftext|>": 50256}
SHARD_ITEMS = 2048
#: Ids that a range of items holds, about.
RANGE_IDS = 2 << 20
#: Ids after which a task writes what it has.
FLUSH_IDS = 1 << 20
#: A term is common in a shard that has it in more than one of so many items.
COMMON = 32
K1, B = 1.2, 0.75
#: Texts on which the rank file and the tokenizers file of the vocabulary must agree.
PROBES = ["", "a<|endoftext|> b", "  <|endoftext|>\n", "I'll don't\t\t x\n\n\n y", "é中 \xa0a", "\r\n", "<|endoftext", "\U00010348\x00", "a" * 300, " " * 99]


@functools.cache
def default_vocabulary_path() -> str:
    """Where the public vocabulary lies on this machine; once per process its rank file, which is
    faster to read from, is held against the tokenizers file of the same name."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(VOCABULARY)
    named = Tokenizer.from_file(public_tokenizers.path(VOCABULARY.replace(".tiktoken", ".json")))
    if any(token_ids(t, path)[:-1].tolist() != named.encode(t, add_special_tokens=False).ids for t in PROBES):
        raise ValueError("the vocabulary's files disagree")
    return path


@functools.cache
def encoding(path: str) -> object:
    """The encoder of a rank file, which gives the ids of the tokenizers file of that vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """A document's ids with the end id; just that for a null or empty text."""
    found = encoding(path).encode_to_numpy(text, allowed_special="all") if text else ()
    out = np.empty(len(found) + 1, np.uint32)
    out[:-1] = found
    out[-1] = END_ID
    return out


def _terms(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of all items in order, how often each occurs, and where each item's begin."""
    flat = np.concatenate([np.sort(ids, kind="stable") for ids in items])
    ends = np.cumsum([len(ids) for ids in items])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[ends[:-1]] = True
    at = np.flatnonzero(new)
    return flat[at].astype(np.int64), np.diff(at, append=len(flat)), np.searchsorted(at, np.concatenate([[0], ends]))


class Corpus:
    """What the whole corpus says about terms: the inverse document frequency of each, and the mean
    length of items."""

    def __init__(self, df: np.ndarray, n: int, ids: int) -> None:
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.mean = ids / max(n, 1)
        self.places: list[np.ndarray] = []

    def _orders(self) -> list[np.ndarray]:
        """Places of all terms in two random orders in which a term is early by its idf."""
        for seed in (1, 2)[len(self.places) :]:
            early = -np.log(np.random.default_rng(seed).random(len(self.idf))) / np.maximum(self.idf, 1e-9)
            place = np.empty(len(early), np.int64)
            place[np.argsort(early, kind="stable")] = np.arange(len(early))
            self.places.append(place)
        return self.places

    def minima(self, items: list[np.ndarray]) -> list[np.ndarray]:
        """Two numbers of each item: the place of its first term in either order."""
        terms, _, first = _terms(items)
        return [np.minimum.reduceat(place[terms], first[:-1]) for place in self._orders()]


class Index:
    """BM25 over a shard: postings by term, for items given as arrays of ids."""

    def __init__(self, items: list[np.ndarray], corpus: Corpus | None = None) -> None:
        flat, tf, first = _terms(items)
        self.flat, self.own, self.n = flat, first, len(items)
        df = np.bincount(flat)
        corpus = corpus or Corpus(df, len(items), sum(map(len, items)))
        row = np.repeat(np.arange(len(items)), np.diff(first))
        lengths = np.array([len(x) for x in items], np.float64)
        weight = corpus.idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / corpus.mean))
        # a term of many items is a row of weights of all items, any other a list of its items
        many = df * COMMON > len(items)
        self.dense = np.zeros((int(many.sum()), len(items)))
        self.place = np.cumsum(many) - 1
        often = many[flat]
        self.dense[self.place[flat[often]], row[often]] = weight[often]
        rare = ~often
        by = np.argsort(flat[rare], kind="stable")
        self.df, self.many, self.row, self.weight = df, many, row[rare][by], weight[rare][by]
        self.first = np.concatenate([[0], np.cumsum(np.where(many, 0, df))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all items for all terms of one. Terms of no other item say nothing."""
        terms = self.flat[self.own[seed] : self.own[seed + 1]]
        terms = terms[self.df[terms] > 1]
        often = self.many[terms]
        out = np.add.reduce(self.dense[self.place[terms[often]]], axis=0)
        rare = terms[~often]
        if len(rare):
            parts = [slice(a, b) for a, b in zip(self.first[rare].tolist(), self.first[rare + 1].tolist(), strict=True)]
            out += np.bincount(np.concatenate([self.row[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), minlength=self.n)
        return out


def fill_windows(items: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, from, to). All but the last hold exactly `window` ids; every id of
    every item lies in one piece."""
    if not items:
        return []
    index, n = Index(items, corpus), len(items)
    at, ends, unused = np.zeros(n, np.int64), np.array([len(x) for x in items]), np.ones(n, bool)
    windows, seed = [], 0

    def place(i: int, space: int) -> int:
        take = min(int(ends[i] - at[i]), space)
        windows[-1].append((i, int(at[i]), int(at[i]) + take))
        at[i] += take
        unused[i] = at[i] < ends[i]
        return space - take

    while seed < n:
        if not unused[seed]:
            seed += 1
            continue
        windows.append([])
        space = place(seed, window)
        if space:
            score = index.scores(seed)
            near = np.flatnonzero(unused & (score > 0))
            near = near[np.argsort(-score[near], kind="stable")]
            for i in near:
                if not (space := place(int(i), space)):
                    break
            spare = seed
            while space and spare < n:
                if unused[spare]:
                    space = place(spare, space)
                else:
                    spare += 1
    return windows


def _powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _cut(pieces: list[tuple[int, int, int]], lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a window cut into sequences of the given lengths."""
    todo = list(reversed(pieces))
    for length in lengths:
        out = []
        while length:
            i, low, high = todo.pop()
            take = min(length, high - low)
            out.append((i, low, low + take))
            length -= take
            if low + take < high:
                todo.append((i, low + take, high))
        yield out


def _kind(path: str) -> np.dtype:
    """How ids are held between stages."""
    return np.dtype("<u2" if encoding(path).max_token_value < 1 << 16 else "<u4")


def tokenised(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Stretches of documents (id, text): id, start, doc_tokens, length and ids in binary, a row per
    whole window and one for the rest; and a row per task with df alone, the number of rests of the
    task that have each id."""
    kind, size = _kind(path), encoding(path).max_token_value + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        names = ["id", "start", "doc_tokens", "length", "ids", "df"]

        def rows(ids: pa.Array, places: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            start, tokens, length, held = (list(x) for x in zip(*places, strict=True))
            if rests := [x for x in held if len(x) < window]:
                df[:] += np.bincount(_terms(rests)[0], minlength=size)
            return pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(tokens, pa.int64()), pa.array(length, pa.int64()), pa.array([x.tobytes() for x in held], pa.binary()), pa.nulls(len(start), pa.list_(pa.int64()))], names)

        last = None
        for batch in batches:
            column, last = batch.column(1), batch.column(0)
            of, places, total = [], [], 0
            for i in range(len(batch)):
                ids = token_ids(column[i].as_py(), path)
                for low in range(0, len(ids), window):
                    piece = ids[low : low + window]
                    of.append(i)
                    places.append((low, len(ids), len(piece), piece.astype(kind)))
                total += len(ids)
                if total >= FLUSH_IDS or i + 1 == len(batch):
                    yield rows(last.take(pa.array(of, pa.int64())), places)
                    of, places, total = [], [], 0
        if last is not None:
            no = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, last.type), no, no, no, pa.nulls(1, pa.binary()), pa.array([df], pa.list_(pa.int64()))], names)
        release()

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, start long, doc_tokens long, length long, ids binary, df array<long>")


def corpus_of(table: DataFrame, size: int, window: int) -> tuple[Corpus, int]:
    """The corpus of a table of `tokenised`, and the ids of all rests; what comes to the driver is a
    number per id of the vocabulary."""
    df = np.zeros(size, np.int64)
    each = table.where("df is not null").select(F.posexplode("df").alias("term", "n")).where("n > 0")
    for term, n in each.groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    n, ids = table.where(F.col("length") < window).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return Corpus(df, n, ids), ids


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, window: int = WINDOW, shard_items: int = SHARD_ITEMS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, start (ids of the document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (in the sequence), and with with_ids the ids themselves.

    Every document, end id included, lies in its pieces without gap or overlap, and every sequence
    has `window` ids or a power of two below. A null or empty text is the end id alone; repeated
    rows are documents of their own; an empty table gives no rows; further columns are not read.
    Texts of any length are taken whole, one at a time.
    """
    bounded_batches(docs.sparkSession)
    path = vocabulary_path or default_vocabulary_path()
    kind = _kind(path)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = scratch(tokenised(given, path, window), "tokens")
    corpus, total = corpus_of(table, encoding(path).max_token_value + 1, window)
    pieces = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    id_type = given.schema["id"].dataType.simpleString()

    def rows(ids: pa.Array, doc: np.ndarray, start: np.ndarray, parts: list[np.ndarray], tokens: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        crc = np.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], np.int64)
        columns = [start, np.array([len(p) for p in parts], np.int64), crc, tokens, sequence, offset]
        held = [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))] * with_ids
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *map(pa.array, columns), *held], ["id", *[c.split()[0] for c in pieces.split(", ")]])

    def fields(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return at["id"], at["start"].to_numpy(), at["doc_tokens"].to_numpy(), [np.frombuffer(x, kind) for x in at["ids"].to_pylist()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (1 << 61) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            for at in range(0, len(batch), 512):
                ids, start, tokens, parts = fields(batch.slice(at, 512))
                yield rows(ids, np.arange(len(ids)), start, parts, tokens, sequence + np.arange(len(ids)), np.zeros(len(ids), np.int64))
                sequence += len(ids)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                for m in corpus.minima(fields(part)[3]):
                    part = part.append_column(f"m{len(part.schema.names)}", pa.array(m))
                yield part
        release()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            ids, start, tokens, items = fields(both)
            out: list[tuple[int, int, int, int, int]] = []  # item, from, to, sequence, offset
            for found in fill_windows(items, window, corpus):
                size = sum(high - low for _, low, high in found)
                for cut in _cut(found, [window] if size == window else _powers(size)):
                    offset = 0
                    for i, low, high in cut:
                        out.append((i, low, high, sequence, offset))
                        offset += high - low
                    sequence += 1
            item, low, high, seq, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
            return rows(ids, item, start[item] + low, [items[i][a:b] for i, a, b in zip(item, low, high, strict=True)], tokens[item], seq, offset)

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, shard_items - sum(map(len, held)))
                held.append(part)
                at += len(part)
                if sum(map(len, held)) == shard_items:
                    yield flush()
        if held:
            yield flush()
        release()

    own = ["id", "start", "doc_tokens", "ids"]
    full = table.where(F.col("length") == window).select(*own).mapInArrow(whole, f"id {id_type}, {pieces}")
    routed = table.where(F.col("length") < window).select(*own).mapInArrow(route, f"id {id_type}, start long, doc_tokens long, ids binary, m1 long, m2 long")
    routed = scratch(routed, "routed")
    order = ["m1", "m2", F.xxhash64("ids"), F.xxhash64("id")]
    dealt = routed.repartitionByRange(max(1, -(-total // RANGE_IDS)), *order).sortWithinPartitions(*order)
    rest = dealt.select(*own).mapInArrow(pack, f"id {id_type}, {pieces}")
    return full.unionByName(rest).withColumnRenamed("id", id_col)
