"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

For a byte-pair encoder a sequence of tokens is the encoding of its text exactly if each two
neighbours are the encoding of theirs. So the encoding of every prefix follows from shorter ones:
the last token t of prefix i is the one whose neighbour, the last token of prefix i - |t|, goes
with it, and count[i] = count[i - |t|] + 1. One pass stores the exact count at every prefix, and
any truncation or budget question is answered from the table without encoding again.

Texts fall into chunks (a run of spaces with the word behind it, or a line end) that no token of
the vocabulary straddles, which is verified when a model is loaded; the table of a chunk is kept
for its next occurrence, and a text's table is the chunks' tables, each raised by the sum of those
before it. Characters outside the vocabulary count as many tokens as they have UTF-8 bytes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Chunks and token pairs that a worker remembers; beyond it starts afresh, with the same results.
REMEMBERED = 1_000_000
#: Longest chunk, in characters, that is remembered; longer ones hardly come twice.
REMEMBERED_CHARS = 64
SPACE = "▁"


def default_model_path() -> str:
    """Where the public tokenizer model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PrefixCounter:
    """Exact token counts of all prefixes of texts, for a sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.names = list(self.score)
        self.ids = {piece: i for i, piece in enumerate(self.names)}
        self.size = len(self.names)
        self.joined = {c for piece in self.score if len(piece) > 1 for c in piece}
        if not self.joined <= self.score.keys():
            raise ValueError("a character of a longer piece is no piece itself")
        straddling = any(SPACE in piece.lstrip(SPACE) for piece in self.score)
        cut = "" if "\n" in self.joined else "\n"
        self.pieces = re.compile("(?s).+" if straddling else f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + ("|\n" if cut else ""))
        self.tables: dict[str, bytes | tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.scripts: dict[int, tuple[list[float], list[str], list[str], bool]] = {}

    def merges(self, token: int) -> tuple[list[float], list[str], list[str], bool]:
        """How a token comes about: the scores of its merges in order, and its leftmost and
        rightmost parts before each merge and at the end, and whether it ends as one part."""
        found = self.scripts.get(token)
        if found is None:
            parts, score = list(self.names[token]), self.score
            steps, left, right = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append(best)
                left.append(parts[0])
                right.append(parts[-1])
            found = self.scripts[token] = (steps, left, right, len(parts) == 1)
        return found

    def goes_with(self, left: int, right: int) -> bool:
        """Whether two tokens next to each other stay as they are: played merge by merge, best
        first and leftmost of equals, no merge across their border comes up."""
        steps, _, ends, whole = self.merges(left)
        others, begins, _, other_whole = self.merges(right)
        score, i, j, ok = self.score, 0, 0, whole and other_whole
        while ok:
            across = score.get(ends[i] + begins[j])
            own = steps[i] if i < len(steps) else None
            other = others[j] if j < len(others) else None
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                ok = False
            elif own is not None and (other is None or own >= other):
                i += 1
            elif other is not None:
                j += 1
            else:
                break
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[left * self.size + right] = ok
        return ok

    def table(self, chunk: str) -> bytes | tuple[int, ...]:
        """Counts of the prefixes of 1, 2, ... characters of a chunk."""
        found = self.tables.get(chunk)
        if found is not None:
            return found
        ids, longest, pairs, size = self.ids, self.longest, self.pairs, self.size
        counts, last = [0], [-1]
        for i in range(1, len(chunk) + 1):
            for start in range(i - longest if i > longest else 0, i):
                token = ids.get(chunk[start:i])
                if token is None:
                    continue
                before = last[start]
                if before < 0:
                    break
                ok = pairs.get(before * size + token)
                if ok or ok is None and self.goes_with(before, token):
                    break
            else:  # a character that no token has: as many tokens as bytes, and nothing joins it
                start, token = i - 1, -1
            counts.append(counts[start] + (1 if token >= 0 else len(chunk[start].encode())))
            last.append(token)
        if len(self.tables) >= REMEMBERED:
            self.tables.clear()
        del counts[0]
        found = bytes(counts) if max(counts) < 256 else tuple(counts)  # counts may fall as a chunk grows
        if len(chunk) <= REMEMBERED_CHARS:
            self.tables[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text as the encoder sees it: a space before it, spaces as their own sign."""
        return self.pieces.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        known, table = self.tables, self.table
        return sum([(known.get(c) or table(c))[-1] for c in self.chunks(text)])

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ..., len(text) characters."""
        if not text:
            return np.zeros(1, np.int64)
        tables = [self.table(c) for c in self.chunks(text)]
        ends = np.cumsum([0] + [t[-1] for t in tables])[:-1]
        lengths = [len(t) for t in tables]
        counts = np.fromiter((n for t in tables for n in t), np.int64, sum(lengths)) + np.repeat(ends, lengths)
        counts[0] = 0  # the space before the text is no prefix of it
        return counts

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most budget tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter per worker and model."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), and fit_chars: the code points
    of the longest prefix within the limit, answered from the table of prefixes.

    A null text counts as empty: 0 bytes, 0 tokens. Whole texts of any length are counted; repeated
    rows each return a row; an empty table gives none; further columns are not looked at. Narrow:
    no shuffle, and a lost task is recomputed alone.
    """
    bounded_batches(docs.sparkSession)
    path = model_path or default_model_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                totals = [count.count(t) for t in texts]
                fits = [len(t) if n <= limit else count.fitting(t, limit) for t, n in zip(texts, totals, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())],
                    ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return given.mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("id", id_col)


def token_prefixes(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and prefix_tokens: the whole table of a text, an array with the token count of its first
    0, 1, 2, ... code points. Truncation to b tokens is the last index with a value of at most b."""
    bounded_batches(docs.sparkSession)
    path = model_path or default_model_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                tables = [count.prefixes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tables, pa.list_(pa.int64()))], ["id", "prefix_tokens"])

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(work, f"id {kind}, prefix_tokens array<bigint>").withColumnRenamed("id", id_col)
