"""Whitening, vector codes and document fingerprints against NumPy and brute force, on small tables
with nulls, unsound and empty vectors, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import functools
import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import codes, fingerprints, packing, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHES = ["id", "v", "n", "width", "kind", "data", "component", "deviation", "code", "error", "i", "facts", "top", "ids", "labels", "of_label"]


def vector_rows(n=300, d=19, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ np.diag(np.linspace(0.2, 2, d)) + np.sin(np.arange(d))).astype(np.float32)
    rows = [(i, [float(v) for v in r], None if i % 11 == 0 else i % 3) for i, r in enumerate(x)]
    return rows + [rows[7], rows[7], (7, rows[6][1], 9), (None, rows[5][1], None)]


UNSOUND = [(900, None, 1), (901, [1.0, None] + [0.0] * 17, 1), (902, [float("nan")] + [0.0] * 18, 2), (903, [float("inf")] + [0.0] * 18, 2)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(5)


def whole(rows, scale, shift):
    return np.floor(scale * np.array([r[1] for r in rows], np.float64)).astype(np.int64) + shift


# whitening


def test_whitening_equals_numpy(spark):
    rows = vector_rows()
    got = whitening.whiten(table(spark, rows + UNSOUND)).collect()
    x = whole(rows, 1024, 100_000)
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    wanted = c @ u[:, :8] / np.sqrt(e[:8])
    deviation = ((n * x - s) ** 2).sum(1)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    for k in range(8):
        part = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == k + 1)
        for sign in (1, -1):
            brute = sorted((str(row[0]), int(v), float(sign * w)) for row, v, w in zip(rows, deviation, wanted[:, k], strict=True))
            if np.allclose([p[2] for p in part], [b[2] for b in brute], atol=1e-8):
                break
        else:
            raise AssertionError(k)
        assert [p[:2] for p in part] == [b[:2] for b in brute]
    for r in got:
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9 and r.residual < 1e-9


def test_whitening_of_close_eigenvalues_and_few_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(40).astype(np.float32)], None) for i in range(2000)]
    got = whitening.whiten(table(spark, rows))
    assert got.agg(F.max("residual"), F.max("identity_error")).first()[0] < 1e-9
    few = whitening.whiten(table(spark, rows[:4])).collect()
    assert len(few) == 4 * 3  # four vectors differ in three directions
    assert max(abs(sum(r.whitened**2 for r in few if r.component == k) / 4 - 1) for k in (1, 2, 3)) < 1e-9


def test_whitening_without_variance(spark):
    row = (1, [0.5] * 6, None)
    for rows in ([], UNSOUND, [row], [row] * 5, [(1, [], 2), (2, [], 2)]):
        got = whitening.whiten(table(spark, rows) if rows else spark.createDataFrame([], SCHEMA))
        assert got.count() == 0 and got.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_whitening_pads_and_keeps_large_numbers(spark):
    rows = [(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [], 0), (4, [3e5, -3e5], 0), (5, [1e30, 1.0], 0)]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows)).where("component = 1").collect()}
    x = [[min(2**63 - 1, int(np.floor(1024.0 * np.float32(v)))) if v < 1e20 else 2**63 - 1 - 100_000 for v in (r[1] + [0.0, 0.0])[:2]] for r in rows]
    x = [[v + 100_000 for v in r] for r in x]
    s = [sum(r[j] for r in x) for j in (0, 1)]
    for row, v in zip(rows, x, strict=True):
        assert got[row[0]].deviation == vectors.nearest_long(sum((5 * a - b) ** 2 for a, b in zip(v, s, strict=True)))


# codes


def brute_codes(rows, parts, entries, rounds, scale=4096):
    x = [[int(np.floor(scale * np.float64(np.float32(v)))) for v in r[1]] for r in rows]
    width = max(map(len, x))
    x = [v + [0] * (width - len(v)) for v in x]
    cuts = [p * width // parts for p in range(parts + 1)]
    start = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k]))[:entries]
    books = [[x[k][a:b] for k in start] for a, b in zip(cuts, cuts[1:], strict=False)]

    def assign():
        out = []
        for v in x:
            found = [min((sum((s - e) ** 2 for s, e in zip(v[a:b], entry, strict=True)), i) for i, entry in enumerate(book)) for a, b, book in zip(cuts, cuts[1:], books, strict=False)]
            out.append(([i for _, i in found], sum(d for d, _ in found)))
        return out

    for _ in range(rounds):
        assigned = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                members = [x[k][cuts[p] : cuts[p + 1]] for k in range(len(x)) if assigned[k][0][p] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    assigned = assign()
    by_label = {}
    for row, (_, error) in zip(rows, assigned, strict=True):
        by_label[row[2]] = by_label.get(row[2], 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    clip = vectors.nearest_long
    return sorted((str(row[0]), "".join(f"{i:02x}" for i in c), clip(error), clip(by_label[row[2]]), digest) for row, (c, error) in zip(rows, assigned, strict=True))


@pytest.mark.parametrize(("rows", "parts", "entries"), [
    (vector_rows(), 8, 16), (vector_rows(60, 16, 3), 4, 7), (vector_rows(9, 3, 2), 8, 16),
    ([(1, [1.0], 0), (2, [1.0, 2.0], None), (3, [], 0), (4, [3e5, -3e5], 0), (5, [1e12, 1.0], None), (6, [-1e12, 5.0], 1)], 2, 3),
])
def test_codes_equal_brute_force(spark, rows, parts, entries):
    got = codes.compress(table(spark, rows + UNSOUND), parts=parts, entries=entries).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == brute_codes(rows, parts, entries, 6)


def test_codes_with_labels_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "SENT_LABELS", 1)
    rows = vector_rows(80, 8)
    got = codes.compress(table(spark, rows)).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == brute_codes(rows, 8, 16, 6)


def test_codes_of_nothing(spark):
    for rows in ([], UNSOUND):
        got = codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_equal_their_sql(spark):
    path = "/root/testdata/sf0.001"
    got = codes.compress(spark.read.parquet(f"{path}/embeddings.parquet")).collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(codes.oracle()).fetchall())


# fingerprints

_MASK = 2**64 - 1


def brute_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def brute_level(symbols, level):
    """A level of the parse, symbol by symbol: the names of the phrases, and the range of symbols of each."""
    step = 0x9E3779B97F4A7C15
    runs = []
    for i, s in enumerate(symbols):
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1, i])
    own = [s if n == 1 else brute_mix(s ^ brute_mix(n * step & _MASK)) for s, n, _ in runs]
    tossed = [s for s, _, _ in runs]
    for _ in range(4):
        out = [tossed[0] & 1]
        for a, b in zip(tossed, tossed[1:], strict=False):
            place = ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(2 * place + (b >> place & 1))
        tossed = out
    starts = [0] + [i for i in range(1, len(own) - 1) if tossed[i - 1] < tossed[i] > tossed[i + 1]]
    names = []
    for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
        total = sum(brute_mix((own[k] + (k - a + 1) * step) & _MASK) for k in range(a, b)) & _MASK
        names.append(brute_mix(total ^ ((b - a) * 64 + level)))
    return names, [(runs[a][2], runs[b][2] if b < len(runs) else len(symbols)) for a, b in zip(starts, [*starts[1:], len(own)], strict=True)]


def brute_print(text):
    if not text:
        return 0, []
    symbols, level, hashes = [ord(c) for c in text], 0, set()
    while level == 0 or len(symbols) > 1:
        level += 1
        symbols, _ = brute_level(symbols, level)
        if level >= fingerprints.FIRST_LEVEL or len(symbols) == 1:
            hashes |= {s >> 32 for s in symbols}
    return symbols[0], sorted(hashes)[: fingerprints.KEPT]


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    if not a[1] or not b[1]:
        return 0.0
    least = sorted({*a[1], *b[1]})[: fingerprints.KEPT]
    return len({*a[1]} & {*b[1]} & {*least}) / len(least)


def brute_rows(rows):
    texts = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = brute_print(text), brute_print(changed), brute_print(following)
        shown = [f"{p[0]:016x}" + "".join(f"{h:08x}" for h in p[1]) for p in (a, b)]
        yield (str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), *shown, brute_likeness(a, b), brute_likeness(a, c))


def text_rows():
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 8))) for _ in range(90)]
    rows = [(i * 3, " ".join(rng.choice(lexicon) for _ in range(rng.randint(0, 150)))) for i in range(70)]
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(9)]
    rows += [(500, None), (501, ""), (502, "x"), (503, "aaaa"), (504, "ab"), (505, "\U0001d11e\U0001d11e!"), (506, "a" * 30_000), (507, "tick tock " * 9000), (None, "without id")]
    return rows


DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def printed(spark):
    df = spark.createDataFrame(text_rows(), DOCS).withColumns({c: F.lit("clash") for c in ["id", "salt", "kind", "part", "n_chars", "fingerprint", "before"]})
    return fingerprints.document_fingerprints(df.repartition(6)).collect()


def test_fingerprints_equal_brute_force(printed):
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in printed) == sorted(brute_rows(text_rows()))


def test_equal_texts_have_equal_fingerprints(printed):
    texts = {i: t or "" for i, t in text_rows()}
    by_text = {}
    for r in printed:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_fingerprints_of_few_and_repeated_rows(spark):
    def run(rows):
        return fingerprints.document_fingerprints(spark.createDataFrame(rows, DOCS)).collect()

    assert run([]) == []
    (one,) = run([(1, "by itself")])
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"by itby i").hexdigest()
    many = run([(1, "again")] * 40 + [(None, None)] * 40)
    assert len(many) == 80 and sum(r.near_next < 1 for r in many) == 2
    assert {r.fingerprint for r in many if r.doc_id is None} == {"0" * 16}


@settings(max_examples=40, deadline=None)
@given(st.text("abc ", min_size=200, max_size=400), st.text("abc ", max_size=60), st.text("abc ", max_size=60))
def test_equal_substrings_share_their_interior_phrases(inner, before, after):
    def levels(text, low, high):
        """Names of the phrases that lie in [low, high) of the text, by level."""
        spans, symbols, out = [(i, i + 1) for i in range(len(text))], [ord(c) for c in text], []
        for level in (1, 2):
            symbols, ranges = brute_level(symbols, level)
            spans = [(spans[a][0], spans[b - 1][1]) for a, b in ranges]
            out.append({s for s, (a, b) in zip(symbols, spans, strict=True) if low <= a and b <= high})
        return out

    a, b = f"{before}{inner}{after}", f"{after}x{inner}"
    margin = 80
    here = levels(a, len(before), len(before) + len(inner))
    there = levels(b, len(after) + 1, len(b))
    deep = levels(a, len(before) + margin, len(before) + len(inner) - margin)
    if max(len(list(g)) for g in _runs(inner)) < 10:
        assert deep[0] <= here[0] & there[0]
        assert deep[1] <= there[1]


def _runs(text):
    out = [[text[0]]]
    for c in text[1:]:
        if c == out[-1][-1]:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def test_text_form_round_trip():
    found = fingerprints.fingerprints(["one text that is long enough for some phrases", "", "two"])
    for p in found:
        back = fingerprints.read(fingerprints.shown(p))
        assert back[0] == p[0] and (back[1] == p[1]).all()


def test_half_edited_texts_are_nearer_than_others(spark):
    got = fingerprints.document_fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 100").collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 0.95 * len(got)
    strangers = sorted(r.near_next for r in got)
    assert strangers[len(got) // 2] < 0.05


# packing's ids


@functools.cache
def named_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext", "  ", "\n\n", "'ll", "  ", "́", "\U0001f600", "\r\n", "\x00"])), max_size=6).map("".join))
def test_packing_ids_are_those_of_the_tokenizers_library(text):
    assert packing.token_ids(text, packing.default_vocabulary_path())[:-1].tolist() == named_tokenizer().encode(text, add_special_tokens=False).ids


def test_packing_ids_of_documents():
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null").fetchall()
    path = packing.default_vocabulary_path()
    assert all(packing.token_ids(t, path)[:-1].tolist() == named_tokenizer().encode(t, add_special_tokens=False).ids for (t,) in rows)
