"""Windows of many texts are handed over piece by piece."""

from __future__ import annotations

import pyarrow as pa

from tidemark.operators import chunking


def test_a_batch_is_handed_over_in_pieces(monkeypatch):
    monkeypatch.setattr(chunking, "FLUSH_CHARS", 1000)
    texts = ["one two three " * 30, None, "", " ", "x" * 5000, *["a b"] * 500, "last"]
    pieces = list(chunking.windows_of(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["y"])]), 8, 25))
    assert max(map(len, pieces)) <= 400 and len(pieces) > 3
    wanted = [chunking.word_windows(t, 8, 25) if t and t.strip() else [] for t in [*texts, "y"]]
    assert [w for p in pieces for w in p.to_pylist()] == wanted


def test_table_of_many_texts(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "word " * i) for i in range(300)], "doc_id long, text string")
    found = chunking.window_chunks(docs, 16, 25).collect()
    assert len(found) == 300 and all(r.chunks == (chunking.word_windows(r.text, 16, 25) if r.text and r.text.strip() else []) for r in found)
