"""The stream of turns, split over files in any way, against the batch operator."""

from __future__ import annotations

import random
from typing import Any

import pandas as pd
import pytest

from tidemark.operators import conversations
from tidemark.streaming import access, ingest

SCHEMA = "conv_id long, turn long, role string, text string"


def turns(seed=2, n=30):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"text {c}.{t} " + "word " * rng.randint(0, 20)) for c in range(n) for t in range(rng.randint(1, 9))]


def shown(df):
    return sorted((r.conv_id, r.exchange, r.question, tuple(r.answers), r.n_answers) for r in df.collect())


def test_any_split_gives_the_rows_of_the_batch(spark, tmp_path):
    rows, rng = turns(), random.Random(7)
    rows += [(100, t, ("user", "assistant")[t % 2], f"six {t} " + "long enough for a chunk " * 4) for t in range(6)]
    parts = [[], [], []]
    for row in rows:
        parts[row[1] // 2 % 3 if row[0] == 100 else rng.randrange(3)].append(row)
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for i, part in enumerate(parts):
        again = rng.sample(parts[0], 5) if i else []  # turns that are there already
        spark.createDataFrame(part + again, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest(access.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), out, mark, conversations.chunks_of).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA)
    batch = conversations.exchanges(whole)
    assert shown(ingest.current(spark, out)) == shown(batch)
    assert len([r for r in shown(ingest.current(spark, out)) if r[0] == 100]) == 3
    chunk = lambda df: sorted((r.chunk_id, r.content) for r in df.collect())
    assert chunk(ingest.current_chunks(spark, out)) == chunk(conversations.exchange_chunks(whole))
    assert {r.conv_id: r.exchanges for r in ingest.processed(spark, out).collect()} == {c: max(e for k, e, *_ in shown(batch) if k == c) for c in {r[0] for r in shown(batch)}}
    assert ingest.late_turns(spark, out).count() == 0


def test_ranges_of_turns_change_nothing(spark):
    df = spark.createDataFrame(turns(5, 12) + [(200, t, ("user", "assistant", "assistant")[t % 3], f"x{t}") for t in range(0, 90, 2)], SCHEMA)
    whole = shown(conversations.exchanges(df, 10**6))
    pairs = lambda b: sorted(map(tuple, conversations.adjacent_pairs(df, b).collect()))
    for bucket in (1, 4, 7):
        assert shown(conversations.exchanges(df, bucket)) == whole and pairs(bucket) == pairs(10**6)


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def keys(self):
        return iter(list(dict.keys(self)))

    def removeKey(self, k):  # noqa: N802
        del self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getMapState(self, *_):  # noqa: N802
        return Map()

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class Clock:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def fed(p: ingest.OpenExchanges, *rows: tuple[int, str, str]) -> list[tuple[Any, ...]]:
    frame = pd.DataFrame(rows, columns=["turn", "role", "text"])
    return [(None if pd.isna(e) else int(e), q, tuple(a), c) for f in p.handleInputRows((1,), iter([frame]), Clock()) for e, q, a, c in zip(f["exchange"], f["question"], f["answers"], f["closed"], strict=True)]


def test_a_silent_conversation_gives_up_its_gaps():
    p = ingest.OpenExchanges(idle=60)
    p.init(Handle())
    assert fed(p, (0, "user", "q1"), (2, "assistant", "a2")) == [(1, "q1", ("a2",), False)]
    assert p.handle.timers == [61_000] and dict(p.waiting) == {(2,): ("assistant", "a2")}
    (frame,) = p.handleExpiredTimer((1,), Clock(), None)
    assert list(frame["answers"]) == [["a2"]] and not p.waiting
    assert fed(p, (1, "assistant", "late"), (2, "assistant", "a2"), (3, "user", "q2")) == [(None, "late", (), True), (1, "q1", ("a2",), True)]


@pytest.mark.parametrize("seed", range(20))
def test_state_follows_any_order(seed):
    rng = random.Random(seed)
    rows = [(t, rng.choice(["user", "assistant", "tool"]), f"x{t}") for t in range(12)]
    order = rows[:]
    rng.shuffle(order)
    p, seen = ingest.OpenExchanges(), {}
    p.init(Handle())
    while order:
        n = rng.randint(1, 4)
        for e, q, a, _ in fed(p, *order[:n]):
            seen[e] = (q, a)
        order = order[n:]
    wanted = []
    for _, role, text in rows:
        if role == "user":
            wanted.append((text, ()))
        elif role == "assistant" and wanted:
            wanted[-1] = (wanted[-1][0], (*wanted[-1][1], text))
    if wanted and not wanted[-1][1]:
        wanted.pop()
    assert seen == {i + 1: w for i, w in enumerate(wanted)}
