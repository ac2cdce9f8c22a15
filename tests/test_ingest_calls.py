"""Calls of the state, each a message to the JVM, and rows instead of a data frame for each conversation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from tests.test_ingest import Clock, Handle, Map, Value, fed
from tidemark.streaming import ingest


class Counted(Handle):
    def __init__(self):
        super().__init__()
        self.calls = []

    def getValueState(self, *_):  # noqa: N802
        return counted(Value, self.calls)

    def getMapState(self, *_):  # noqa: N802
        return counted(Map, self.calls)


def counted(kind, calls):
    def called(name):
        def call(self, *a):
            calls.append(name)
            return getattr(kind, name)(self, *a)

        return call

    names = [n for n in ("exists", "get", "update", "iterator", "keys", "removeKey", "updateValue", "clear") if hasattr(kind, n) and not (kind is Map and n in ("get", "update"))]
    return type(kind.__name__, (kind,), {n: called(n) for n in names})()


def test_few_calls_of_the_state():
    handle = Counted()
    p = ingest.OpenExchanges()
    p.init(handle)
    assert fed(p, (0, "user", "q"), (1, "assistant", "a")) == [(1, "q", ("a",), False)]
    assert handle.calls == ["get", "update"]
    handle.calls.clear()
    fed(p, (3, "assistant", "c"), (4, "user", "r"))  # beyond a gap
    assert sorted(handle.calls) == ["get", "iterator", "updateValue", "updateValue"]
    handle.calls.clear()
    assert fed(p, (2, "assistant", "b")) == [(1, "q", ("a", "b", "c"), True)]
    assert sorted(handle.calls) == ["clear", "get", "iterator", "update"]


@pytest.mark.parametrize("idle", [None, 60])
def test_rows_are_the_frames_rows(idle):
    rng = random.Random(3)
    turns = [(t, rng.choice(["user", "assistant", "tool"]), rng.choice([None, "", f"x{t}"])) for t in range(40) if t != 20]
    rng.shuffle(turns)
    frames, rows = ingest.OpenExchanges(idle=idle), ingest.OpenExchangeRows(idle=idle)
    for p in (frames, rows):
        p.init(Handle())
    plain = lambda found: [(r.conv_id, r.exchange, r.question, tuple(r.answers), r.n_answers, r.closed) for r in found]
    for at in range(0, len(turns), 7):
        part = turns[at : at + 7]
        found = plain(rows.handleInputRows((1,), iter([Row(turn=t, role=r, text=x) for t, r, x in part]), Clock()))
        assert [(e, q, a, c) for _, e, q, a, _, c in found] == fed(frames, *part)
    (frame,) = frames.handleExpiredTimer((1,), Clock(), None)
    late = plain(rows.handleExpiredTimer((1,), Clock(), None))
    assert late and [(c, e, n) for c, e, _, _, n, _ in late] == list(zip(frame["conv_id"], frame["exchange"], frame["n_answers"], strict=True))
