"""A Feistel permutation of 0 .. n-1 with cycle walking, as Column expressions.

The domain is a rectangle a x b with a = ceil(sqrt(n)) and b = ceil(n / a), so a * b exceeds n by
less than a. A position is a pair (left, right); each round adds a keyed function of one half to
the other modulo the other's radix, and halves and radices swap. An even number of rounds ends in
the original radices. Positions outside 0 .. n-1 are walked on until they fall inside: there are
at most a * b - n of them, so a walk of that length always ends, and as a row starts one with
probability below 1 / sqrt(n), the expected cost per row stays one application.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.common import PRIME

ROUNDS = 6
#: Multiplier of the round function.
FACTOR = 69621


def round_keys(key: int) -> list[int]:
    """The constants of the rounds, from one integer key."""
    state, out = key % PRIME, []
    for i in range(ROUNDS):
        state = (state * 48271 + 11 + i) % PRIME
        out.append(state)
    return out


def div(x: Column, y: Column | int) -> Column:
    """Integer quotient."""
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y))


def _applied(x: Column, a: Column, b: Column, keys: Column, forward: bool) -> Column:
    prime = F.lit(PRIME).cast("long")

    def mixed(v: Column, k: Column) -> Column:
        y = (v * F.lit(FACTOR).cast("long") + k) % prime
        return (y * y % prime) * y % prime

    def step(s: Column, k: Column) -> Column:
        if forward:
            return F.struct(s["r"].alias("l"), ((s["l"] + mixed(s["r"], k)) % s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))
        return F.struct(F.pmod(s["r"] - mixed(s["l"], k), s["b"]).alias("l"), s["l"].alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    start = F.struct(div(x, b).alias("l"), (x % b).alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(keys, start, step, lambda s: s["l"] * s["b"] + s["r"])


def permute(x: Column, n: Column, key: int | Column, inverse: bool = False) -> Column:
    """Where the permutation of 0 .. n-1 under the key sends x, or with inverse, what it sends to
    x. n may differ by row, and so may a key given as a column of longs. Null for null x."""
    x, n = x.cast("long"), n.cast("long")
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = div(n + a - 1, a)
    if isinstance(key, Column):
        order = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(PRIME).cast("long")) for i in range(ROUNDS)]
    else:
        order = [F.lit(k).cast("long") for k in round_keys(key)]
    keys = F.array(*(order[::-1] if inverse else order))
    first = _applied(x, a, b, keys, not inverse)
    walk = F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1).cast("long")))
    return F.when(first < n, first).otherwise(
        F.aggregate(walk, first, lambda at, _: F.when(at < n, at).otherwise(_applied(at, a, b, keys, not inverse)))
    )


def oracle_cycle(n_sql: str, key: int) -> str:
    """DuckDB SQL of a table (x, y): the permutation of 0 .. n-1, n a scalar subquery. For small n."""
    rounds = "SELECT x, x // b AS l, x % b AS r, a, b FROM grid"
    for k in round_keys(key):
        y = f"((r * {FACTOR} + {k}) % {PRIME})"
        rounds = f"SELECT x, r AS l, (l + ({y} * {y} % {PRIME}) * {y} % {PRIME}) % a AS r, b AS a, a AS b FROM ({rounds})"
    return f"""
    side AS (SELECT n, greatest(ceil(sqrt(n))::BIGINT, 1) AS a FROM (SELECT {n_sql} AS n)),
    rect AS (SELECT n, a, (n + a - 1) // a AS b FROM side),
    grid AS (SELECT unnest(range(a * b)) AS x, a, b FROM rect),
    once AS (SELECT x, l * b + r AS y FROM ({rounds})),
    walk(x, y) AS (
        SELECT x, y FROM once WHERE x < (SELECT n FROM rect)
        UNION ALL
        SELECT walk.x, once.y FROM walk JOIN once ON once.x = walk.y WHERE walk.y >= (SELECT n FROM rect)
    ),
    cycle AS (SELECT x, y FROM walk WHERE y < (SELECT n FROM rect))"""
