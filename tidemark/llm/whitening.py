"""Embedding whitening by LOBPCG, without ever forming the covariance matrix.

The leading eigenvectors of the vectors' covariance V are found by the locally optimal block
preconditioned conjugate gradient method (without a preconditioner). What Spark computes is the
product of V with a block of directions: every block of rows is centred, multiplied by the
directions, and multiplied back, and the products of the blocks are summed by a tree. A round is
one such pass: the directions are an orthonormal basis of the iterate, its residuals and the
previous directions; the Rayleigh-Ritz method on that basis gives the next iterate. Rounds end when
every wanted residual is below TOLERANCE of the largest eigenvalue. A last pass multiplies V by the
result alone; from it come the residuals that are reported, and how far the whitened vectors'
covariance is from the identity. The block is a few directions wider than asked for, which makes
close eigenvalues at its edge converge.

Sums of the entries and of their squares are exact, so the mean, the trace of V and the deviations
are those of the whole numbers themselves. The driver holds directions only: width of a vector times
three blocks. Rows are read from a table of blocks in the shared folder, a lost executor costs a
re-read of its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release
from tidemark.llm.vectors import matrix, nearest_long, vector_blocks, whole_vectors

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Directions iterated beside those asked for.
GUARD = 8
#: Residual at which a component counts as found, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Residual that is accepted where rounding keeps it from falling further.
ACCEPTED = 1e-9
ROUNDS = 500
#: Rounds without a smaller residual after which it is taken to be rounding.
STALLED = 8
#: Eigenvalues below this share of the largest count as zero.
RANK = 1e-12


def _sums(blocks: DataFrame, wide: int, fill: int) -> tuple[list[int], list[int]]:
    """Sums of the entries and of their squares by dimension, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, wide), object)
        for batch in batches:
            for n, width, kind, data in zip(*[batch.column(c).to_pylist() for c in ("n", "width", "kind", "data")], strict=True):
                x = matrix(n, width, kind, data, wide, fill)
                top = max(-int(x.min(initial=0)), int(x.max(initial=0)))
                x = x if top * top * max(1, n) < 2**62 else x.astype(object)
                total += np.array([x.sum(0), (x * x).sum(0)]).astype(object)
        kinds = [pa.int32(), pa.decimal128(38, 0), pa.int32()]
        flat = [[j for _ in (0, 1) for j in range(wide)], [int(v) for v in total.ravel()], [p for p in (0, 1) for _ in range(wide)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(flat, kinds, strict=True)], names=["j", "s", "power"])

    found = blocks.select("n", "width", "kind", "data").mapInArrow(partial, "j int, s decimal(38,0), power int").groupBy("power", "j").agg(F.sum("s").alias("s"))
    out = [[0] * wide, [0] * wide]
    for row in found.collect():  # two numbers per dimension
        out[row.power][row.j] = int(row.s)
    return out[0], out[1]


class Covariance:
    """The covariance of all vectors of a block table, known by its products."""

    def __init__(self, blocks: DataFrame, n: int, wide: int, fill: int):
        self.blocks, self.n, self.wide, self.fill = blocks, n, wide, fill
        self.sums, squares = _sums(blocks, wide, fill)
        self.base = [s // n for s in self.sums]
        self.rest = np.array([s % n / n for s in self.sums])
        self.trace = sum(n * q - s * s for s, q in zip(self.sums, squares, strict=True)) / n**2

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, in doubles: the whole part of the mean is taken off exactly."""
        return _centred(x, self.base, self.rest)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q: one pass over all rows."""
        wide, fill, base, rest = self.wide, self.fill, self.base, self.rest

        def partial(rows: Iterator) -> Iterator[np.ndarray]:
            total = np.zeros(q.shape)
            for r in rows:
                c = _centred(matrix(r.n, r.width, r.kind, r.data, wide, fill), base, rest)
                total += c.T @ (c @ q)
            yield total

        return self.blocks.select("n", "width", "kind", "data").rdd.mapPartitions(partial).treeReduce(np.add, depth=3) / self.n


def _centred(x: np.ndarray, base: list[int], rest: np.ndarray) -> np.ndarray:
    small = max(map(abs, base), default=0) < 2**61 and x.min(initial=0) > -(2**61) and x.max(initial=0) < 2**61
    return (x - np.array(base, np.int64)).astype(np.float64) - rest if small else x.astype(np.float64) - np.array(base, np.float64) - rest


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the span: each block is freed, twice, of what stands before it, and
    directions that are left with nothing are dropped."""
    q = blocks[0]
    for b in blocks[1:]:
        b = b / np.maximum(np.linalg.norm(b, axis=0), 1e-300)
        for _ in range(2):
            b = b - q @ (q.T @ b)
            left, size, _ = np.linalg.svd(b, full_matrices=False)
            b = left[:, size > 1e-8]
        q = np.hstack([q, b])
    return q


def lobpcg(v: Covariance, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The `wanted` leading eigenvectors (columns), their eigenvalues, the certified residual of each
    as a share of the largest eigenvalue, and the number of rounds."""
    block = min(v.wide, wanted + GUARD)
    start = np.random.default_rng(seed).standard_normal((v.wide, block))
    q, x_n = np.linalg.qr(start)[0], block
    least, stalled = float("inf"), 0
    for rounds in range(1, ROUNDS + 1):
        g = v.times(q)
        h = q.T @ g
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1][:block], y[:, ::-1][:, :block]
        x, gx = q @ y, g @ y
        residuals = gx - x * theta
        top = max(theta[0], 1e-300)
        worst = np.linalg.norm(residuals[:, :wanted], axis=0).max() / top
        stalled = 0 if worst < least / 2 else stalled + 1
        least = min(least, worst)
        if worst <= TOLERANCE or (stalled >= STALLED and least <= ACCEPTED) or q.shape[1] == v.wide:
            break
        previous = q[:, x_n:] @ y[x_n:]
        x = np.linalg.qr(x)[0]
        q, x_n = _basis(x, residuals, *([previous] if previous.size and np.abs(previous).max() > 0 else [])), x.shape[1]
    x = np.linalg.qr(x)[0][:, :wanted]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
    g = v.times(x)
    theta = (x * g).sum(0)
    certified = np.linalg.norm(g - x * theta, axis=0) / max(theta.max(), 1e-300)
    if certified.max() > ACCEPTED:
        raise ArithmeticError(f"no convergence: residual {certified.max():.2g} after {rounds} rounds")
    return x, theta, certified, rounds


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Projects all vectors on the leading eigenvectors of their covariance, each divided by the root
    of its eigenvalue. A component c of a vector counts as the whole number floor(scale * c) + shift.

    Returns a row per vector and component: the id, component (from 1, by falling eigenvalue), n (the
    number of vectors), deviation (sum over dimensions of (n * x - S)^2, S being the sum of all x;
    beyond 63 bits the nearest long), whitened, explained (eigenvalue over trace), identity_error
    (largest absolute entry of the whitened vectors' covariance minus the identity), residual (of the
    eigenvector, as a share of the largest eigenvalue) and rounds.

    Rows whose vector is null or has a null or non-finite component take no part. Shorter vectors
    count as padded with zeros to the longest, so empty ones are all zeros. Repeated rows and ids count as
    often as they stand. A null id is kept. Components without variance are left out: with fewer
    than `components` dimensions or independent rows there are fewer components, and for equal
    vectors, a single one or none there are no rows. Of equal eigenvalues some basis is taken. Other columns are ignored.
    """
    whole = whole_vectors(df, id_col, vector_col, scale, shift)
    kind = whole.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("deviation long, whitened array<double>").fields])
    known = "component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, rounds int"
    blocks = vector_blocks(whole, "whitening", shift)
    n, wide = blocks.agg(F.sum("n"), F.max("width")).first()
    v = Covariance(blocks, n, wide, shift) if n and wide else None
    if v is None or v.trace <= 0:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string(known).fields]))
    x, theta, certified, rounds = lobpcg(v, min(components, wide))
    there = theta > RANK * theta.max()
    x, theta, certified = x[:, there], theta[there], certified[there]
    order = np.argsort(-theta, kind="stable")
    x, theta, certified = x[:, order] / np.sqrt(theta[order]), theta[order], certified[order]
    error = float(np.abs(x.T @ v.times(x) - np.eye(len(theta))).max())
    base, rest, sums, total = v.base, v.rest, v.sums, n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = np.array([s - total * b for s, b in zip(sums, base, strict=True)], object)
        for batch in batches:
            for i in range(len(batch)):
                m = matrix(*[batch.column(c)[i].as_py() for c in ("n", "width", "kind", "data")], wide, shift)
                c = _centred(m, base, rest)
                size = np.abs(c).max(initial=0) * total
                rough = ((c * total) ** 2).sum(1)
                if wide * (size + 1) ** 2 < 2**62:
                    away = total * (m - np.array(base, np.int64)) - offset.astype(np.int64)
                    deviation = (away * away).sum(1).tolist()
                else:
                    deviation = [2**63 - 1] * len(m)
                    for k in np.flatnonzero(rough < 1.01 * 2.0**63):
                        away = total * (m[k].astype(object) - np.array(base, object)) - offset
                        deviation[k] = nearest_long((away * away).sum())
                z = c @ x
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])
        release()

    # three numbers per component, known by now
    facts = F.array(*[F.struct(F.lit(float(t / v.trace)).alias("explained"), F.lit(float(r)).alias("residual")) for t, r in zip(theta, certified, strict=True)])
    each = blocks.select("n", "width", "kind", "data", "ids").mapInArrow(project, out).select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    fact = F.element_at(facts, F.col("i") + 1)
    return each.select(
        F.col("id").alias(id_col), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        fact["explained"].alias("explained"), F.lit(error).alias("identity_error"), fact["residual"].alias("residual"), F.lit(rounds).alias("rounds"),
    )
