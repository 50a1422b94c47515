"""Whitening of embeddings with an exact covariance.

Entries become integers (floor(1024 * c) + 100000), so sums and products can be exact. A first pass sums
each dimension. A second one centres every vector by these sums (y = n * x - S, still integers), splits y into
limbs of LIMB bits and multiplies limbs as float64 matrices, BLOCK rows at a time: each product is below
2 ** (2 * LIMB) and BLOCK of them stay within 2 ** 53, so BLAS rounds nothing. A task recombines its limbs'
products as big integers and sends one row for each pair of dimensions, in parts of 32 bits; Spark sums the
parts. The driver gets a row for each pair of dimensions, whatever the number of vectors, divides (correctly
rounded) and takes eigenvectors. A third pass measures the covariance of what comes out, each block centred by its own mean
and blocks merged by their means; the last one returns the vectors.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of another
length than the most frequent one (the greater of two) can't be projected with the others and are dropped as well.
floor(1024 * c) beyond 2 ** 62 either way counts as that bound. Repeated rows and null ids are rows like others.
Components whose variance is nothing but rounding (all vectors equal, fewer dimensions than components) don't exist:
without any, or without vectors, the result is empty. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, table

#: Bits of a limb, and rows multiplied at once: BLOCK * 2 ** (2 * LIMB) = 2 ** 53.
LIMB, BLOCK = 20, 1 << 13
#: Entries of a block at most, where vectors are long.
BLOCK_ENTRIES = 1 << 21
#: Bits of the parts in which big integers are summed by Spark.
PART = 32
SCALE, SHIFT, REACH = 1024.0, 100_000, 1 << 62


def _blocks(col: pa.Array, dim: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integers of these rows) of the vectors that count, some at a time; of one length, where given."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = 0
    while at < len(col):
        lengths = pc.fill_null(pc.list_value_length(col.slice(at, BLOCK)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fits = int(np.searchsorted(np.cumsum(lengths), BLOCK_ENTRIES, "right"))
        lengths = lengths[: max(1, fits)]
        part = col.slice(at, len(lengths))
        values = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
        row = np.repeat(np.arange(len(lengths)), lengths)
        sound = (lengths > 0) & (np.bincount(row, ~np.isfinite(values), minlength=len(lengths)) == 0)
        start = np.cumsum(lengths) - lengths
        for d in np.unique(lengths[sound]) if dim is None else [dim]:
            rows = np.flatnonzero(sound & (lengths == d))
            if len(rows):
                c = values[start[rows][:, None] + np.arange(d)]
                with np.errstate(over="ignore"):
                    c = np.clip(np.floor(c * SCALE), -float(REACH), float(REACH))
                yield int(d), at + rows, c.astype(np.int64) + SHIFT
        at += len(lengths)


def _sums(vectors: DataFrame) -> DataFrame:
    """(dim, j, n, total in two parts, least, most) of each task, length and dimension."""

    def run(batches):
        found: dict[int, list] = {}
        for b in batches:
            for d, rows, x in _blocks(b.column(0)):
                n, low, high, least, most = found.get(d) or (0, 0, 0, x[0], x[0])
                low, high = low + (x & (2**PART - 1)).sum(0), high + (x >> PART).sum(0)
                found[d] = [n + len(rows), low, high, np.minimum(least, x.min(0)), np.maximum(most, x.max(0))]
        for d, (n, low, high, least, most) in found.items():
            columns = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n, np.int64), low, high, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["dim", "j", "n", "low", "high", "least", "most"])

    return vectors.mapInArrow(run, "dim int, j int, n long, low long, high long, least long, most long")


class Fit:
    """Number of vectors, sums of their dimensions, and the bound of centred entries; all a driver keeps of the rows."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums, self.dim = n, np.array(sums, dtype=object), len(sums)
        self.bound = [max(n * m - s, s - n * k) for s, k, m in zip(sums, least, most)]
        self.limbs = max(1, -(-max(self.bound).bit_length() // LIMB))
        self.long = n * max(map(abs, [*least, *most])) < 2**62  # so are its sums
        if self.long:
            self.sums = self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where these hold them, Python's where they don't."""
        return self.n * (x if self.long else x.astype(object)) - self.sums

    def split(self, y: np.ndarray) -> list[np.ndarray]:
        """y's limbs, lowest first; the highest one has the sign."""
        low = [(y >> (LIMB * k)) & (2**LIMB - 1) for k in range(self.limbs - 1)]
        return [x.astype(np.int64) for x in [*low, y >> (LIMB * (self.limbs - 1))]]

    def norms(self, y: np.ndarray) -> pa.Array:
        """Sum of squares of each row, exact, as decimals of 38 digits; null where it has more."""
        if sum(b * b for b in self.bound) < 2**63:
            return pa.array((y * y).sum(1).astype(np.int64)).cast(pa.decimal128(38, 0))
        limbs, total = self.split(y), np.zeros(len(y), object)
        for k, a in enumerate(limbs):
            for m, b in enumerate(limbs[k:], k):
                total = total + (a * b).sum(1).astype(object) * ((1 if k == m else 2) << (LIMB * (k + m)))
        return pa.array([Decimal(t) if t < 10**38 else None for t in total.tolist()], pa.decimal128(38, 0))


def fit(vectors: DataFrame) -> Fit | None:
    """Of the vectors that count (the first column); None if there are none."""
    sums = table(_sums(vectors).groupBy("dim", "j").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")], F.min("least").alias("least"), F.max("most").alias("most")), "sums")
    first = sums.filter("j = 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    rows = sums.filter(F.col("dim") == first[0]["dim"]).orderBy("j").collect() if first else []  # a row for each dimension
    forget(sums)
    if not rows:
        return None
    return Fit(rows[0]["n"], [r["low"] + (r["high"] << PART) for r in rows], [r["least"] for r in rows], [r["most"] for r in rows])


def products(vectors: DataFrame, at: Fit) -> np.ndarray:
    """Sum over all vectors of y_i * y_j, as exact big integers, for each pair of dimensions."""
    bits = (at.n * max(at.bound) ** 2).bit_length() + 1
    parts = range(bits // PART + 1)
    upper = np.triu_indices(at.dim)

    def run(batches):
        total = np.zeros(len(upper[0]), object)
        pairs = [(k, m) for k in range(at.limbs) for m in range(k, at.limbs)]
        sums, added = {p: np.zeros((at.dim, at.dim), np.int64) for p in pairs}, 0

        def recombined():
            out = 0
            for (k, m), p in sums.items():
                p = p if k == m else p + p.T
                out = out + p[upper].astype(object) * (1 << (LIMB * (k + m)))
                sums[k, m][:] = 0
            return out

        seen = False
        for b in batches:
            for _, _, x in _blocks(b.column(0), at.dim):
                limbs = [limb.astype(np.float64) for limb in at.split(at.centred(x))]
                for k, m in pairs:
                    sums[k, m] += (limbs[k].T @ limbs[m]).astype(np.int64)
                added, seen = added + 1, True
                if added == 256:  # of 2 ** 53 each, and twice that when mirrored
                    total, added = total + recombined(), 0
        if seen:
            total = total + recombined()
            low = [(total >> (PART * k)) & (2**PART - 1) for k in parts[:-1]]
            columns = [upper[0].astype(np.int32), upper[1].astype(np.int32), *[x.astype(np.int64) for x in [*low, total >> (PART * parts[-1])]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["i", "j", *[f"p{k}" for k in parts]])

    found = vectors.mapInArrow(run, "i int, j int, " + ", ".join(f"p{k} long" for k in parts))
    out = np.zeros((at.dim, at.dim), object)
    for r in found.groupBy("i", "j").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in parts]).collect():  # a row for each pair
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = sum(r[f"p{k}"] << (PART * k) for k in parts)
    return out


def principal(total: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit eigenvectors as columns, eigenvalues, shares of the trace) of the covariance total / n ** 3, greatest first.
    Of an eigenvector and its negative the one whose greatest entry is positive."""
    dim = len(total)
    v = np.array([[total[i, j] / n**3 for j in range(dim)] for i in range(dim)], np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    real = int((e > dim * np.finfo(float).eps * max(e[0], 0)).sum()) if e[0] > 0 else 0
    k = min(components, real)
    e, u = e[:k], u[:, :k]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(k)])
    trace = sum(total[i, i] for i in range(dim)) / n**3
    return u, e, e / trace if k else e


def _identity_error(vectors: DataFrame, at: Fit, w: np.ndarray) -> float:
    """Largest absolute entry of the projected vectors' covariance minus the identity."""
    upper = np.triu_indices(w.shape[1])

    def run(batches):
        n, mean, m2 = 0, np.zeros(w.shape[1]), np.zeros((w.shape[1],) * 2)
        for b in batches:
            for _, rows, x in _blocks(b.column(0), at.dim):
                z = at.centred(x).astype(np.float64) / at.n @ w
                own = z.mean(0)
                step, z, both = own - mean, z - own, n + len(rows)
                m2 += z.T @ z + np.outer(step, step) * (n * len(rows) / both)
                mean, n = mean + step * (len(rows) / both), both
        if n:
            a, b = upper
            columns = [a.astype(np.int32), b.astype(np.int32), np.full(len(a), n, np.int64), mean[a], mean[b], m2[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "n", "mean_a", "mean_b", "m2"])

    parts = table(vectors.mapInArrow(run, "a int, b int, n long, mean_a double, mean_b double, m2 double"), "moments")
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"all_{c}")
    whole = parts.groupBy("a", "b").agg(mean("mean_a"), mean("mean_b"))  # a row for each pair of components
    between = F.col("n") * (F.col("mean_a") - F.col("all_mean_a")) * (F.col("mean_b") - F.col("all_mean_b"))
    cov = parts.join(whole, ["a", "b"]).groupBy("a", "b").agg((F.sum(F.col("m2") + between) / F.sum("n")).alias("cov"))
    error = cov.agg(F.max(F.abs(F.col("cov") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)))).first()[0]
    forget(parts)
    return float(error)


def whiten(rows: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) of each remaining row. n: vectors fitted on. deviation: the
    exact sum of (n * x - S) ** 2, decimal(38, 0). whitened, explained: arrays by component."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    vectors = rows.select(F.col(vector).cast("array<double>").alias("v"))
    out = f"{key} {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    at = fit(vectors)
    if at is None:
        return spark.createDataFrame([], out)
    u, e, share = principal(products(vectors, at), at.n, components)
    if not len(e):
        return spark.createDataFrame([], out)
    w = u / np.sqrt(e)
    error = _identity_error(vectors, at, w)

    def run(batches):
        for b in batches:
            for _, kept, x in _blocks(b.column(1), at.dim):
                y = at.centred(x)
                z = y.astype(np.float64) / at.n @ w
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                whitened = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(z).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), at.norms(y), whitened], [key, "deviation", "whitened"])

    found = rows.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"{key} {kind}, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*[F.lit(float(s)) for s in share])
    return found.select(key, F.lit(at.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
