"""Whitening of embeddings by covariances from polarisation.

Entries become whole numbers on a grid (``floor(64 * c) + 1000000``), so every sum is exact.  A first pass sums each
dimension of the distinct vectors.  A second one centres them at the whole number nearest to the mean and
adds up the squares of every dimension and of the sum of every two dimensions, in whole numbers without a bound; what the
centre lacks to the mean is taken off exactly.  ``Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2`` then gives the
whole matrix, rounded once, and ``eigh`` its components.

Only sums leave the tasks: ``d * (d + 1) / 2`` of them for ``d`` dimensions, whatever the number of rows.

* Rows whose vector is null, empty, or holds a null, an infinite or undefined entry or one that has no whole number of
  64 bits are left out, and so are vectors of another length than most rows have (of lengths as frequent, the longest).
* Repeated vectors count once in the fit and keep all their rows in the result; null and repeated ids stay as they are.
* A component without variance has null ``whitened``; without any variance ``explained`` is null too.  ``deviation``
  is null where it exceeds a long.  Without usable rows the result is empty.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common

SCALE, OFFSET = 64, 1_000_000
#: Whole numbers beyond this size are added up without a bound of bits.
NARROW = 1 << 62
#: Sums travel as two decimals, ``high * 2**LIMB + low``.
LIMB = 60
SUMS = "place int, high decimal(38,0), low decimal(38,0)"
RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
          "identity_error double")


# ---- whole-number vectors -------------------------------------------------------


def grid(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``size`` and ``x`` (little-endian longs) of the usable rows."""
    schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("vec_id"), batch.column("embedding")
            keep, size, x = [], [], []
            for k in range(batch.num_rows):
                entries = column[k].values
                if entries is None or not len(entries) or entries.null_count:
                    continue
                scaled = np.floor(entries.to_numpy(zero_copy_only=False) * SCALE)
                if np.all(np.abs(scaled) < float(NARROW)):  # false for an undefined one as well
                    keep.append(k)
                    size.append(len(scaled))
                    x.append((scaled.astype("<i8") + OFFSET).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int64())), pa.array(size, pa.int32()), pa.array(x, pa.binary())],
                schema=schema,
            )

    entries = F.col("embedding").cast("array<double>")
    return common.arrow_map(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("embedding")),
        run, "vec_id bigint, size int, x binary",
    )


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, d)


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Differences to the centre; Python's whole numbers where a long could overflow."""
    if max(map(abs, centre)) < NARROW >> 1 and (not x.size or np.abs(x).max() < NARROW >> 1):
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def narrow(u: np.ndarray, terms: int) -> bool:
    """Whether squares of sums of two entries, so many of them, add up within a long."""
    if u.dtype == object or not u.size:
        return u.dtype != object
    return 4 * int(np.abs(u).max()) ** 2 * terms < 1 << 63


# ---- exact sums -----------------------------------------------------------------


def _total(rows: DataFrame, d: int, k: int, add) -> list[int]:
    """Exact totals of ``k`` numbers, of which ``add`` gives a batch's share."""
    schema = pa.schema([("place", pa.int32()), ("high", pa.decimal128(38)), ("low", pa.decimal128(38))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, object)
        for batch in batches:
            if batch.num_rows:
                total += add(matrix(batch, d))
        pairs = [divmod(int(t), 1 << LIMB) for t in total]
        with localcontext(prec=38):
            yield pa.RecordBatch.from_arrays([
                pa.array(range(k), pa.int32()), pa.array([Decimal(h) for h, _ in pairs], pa.decimal128(38)),
                pa.array([Decimal(low) for _, low in pairs], pa.decimal128(38)),
            ], schema=schema)

    parts = common.arrow_map(rows.select("x"), run, SUMS)
    found = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out = [0] * k
    for row in found:
        out[row["place"]] = (int(row["high"]) << LIMB) + int(row["low"])
    return out


def dimension_sums(fit: DataFrame, d: int) -> list[int]:
    def add(x: np.ndarray) -> np.ndarray:
        safe = int(np.abs(x).max()) * len(x) < 1 << 63
        return (x if safe else x.astype(object)).sum(axis=0).astype(object)

    return _total(fit, d, d, add)


def pairs(d: int) -> list[tuple[int, int]]:
    """Places of the sums: every dimension with itself, and every two of them."""
    return [(a, b) for a in range(d) for b in range(a, d)]


def squares(fit: DataFrame, d: int, centre: list[int]) -> list[int]:
    """Sums of squares of each centred dimension (a, a) and of the sum of each two (a, b)."""

    def add(x: np.ndarray) -> np.ndarray:
        u = centred(x, centre)
        if not narrow(u, len(u)):
            u = u.astype(object)
        out = []
        for a in range(d):
            both = u[:, a:] + u[:, a : a + 1]
            both[:, 0] = u[:, a]
            out.append((both * both).sum(axis=0))
        return np.concatenate(out).astype(object)

    return _total(fit, d, d * (d + 1) // 2, add)


# ---- the model ------------------------------------------------------------------


class Model:
    """Mean, covariance and components of the distinct vectors."""

    def __init__(self, n: int, sums: list[int], centre: list[int], found: list[int], most: int):
        d = len(sums)
        self.n, self.centre = n, centre
        #: What the sums have beyond the centre: ``sum(x) - n * centre``.
        self.rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
        # n * n times the variance of a dimension, or of the sum of two.
        spread = {}
        for (a, b), q in zip(pairs(d), found, strict=True):
            over = self.rest[a] + (self.rest[b] if a != b else 0)
            spread[a, b] = n * q - over * over
        v = np.empty((d, d))
        for (a, b), s in spread.items():
            if a == b:
                v[a, a] = s / (n * n)
            else:
                v[a, b] = v[b, a] = (s - spread[a, a] - spread[b, b]) / (2 * n * n)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:most]
        self.covariance = v
        self.values, self.vectors = values[order], vectors[:, order]
        trace = sum(spread[a, a] for a in range(d)) / (n * n)
        self.explained = self.values / trace if trace > 0 else np.full(len(order), np.nan)
        self.some = self.values > max(trace, 0) * d * np.finfo(float).eps
        root = np.sqrt(np.where(self.some, self.values, np.nan))
        self.project = self.vectors / root

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows minus the mean, on the components, over the roots of their variances; NaN without variance."""
        u = centred(x, self.centre).astype(float) - np.array([r / self.n for r in self.rest])
        return u @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sum)**2``, exactly."""
        u = centred(x, self.centre)
        most = self.n * (int(np.abs(u).max()) + 1) if u.size else 0
        if u.dtype == object or most * most * u.shape[1] >= 1 << 63:
            u = u.astype(object)
            off = u * self.n - np.array(self.rest, object)
        else:
            off = u * self.n - np.array(self.rest, np.int64)
        out = [int(t) for t in (off * off).sum(axis=1)]
        return [t if t < 1 << 63 else None for t in out]


def identity_error(fit: DataFrame, model: Model, d: int) -> float | None:
    """Largest absolute entry of the whitened fit vectors' covariance minus the identity."""
    if not model.some.any():
        return None
    k = len(model.values)
    schema = pa.schema([("place", pa.int32()), ("total", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(matrix(batch, d))
                total += w.T @ w  # the mean was taken off before
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], schema=schema
        )

    parts = common.arrow_map(fit.select("x"), run, "place int, total double")
    cov = np.zeros(k * k)
    for row in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        cov[row["place"]] = row["total"] / model.n
    off = np.abs(cov.reshape(k, k) - np.eye(k))
    return float(off[np.ix_(model.some, model.some)].max())


def fit_rows(usable: DataFrame) -> tuple[DataFrame | None, int]:
    """The distinct vectors of the most frequent length, written, and that length."""
    lengths = usable.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None, 0
    d = lengths["size"]
    # Copies collapse before the shuffle; a hash of each vector's bytes deals them out.
    return common.written(usable.filter(F.col("size") == d).select("x").distinct(), "whitening-fit"), d


def learn(fit: DataFrame, d: int, most: int = 16) -> Model:
    n = fit.count()
    sums = dimension_sums(fit, d)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    return Model(n, sums, centre, squares(fit, d, centre), most)


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """A row for each usable row and component (``most`` at most): the columns of ``RESULT``."""
    usable = grid(vectors)
    fit, d = fit_rows(usable)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    model = learn(fit, d, most)
    error = identity_error(fit, model, d)
    k = len(model.values)
    explained = [float(e) if np.isfinite(e) else None for e in model.explained]
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch, d)
            each = pa.array(np.repeat(np.arange(m), k))
            w = model.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
            ], schema=schema)

    return common.arrow_map(usable.filter(F.col("size") == d).select("vec_id", "x"), run, RESULT)
