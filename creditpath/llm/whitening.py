"""Embedding whitening: principal components of a distributed covariance, refined in mixed precision.

Vectors are fixed-point integers, so sums and products over any number of rows are exact and do
not depend on how rows are dealt out or retried. Tasks add up their rows' products as integers;
Spark adds the tasks'; the covariance is rounded once, at the end.

The eigenvectors come from a float32 solver and are corrected by Ogita and Aishima's iteration,
which takes a few matrix products in extended precision and doubles the right digits each time.
It divides by differences of eigenvalues, so eigenvalues that cannot yet be told apart are a
cluster: their space is corrected as a whole, and a small eigenproblem within it, shifted by the
cluster's mean, parts it. The next step, being more precise, has smaller clusters.

The driver holds matrices of the vectors' size only (dimension squared), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from creditpath.llm.common import stash

UNITS, OFFSET = 1024, 100_000  # of a fixed-point entry
# An entry is in range when its fixed-point form is; others count as non-finite.
RANGE = 2.0**40
COMPONENTS = 8
MAX_STEPS = 30
# An eigenvalue up to this share of the trace is zero: its direction holds no variance.
NO_VARIANCE = 1e-16
_EXACT = 2**53  # integers below are exact as doubles
_LONG = 2**62


def fixed_point(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``x``: floor(1024 * c) + 100000 for each entry c.

    Rows whose vector is NULL or empty, or has an entry that is NULL, NaN, infinite or 2^40 or more, are left out.
    """
    entries = F.col(column)
    valid = (F.size(entries) > 0) & F.forall(entries, lambda c: F.abs(c.cast("double")) < RANGE)
    x = F.transform(entries, lambda c: F.floor(c.cast("double") * UNITS).cast("long") + F.lit(OFFSET).cast("long"))
    return vectors.where(valid).withColumn("x", x)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The arrays of one column, all of one length, as rows."""
    entries = batch.column(batch.schema.get_field_index(column))
    flat = entries.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(entries), -1)


def _largest(z: np.ndarray) -> int:
    return int(max(z.max(initial=0), -z.min(initial=0)))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if _largest(x) * len(x) < _LONG:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def exact_products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` as Python integers, by floating-point products where these are exact."""
    square = _largest(z) ** 2
    if square * len(z) < _EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if square < _EXACT:
        rows = (_EXACT - 1) // square
        return sum(exact_products(z[i : i + rows]) for i in range(0, len(z), rows))
    whole = z.astype(object)
    return whole.T @ whole


def _numbers(places: list[tuple], totals: list) -> pa.RecordBatch:
    columns = [pa.array([p[k] for p in places], pa.int32()) for k in range(2)]
    names = ["i", "j", "total"]
    return pa.RecordBatch.from_arrays([*columns, pa.array([str(t) for t in totals], pa.string())], names=names)


def _totals(rows: DataFrame, partial) -> dict[tuple[int, int], int]:
    """Integer totals over all rows by (i, j); ``partial`` makes one task's from its batches."""
    found = rows.select("x").mapInArrow(partial, "i int, j int, total string")
    summed = found.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in summed.toLocalIterator()}


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, 0
    for batch in batches:
        if batch.num_rows:
            n, sums = n + batch.num_rows, sums + exact_sums(_matrix(batch))
    if n:
        yield _numbers([(-1, -1), *((i, -1) for i in range(len(sums)))], [n, *sums])


@dataclass(frozen=True)
class Moments:
    """Exact moments of integer vectors.

    ``centre`` is the rounded mean and ``rest`` the sums of the differences from it.
    """

    n: int
    centre: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray  # extended precision, divisor n


def moments(rows: DataFrame) -> Moments | None:
    """The moments of ``rows`` (x: arrays of one length); None for no rows."""
    first = _totals(rows, _task_sums)
    n = first.pop((-1, -1), 0)
    if not n:
        return None
    sums = [first[i, -1] for i in range(len(first))]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    around = np.array(centre, dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = exact_products(_matrix(batch) - around)
                total = found if total is None else total + found
        if total is not None:
            upper = list(zip(*(k.tolist() for k in np.triu_indices(len(total)))))
            yield _numbers(upper, [total[k] for k in upper])

    size = len(sums)
    covariance = np.zeros((size, size), dtype=np.longdouble)
    for (i, j), total in _totals(rows, products).items():
        # Exact up to here; one rounding of the numerator and one of the quotient.
        value = np.longdouble(str(n * total - rest[i] * rest[j])) / np.longdouble(str(n * n))
        covariance[i, j] = covariance[j, i] = value
    return Moments(n, around, np.array(rest, dtype=object), covariance)


def _clusters(values: np.ndarray, apart: float) -> np.ndarray:
    """The cluster of each eigenvalue: sorted neighbours no more than ``apart`` from each other share one."""
    order = np.argsort(values, kind="stable")
    label = np.empty(len(values), dtype=int)
    label[order] = np.concatenate([[0], np.cumsum(np.diff(values[order]) > apart)])
    return label


def refined_eigenvectors(a: np.ndarray, vectors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the symmetric matrix ``a``, in extended precision.

    ``vectors`` are the approximate ones to begin with; default: of a float32 solver. Equal
    eigenvalues have some orthonormal basis of their space.
    """
    size = len(a)
    a = a.astype(np.longdouble)
    top = np.abs(a).max(initial=0)
    if not top:
        return np.zeros(size, np.longdouble), np.eye(size, dtype=np.longdouble)
    scale = np.ldexp(np.longdouble(1), int(np.frexp(top)[1]))
    a = a / scale
    if vectors is None:
        vectors = np.linalg.eigh(a.astype(np.float32))[1]
    x, one = vectors.astype(np.longdouble), np.eye(size, dtype=np.longdouble)
    tiny = np.finfo(np.longdouble).eps
    norm = np.sqrt((a * a).sum())
    last = np.inf
    for _ in range(MAX_STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        # Exactly symmetric, so that rounding turns the vectors, but does not bend them towards each other.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        unsure = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        label = _clusters(values, max(unsure, tiny * norm))
        together = label[:, None] == label[None, :]
        gaps = np.where(together, 1, values[None, :] - values[:, None])
        step = np.where(together, r / 2, (s + values[None, :] * r) / gaps)
        x = x + x @ step
        for k in np.flatnonzero(np.bincount(label) > 1):
            x[:, label == k] = _parted(a, x[:, label == k], values[label == k].mean(), tiny * norm)
        before, last = last, np.abs(step).max()
        # As good as it gets: no change, or rounding turns vectors of close values to and fro.
        if last < 4 * tiny * size or (last < 1e-6 and last > before / 2 and before < 1e-6):
            break
    for _ in range(3):
        x = x + x @ (one - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _parted(a: np.ndarray, space: np.ndarray, middle, noise) -> np.ndarray:
    """The basis of a cluster's space in which ``a`` is diagonal, as far as its differences can be told."""
    inner = space.T @ (a @ space - middle * space)
    inner = (inner + inner.T) / 2
    spread = np.abs(inner).max()
    if np.abs(inner - np.diag(np.diag(inner))).max() <= 4 * noise:
        return space
    return space @ np.linalg.eigh((inner / spread).astype(np.float64))[1].astype(np.longdouble)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: row k of ``directions`` gives component k + 1 with unit variance."""

    moments: Moments
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The transform to the first ``components`` principal components of ``rows`` (x); None for no rows."""
    found = moments(rows)
    if found is None:
        return None
    values, vectors = refined_eigenvectors(found.covariance)
    trace = np.trace(found.covariance)
    values, vectors = values[:components], vectors[:, :components]
    has = values > NO_VARIANCE * trace
    scaled = np.where(has, vectors / np.sqrt(np.where(has, values, 1)), 0)
    share = np.where(has, values / (trace if trace else 1), 0)
    return Whitening(found, scaled.T.astype(np.float64), np.where(has, values, 0).astype(np.float64), share.astype(np.float64))


def _squares(z: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * z - rest)^2, exact; None where it is no long."""
    most = n * _largest(z) + max(abs(r) for r in rest)
    if most * most * z.shape[1] < 2 * _LONG:
        d = n * z - rest.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * z.astype(object) - rest
    return [v if v < 2 * _LONG else None for v in (d * d).sum(axis=1).tolist()]


def transformed(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the ``whitened`` components (array<double>) of each of ``rows`` (vec_id, x)."""
    kind = StructType([rows.schema["vec_id"], *StructType.fromDDL("deviation long, whitened array<double>")])
    arrow = to_arrow_schema(kind)
    n, centre, rest = model.moments.n, model.moments.centre, model.moments.rest
    shift = np.array([r / n for r in rest])
    directions = model.directions

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch) - centre
            out = (z.astype(np.float64) - shift) @ directions.T
            ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
            squares = pa.array(_squares(z, n, rest), pa.int64())
            columns = [batch.column(batch.schema.get_field_index("vec_id")), squares, whitened]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.select("vec_id", "x").mapInArrow(apply, kind)


def identity_error(out: DataFrame, values: np.ndarray) -> float:
    """The largest entry, in size, of the whitened components' covariance minus the identity, without empty directions."""
    used = [k for k, value in enumerate(values) if value > 0]
    if not used:
        return 0.0
    at = {k: F.get("whitened", F.lit(k)) for k in used}
    pairs = [F.abs(F.covar_pop(at[i], at[j]) - float(i == j)) for i in used for j in used if i <= j]
    return float(out.agg(F.array_max(F.array(*pairs))).first()[0])


def whitening(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``vectors`` has vec_id and embedding; further columns are left out. Rows as of :func:`fixed_point`
    are used, and of these the vectors of the length that most have (ties: the longest), which all
    are in an ordinary table. Repeated rows and NULL ids are rows like others; an empty table gives
    an empty result. ``deviation`` is NULL where it does not fit a long. A component without any
    variance (eigenvalue zero: equal vectors, fewer vectors than components) has whitened and
    explained 0 and does not count for identity_error.
    """
    rows = fixed_point(vectors.select("vec_id", "embedding")).select("vec_id", "x")
    sizes = rows.groupBy(F.size("x").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    result = StructType(
        [rows.schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")]
    )
    model = fit(rows.where(F.size("x") == usual["size"]), components) if usual else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], result)
    out = stash(transformed(rows.where(F.size("x") == usual["size"]), model), "whitened")
    error = identity_error(out, model.values)
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.moments.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
