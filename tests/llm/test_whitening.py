"""Whitening against plain numpy, and the eigenvector refinement on clustered eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA

from creditpath.llm import queries as llm_queries
from creditpath.llm.whitening import exact_products, exact_sums, refined_eigenvectors, whitening

SCHEMA = "vec_id long, embedding array<float>"


def matrix_with(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(len(values)) - 0.5 * (q.T @ q))  # orthonormal beyond double precision
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1],
        [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5 - 1e-8, 1e-3],
        [3, 3, 3, 2, 2, 1],
        [1e9, 1e9 - 1, 1, 1e-3],
        [0, 0, 0],
        [7],
        [1, 1 + 1e-6, 1 + 2e-6, 1 + 2e-6 + 1e-11, 2, 2],
    ],
)
def test_refined_eigenvectors(values):
    values = sorted(values, reverse=True)
    a, q = matrix_with(values)
    found, x = refined_eigenvectors(a)
    top = max(values) or 1
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(found - np.array(values, dtype=np.longdouble)).max() < 1e-17 * top
    assert np.abs(a @ x - x * found).max() < 1e-17 * top
    for k, value in enumerate(values):
        gap = min([abs(value - v) for i, v in enumerate(values) if i != k], default=1)
        if gap > 1e-6 * top:
            # A single eigenvalue: the vector is right up to its sign, to double precision and better.
            assert min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max()) < 1e-17 * max(1, top / gap)


def test_refinement_beats_its_start():
    a, q = matrix_with(np.linspace(1, 3, 40)[::-1])
    plain = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    error = lambda x: max(min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max()) for k in range(40))
    assert error(plain.astype(np.longdouble)) > 1e-8 and error(refined_eigenvectors(a)[1]) < 1e-16


def test_exact_integer_products():
    rng = np.random.default_rng(2)
    for most in (100, 2**20, 2**27, 2**45):
        z = rng.integers(-most, most, (50, 3))
        whole = z.astype(object)
        assert (exact_products(z) == whole.T @ whole).all()
        assert (exact_sums(z) == whole.sum(axis=0)).all()


def plain(vectors, components=8):
    """The same by integers, fractions and numpy's double-precision solver."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    v = y.T @ y / n
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    return deviation, y @ vectors / np.sqrt(e), e / np.trace(v), n


def compare(rows, vectors, digits=1e-9):
    deviation, whitened, explained, n = plain(list(vectors.values()))
    k = whitened.shape[1]
    at = {vec_id: i for i, vec_id in enumerate(vectors)}
    got = np.zeros_like(whitened)
    assert len(rows) == len(vectors) * k
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]] and r["n"] == n
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - signs * whitened).max() < digits


def test_query_against_numpy(spark):
    folder = f"{DATA}/sf0.01"
    vectors = {
        r["vec_id"]: r["embedding"]
        for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
        if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])
    }
    compare(llm_queries.op11_embedding_whitening(spark, folder).collect(), vectors, 1e-6)


def test_edges(spark):
    rng = np.random.default_rng(4)
    good = {i: [float(c) for c in rng.standard_normal(3).astype(np.float32)] for i in range(30)}
    bad = [
        (100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("-inf"), 0.0, 1.0]),
        (104, []), (105, [1.0]), (106, [1e30, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in [*good.items(), *bad]], SCHEMA + ", x string, n int")
    compare(whitening(df.repartition(5)).collect(), good)
    assert whitening(df.limit(0)).collect() == []
    assert whitening(df.where("vec_id >= 100 and vec_id < 105")).collect() == []


def test_no_variance_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])], SCHEMA)
    rows = whitening(df).collect()
    assert len(rows) == 6 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in rows} == {(0, 0, 0, 0)}
    two = whitening(spark.createDataFrame([(1, [0.0, 2.0, 1.0]), (2, [1.0, 2.0, 1.0])], SCHEMA)).collect()
    first = sorted((r["vec_id"], abs(r["whitened"])) for r in two if r["component"] == 1)
    assert first == [(1, pytest.approx(1)), (2, pytest.approx(1))]
    assert all(r["whitened"] == 0 for r in two if r["component"] > 1)


def test_deviation_beyond_a_long(spark):
    rows = whitening(spark.createDataFrame([(1, [1e11, 0.0]), (2, [-1e11, 5.0]), (3, [0.0, 1.0])], SCHEMA)).collect()
    assert {r["deviation"] for r in rows if r["vec_id"] < 3} == {None}
    assert all(r["identity_error"] < 1e-9 for r in rows)
