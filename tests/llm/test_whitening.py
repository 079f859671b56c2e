"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from sluice.llm import whitening
from sluice.llm.queries import op11_embedding_whitening, ready

SCHEMA = "vec_id long, embedding array<float>, label int, component int, _id string"


def table(spark, vectors, schema=SCHEMA):
    ready(spark)
    return spark.createDataFrame([(i, v, 0, 7, "own") for i, v in enumerate(vectors)], schema)


def check(rows, vectors):
    """Values, deviations and figures of fine vectors, given by id."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors.values()], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = dict(zip(vectors, ((n * x - sums) ** 2).sum(1)))
    centred = ((n * x - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    rank = np.linalg.matrix_rank(centred)
    width = min(32, rank)
    values = {(r["vec_id"], r["component"]): r for r in rows}
    assert set(values) == {(i, c + 1) for i in vectors for c in range(width)}
    own = np.array([[values[i, c + 1]["whitened"] for c in range(width)] for i in vectors])
    assert np.abs(own.T @ own / n - np.eye(width)).max() < 1e-4
    assert all(r["identity_error"] < 1e-8 and r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in rows)
    assert np.allclose([values[next(iter(vectors)), c + 1]["explained"] for c in range(width)], e[:width] / e.sum(), rtol=1e-6)
    want = centred @ v[:, :width] / np.sqrt(e[:width])
    for c in range(width):
        near = [k for k in range(len(e)) if abs(e[k] - e[c]) < 1e-9 * e[0] and k != c]
        if not near:
            sign = np.sign(want[:, c] @ own[:, c])
            assert np.allclose(own[:, c] * sign, want[:, c], atol=1e-6)


def test_whole_table(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    fine = {r["vec_id"]: r["embedding"] for r in source if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    check(op11_embedding_whitening(spark, sf_dir).collect(), fine)


def test_bad_vectors_go_and_repeats_count(spark):
    rng = np.random.default_rng(1)
    good = [[float(c) for c in v] for v in rng.normal(size=(40, 5))]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0], [1e30] * 5, [1.0, 2.0]]
    rows = whitening.whitened(table(spark, good + bad + good[:3])).collect()
    check(rows, {i: v for i, v in enumerate(good)} | {len(good) + len(bad) + i: v for i, v in enumerate(good[:3])})


def test_dependent_constant_and_badly_scaled_places(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 4))
    vectors = np.column_stack([base[:, 0] * 1e4, base[:, 0] * 1e4, np.full(60, 3.0), base[:, 1], base[:, 2] * 0.05, np.zeros(60)])
    check(whitening.whitened(table(spark, vectors.tolist())).collect(), dict(enumerate(vectors.tolist())))
    few = rng.normal(size=(5, 12)).tolist()
    check(whitening.whitened(table(spark, few)).collect(), dict(enumerate(few)))


def test_more_places_than_components(spark):
    vectors = np.random.default_rng(3).normal(size=(200, 40)).tolist()
    check(whitening.whitened(table(spark, vectors)).collect(), dict(enumerate(vectors)))


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[float("nan")]]])
def test_nothing_to_whiten(spark, vectors):
    out = whitening.whitened(table(spark, vectors))
    assert out.count() == 0
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_ids_come_out(spark):
    ready(spark)
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 0.0]), (1, [5.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(str(r["vec_id"]) for r in whitening.whitened(df).collect()) == ["1"] * 4 + ["None"] * 2


def test_deviation_is_null_where_no_long_holds_it(spark):
    ready(spark)
    df = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    x = [(math.floor(64 * a) + 10**6, math.floor(64 * b) + 10**6) for a, b in ((1e12, 0.0), (-1e12, 1.0), (0.0, 2.0))]
    sums = [sum(c) for c in zip(*x)]
    want = {i + 1: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in whitening.whitened(df).collect()} == {i: w if w < 2**63 else None for i, w in want.items()}
