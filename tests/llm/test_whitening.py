from __future__ import annotations

import math

import numpy as np
import pytest

from boxoffice.llm.jacobi_davidson import largest_eigenpairs, minres
from boxoffice.llm.whitening import whitened_components


@pytest.mark.parametrize(("size", "count", "spectrum"), [(64, 32, "flat"), (200, 10, "steep"), (200, 32, "rank"), (5, 32, "flat"), (1, 3, "flat")])
def test_eigenpairs(size, count, spectrum):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    e = {"flat": np.sort(rng.uniform(50, 70, size))[::-1], "steep": 0.9 ** np.arange(size), "rank": np.r_[np.linspace(9, 1, 12), np.zeros(max(size - 12, 0))][:size]}[spectrum]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = largest_eigenpairs(lambda b: a @ b, size, count)
    assert np.abs(values - e[:count]).max() < 1e-13 * e[0] * size
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 2e-13 * e[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_each_column():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 20))
    a, right = a + a.T, rng.standard_normal((20, 3))
    right[:, 1] = 0
    x = minres(lambda b: a @ b, right, 40)
    assert np.abs(a @ x - right).max() < 1e-8


def plain(vectors: list, components: int):
    """Deviations and components by a dense eigendecomposition of centred whole numbers."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    size = max(sorted(set(sizes), reverse=True), key=sizes.count)
    good = [(i, v) for i, v in good if len(v) == size]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    return [i for i, _ in good], n, deviations, centred @ turn / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize(("size", "components"), [(40, 32), (6, 32), (90, 5)])
def test_whitening_against_numpy(spark, size, components):
    rng = np.random.default_rng(size)
    data = (rng.standard_normal((400, size)) * np.linspace(3, 0.4, size)).astype(np.float32)
    vectors = [(int(i), [float(c) for c in v]) for i, v in enumerate(data)]
    vectors += [(900, None), (901, [float("nan")] * size), (902, [None] * size), (903, [float("inf")] + [0.0] * (size - 1)), (904, []), (905, [1.0]), (None, [1.0] * size), (3, [0.5] * size), (3, [0.5] * size)]
    rows = [(i, v, i, "x") for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x long, size string").repartition(5)
    got = whitened_components(df, components=components).collect()
    ids, n, deviations, whitened, explained = plain(vectors, components)
    k = min(size, components)
    assert len(got) == n * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(zip(map(str, ids), deviations, strict=True))
    single = {(r.vec_id, r.component): r for r in got if r.vec_id not in (None, 3)}
    at = {i: j for j, i in enumerate(ids)}
    for c in range(1, k + 1):
        sign = np.sign(single[0, c].whitened * whitened[0, c - 1])
        for i in range(0, 400, 7):
            if i != 3:
                assert abs(single[i, c].whitened - sign * whitened[at[i], c - 1]) < 1e-7
        assert abs(single[0, c].explained / explained[c - 1] - 1) < 1e-10


def test_whitening_of_odd_tables(spark):
    schema = "vec_id string, embedding array<double>"
    for rows in ([], [("a", None)], [("a", [])], [("a", [1.0, 2.0])], [("a", [1.0, 2.0])] * 3):
        found = whitened_components(spark.createDataFrame(rows, schema))
        assert found.columns[:2] == ["vec_id", "component"] and found.count() == 0
    # One direction only; distances beyond a long are null, others exact.
    got = whitened_components(spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 2.0]), ("c", [1e300, 1.0])], schema)).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} <= {1, 2}
    line = whitened_components(spark.createDataFrame([(str(k), [float(k), 2.0 * k]) for k in range(9)], schema)).collect()
    assert len(line) == 9 and all(abs(r.explained - 1) < 1e-12 for r in line)
