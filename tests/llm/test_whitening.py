import math

import numpy as np
import pytest

from wirewarden.llm import whitening
from wirewarden.llm.whitening import whiten

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]


def table(spark, rows, partitions=5):
    return spark.createDataFrame([(i, v, "clash", 1.0, 7) for i, v in rows], "vec_id long, embedding array<double>, x string, n double, component int").repartition(partitions)


def usable(v, width):
    return v is not None and len(v) == width and all(c is not None and math.isfinite(c) and abs(c) < 2**40 for c in v)


def compare(got, rows, width, components=8):
    """Against the covariance matrix in whole numbers and numpy's eigenvectors."""
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if usable(v, width)]
    n = len(kept)
    sums = [sum(column) for column in zip(*(x for _, x in kept), strict=True)]
    exact = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept) for b in range(width)] for a in range(width)]
    covariance = np.array([[float(e) for e in row] for row in exact]) / float(n) ** 3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, width, int((values > 1e-16 * values[0]).sum()))
    assert len(got) == n * k
    by: dict = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error <= 1e-4 and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    assert sorted(by) == list(range(1, k + 1))
    expected = sorted((-1 if i is None else i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept)
    for c, own in by.items():
        assert sorted((-1 if r.vec_id is None else r.vec_id, int(r.deviation_exact)) for r in own) == expected
        assert all(r.deviation == (r.deviation_exact if r.deviation_exact < 2**63 else None) for r in own)
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in own)
        centred = np.array([[a - s / n for a, s in zip(x, sums, strict=True)] for _, x in kept])
        plain = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        best = min(max(abs(a[1] - b[1]) for a, b in zip(mine, sorted((-1 if i is None else i, sign * float(y)) for (i, _), y in zip(kept, plain, strict=True)), strict=True)) for sign in (1, -1))
        assert best < 1e-8


def vectors(n, d, seed=0, falling=0.9):
    rng = np.random.default_rng(seed)
    mixed = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [[float(c) for c in row] for row in rng.standard_normal((n, d)) * falling ** np.arange(d) @ mixed + rng.standard_normal(d)]


def test_equals_eigenvectors(spark):
    rows = list(enumerate(vectors(700, 12)))
    rows += [(1, rows[1][1]), (None, rows[2][1]), (800, None), (801, []), (802, [1.0] * 11 + [None]), (803, [float("nan")] * 12), (804, [float("inf")] * 12), (805, [1.0] * 5), (806, [2.0**41] * 12)]
    got = whiten(table(spark, rows))
    assert got.columns == NAMES
    compare(got.collect(), rows, 12)


def test_close_eigenvalues_and_more_steps(spark):
    rows = list(enumerate(vectors(900, 24, 3, falling=0.995)))
    compare(whiten(table(spark, rows)).collect(), rows, 24)


def test_equal_eigenvalues(spark):
    """Each start has one vector of an eigenspace only: the others come from new starts."""
    rows = list(enumerate([[s * scale if k == j else 0.0 for k in range(10)] for j, scale in enumerate([3.0] * 4 + [1.0] * 6) for s in (1.0, -1.0)]))
    got = whiten(table(spark, rows)).collect()
    assert len(got) == 20 * 8 and all(r.identity_error < 1e-9 for r in got)
    shares = {r.component: r.explained for r in got}
    assert [round(shares[k], 9) for k in range(1, 9)] == [round(9 / 42, 9)] * 4 + [round(1 / 42, 9)] * 4


def test_fewer_directions(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(a), 2.0 * float(a), 5.0]) for k, a in enumerate(rng.integers(-9, 9, 60))]
    got = whiten(table(spark, rows)).collect()
    compare(got, rows, 3)
    assert {r.component for r in got} == {1}


def test_no_spread(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None)])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(table(spark, [(k, [1.0, 2.0]) for k in range(9)])).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(k, [2.0**39 - k, float(k), -(2.0**38) + 3 * k * k]) for k in range(30)]
    got = whiten(table(spark, rows)).collect()
    sums = [sum(math.floor(1024 * v[c]) + 100_000 for _, v in rows) for c in range(3)]
    expected = {i: sum((30 * (math.floor(1024 * c) + 100_000) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in rows}
    assert got and all(int(r.deviation_exact) == expected[r.vec_id] for r in got)


def test_many_tasks_send_few_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 2)
    monkeypatch.setattr(whitening, "TASK_BYTES", 1 << 10)
    rows = list(enumerate(vectors(300, 6)))
    compare(whiten(table(spark, rows, 9)).collect(), rows, 6)


def test_a_table_of_floats(spark):
    rows = [(k, v) for k, v in enumerate([[0.1, 0.2, 0.7], [0.3, -0.2, 0.25], [0.9, 0.33, -0.5], [0.0, 0.5, 1.0]])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    compare(got, [(k, [float(np.float32(c)) for c in v]) for k, v in rows], 3)


@pytest.mark.parametrize("beside", [[0.5, 0.0], [1.0, 2.0]])
def test_bidiagonal(beside):
    assert whitening._bidiagonal([1.0, 2.0, 3.0], beside).tolist() == [[1.0, beside[0], 0], [0, 2.0, beside[1]], [0, 0, 3.0]]
