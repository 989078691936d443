"""Whitening against numpy's own eigensolver and exact integers."""

import math

import numpy as np
import pytest

from tallyspark.llm import whitening


@pytest.mark.parametrize("kind", ["random", "cluster", "equal", "diagonal", "graded", "rank one", "tiny"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(5)
    n = 40
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    spectrum = {
        "random": rng.random(n) * 9, "cluster": np.concatenate(([5, 5 - 1e-9, 5 - 2e-9, 5 - 3e-9], rng.random(n - 4))), "equal": np.concatenate(([3.0] * 6, rng.random(n - 6))),
        "diagonal": np.arange(1.0, n + 1), "graded": 10.0 ** -np.arange(n), "rank one": np.concatenate(([2.0], np.zeros(n - 1))), "tiny": rng.random(n) * 1e-200,
    }[kind]
    a = np.diag(spectrum) if kind == "diagonal" else q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigenpairs(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    scale = want[0]
    assert len(values) == (1 if kind == "rank one" else 4)
    assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * scale)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert np.abs((a / scale) @ vectors.T - vectors.T * (np.array(values) / scale)).max() < 1e-13


def test_sturm_counts():
    d, e = np.array([2.0, -1, 0, 3, 3]), np.array([1.0, 0, 2, 0.5])
    all_ = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for x in np.linspace(-4, 6, 41):
        assert whitening.count_below(d, e, x) == (all_ < x).sum()


def by_force(rows, k=4):
    """Per row and component what the contract says, up to the sign of a component."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**63 for c in v)]
    width = max({len(x) for _, x in kept}, key=lambda w: (sum(len(x) == w for _, x in kept), w))
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(c) for c in x] for x in fit]) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for j in range(1, min(k, width) + 1):
            if e[-j] > width * np.finfo(float).eps * e[-1]:
                w = (np.array(x, float) - np.array([s / n for s in sums])) @ u[:, -j] / math.sqrt(e[-j])
                out.append((i, j, n, deviation if deviation < 2**63 else None, w, e[-j] / np.trace(v)))
    return out


def check(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = whitening.whiten(df).collect()
    want = by_force([(r[0], [None if c is None else float(np.float32(c)) if kind == "float" else c for c in r[1]] if r[1] is not None else None) for r in rows])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rs if r[1] == j]) for rs in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9) and len({r[6] for r in got}) == 1 and 0 <= got[0][6] < 1e-6
    return got


def test_whiten(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.arange(12, 0, -1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist(), 1) for i in range(150)]  # a third are copies
    got = check(spark, rows)
    assert len(got) == 4 * 450 and {r[2] for r in got} == {300}


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3).tolist(), None) for i in range(20)]
    rows += [(30, None, 1), (31, [1.0, None, 2.0], 1), (32, [1.0, math.nan, 2.0], 1), (33, [math.inf, 0.0, 1.0], 1), (34, [], 1), (35, [1.0, 2.0], 1), (36, [1e30, 0.0, 0.0], 1)]
    rows += [(None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5], 1), (3, [-0.001, -0.0, 0.0], 1)]
    got = check(spark, rows)
    assert {r[0] for r in got} == {*range(20), None} and max(r[1] for r in got) == 3


def test_a_deviation_beyond_a_long_is_null(spark):
    got = check(spark, [(1, [1e6, 1.0, 0.0], 0), (2, [-1e6, 2.0, 5.0], 0), (3, [4e12, 7.0, 1.0], 0), (4, [3.0, 9.0, 2.0], 0)], "double")
    assert any(r[3] is None for r in got)


def test_constant_and_empty_tables(spark):
    shape = "vec_id long, embedding array<float>, component string, whitened int, `a.b` int, x map<string,int>"
    same = spark.createDataFrame([(i, [0.5, 0.25], "c", 1, 2, {"a": 1}) for i in range(5)], shape)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for df in (same, same.limit(0)):
        assert whitening.whiten(df).collect() == [] and whitening.whiten(df).columns == names
    two = same.union(spark.createDataFrame([(9, [0.5, 0.75], "c", 1, 2, None)], shape))
    assert {(r.component, r.n, abs(round(r.whitened, 12)), round(r.explained, 12)) for r in whitening.whiten(two).collect()} == {(1, 2, 1.0, 1.0)}
