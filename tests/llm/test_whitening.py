import numpy as np
import pytest

from postmill.llm import whitening


def expected(rows, count=8):
    """By vec_id, the deviation and the whitened values, and the shares explained, from a dense eigensolver."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in good])
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    deviation = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    return n, {i: int(d) for (i, _), d in zip(good, deviation, strict=True)}, dict(zip([i for i, _ in good], centred @ u / np.sqrt(e), strict=True)), e / np.trace(cov)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, whitened string").repartition(3)


def test_whitened_rows_match_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 24))
    x = np.float32(0.1 * rng.normal(size=(700, 24)) * np.linspace(0.5, 2, 24) + 0.3 * centres[rng.integers(0, 5, 700)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(3, rows[5][1]), (9000, rows[7][1])]  # repeated id, repeated vector
    odd = [(800, None), (801, [float("nan")] + [1.0] * 23), (802, [None] + [1.0] * 23), (803, [float("inf")] + [1.0] * 23), (804, []), (805, [1e30] + [0.0] * 23)]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    assert len(got) == 8 * len(rows)
    n, deviation, white, explained = expected([r for r in rows if r[0] != 3] + [(3, rows[3][1]), (-3, rows[5][1])])
    sign = {}
    for r in got:
        if r["vec_id"] == 3:
            continue
        w = white[r["vec_id"]][r["component"] - 1]
        sign.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["whitened"] * sign[r["component"]] - w) < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-10
    assert {r["deviation"] for r in got if r["vec_id"] == 3} == {deviation[3], deviation[-3]}


def test_vectors_of_several_lengths_and_too_few(spark):
    rng = np.random.default_rng(4)
    wide = [(i, [float(c) for c in rng.normal(size=12)]) for i in range(5)]       # rank 4
    flat = [(100 + i, [1.0, float(i), 2.0 * i]) for i in range(6)]                # constant and dependent columns
    one = [(200, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, wide + flat + one + [(None, [0.5, 7.0, 9.0])])).collect()
    count = {}
    for r in got:
        count[r["vec_id"]] = count.get(r["vec_id"], 0) + 1
        assert r["identity_error"] < 1e-9
    assert count == {**{i: 4 for i in range(5)}, **{100 + i: 2 for i in range(6)}, None: 2}
    assert {r["n"] for r in got if r["vec_id"] in (None, 100)} == {7}
    assert whitening.whiten(frame(spark, one)).count() == 0 and whitening.whiten(frame(spark, []).limit(0)).count() == 0


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [1e6 * i, float(i % 3)]) for i in range(40)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    _, want, _, _ = expected(rows)
    assert any(v is None for v in got.values())
    assert all(v is None or v == want[i] for i, v in got.items()) and all(v is not None for i, v in got.items() if want[i] < 8e18)


@pytest.mark.parametrize("dim, count", [(6, 8), (40, 8), (90, 3), (200, 8)])
def test_leading_pairs_reach_double_precision(dim, count):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(3 * dim, dim)) * np.linspace(1, 2, dim) + 4 * rng.normal(size=(4, dim))[rng.integers(0, 4, 3 * dim)]
    cov = np.cov(x.T, bias=True)
    passes = []
    e, u = whitening.leading(lambda b: passes.append(b.shape[1]) or cov @ b, dim, float(np.trace(cov)), count, subspace=40, kept=16)
    want = np.linalg.eigvalsh(cov)[::-1][:count]
    assert len(e) == min(dim, count) and np.abs(e / want[:len(e)] - 1).max() < 1e-12
    assert np.linalg.norm(cov @ u - u * e, axis=0).max() < 1e-13 * e[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
    assert len(passes) < 120


def test_correction_equations_are_solved():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = a @ a.T
    q = np.linalg.qr(rng.normal(size=(30, 3)))[0]
    right = rng.normal(size=(30, 2))
    right -= q @ (q.T @ right)
    theta = np.array([1.0, 400.0])
    t = whitening.minres(lambda b: a @ b, theta, right, q, 60, 1e-12)
    left = a @ t - t * theta
    assert np.abs(left - q @ (q.T @ left) - right).max() < 1e-6 and np.abs(q.T @ t).max() < 1e-12
