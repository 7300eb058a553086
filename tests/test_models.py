"""Isolation forests and behaviour models against slow definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
import xxhash

from orebed.operators import models as M


def spark_hash(*values: int) -> int:
    """xxhash64 over longs, as the engine chains it."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def slow_depth(x, rows, seed, tree, depth=0, number=1, most=None):
    """The depth that x reaches, growing only the branch that it takes."""
    most = math.ceil(math.log2(max(len(rows), 2))) if most is None else most
    low, high = (np.min(rows, axis=0), np.max(rows, axis=0)) if len(rows) else ([], [])
    free = [j for j in range(len(low)) if low[j] < high[j]]
    if depth >= most or not free:
        n = len(rows)
        return depth + (0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)
    j = free[int(M.uniform(seed, tree, number, 0) * len(free))]
    cut = low[j] + M.uniform(seed, tree, number, 1) * (high[j] - low[j])
    left = x[j] <= cut
    return slow_depth(x, [r for r in rows if (r[j] <= cut) == left], seed, tree, depth + 1, 2 * number + (not left), most)


@pytest.mark.parametrize(("n", "sample"), [(300, 32), (20, 32)])
def test_forest(spark, n, sample):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((n, 3)), 2)
    x[7] = [9, -9, 9]
    x[:, 2] = np.where(np.arange(n) % 2, 1.0, x[:, 2])
    table = [(i, *map(float, r)) for i, r in enumerate(x)]
    table[3] = (3, None, float("nan"), float("inf"))
    x[3] = 0
    got = {r.id: r for r in M.isolation_forest(spark.createDataFrame(table, "id long, a double, b double, c double"), ["id"], ["a", "b", "c"], 12, sample, 0.05, seed=4).collect()}
    total = np.zeros(n)
    for tree in range(12):
        drawn = sorted(range(n), key=lambda i: spark_hash(i, tree, 4))[:sample]
        total += [slow_depth(r, list(x[drawn]), 4, tree) for r in x]
    m = min(n, sample)
    scores = 2 ** -(total / 12 / (2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m))
    assert np.allclose([got[i].score for i in range(n)], scores)
    assert [got[i].alarm for i in range(n)] == (scores > np.quantile(scores, 0.95)).tolist()
    assert got[7].alarm


def test_forest_of_nothing(spark):
    assert M.isolation_forest(spark.createDataFrame([], "id long, a double"), ["id"], ["a"]).count() == 0


def test_boosting_takes_the_best_split():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((400, 2)), None
    y = np.where(x[:, 1] > 0.3, 5.0, -1.0) + 0.01 * x[:, 0]
    model = M.boosted(x, y)
    assert model[1] == 1  # the first split's column
    assert abs(model[1 + 7] - 0.3) < 0.1
    assert np.abs(M.boosted_values(model, x) - y).mean() < 0.1
    assert np.allclose(M.boosted_values(M.boosted(x, np.full(400, 2.0)), x), 2.0)


def plain_scale(r, least):
    if len(r) < least:
        return None
    center = np.median(r)
    scale = np.median(np.abs(r - center)) * 1.4826
    return center, scale if scale >= 1e-12 else (r.std() if r.std() >= 1e-12 else None)


def test_behaviour_models_by_plain_refits(spark):
    rng = np.random.default_rng(6)
    n = 900
    regime = rng.choice(["hot", "hot", "hot", "b", "rare"], n, p=[0.3, 0.3, 0.2, 0.18, 0.02])
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    y = np.where(regime == "b", 3.0, 1.0) * a + b**2 + 0.1 * rng.standard_normal(n)
    ref = rng.random(n) < 0.7
    table = [(i, str(regime[i]), bool(ref[i]), float(y[i]), float(a[i]), float(b[i])) for i in range(n)]
    table[5] = (5, "hot", True, None, 0.5, 0.5)
    table[6] = (6, "b", True, 1.0, None, 0.5)
    table[8] = (8, None, True, 1.0, 0.5, 0.5)
    df = spark.createDataFrame(table, "i long, regime string, ref boolean, y double, a double, b double")
    got = {r.i: r for r in M.behaviour_residuals(df, "ref", "regime", ["i"], ["y"], ["y", "a", "b"], fit_rows=200).collect()}
    assert len(got) == n
    rows = [r for r in table if r[2] and None not in (r[1], r[3], r[4])]
    by = {g: [r for r in rows if r[1] == g] for g in ("hot", "b", "rare")}

    def few(part):
        m = len(part)
        return part if m <= 200 else [part[k] for k in sorted({math.floor(j * (m - 1) / 199) for j in range(200)})]

    def fit(part):
        part = few(sorted(part))
        return M.boosted(np.array([r[4:] for r in part]), np.array([r[3] for r in part]))

    def value(model, r):
        return float(M.boosted_values(model, np.array([r[4:]]))[0])

    held = {g: p[::5] for g, p in by.items() if len(p) >= 10}
    rest = {g: [r for r in p if r not in held[g]] for g, p in by.items() if len(p) >= 10}
    rest_all = fit([r for p in rest.values() for r in p])
    rest_own = {g: fit(p) for g, p in rest.items() if len(p) >= 30}
    residual = {g: np.array([r[3] - value(rest_own.get(g, rest_all), r) for r in p]) for g, p in held.items()}
    whole = plain_scale(np.concatenate(list(residual.values())), 10)
    full_all, full_own = fit(rows), {g: fit(p) for g, p in by.items() if len(p) >= 30}
    for r in table:
        if None in (r[4], r[5]):
            assert got[r[0]].expected is None
            continue
        e = value(full_own.get(r[1], full_all), r)
        assert got[r[0]].expected == pytest.approx(e)
        if r[3] is not None:
            own = plain_scale(residual.get(r[1], np.zeros(0)), 8) or whole
            assert got[r[0]].normalized == pytest.approx((r[3] - e - own[0]) / (own[1] or whole[1]))
    good = [abs(got[i].residual) for i in range(n) if got[i].residual is not None and regime[i] != "rare"]
    assert np.mean(good) < 0.5 * y.std()


def test_behaviour_rows_keep_their_own_values_without_an_order(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal(60)
    table = [(None if i == 3 else min(i, 57), "hot", True, 2.0 * float(a[i]), float(a[i])) for i in range(60)]
    df = spark.createDataFrame(table, "i long, regime string, ref boolean, y double, a double")
    got = M.behaviour_residuals(df, "ref", "regime", ["i"], ["y", "a"], ["y", "a"]).collect()
    assert len(got) == 120  # three rows share an order, one has none
    expected = {r.expected + r.residual for r in got if r.target == "y"}
    assert sorted(expected) == pytest.approx(sorted(2.0 * a))


def test_risk_rows_are_read_once(spark, sf_dir):
    from orebed.queries import learning

    rows = learning.risk_rows(spark, sf_dir)
    assert "Relation" not in rows._jdf.queryExecution().optimizedPlan().toString()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows.collect():
        assert r.digits == sum("0" <= c <= "9" for c in texts[r.doc_id]) / max(1, len(texts[r.doc_id]))
