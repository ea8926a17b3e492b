"""Models fitted from aggregates against direct computation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnoframe.functions import learn


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(7)
    y = r.integers(0, 3, 600)
    x = np.column_stack([r.normal(y, 1 + 0.5 * y), r.normal(-2.0 * y, 1.0)]) + 1000
    t = 2 + 0.5 * x[:, 0] - 3 * x[:, 1] + r.normal(size=600)
    z = (r.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 1000) + 0.5))).astype(int)
    rows = [(int(k), float(a), float(b), float(c), int(d)) for k, (a, b), c, d in zip(y, x, t, z, strict=True)]
    return spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1)], "y int, a double, b double, t double, z int"), x, y, t, z


def test_linear(points):
    df, x, _, t, _ = points
    m = learn.linear(df, ["a", "b"], "t")
    full = np.column_stack([np.ones(600), x])
    beta, rss = np.linalg.lstsq(full, t, rcond=None)[:2]
    assert m["n"] == 600 and np.allclose(m["coef"], beta, rtol=1e-6) and abs(m["r2"] - (1 - rss[0] / ((t - t.mean()) ** 2).sum())) < 1e-9
    assert np.allclose(m["se"], np.sqrt(rss[0] / 597 * np.diag(np.linalg.inv(full.T @ full))), rtol=1e-4)
    with pytest.raises(ValueError):
        learn.linear(df.limit(2), ["a", "b"], "t")


def test_logistic(points):
    df, x, _, _, z = points
    m = learn.logistic(df.withColumn("a", F.col("a") - 1000), ["a"], "z")
    p = 1 / (1 + np.exp(-(m["coef"][0] + m["coef"][1] * (x[:, 0] - 1000))))
    assert abs((z - p).sum()) < 1e-6 and abs(((z - p) * (x[:, 0] - 1000)).sum()) < 1e-6 and 0.7 < m["coef"][1] < 1.4


def test_quadratic(points):
    df, x, y, _, _ = points
    model = learn.quadratic(df, ["a", "b"], "y")
    for m in model:
        sub = x[y == m["label"]]
        assert np.allclose(m["mean"], sub.mean(0)) and np.allclose(m["cov"], np.cov(sub.T)) and m["prior"] == len(sub) / 600
    got = np.array([r["c"] for r in df.where("a is not null").select(learn.quadratic_class(model, ["a", "b"]).alias("c")).collect()])
    want = [max(model, key=lambda m: np.log(m["prior"]) - 0.5 * np.linalg.slogdet(m["cov"])[1] - 0.5 * (p - m["mean"]) @ np.linalg.inv(m["cov"]) @ (p - m["mean"]))["label"] for p in x]
    assert np.array_equal(got, want) and (got == y).mean() > 0.75


def test_k_means(points):
    df, x, _, _, _ = points
    c, near = learn.k_means(df, ["a", "b"], x[:3])
    want = x[:3].copy()
    for _ in range(50):
        lab = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([x[lab == k].mean(0) if (lab == k).any() else want[k] for k in range(3)])
    assert np.allclose(c, want)
    assert np.array_equal([r["k"] for r in df.where("a is not null").select(near.alias("k")).collect()], lab)


@pytest.mark.parametrize("kind", ["complete", "single", "average"])
def test_linkage(kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    far = {"complete": np.max, "single": np.min, "average": np.mean}[kind]
    groups = [[i] for i in range(30)]
    while len(groups) > 4:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: far(d[np.ix_(groups[p[0]], groups[p[1]])]))
        groups[a] += groups.pop(b)
    got = learn.linkage(d, 4, kind)
    assert {frozenset(np.flatnonzero(got == k)) for k in range(4)} == {frozenset(g) for g in groups}
    assert len(set(learn.linkage(d, 1))) == 1 and len(set(learn.linkage(d, 30))) == 30 and len(learn.linkage(np.zeros((0, 0)), 2)) == 0
