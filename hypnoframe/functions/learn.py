"""Linear and logistic models, quadratic discriminants, k-means and linkage clustering.

Models are fitted from sums that Spark aggregates: what comes to the driver is of
the size of the model (columns squared, classes, centres), however many rows there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _sums(df: DataFrame, xs: list[Column], ys: list[Column], weight: Column, by: list[str] | None = None) -> list[Row]:
    """Weighted sums of all products of ``xs`` and of ``xs`` with ``ys``, in one aggregation."""
    n = len(xs)
    cells = [F.sum(weight * xs[i] * xs[j]).alias(f"x{i}_{j}") for i in range(n) for j in range(i, n)]
    cells += [F.sum(weight * x * y).alias(f"y{k}_{i}") for k, y in enumerate(ys) for i, x in enumerate(xs)]
    return df.groupBy(*(by or [])).agg(*cells).collect()


def _square(r: Row, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = r[f"x{i}_{j}"] or 0.0
    return m


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in cols))


def linear(df: DataFrame, xs: list[str], y: str) -> dict:
    """Least squares of ``y`` on ``xs`` and 1: coefficients (1 first), standard errors, R squared, rows. Rows with nulls are left out.

    Columns are centred first, so that large means lose no digits.
    """
    d = _complete(df.select(*(F.col(c).cast("double").alias(c) for c in (*xs, y))), [*xs, y])
    r = d.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in (*xs, y))).first()
    n = r["n"]
    if n <= len(xs) + 1:
        raise ValueError("too few rows")
    mean = np.array([r[f"m_{c}"] for c in xs])
    got = _sums(d, [F.col(c) - F.lit(float(m)) for c, m in zip((*xs, y), (*mean, r[f"m_{y}"]), strict=True)], [], F.lit(1.0))[0]
    m = _square(got, len(xs) + 1)
    a, b, total = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    slope = np.linalg.solve(a, b)
    left = max(total - slope @ b, 0.0)
    var = left / (n - len(xs) - 1)
    inv = np.linalg.inv(a)
    se = np.sqrt(var * np.concatenate([[1 / n + mean @ inv @ mean], np.diag(inv)]))
    return {"coef": np.concatenate([[r[f"m_{y}"] - slope @ mean], slope]), "se": se, "r2": 1 - left / total if total else math.nan, "n": n}


def logistic(df: DataFrame, xs: list[str], y: str, steps: int = 25, tol: float = 1e-10, ridge: float = 0.0) -> dict:
    """Logistic regression by iterated weighted least squares, a pass over the rows a step; ``y`` is 0 or 1."""
    d = _complete(df.select(*(F.col(c).cast("double").alias(c) for c in (*xs, y))), [*xs, y])
    cols, beta = [F.lit(1.0), *(F.col(c) for c in xs)], np.zeros(len(xs) + 1)
    inv = np.zeros((len(beta), len(beta)))
    for _ in range(steps):
        z = sum((c * F.lit(float(b)) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        e = d.withColumns({"_p": p, "_w": p * (1 - p)})
        # the gradient's sums are unweighted: weight times (y - p) / weight
        g = e.agg(*(F.sum(c * (F.col(y) - F.col("_p"))).alias(f"g{i}") for i, c in enumerate(cols)), *(F.sum(F.col("_w") * cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols)))).first()
        if g["g0"] is None:
            raise ValueError("no rows")
        h = _square(g, len(cols)) + ridge * np.eye(len(cols))
        step = np.linalg.solve(h, np.array([g[f"g{i}"] for i in range(len(cols))]) - ridge * beta)
        inv, beta = np.linalg.inv(h), beta + step
        if np.abs(step).max() < tol:
            break
    return {"coef": beta, "se": np.sqrt(np.diag(inv))}


def quadratic(df: DataFrame, xs: list[str], label: str) -> list[dict]:
    """Quadratic discriminants: prior, mean and covariance of each class, from one aggregation after the means'."""
    d = _complete(df, xs).where(F.col(label).isNotNull()).select(F.col(label).alias("_y"), *(F.col(c).cast("double").alias(c) for c in xs))
    mean = d.agg(*(F.avg(c).alias(c) for c in xs)).first()
    shifted = [F.lit(1.0), *(F.col(c) - F.lit(float(mean[c] or 0.0)) for c in xs)]
    rows = sorted(_sums(d, shifted, [], F.lit(1.0), ["_y"]), key=lambda r: r["_y"])
    total = sum(r["x0_0"] for r in rows)
    out = []
    for r in rows:
        m, n = _square(r, len(xs) + 1), r["x0_0"]
        if n < 2:
            continue
        c = m[0, 1:] / n
        out.append({"label": r["_y"], "prior": n / total, "mean": c + np.array([mean[k] for k in xs]), "cov": (m[1:, 1:] - n * np.outer(c, c)) / (n - 1)})
    return out


def quadratic_class(model: list[dict], xs: list[str]) -> Column:
    """The likeliest class as a Column; of equals the first."""
    scores = []
    for m in model:
        inv, dist = np.linalg.inv(m["cov"]), F.lit(0.0)
        off = [F.col(x) - F.lit(float(c)) for x, c in zip(xs, m["mean"], strict=True)]
        for i in range(len(xs)):
            for j in range(len(xs)):
                dist = dist + off[i] * off[j] * F.lit(float(inv[i, j]))
        scores.append(F.struct((F.lit(math.log(m["prior"]) - 0.5 * float(np.linalg.slogdet(m["cov"])[1])) - 0.5 * dist).alias("s"), F.lit(m["label"]).alias("l")))
    return F.aggregate(F.array(*scores[1:]), scores[0], lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))["l"] if len(scores) > 1 else scores[0]["l"]


def k_means(df: DataFrame, xs: list[str], centres: np.ndarray, steps: int = 50, tol: float = 1e-9) -> tuple[np.ndarray, Column]:
    """Lloyd's iterations from given centres, a pass over the rows each: centres, and the nearest's number as a Column. An empty cluster keeps its centre."""
    d, c = _complete(df.select(*(F.col(x).cast("double").alias(x) for x in xs)), xs), np.array(centres, float)

    def nearest(c: np.ndarray) -> Column:
        far = [F.struct(sum(((F.col(x) - F.lit(float(v))) ** 2 for x, v in zip(xs, row, strict=True)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, row in enumerate(c)]
        return F.array_min(F.array(*far))["k"]

    for _ in range(steps):
        got = {r["_k"]: [r[x] for x in xs] for r in d.groupBy(nearest(c).alias("_k")).agg(*(F.avg(x).alias(x) for x in xs)).collect()}
        new = np.array([got.get(k, row) for k, row in enumerate(c)])
        moved, c = np.abs(new - c).max(), new
        if moved < tol:
            break
    return c, nearest(c)


def linkage(dist: np.ndarray, k: int, kind: str = "complete") -> np.ndarray:
    """Clusters of a distance matrix, joined two by two until ``k`` are left (complete, single or average); numbered by first member."""
    n = len(dist)
    d, size, of = np.array(dist, float), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    for _ in range(max(0, n - max(k, 1))):
        a, b = sorted(divmod(int(d.argmin()), n))
        row = {"complete": np.maximum(d[a], d[b]), "single": np.minimum(d[a], d[b]), "average": (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])}[kind]
        row[[a, b]] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        of[of == b] = a
    return np.unique(of, return_inverse=True)[1]
