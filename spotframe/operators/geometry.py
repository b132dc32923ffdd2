"""Fits of transforms between point sets from grouped sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.functions.exprs import dot, monomials
from spotframe.operators.stats import group_percentiles
from spotframe.session import cut


def polynomial_fit(df: DataFrame, group: str, coords: list[str], target: str, degree: int = 3) -> DataFrame:
    """``group``, ``n``, ``coefficients``: least squares of ``target`` by all monomials of three coordinates.

    The normal equations are sums that every partition adds up on its own; one small matrix per
    group is solved. Coordinates are centred and scaled for the sums, so coefficients are in
    units of ``(c - mean) / 100``; ``means`` gives the centre. NULL and NaN rows drop out.
    """
    ok = F.lit(True)
    for c in [*coords, target]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(ok).select(group, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)], F.col(target).cast("double").alias("t"))
    means = rows.groupBy(group).agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(3)])
    rows = rows.join(means, group)
    b = monomials(*[(F.col(f"c{i}") - F.col(f"m{i}")) / 100.0 for i in range(3)], degree=degree)
    kind = rows.schema[group].dataType.simpleString()
    size = len([0 for n in range(degree + 1) for i in range(n + 1) for j in range(n - i + 1)])

    def sums(batches):
        for p in batches:
            for g, q in p.groupby(group, sort=False):
                x = np.concatenate([np.stack(q["b"].to_list()), q["t"].to_numpy()[:, None]], 1)
                yield pd.DataFrame({group: [g], "n": [len(q)], "m": [(x.T @ x).ravel()]})

    part = rows.select(group, b.alias("b"), "t").mapInPandas(sums, f"`{group}` {kind}, n long, m array<double>")
    cells = part.select(group, "n", F.posexplode("m").alias("i", "v")).groupBy(group, "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = cells.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("m"))

    def solve(batches):
        for p in batches:
            out = []
            for g, n, m in zip(p[group], p["n"], p["m"]):
                a = np.asarray(m).reshape(size + 1, size + 1)
                out.append((g, n, np.linalg.lstsq(a[:size, :size], a[:size, size], rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=[group, "n", "coefficients"])

    fit = whole.mapInPandas(solve, f"`{group}` {kind}, n long, coefficients array<double>")
    return fit.join(means, group).select(group, "n", "coefficients", F.array("m0", "m1", "m2").alias("means"))


def fit_residuals(df: DataFrame, fit: DataFrame, group: str, coords: list[str], target: str, degree: int = 3) -> DataFrame:
    """Per group: mean and 90th percentile of the absolute residual, and ``ok`` where there are twice as many rows as terms."""
    rows = df.join(fit, group)
    b = monomials(*[(F.col(c).cast("double") - F.col("means")[i]) / 100.0 for i, c in enumerate(coords)], degree=degree)
    r = rows.select(group, "n", F.size("coefficients").alias("terms"), F.abs(F.col(target).cast("double") - dot(F.col("coefficients"), b)).alias("r")).where("NOT isnan(r)")
    r = cut(r)
    return r.groupBy(group).agg(F.avg("r").alias("mean"), (F.max("n") >= 2 * F.max("terms")).alias("ok")).join(group_percentiles(r, [group], "r", {"p90": 0.9}), group)


def rigid_fit(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Least-squares rotation ``angle`` and shift (``dx``, ``dy``) taking (x, y) to (u, v), per group."""
    m = pairs.groupBy(*group).agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"])
    r = pairs.join(m, group) if group else pairs.crossJoin(F.broadcast(m))
    x, y, u, v = (F.col(c) - F.col(f"m{c}") for c in "xyuv")
    a = r.groupBy(*group, *[f"m{c}" for c in "xyuv"]).agg(F.atan2(F.sum(x * v - y * u), F.sum(x * u + y * v)).alias("angle"))
    c, s = F.cos("angle"), F.sin("angle")
    return a.select(*group, "angle", (F.col("mu") - c * F.col("mx") + s * F.col("my")).alias("dx"), (F.col("mv") - s * F.col("mx") - c * F.col("my")).alias("dy"))
