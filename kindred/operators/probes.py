"""Probes: ridge and PLS from Gram matrices (one aggregation in Spark, a d x d solve on the driver), logistic
regression by Newton steps whose sums Spark makes, a multilayer perceptron, and the null of permuted labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V


@dataclass(frozen=True)
class Gram:
    n: float
    sx: np.ndarray
    sy: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.sx - other.sx, self.sy - other.sy, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sx + other.sx, self.sy + other.sy, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients and the unpenalised intercept."""
        mx, my = self.sx / self.n, self.sy / self.n
        a = self.xx - self.n * np.outer(mx, mx) + alpha * np.eye(len(mx))
        w = np.linalg.solve(a, self.xy - self.n * mx * my)
        return w, float(my - mx @ w)

    def standardised(self) -> tuple[Gram, np.ndarray, np.ndarray]:
        """The sums over features less their mean, over their population deviation (1 where that is 0); mean; deviation."""
        mx = self.sx / self.n
        centred = self.xx - self.n * np.outer(mx, mx)
        sd = np.sqrt(np.maximum(np.diag(centred) / self.n, 0))
        sd[sd == 0] = 1.0
        return Gram(self.n, np.zeros_like(mx), self.sy, centred / np.outer(sd, sd), (self.xy - mx * self.sy) / sd, self.yy), mx, sd

    def r2(self, w: np.ndarray, b: float) -> float:
        """Share of the variance of these rows that ``w`` and ``b`` explain."""
        wrong = self.yy - 2 * (w @ self.xy + b * self.sy) + w @ self.xx @ w + 2 * b * (w @ self.sx) + self.n * b * b
        return float(1 - wrong / (self.yy - self.sy**2 / self.n))

    def pls(self, k: int) -> np.ndarray:
        """(d, k) rotations of partial least squares on one target; they apply to features less their mean.

        Fewer columns come back where the target is explained before k of them.
        """
        mx = self.sx / self.n
        xx, xy = self.xx - self.n * np.outer(mx, mx), self.xy - mx * self.sy
        out, loads, least = [], [], 1e-12 * np.linalg.norm(xy)
        for _ in range(min(k, len(mx))):
            size = np.linalg.norm(xy)
            if size <= least:
                break
            r = w = xy / size
            for p, q in zip(loads, out, strict=True):
                r = r - (p @ w) * q
            tt = r @ xx @ r
            if tt <= 0:
                break
            load = xx @ r / tt
            xy = xy - load * (r @ xy)
            out.append(r)
            loads.append(load)
        return np.column_stack(out) if out else np.zeros((len(mx), 0))


def _added(parts: DataFrame, by: list[str], width: int) -> list:
    """Sums of the arrays ``row`` per key, position by position."""
    return parts.groupBy(*by).agg(*[F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(width)]).collect()


def grams(rows: DataFrame, vector: str, target: str, fold: str) -> dict[int, Gram]:
    """Sums per fold; rows with a null vector, target or fold take no part. Each task folds its rows before the shuffle."""
    dim = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    if dim is None:
        return {}
    d = dim["d"]

    def local(batches):
        import pandas as pd

        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("f"):
                z = np.column_stack([np.ones(len(part)), np.array(part["v"].tolist(), dtype=np.float64), part["y"].to_numpy(dtype=np.float64)])
                held[f] = held.get(f, 0) + z.T @ z
        yield pd.DataFrame([(int(f), i, row) for f, m in held.items() for i, row in enumerate(m)], columns=["f", "i", "row"])

    src = rows.select(F.col(fold).cast("int").alias("f"), F.col(vector).alias("v"), F.col(target).cast("double").alias("y")).where(f"f is not null and y is not null and size(v) = {d}")
    out: dict[int, np.ndarray] = {}
    for r in _added(src.mapInPandas(local, "f int, i int, row array<double>"), ["f", "i"], d + 2):
        out.setdefault(r["f"], np.zeros((d + 2, d + 2)))[r["i"]] = r[2:]
    return {f: Gram(m[0, 0], m[0, 1:-1], m[0, -1], m[1:-1, 1:-1], m[1:-1, -1], m[-1, -1]) for f, m in out.items()}


def out_of_fold(rows: DataFrame, vector: str, target: str, fold: str, alpha: float) -> DataFrame:
    """Each row predicted by the probe that was fitted on all other folds (total less own fold)."""
    by = grams(rows, vector, target, fold)
    if len(by) < 2:
        return rows.withColumn("yhat", F.lit(None).cast("double"))
    total = None
    for g in by.values():
        total = g if total is None else total + g
    yhat = F.lit(None).cast("double")
    for f, g in by.items():
        w, b = (total - g).ridge(alpha)
        dot = F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, w.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        yhat = F.when(F.col(fold) == f, dot + F.lit(b)).otherwise(yhat)
    return rows.withColumn("yhat", yhat)


def alpha_errors(rows: DataFrame, vector: str, target: str, role: str, alphas: Sequence[float]) -> list[tuple[float, float]]:
    """(alpha, mean absolute error on rows of role "validation") of ridges fitted on rows of role "fit"; one pass for all alphas."""
    fit = grams(rows.where(F.col(role) == "fit").withColumn("_all", F.lit(0)), vector, target, "_all").get(0)
    if fit is None:
        raise ValueError("no rows to fit on")
    errors = []
    for i, a in enumerate(alphas):
        w, b = fit.ridge(a)
        errors.append(F.avg(F.abs(F.col(target) - V.project(F.col(vector), w.tolist()) - F.lit(b))).alias(f"e{i}"))
    found = rows.where(F.col(role) == "validation").agg(*errors).first()
    return [(a, found[i]) for i, a in enumerate(alphas)]


def best_alpha(errors: Sequence[tuple[float, float]], larger: bool = True) -> float:
    """The alpha of least error; ties go to the larger (or the smaller) alpha."""
    return min(errors, key=lambda e: (e[1], -e[0] if larger else e[0]))[0]


def with_products(v: Column) -> Column:
    """The features and the products of every two different ones, without squares."""
    return F.concat(v, F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 2, F.size(v)), lambda y: x * y))))


@dataclass(frozen=True)
class Logistic:
    w: np.ndarray
    b: float

    def probability(self, v: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(V.project(v, self.w.tolist()) + F.lit(self.b))))


def fit_logistic(rows: DataFrame, vector: str, label: str, c: float = 1.0, tol: float = 1e-9, most: int = 100) -> Logistic:
    """The one model of ``fit_logistics`` for one penalty."""
    return fit_logistics(rows, vector, label, [c], tol, most)[0]


def fit_logistics(rows: DataFrame, vector: str, label: str, cs: Sequence[float], tol: float = 1e-9, most: int = 100) -> list[Logistic]:
    """Logistic regressions with L2 penalties of 1 / (2 c) on all but the intercept, by Newton steps; one model for each c.

    A step is one pass for all models that have not converged, in which each task adds up loss, gradient and Hessian of
    each; only their sums, (d + 2) squared numbers for a model, reach the driver. Rows with a null vector or label take no
    part; labels of one class raise. ``rows`` are read once a step: stage them if they are costly.
    """
    src = rows.select(V.wide(vector).alias("v"), F.col(label).cast("double").alias("y")).where("v is not null and y is not null")
    sides = src.agg(F.max(F.size("v")).alias("d"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    if sides["d"] is None or sides["low"] == sides["high"]:
        raise ValueError("labels of both classes are needed")
    d = sides["d"]

    def sums(at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def local(batches: Iterable):
            import pyarrow as pa

            held = {m: np.zeros((d + 2, d + 2)) for m in at}
            for b in batches:
                # no row is longer than d, so this fails where one is shorter
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                x, y = np.column_stack([v, np.ones(len(v))]), b.column(1).to_numpy(zero_copy_only=False)
                for m, h in held.items():
                    z = x @ at[m]
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    h[: d + 1, : d + 1] += (x * (p * (1 - p))[:, None]).T @ x
                    h[: d + 1, d + 1] += x.T @ (p - y)
                    h[d + 1, d + 1] += (np.logaddexp(0, z) - y * z).sum()
            key = [(m, i) for m in held for i in range(d + 2)]
            row = [held[m][i] for m, i in key]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in key], pa.int32()), pa.array([i for _, i in key], pa.int32()), pa.array(row, pa.list_(pa.float64()))], ["m", "i", "row"])

        out = {m: np.zeros((d + 2, d + 2)) for m in at}
        for r in _added(src.mapInArrow(local, "m int, i int, row array<double>"), ["m", "i"], d + 2):
            out[r["m"]][r["i"]] = r[2:]
        for m, h in out.items():
            ridge = np.append(np.full(d, 1 / cs[m]), 0.0)
            h[: d + 1, : d + 1] += np.diag(ridge)
            h[: d + 1, d + 1] += ridge * at[m]
            h[d + 1, d + 1] += (ridge * at[m] * at[m]).sum() / 2
        return out

    at = {m: np.zeros(d + 1) for m in range(len(cs))}
    now, step = sums(at), {}
    for _ in range(most):
        left = [m for m, h in now.items() if not np.abs(h[: d + 1, d + 1]).max() <= tol * max(1.0, h[d + 1, d + 1])]
        if not left:
            break
        for m in left:
            if m not in step:
                step[m] = -np.linalg.solve(now[m][: d + 1, : d + 1], now[m][: d + 1, d + 1])
        for m, new in sums({m: at[m] + step[m] for m in left}).items():
            if new[d + 1, d + 1] > now[m][d + 1, d + 1] * (1 + 1e-12):
                step[m] = step[m] / 2
            else:
                at[m], now[m] = at[m] + step.pop(m), new
    else:
        raise RuntimeError(f"no convergence in {most} steps")
    return [Logistic(at[m][:-1], float(at[m][-1])) for m in range(len(cs))]


def perceptron(fit: DataFrame, rows: DataFrame, vector: str, label: str, hidden: Sequence[int] = (32, 16), seed: int = 17, steps: int = 200) -> DataFrame:
    """``rows`` with ``p1``, the probability of label 1 by a perceptron of sigmoid layers that Spark fits on ``fit`` by L-BFGS.

    Rows without a vector get null; a fit of no rows raises.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = fit.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(V.wide(vector)).alias("_f"), F.col(label).cast("double").alias("_y"))
    first = fit.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    model = MultilayerPerceptronClassifier(layers=[first["d"], *hidden, 2], featuresCol="_f", labelCol="_y", seed=seed, maxIter=steps, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(known)
    judged = model.transform(rows.where(F.col(vector).isNotNull()).withColumn("_f", array_to_vector(V.wide(vector))))
    judged = judged.withColumn("p1", F.get(vector_to_array("_p"), F.lit(1))).drop("_f", "_p", "_r", "_c")
    return judged.unionByName(rows.where(F.col(vector).isNull()).withColumn("p1", F.lit(None).cast("double")))


def permuted_products(rows: DataFrame, vector: str, target: str, key: str, replicates: int, seed: int = 17, block: int = 4096) -> np.ndarray:
    """(d, replicates): sums of features times targets, the targets permuted anew for each replicate.

    Targets change places inside blocks of about ``block`` rows that a hash of the row chooses, so that no
    task holds more and reruns agree.
    """
    src = rows.select(F.col(key).alias("k"), V.wide(vector).alias("v"), F.col(target).cast("double").alias("y")).where("v is not null and y is not null")
    n, d = src.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no rows to permute")

    def shuffled(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["k", "y"])
        x, y = np.array(pdf["v"].tolist(), dtype=np.float64), pdf["y"].to_numpy()
        rng = np.random.default_rng([seed, int(pdf["b"].iloc[0])])
        out = x.T @ np.column_stack([rng.permutation(y) for _ in range(replicates)])
        return pd.DataFrame({"i": range(d), "row": list(out)})

    dealt = src.withColumn("b", F.pmod(F.xxhash64("k", "v"), F.lit(math.ceil(n / block))))
    out = np.zeros((d, replicates))
    for r in _added(dealt.groupBy("b").applyInPandas(shuffled, "i int, row array<double>"), ["i"], replicates):
        out[r["i"]] = r[1:]
    return out


def permutation_null(fit: Gram, products: np.ndarray, statistic: Callable[[np.ndarray, float], float], alpha: float = 1.0) -> dict[str, float]:
    """The statistic of a ridge on the true targets against those on permuted ones: mean, 95 % and 99 % points of the null.

    Only the products with the target change under a permutation, so a replicate costs one solve and no pass.
    """
    values = [statistic(*Gram(fit.n, fit.sx, fit.sy, fit.xx, xy, fit.yy).ridge(alpha)) for xy in products.T]
    return {"observed": statistic(*fit.ridge(alpha)), "mean": float(np.mean(values)), "q95": float(np.quantile(values, 0.95)), "q99": float(np.quantile(values, 0.99)), "replicates": len(values)}
