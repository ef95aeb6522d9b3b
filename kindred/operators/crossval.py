"""Ridge on several targets at once from sums of products: grouped cross-validation, and predictions that no row's own model made.

One pass sums the products of features and targets for each fold; what a model is fitted on is the total less a fold, and
standardising and the choice of penalty work on these sums. A second pass takes the errors of all folds, penalties and
targets together. The driver gets sums and coefficients, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators.keys import global_rank, hash_folds
from kindred.operators.probes import _added
from kindred.operators.quantiles import quantiles


@dataclass(frozen=True)
class Moments:
    """Sums of products of (1, features, targets) over rows; ``d`` features."""

    sums: np.ndarray
    d: int

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.d)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.sums - other.sums, self.d)

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation (1 where that is 0) of each feature."""
        mean = self.sums[0, 1 : self.d + 1] / self.n
        sd = np.sqrt(np.maximum(np.diag(self.sums)[1 : self.d + 1] / self.n - mean * mean, 0))
        return mean, np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 1.0)

    def ridge(self, alpha: float, sd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (feature, target) and intercepts for features as they are; the penalty is on features over ``sd``, if that is given."""
        d, sd = self.d, np.ones(self.d) if sd is None else sd
        x, y = self.sums[0, 1 : d + 1] / self.n, self.sums[0, d + 1 :] / self.n
        xx = (self.sums[1 : d + 1, 1 : d + 1] - self.n * np.outer(x, x)) / np.outer(sd, sd)
        xy = (self.sums[1 : d + 1, d + 1 :] - self.n * np.outer(x, y)) / sd[:, None]
        w = np.linalg.solve(xx + alpha * np.eye(d), xy) / sd[:, None]
        return w, y - x @ w


def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(pdf["x"].tolist(), dtype=np.float64), np.array(pdf["y"].tolist(), dtype=np.float64)


def _rows(rows: DataFrame, vector: str, targets: Sequence[str], fold: str) -> tuple[DataFrame, int]:
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    d = first["d"] if first else 0
    y = F.array(*[F.col(t).cast("double") for t in targets])
    src = rows.select(F.col(fold).cast("int").alias("f"), V.wide(vector).alias("x"), y.alias("y"))
    return src.where((F.size("x") == d) & F.col("f").isNotNull() & F.forall("y", lambda t: t.isNotNull()) & F.forall("x", lambda v: v.isNotNull())), d


def moments(rows: DataFrame, vector: str, targets: Sequence[str], fold: str) -> dict[int, Moments]:
    """Sums of each fold; rows with a null fold, target or component, or of another length, take no part."""
    src, d = _rows(rows, vector, targets, fold)
    width = 1 + d + len(targets)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("f"):
                x, y = _batch(part)
                z = np.column_stack([np.ones(len(part)), x, y])
                held[int(f)] = held.get(int(f), 0) + z.T @ z
        yield pd.DataFrame([(f, i, row) for f, m in held.items() for i, row in enumerate(m)], columns=["f", "i", "row"])

    out: dict[int, np.ndarray] = {}
    for r in _added(src.mapInPandas(local, "f int, i int, row array<double>"), ["f", "i"], width):
        out.setdefault(r["f"], np.zeros((width, width)))[r["i"]] = r[2:]
    return {f: Moments(m, d) for f, m in sorted(out.items())}


def fold_errors(rows: DataFrame, vector: str, targets: Sequence[str], fold: str, models: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """For each fold the mean absolute errors (model, target) of its own list of models on its rows, all in one pass."""
    src, _ = _rows(rows, vector, targets, fold)
    w = {f: (np.concatenate([m[0] for m in own], axis=1), np.concatenate([m[1] for m in own])) for f, own in models.items()}
    n_models, t = len(next(iter(models.values()))), len(targets)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("f"):
                if f in w:
                    x, y = _batch(part)
                    wrong = np.abs(np.tile(y, n_models) - x @ w[f][0] - w[f][1]).sum(axis=0)
                    held[int(f)] = held.get(int(f), 0) + np.append(wrong, len(part))
        if held:
            yield pd.DataFrame({"f": list(held), "row": list(held.values())})

    return {r["f"]: (np.array(r[1:-1]) / r[-1]).reshape(n_models, t) for r in _added(src.mapInPandas(local, "f int, row array<double>"), ["f"], n_models * t + 1)}


@dataclass(frozen=True)
class Chosen:
    """``errors`` (alpha, target): mean over folds of the mean absolute error; ``alphas`` chosen for each target; coefficients and intercepts refitted on all rows."""

    tried: list[float]
    errors: np.ndarray
    alphas: list[float]
    w: np.ndarray
    b: np.ndarray


def grouped_cv(rows: DataFrame, vector: str, targets: Sequence[str], group: str, folds: int, alphas: Sequence[float]) -> Chosen:
    """Ridge on standardised features with the penalty of least error over folds of whole groups, for each target; ties go to the smaller one.

    Groups are dealt to folds by the order of their hashes; rows without a group take no part. Features are standardised
    over all rows, inside the sums. Fewer than two groups raise. ``rows`` is read three times, so it should be a stored table.
    """
    dealt = rows.join(hash_folds(rows, group, folds), group)
    by = moments(dealt, vector, targets, "fold")
    if len(by) < 2:
        raise ValueError("rows of two groups at least are needed")
    total = sum(by.values(), Moments(np.zeros_like(next(iter(by.values())).sums), next(iter(by.values())).d))
    _, sd = total.scale()
    found = fold_errors(dealt, vector, targets, "fold", {f: [(total - m).ridge(a, sd) for a in alphas] for f, m in by.items()})
    errors = np.mean([found[f] for f in by], axis=0)
    best = [min(range(len(alphas)), key=lambda i: (errors[i, t], alphas[i])) for t in range(len(targets))]
    final = [total.ridge(alphas[i], sd) for i in best]
    return Chosen(list(alphas), errors, [alphas[i] for i in best], np.column_stack([m[0][:, t] for t, m in enumerate(final)]), np.array([m[1][t] for t, m in enumerate(final)]))


def predicted(vector: str, w: np.ndarray, b: np.ndarray) -> Column:
    """The targets that coefficients (feature, target) and intercepts give for a vector, as an array."""
    return F.array(*[V.project(F.col(vector), w[:, t].tolist()) + F.lit(float(b[t])) for t in range(w.shape[1])])


def prediction_relation(rows: DataFrame, key: str, role: str, vector: str, targets: Sequence[str], folds: int, alphas: Sequence[float]) -> DataFrame:
    """``(key, role, fold, model, predicted, truth, bundle)``: what ridges say of each row's scaled targets, none of them fitted on the row.

    Roles are train, validation and test. Targets are scaled by the medians and interquartile ranges (1 at least) of the
    training rows. The penalty of each target has the least mean absolute error on validation rows for a fit on all
    training rows; ties go to the larger one. Training rows, dealt to folds by the order of their keys' hashes, are predicted by
    the model ``without-<fold>``, others by the model ``all``. ``bundle`` is a digest of scales, penalties and
    coefficients. Rows with a null key, role, target or component take no part. Keys are unique. ``rows`` should be a stored table.
    """
    fine = rows.where(F.col(key).isNotNull() & F.col(role).isin("train", "validation", "test"))
    scales = quantiles(fine.where(F.col(role) == "train"), {t: [0.25, 0.5, 0.75] for t in targets})
    if any(s is None for s in scales.values()):
        raise ValueError("no training rows")
    scaled = [((F.col(t) - scales[t][1]) / max(scales[t][2] - scales[t][0], 1.0)).alias(f"_t{i}") for i, t in enumerate(targets)]
    names = [f"_t{i}" for i in range(len(targets))]
    all_ = fine.select(F.col(key).alias("_k"), F.col(role).alias("_role"), V.wide(vector).alias("_x"), *scaled)
    order = global_rank(all_.where("_role = 'train'").select("_k", F.sha2(F.col("_k").cast("string"), 256).alias("_h")), [F.col("_h"), F.col("_k")])
    # validation is fold -1 here, test -2: sums and errors of all roles come from the same passes
    dealt = all_.join(order.select("_k", ((F.col("rk") - 1) % folds).cast("int").alias("_f")), "_k", "left")
    dealt = dealt.withColumn("_f", F.when(F.col("_role") == "validation", -1).when(F.col("_role") == "test", -2).otherwise(F.col("_f")))
    by = {f: m for f, m in moments(dealt.where("_f >= 0"), "_x", names, "_f").items()}
    total = sum(by.values(), Moments(np.zeros_like(next(iter(by.values())).sums), next(iter(by.values())).d))
    fits = [total.ridge(a) for a in alphas]
    found = fold_errors(dealt, "_x", names, "_f", {-1: fits})
    if -1 not in found:
        raise ValueError("no validation rows")
    best = [min(range(len(alphas)), key=lambda i: (found[-1][i, t], -alphas[i])) for t in range(len(names))]

    def fitted(m: Moments) -> tuple[np.ndarray, np.ndarray]:
        own = [m.ridge(alphas[i]) for i in best]
        return np.column_stack([w[:, t] for t, (w, _) in enumerate(own)]), np.array([b[t] for t, (_, b) in enumerate(own)])

    models = {"all": fitted(total)} | {f"without-{f}": fitted(total - m) for f, m in by.items() if total.n > m.n}
    digest = hashlib.sha256()
    for name, (w, b) in sorted(models.items()):
        digest.update(name.encode() + np.ascontiguousarray(w).tobytes() + b.tobytes())
    digest.update(repr(([alphas[i] for i in best], sorted(scales.items()))).encode())
    model = F.when(F.col("_role") == "train", F.concat(F.lit("without-"), F.col("_f").cast("string"))).otherwise("all")
    value = F.lit(None).cast("array<double>")
    for name, (w, b) in models.items():
        value = F.when(F.col("_model") == name, predicted("_x", w, b)).otherwise(value)
    out = dealt.withColumn("_model", model).withColumn("_p", value).where(F.col("_p").isNotNull() & F.forall("_p", lambda v: v.isNotNull()))
    fold = F.when(F.col("_role") == "train", F.col("_f"))
    return out.select(F.col("_k").alias(key), F.col("_role").alias("role"), fold.alias("fold"), F.col("_model").alias("model"), F.col("_p").alias("predicted"), F.array(*names).alias("truth"), F.lit(digest.hexdigest()).alias("bundle"))


class SeenError(ValueError):
    """A prediction was about to be used that its own model was fitted on, or that has another role or bundle than asked."""


def unseen(predictions: DataFrame, role: str, bundle: str | None = None) -> DataFrame:
    """``predictions`` of one role, after all of them were checked: a training row by the model without its own fold, others by the model of all training rows, and one bundle."""
    own = F.when(F.col("role") == "train", F.concat(F.lit("without-"), F.col("fold").cast("string"))).otherwise("all")
    wrong = predictions.where(~F.col("model").eqNullSafe(own) | ~F.col("role").eqNullSafe(F.lit(role)) | (~F.col("bundle").eqNullSafe(F.lit(bundle)) if bundle else F.lit(False)))
    some = wrong.limit(3).collect()
    if some:
        raise SeenError(f"predictions that may not be used as {role}: {[tuple(r)[:4] for r in some]}")
    return predictions
