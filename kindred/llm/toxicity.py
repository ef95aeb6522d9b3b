"""Operator 6: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character 3- to 5-grams that occur in it, lower case. Each is scaled by
the log of the ratio of its smoothed shares in toxic and in other texts; features whose ratio is not clear
of chance are left out; a logistic regression on the scaled features gives the score.

It is fitted on at most ``max_rows`` labelled rows (toxic ones up to a third of that first), taken by the
smallest hashes of their keys: a bounded sample. Counting and feature sets stay on the executors; the driver
gets all features that are clear (of ``2**BITS`` that there can be) and, in four bytes each, which of them each
row of the sample has, and goes through these piece by piece. Scoring is one pass over all texts against a table
of ``2**BITS`` weights (4 MB), without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.storage import staged

BITS, ORDERS = 20, (3, 4, 5)
#: Bound of the labelled sample.
MAX_ROWS = 12_000
REJECT = 0.7


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hashed n-gram that starts at each character, first character of each text) of all texts in a row, lower case, spaces around."""
    low = [f" {t.lower()} " for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.cumsum([0, *map(len, low)])
    h = cp * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(cp) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield n, x >> np.uint32(32 - BITS), first


def features(texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once; only features with a weight, if weights are given. Texts are numbered only where a feature is left."""
    out = []
    for n, h, first in grams(texts):
        i = np.arange(len(h)) if weights is None else np.flatnonzero(weights[h])
        owner = np.searchsorted(first, i, "right") - 1
        i, owner = (x[i + n <= first[owner + 1]] for x in (i, owner))
        out.append((owner << BITS) | h[i])
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _groups(texts: list[str], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def logistic(cols: list[np.ndarray], scale: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 150, most: int = 1 << 20) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression, by gradient steps of Barzilai-Borwein length that never raise the loss.

    Row r has the value ``scale[c]`` in each column c of ``cols[r]``. About ``most`` values are laid out at once.
    """
    size = np.array([len(c) for c in cols], dtype=np.int64)
    piece = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(cols)]
    pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
    col = np.concatenate(cols)
    first = np.concatenate([[0], np.cumsum(size)])
    n_cols = len(scale)
    w = np.zeros(n_cols + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g, scaled = ridge / 2 * float(w[:-1] @ w[:-1]), np.append(ridge * w[:-1], 0.0), scale * w[:-1]
        for a, b in pieces:
            c, row = col[first[a] : first[b]], np.repeat(np.arange(b - a), size[a:b])
            z = np.bincount(row, weights=scaled[c], minlength=b - a) + w[-1]
            loss += float((np.logaddexp(0, z) - y[a:b] * z).sum())
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]
            g[:-1] += scale * np.bincount(c, weights=e[row], minlength=n_cols)
            g[-1] += e.sum()
        return loss, g

    loss, g = at(w)
    step = 1 / max(1.0, float(np.abs(g).sum()))
    for _ in range(rounds):
        new = w - step * g
        new_loss, new_g = at(new)
        if not new_loss <= loss - 1e-4 * step * (g @ g):  # too far: a shorter step from the same place
            step /= 4
            continue
        s, d = new - w, new_g - g
        done = loss - new_loss < 1e-7 * abs(loss)
        w, loss, g = new, new_loss, new_g
        step = float(s @ s / (s @ d)) if s @ d > 0 else step * 2
        if done:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, clear: float = 3.0, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (one for each hashed feature, ratio and coefficient in one) and the intercept.

    Rows with a null key, a null label or another label than 0 and 1 teach nothing; a key that has both
    labels, or a repeated one, counts once, as toxic if any of its rows says so. Without both kinds of rows
    all weights are 0 and the score is the share of toxic rows (1/2 without any).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.join(docs.select(F.col(key).alias("k")).where("k is not null").distinct(), "k", "left_semi")
    by_hash = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(n)
    sample = staged(by_hash(1, max_rows // 3).unionByName(by_hash(0, max_rows - max_rows // 3)), "sample", few=True)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            for i, j in _groups(texts):
                d, f = features(texts[i:j])
                cut = np.searchsorted(d, np.arange(j - i + 1))
                yield pd.DataFrame({"y": pdf["y"].iloc[i:j].to_numpy(), "f": [f[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    # at most max_rows keys: this broadcast can't grow with the corpus
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").select("y", "t")
    sets = staged(texts.mapInPandas(extract, "y int, f binary"), "features")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, 1 << BITS), dtype=np.int64)
        for pdf in batches:
            for y, f in zip(pdf["y"], pdf["f"], strict=True):
                n[y, np.frombuffer(f, dtype="<i4")] += 1
        i = np.flatnonzero(n.sum(axis=0))
        yield pd.DataFrame({"i": i, "q": n[0, i], "p": n[1, i]})

    counts = sets.mapInPandas(count, "i int, q long, p long").groupBy("i").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).where("p + q >= 4")
    counts = staged(counts.select("i", (F.col("p") + 1.0).alias("p"), (F.col("q") + 1.0).alias("q")), "counts", few=True)
    total = counts.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    ratio = F.log((F.col("p") / F.lit(total["p"] or 1.0)) / (F.col("q") / F.lit(total["q"] or 1.0)))
    z = F.abs(ratio) / F.sqrt(1 / F.col("p") + 1 / F.col("q"))
    best = counts.select("i", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= clear).select("i", "ratio").toArrow().sort_by("i")
    i, ratio = best["i"].to_numpy().astype(np.int64), best["ratio"].to_numpy()
    weights = np.zeros(1 << BITS, dtype=np.float32)
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[i] = np.arange(len(i))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [number[np.frombuffer(b, dtype="<i4")] for b in pdf["f"]]
            yield pd.DataFrame({"y": pdf["y"], "f": [x[x >= 0].tobytes() for x in f]})

    chosen = sets.mapInPandas(choose, "y int, f binary").toPandas()
    y = chosen["y"].to_numpy(dtype=float) if len(chosen) else np.zeros(0)
    if not len(i) or not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return weights, float(np.log(share / (1 - share)))
    cols = [np.frombuffer(b, dtype=np.int32) for b in chosen["f"]]
    coef, bias = logistic(cols, ratio, y, ridge)
    weights[i] = coef * ratio
    return weights, bias


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each whole text in the column ``out``; a null text counts as empty."""
    weights, bias = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, z = [t if isinstance(t, str) else "" for t in s], np.full(len(s), bias)
            for i, j in _groups(texts):
                d, f = features(texts[i:j], weights)
                z[i:j] += np.bincount(d, weights=weights[f], minlength=j - i)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return docs.withColumn(out, score(F.col(text)))


def teaches(key: str = "doc_id") -> Column:
    """Rows that may be learnt from; the others are held out."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), teaches())
    out = score_toxicity(docs, model, out="score")
    return out.select("doc_id", F.coalesce(~teaches(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
