"""Queries over fitted probes: intervals by resampled clusters, measures of whole orders, selection, predictions that are refused where a model saw the row."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators import crossval as C
from kindred.operators import hard_negatives as H
from kindred.operators import inference as I
from kindred.operators import probes as P
from kindred.operators import ranking as K
from kindred.operators.nearest import nearest
from kindred.plans import queries as Q
from kindred.plans.sql import _E
from kindred.storage import staged

REPLICATES = 2000
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
TARGETS = ["p1", "p2", "p3"]
#: Rows for one task of a fit of some hundred short passes.
FIT_ROWS = 1 << 16


def _intervals(spark, scores: DataFrame, values: list[str], units: dict[str, str], target: str, raw: list[str]) -> DataFrame:
    rows = []
    for unit, cluster in units.items():
        found = I.resampled_clusters(scores, cluster, values, REPLICATES).intervals((target, raw))
        rows += [(unit, name, *x, REPLICATES) for name, x in found.items()]
    out = spark.createDataFrame(rows, "unit string, measure string, mean double, low double, high double, replicates int")
    return out.select("unit", "measure", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "replicates")


def cluster_bootstrap_interval(spark, sf_dir):
    """Hard-negative accuracies and their gap with 95 % intervals, resampling whole sources, and single queries."""
    per = Q._hard_scores(spark, sf_dir).select("q", "q_source", "length", "first")
    return _intervals(spark, staged(per, "scores"), ["length", "first"], {"source": "q_source", "query": "q"}, "first", ["length"])


def _scored(spark, sf_dir) -> DataFrame:
    """Truths, and scores cut to two digits so that many are equal."""
    e = Q._vectors(spark, sf_dir)
    return e.select("id", "label", F.col("y").alias("truth"), F.round(F.col("y") + 0.2 * F.get("v", F.lit(3)), 2).alias("score"))


def rank_correlation(spark, sf_dir):
    """Rank correlation of scores with truths in each label."""
    return K.spearman(_scored(spark, sf_dir), ["label"], "truth", "score").select("label", F.round("spearman", 6).alias("spearman"))


def global_average_precision(spark, sf_dir):
    s = staged(_scored(spark, sf_dir).select("score", (F.col("truth") > 0).alias("positive")), "scored")
    ap = K.average_precision(s, "score", "positive")
    return spark.createDataFrame([(ap,)], "ap double").select(F.round("ap", 6).alias("ap"))


def _roles(spark, sf_dir) -> DataFrame:
    """Vectors with roles by a hash of the id: three fifths train, a fifth each validates and tests."""
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    return Q._vectors(spark, sf_dir).withColumn("role", F.when(fold < 3, "train").when(fold == 3, "validation").otherwise("test"))


def _tasks(spark, sf_dir) -> DataFrame:
    """Vectors less their first three components, which are the targets, with their roles."""
    e = _roles(spark, sf_dir)
    return staged(e.select("id", "label", "v", "role", F.slice("v", 4, Q.DIM - 3).alias("x"), *[F.get("p", F.lit(i)).alias(t) for i, t in enumerate(TARGETS)]), "tasks")


def grouped_cv(spark, sf_dir):
    """Mean error of each penalty for each target over folds of whole labels, and which is chosen."""
    t = _tasks(spark, sf_dir)
    c = C.grouped_cv(t, "x", TARGETS, "label", 4, ALPHAS)
    rows = [(name, a, float(c.errors[i, j]), a == c.alphas[j]) for j, name in enumerate(TARGETS) for i, a in enumerate(c.tried)]
    return spark.createDataFrame(rows, "target string, alpha double, mae double, chosen boolean").withColumn("mae", F.round("mae", 6))


def _signs(spark, sf_dir) -> DataFrame:
    """First components over the scale of the whole training rows, and whether the first two have one sign.

    Only these components are stored, dealt by the hash of the id to pieces of FIT_ROWS, so tasks of the fits follow from the rows and not from the files or row groups of the input.
    """
    e = _roles(spark, sf_dir)
    one = e.where(F.col("v").isNotNull()).select(F.size("v").alias("d")).first()
    whole = (F.col("role") == "train") & (F.size("v") == (one["d"] if one else 0)) & F.forall("v", lambda x: x.isNotNull())
    few = e.select("id", "role", F.slice("v", 1, 4).alias("first"), F.get("p", F.lit(0)).alias("p1"), F.get("p", F.lit(1)).alias("p2"), F.when(whole, 0).alias("_f"))
    few = staged(few.repartition(max(1, math.ceil(e.count() / FIT_ROWS)), "id").sortWithinPartitions("id"), "components")
    mean, sd = C.moments(few, "first", ["p1"], "_f")[0].scale()
    first = F.zip_with(F.zip_with("first", V.literal(mean.tolist()), lambda x, m: x - m), V.literal(sd.tolist()), lambda x, s: x / s)
    plain = few.select("id", "role", first.alias("plain"), (F.col("p1") * F.col("p2") > 0).cast("int").alias("same"))
    return staged(plain.withColumn("products", P.with_products(F.col("plain"))), "signs")


def interaction_selection(spark, sf_dir):
    """Models of whether two components have one sign, by average precision on validation rows; the best is refitted on training and validation rows and judged on test rows."""
    rows = _signs(spark, sf_dir)
    penalties = {f"products-logistic-{c:g}": c for c in (0.1, 1.0, 10.0)}
    layers = {f"perceptron-{'x'.join(map(str, h))}": h for h in ((16,), (32, 16))}

    def judged(names: list[str], fit: DataFrame, on: DataFrame) -> DataFrame:
        """``(model, p, same)`` of all models; the fits of logistics share their passes, the others run beside them, as each of their many steps is too short for a cluster."""
        cs = {n: penalties[n] for n in names if n in penalties}
        own = [n for n in names if n in layers]

        def logistics() -> list[DataFrame]:
            found = P.fit_logistics(fit, "products", "same", list(cs.values()))
            return [on.select(F.lit(n).alias("model"), m.probability(F.col("products")).alias("p"), "same") for n, m in zip(cs, found, strict=True)]

        def perceptron(name: str) -> list[DataFrame]:
            return [P.perceptron(fit, on, "plain", "same", layers[name]).select(F.lit(name).alias("model"), F.col("p1").alias("p"), "same")]

        fits = [logistics] * bool(cs) + [lambda n=n: perceptron(n) for n in own]
        with ThreadPool(len(fits)) as pool:
            parts = [p for found in pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in fits]) for p in found]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    names = [*penalties, *layers]
    found = K.average_precisions(judged(names, rows.where("role = 'train'"), rows.where("role = 'validation'")), "model", "p", "same")
    best = min(names, key=lambda n: (-(found.get(n) or 0.0), names.index(n)))
    final = K.average_precisions(judged([best], rows.where("role in ('train', 'validation')"), rows.where("role = 'test'")), "model", "p", "same").get(best)
    out = spark.createDataFrame([(n, found.get(n), n == best, final if n == best else None) for n in names], "model string, validation_ap double, chosen boolean, test_ap double")
    return out.select("model", F.round("validation_ap", 6).alias("validation_ap"), "chosen", F.round("test_ap", 6).alias("test_ap"))


def _predictions(spark, sf_dir) -> DataFrame:
    return staged(C.prediction_relation(_tasks(spark, sf_dir), "id", "role", "x", TARGETS, 5, ALPHAS), "predictions")


def predicted_values(spark, sf_dir):
    """What each row's model says of its scaled targets, and how far that is from them."""
    p = _predictions(spark, sf_dir)
    gap = F.array_max(F.zip_with("predicted", "truth", lambda a, b: F.abs(a - b)))
    return p.select("id", "role", "fold", "model", *[F.round(F.get("predicted", F.lit(i)), 6).alias(t) for i, t in enumerate(TARGETS)], F.round(gap, 6).alias("error"))


def _both_sides(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test rows that ask and training rows that answer, of one bundle, none predicted by a model that saw it."""
    one = p.select("bundle").first()
    bundle = one["bundle"] if one else None
    q = C.unseen(p.where("role = 'test'"), "test", bundle).select(F.col("id").alias("q"), F.col("predicted").alias("v"), "truth")
    return q, C.unseen(p.where("role = 'train'"), "train", bundle).select(F.col("id").alias("c"), F.col("predicted").alias("v"), "truth")


def predicted_executor_topk(spark, sf_dir):
    """Nearest training rows of every test row by the largest difference of predicted targets."""
    q, c = _both_sides(_predictions(spark, sf_dir))
    return nearest(q, c, 10, "chebyshev").select("q", "c", "rk", F.round("d", 6).alias("d"))


def predicted_executor_accuracy(spark, sf_dir):
    """Of hard negatives among the 64 training rows that are truly nearest to a test row, how many the predicted distance orders right, and the raw cosine; with intervals over labels."""
    q, c = _both_sides(_predictions(spark, sf_dir))
    true = nearest(q.select("q", F.col("truth").alias("v")), c.select("c", F.col("truth").alias("v")), 64, "chebyshev")
    e = Q._vectors(spark, sf_dir).select("id", "label", "n", F.col("v").alias("raw"))
    side = lambda t, k: t.select(k, F.col("v").alias(f"{k}_p")).join(e.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label"), F.col("n").alias(f"{k}_n"), F.col("raw").alias(f"{k}_v")), k)
    j = true.join(side(q, "q"), "q").join(side(c, "c"), "c")
    j = j.select("q", "q_label", "c", F.col("rk").alias("ork"), F.round("d", 9).alias("o"), F.round(V.chebyshev_distance(F.col("q_p"), F.col("c_p")), 9).alias("predicted"), F.round(V.cosine_distance(F.col("q_v"), F.col("c_v"), F.col("q_n"), F.col("c_n")), 9).alias("cosine"))
    pairs = H.hash_cap(H.separated_pairs(j, 5, 25, carry=("predicted", "cosine", "q_label")), "seed-17", 128)
    score = lambda m: F.avg(H.pair_accuracy(F.col(f"closer_{m}"), F.col(f"farther_{m}"))).alias(m)
    per = pairs.groupBy("q", F.col("closer_q_label").alias("label")).agg(score("predicted"), score("cosine"))
    return _intervals(spark, staged(per, "scores"), ["predicted", "cosine"], {"label": "label"}, "predicted", ["cosine"])


_S = f"WITH {_E}, s AS (SELECT id, label, y AS truth, round(y + 0.2::DOUBLE * v[4], 2) + 0 AS score FROM e)"
ORACLES = {
    "rank_correlation": f"{_S}, k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY truth) + (count(*) OVER (PARTITION BY label, truth) - 1) / 2 AS a, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2 AS b FROM s) SELECT label, round(CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END, 6) AS spearman FROM k GROUP BY label",
    "global_average_precision": f"{_S}, g AS (SELECT score, count(*) AS n, sum((truth > 0)::INT) AS p FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * cp / cn) / sum(p), 6) AS ap FROM c",
}
