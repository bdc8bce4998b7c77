"""Models over count tables: differential tests, topics, smoothing, and samples whose distances are complete."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups (plate, cluster) up to which their sizes are held by every task of the test.
GROUPS = 100_000
#: Samples whose partners are asked for at a time.
ASKED = 64


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction evaluated from the front."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 100_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * f / a


def f_tail(f: float, over: float, under: float) -> float:
    """The chance that an F statistic of (over, under) degrees of freedom is larger than f."""
    return _beta_share(under / 2, over / 2, under / (under + over * f)) if f > 0 else 1.0


def poisson_fit(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and their covariance of log(mean / exposure) = x b by Newton's steps; None where they are not determined."""
    if np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    b = np.linalg.lstsq(x, np.log(y / exposure), rcond=None)[0]
    for _ in range(steps):
        mean = exposure * np.exp(x @ b)
        step = np.linalg.solve(x.T @ (mean[:, None] * x), x.T @ (y - mean))
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b, np.linalg.inv(x.T @ ((exposure * np.exp(x @ b))[:, None] * x))


def differential(counts: DataFrame, cells: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """(gene, f_score, p_value, cluster_coeff, cluster_stderr): does a cell's cluster (a number) explain its counts of a gene
    beyond its plate? Two Poisson models with the log of the cell's total as offset, nested, and their F statistic.

    counts has (cell, gene, n), cells (cell, plate, cluster). A count that is not there is 0; pseudocount is added to every
    one. Both models see a cell by its plate and cluster only, so sums by (gene, plate, cluster) are all they need, and no
    gene's cells come together in a task. Cells without counts, plate or cluster are left out; a cluster that the plates
    determine gives no rows."""
    n = counts.groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    totals = n.groupBy("cell").agg(F.sum("n").cast("double").alias("_total")).where("_total > 0")
    who = cells.where("plate is not null and cluster is not null").select("cell", "plate", F.col("cluster").cast("double").alias("cluster")).join(totals, "cell")
    found = who.groupBy("plate", "cluster").agg(F.count("*").alias("cells"), F.sum("_total").alias("exposure")).orderBy("plate", "cluster").limit(GROUPS + 1).toPandas()
    if len(found) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups of plate and cluster")
    schema = "gene string, f_score double, p_value double, cluster_coeff double, cluster_stderr double"
    if not len(found):
        return counts.sparkSession.createDataFrame([], schema)
    place = {(p, c): k for k, (p, c) in enumerate(zip(found["plate"], found["cluster"], strict=True))}
    plates = sorted(set(found["plate"]))
    size, exposure = found["cells"].to_numpy(float), found["exposure"].to_numpy(float)
    null = np.array([[1.0, *(float(p == q) for q in plates[1:])] for p in found["plate"]])
    full = np.concatenate((null, found["cluster"].to_numpy(float)[:, None]), 1)
    sums = n.join(who.select("cell", "plate", "cluster"), "cell").groupBy("gene", "plate", "cluster").agg(F.sum("n").cast("double").alias("n"))

    def test(f: pd.DataFrame) -> pd.DataFrame:
        y = pseudocount * size
        for p, c, v in zip(f["plate"], f["cluster"], f["n"], strict=True):
            y[place[p, c]] += v
        small, big = poisson_fit(null, y, exposure), poisson_fit(full, y, exposure)
        if small is None or big is None:
            return pd.DataFrame(columns=["gene", "f_score", "p_value", "cluster_coeff", "cluster_stderr"])
        (b0, _), (b1, spread) = small, big
        gain = 2 * float((y * (full @ b1 - null @ b0) - exposure * (np.exp(full @ b1) - np.exp(null @ b0))).sum())
        return pd.DataFrame([(f["gene"].iloc[0], gain, f_tail(gain, 1, size.sum() - (full.shape[1] - 1)), b1[-1], math.sqrt(spread[-1, -1]))], columns=["gene", "f_score", "p_value", "cluster_coeff", "cluster_stderr"])

    return sums.groupBy("gene").applyInPandas(test, schema)


def topics(counts: DataFrame, k: int, iterations: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sm, topic, weight) of every sample and (topic, feature, weight) of every topic, by latent Dirichlet allocation.

    counts has (sm, feature, n). The vocabulary is every feature; weights of a sample, and of a topic, sum to one."""
    words = counts.where("n > 0 and feature is not null").groupBy("sm").agg(F.flatten(F.collect_list(F.array_repeat("feature", F.col("n").cast("int")))).alias("words"))
    vocabulary = CountVectorizer(inputCol="words", outputCol="features", vocabSize=(1 << 31) - 1).fit(words)
    model = LDA(k=k, maxIter=iterations, seed=seed).fit(vocabulary.transform(words))
    spread = model.transform(vocabulary.transform(words)).select("sm", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    names = counts.sparkSession.createDataFrame(list(enumerate(vocabulary.vocabulary)), "_i int, feature string")
    terms = model.describeTopics(len(vocabulary.vocabulary)).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    return spread, terms.select("topic", F.col("t.termIndices").alias("_i"), F.col("t.termWeights").alias("weight")).join(names, "_i").select("topic", "feature", "weight")


def reconstructed(samples: DataFrame, terms: DataFrame) -> DataFrame:
    """(sm, feature, share): the chance of each feature in a sample, as its topics have it."""
    t = terms.select("topic", "feature", F.col("weight").alias("_w"))
    return samples.join(t, "topic").groupBy("sm", "feature").agg(F.sum(F.col("weight") * F.col("_w")).alias("share"))


def _blurred(matrix: DataFrame, axis: str, other: str, size: int, sigma: float) -> DataFrame:
    reach = int(4 * sigma + 0.5)
    if reach == 0:
        return matrix
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    whole = raw[0] + 2 * sum(raw[1:])
    weights = F.array(*[F.lit(w / whole) for w in raw])
    # beyond an edge the values go on mirrored, the edge's own first: each value stands at its images too
    turns = F.sequence(F.lit(-(reach // size) - 1), F.lit(reach // size + 1))
    images = F.flatten(F.transform(turns, lambda t: F.array(F.col(axis) + 2 * size * t, -1 - F.col(axis) + 2 * size * t)))
    seen = F.filter(images, lambda m: (m >= -reach) & (m < size + reach))
    at = matrix.select(other, "value", F.explode(seen).alias("_m"))
    to = F.explode(F.sequence(F.greatest(F.lit(0), F.col("_m") - reach), F.least(F.lit(size - 1), F.col("_m") + reach)))
    at = at.select(other, "value", "_m", to.alias(axis))
    return at.groupBy(axis, other).agg(F.sum(F.col("value") * F.element_at(weights, (F.abs(F.col(axis) - F.col("_m")) + 1).cast("int"))).alias("value"))


def smoothed(matrix: DataFrame, rows: int, columns: int, sigma: tuple[float, float]) -> DataFrame:
    """(row, column, value) under a Gaussian of sigma rows and columns, cut at four sigma, with mirrored edges.

    Places that matrix does not have are 0, and so are those beyond the reach of any value, which give no row."""
    cells = matrix.select(F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), F.col("value").cast("double").alias("value"))
    return _blurred(_blurred(cells, "row", "column", rows, sigma[0]), "column", "row", columns, sigma[1]).select("row", "column", "value")


def complete_distances(distances: DataFrame, samples: DataFrame) -> DataFrame:
    """Distances (a, b, distance; a < b) among the samples that are left when the sample with most missing distances is dropped
    until none is missing; of equals, the first name.

    The driver holds one number for each sample and asks for the partners of the samples that are next to go, ASKED at a
    time; the pairs stay where they are."""
    names = sorted(r[0] for r in samples.where("sm is not null").select("sm").distinct().collect())
    both = distances.where("distance is not null").select("a", "b").union(distances.where("distance is not null").select("b", "a")).distinct()
    both = both.persist()
    have = {r.a: r.n for r in both.groupBy("a").agg(F.count("*").alias("n")).collect()}
    missing = {s: len(names) - 1 - have.get(s, 0) for s in names}
    asked: dict[str, set[str]] = {}
    while missing:
        worst = max(missing, key=missing.get)
        if missing[worst] == 0:
            break
        if worst not in asked:
            asked = {s: set() for s in sorted(missing, key=missing.get, reverse=True)[:ASKED]}
            for r in both.where(F.col("a").isin(*asked)).collect():
                asked[r.a].add(r.b)
        del missing[worst]
        for s in missing.keys() - asked[worst]:
            missing[s] -= 1
    both.unpersist()
    left = distances.sparkSession.createDataFrame([(s,) for s in missing], "_s string")
    kept = distances.join(left, F.col("a") == F.col("_s"), "left_semi")
    return kept.join(left, F.col("b") == F.col("_s"), "left_semi")
