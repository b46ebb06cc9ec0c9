"""Classifiers and fusion of weak classifiers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.functions.special import digamma, gaussian


# --- naive Bayes over long features (id, f, v, label) -------------------------------------------------------------------

def histograms(rows: DataFrame) -> DataFrame:
    """f, label, v, n; binary occurrence is the case of v in {0, 1}."""
    return rows.groupBy("f", "label", "v").agg(F.count(F.lit(1)).alias("n"))


def moments(hist: DataFrame) -> DataFrame:
    """f, label, mean, var (of the population) from a histogram."""
    m = hist.groupBy("f", "label").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"))
    return m.select("f", "label", (F.col("s") / F.col("c")).alias("mean"), (F.col("q") / F.col("c") - F.pow(F.col("s") / F.col("c"), 2)).alias("var"))


def nb_gaussian(rows: DataFrame, stats: DataFrame, priors: dict[int, float]) -> DataFrame:
    """id, label, score: ln prior + sum of ln densities; features without variance are left out."""
    met = rows.select("id", "f", "v").join(stats.filter("var > 1e-12"), "f")
    prior = F.lit(None).cast("double")
    for k, p in priors.items():
        prior = F.when(F.col("label") == k, F.log(F.lit(p))).otherwise(prior)
    s = met.groupBy("id", "label").agg(F.sum(F.log(F.greatest(gaussian(F.col("v"), F.col("mean"), F.col("var")), F.lit(1e-300)))).alias("ll"))
    return s.select("id", "label", (prior + F.col("ll")).alias("score"))


def nb_histogram(rows: DataFrame, hist: DataFrame) -> DataFrame:
    """id, label, score: ln of the class share + sum of ln (n + 1) / (class total + values)."""
    totals = hist.groupBy("f", "label").agg(F.sum("n").alias("t"))
    values = hist.groupBy("f").agg(F.count_distinct("v").alias("k"))
    share = totals.groupBy("label").agg(F.max("t").alias("size"))
    cells = totals.join(values, "f")
    met = rows.select("id", "f", "v").join(cells, "f").join(hist, ["f", "label", "v"], "left")
    s = met.groupBy("id", "label").agg(F.sum(F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("t") + F.col("k")))).alias("ll"))
    all_ = share.agg(F.sum("size").alias("all_"))
    return s.join(share, "label").crossJoin(F.broadcast(all_)).select("id", "label", (F.log(F.col("size") / F.col("all_")) + F.col("ll")).alias("score"))  # one row


def best_label(scores: DataFrame, first: bool = True) -> DataFrame:
    """The label of the largest score; the smaller (first) or the larger label wins a tie."""
    tie = -F.col("label") if first else F.col("label")
    return scores.groupBy("id").agg(F.max_by("label", F.struct(F.round("score", 9).alias("s"), tie.alias("t"))).alias("label"))


# --- ensembles ------------------------------------------------------------------------------------------------------------

def under_sampled(rows: DataFrame, members: int, share: float, key: str = "id") -> DataFrame:
    """Rows with a column member: all of the smaller class (label 1), a seeded share of the others."""
    m = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("member").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296
    return m.filter((F.col("label") == 1) | (draw < share))


def bagged(votes: DataFrame) -> DataFrame:
    """id, score: the size of the mean of the members' scores, the sign of their majority; ties are negative."""
    v = votes.groupBy("id").agg(F.avg("score").alias("m"), F.sum(F.when(F.col("score") > 0, 1).otherwise(-1)).alias("vote"))
    return v.select("id", (F.abs("m") * F.when(F.col("vote") > 0, 1).otherwise(-1)).alias("score"))


def error_weighted(votes: DataFrame, errors: DataFrame) -> DataFrame:
    """id, score: the mean weighted by 1 - error of the members."""
    return votes.join(errors, "member").groupBy("id").agg((F.sum(F.col("score") * (1 - F.col("error"))) / F.sum(1 - F.col("error"))).alias("score"))


# --- passive-aggressive ------------------------------------------------------------------------------------------------------

def passive_aggressive(rows: DataFrame, member: str, order: str, slack: dict[int, float], epsilon: float | None = None) -> DataFrame:
    """member, weights, averaged, updates of PA-II over rows (member, order, x array, y). A member's rows are taken in order by one
    task, a batch at a time: the learner is sequential, its memory is a weight vector. epsilon: regression with that tolerance; else
    binary updates with y in {-1, 1}. slack: the aggressiveness by class (by the sign of the correction when regressing)."""
    import numpy as np

    def fold(batches: Iterator) -> Iterator:
        import pandas as pd

        now, w, total, n = None, None, None, 0

        def out():
            return pd.DataFrame({member: [now], "weights": [w.tolist()], "averaged": [(total / max(n, 1)).tolist()], "updates": [n]})

        for b in batches:
            for m, x, y in zip(b[member], b["x"], b["y"], strict=True):
                x = np.asarray(x, dtype=float)
                if m != now:
                    if now is not None:
                        yield out()
                    now, w, total, n = m, np.zeros(len(x)), np.zeros(len(x)), 0
                s = float(w @ x)
                if epsilon is None:
                    loss, label = max(0.01, 1 - y * s), (1 if y > 0 else -1)
                    loss = loss if loss > 0.01 else 0.0
                else:
                    loss, label = max(0.0, abs(s - y) - epsilon), (1 if y - s > 0 else -1)
                if loss > 0:
                    w = w + loss / (float(x @ x) + 1 / (2 * slack[label])) * label * x
                    total, n = total + w, n + 1
        if now is not None:
            yield out()

    dealt = rows.select(member, order, "x", F.col("y").cast("double").alias("y")).repartition(member).sortWithinPartitions(member, order)
    return dealt.mapInPandas(fold, f"{member} long, weights array<double>, averaged array<double>, updates long")


def graph_regularised(nodes: DataFrame, edges: DataFrame, gamma: float, lam: float, rounds: int, tolerance: float, written) -> DataFrame:
    """node, score. nodes: node, base (the classifier's score), label (null if unlabelled); edges: src, dst, n.

    Jacobi steps of score_i = (b_i y_i + lambda base_i + gamma sum_j w_ij score_j) / (b_i + lambda + gamma sum_j w_ij), where b_i is one
    by the number of labels and w_ij = ln(1 + n_ij) + ln(1 + n_ji), a tenth of it where the base score of i is below that of j. Steps go on until no
    score moves by `tolerance`; more than `rounds` steps are an error. `written` cuts the lineage of each round."""
    from loomcount.operators.graph import both_ways

    labels = nodes.agg(F.count("label").alias("l"))
    w = both_ways(edges, nodes.select("node", F.col("base").alias("x"))).select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "w")
    sums = w.groupBy("node").agg(F.sum("w").alias("sw"))
    b = F.when(F.col("label").isNotNull(), 1 / F.col("l")).otherwise(0.0)
    fixed = nodes.join(sums, "node", "left").crossJoin(F.broadcast(labels))  # one row
    fixed = written(fixed.select("node", (b * F.coalesce("label", F.lit(0)) + lam * F.col("base")).alias("top"), (b + lam + gamma * F.coalesce("sw", F.lit(0.0))).alias("bottom"), "base"))
    w, score = written(w), fixed.select("node", F.col("base").alias("score"))
    for _ in range(rounds):
        near = w.join(score.select(F.col("node").alias("nbr"), "score"), "nbr").groupBy("node").agg(F.sum(F.col("w") * F.col("score")).alias("s"))
        new = written(fixed.join(near, "node", "left").join(score.withColumnRenamed("score", "old"), "node").select("node", ((F.col("top") + gamma * F.coalesce("s", F.lit(0.0))) / F.col("bottom")).alias("score"), "old"))
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        score = new.select("node", "score")
        if moved < tolerance:
            return score
    raise ValueError(f"scores still move by {moved} after {rounds} rounds")


# --- Bayesian combination of classifiers -------------------------------------------------------------------------------------

def ibcc(outputs: DataFrame, classes: int, rounds: int, written, user_prior: float | None = None, soft: bool = True) -> DataFrame:
    """epoch, class, rho (posterior). outputs: source, epoch, k, p (share of output k), gold (null: to be told).

    Variational Bayes: a class by output count table for each source (alpha, from one pseudo-count, the labelled epochs' outputs and a true
    label bonus) and class counts (nu). Each round takes the expectations ln pi = psi(alpha) - psi(sum alpha) and
    ln kappa = psi(nu) - psi(sum nu), and then rho from them; labelled epochs stay as they are. soft: outputs count by p, else the largest by 1."""
    if not soft:
        top = W.partitionBy("source", "epoch").orderBy(F.desc("p"), "k")
        outputs = outputs.withColumn("p", (F.row_number().over(top) == 1).cast("double"))
    outputs = written(outputs)
    epochs = outputs.groupBy("epoch").agg(F.max("gold").alias("gold")).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    told = F.col("gold").isNotNull()
    rho = epochs.select("epoch", "gold", "class", F.when(told, (F.col("gold") == F.col("class")).cast("double")).otherwise(0.5).alias("rho"))
    grid = outputs.select("source", "k").distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    gold = outputs.filter("gold IS NOT NULL").groupBy("source", F.col("gold").alias("class"), "k").agg(F.sum("p").alias("c"), F.count_if(F.col("k") == F.col("gold")).alias("own"))
    alpha0 = grid.join(gold, ["source", "class", "k"], "left")
    alpha0 = alpha0.select("source", "class", "k", F.lit(user_prior).alias("a0") if user_prior is not None else (1 + F.coalesce("c", F.lit(0.0)) + F.coalesce("own", F.lit(0))).alias("a0"))
    nu0 = rho.filter(told).groupBy("class").agg(F.sum("rho").alias("n0"))
    alpha0 = written(alpha0)
    for _ in range(rounds):
        seen = outputs.join(rho.select("epoch", "class", "rho"), "epoch").groupBy("source", "class", "k").agg(F.sum(F.col("p") * F.col("rho")).alias("c"))
        alpha = alpha0.join(seen, ["source", "class", "k"], "left").withColumn("alpha", F.col("a0") + F.coalesce("c", F.lit(0.0)))
        pi = alpha.select("source", "class", "k", (digamma(F.col("alpha")) - digamma(F.sum("alpha").over(W.partitionBy("source", "class")))).alias("pi"))
        nu = rho.groupBy("class").agg(F.sum("rho").alias("n")).join(nu0, "class", "left").withColumn("nu", F.greatest(F.col("n") + F.coalesce("n0", F.lit(0.0)), F.lit(1e-3)))
        total = nu.agg(F.sum("nu").alias("all_"))
        kappa = nu.crossJoin(F.broadcast(total)).select("class", (digamma(F.col("nu")) - digamma(F.col("all_"))).alias("kappa"))  # one row
        ll = outputs.select("source", "epoch", "k", "p").join(pi, ["source", "k"]).groupBy("epoch", "class").agg(F.sum(F.col("p") * F.col("pi")).alias("ll"))
        ll = ll.join(kappa, "class").withColumn("ll", F.col("ll") + F.col("kappa"))
        e = F.exp(F.col("ll") - F.max("ll").over(W.partitionBy("epoch")))
        soft_max = ll.withColumn("e", e).withColumn("new", F.col("e") / F.sum("e").over(W.partitionBy("epoch")))
        rho = written(rho.join(soft_max.select("epoch", "class", "new"), ["epoch", "class"]).select("epoch", "gold", "class", F.when(told, F.col("rho")).otherwise(F.col("new")).alias("rho")))
    return rho.select("epoch", "class", "rho")


# --- library learners -----------------------------------------------------------------------------------------------------------

def stream_classifiers(rows: DataFrame, streams: list, kind: str, features: str = "x", label: str = "label", trees: int = 50, share: float = 0.2) -> DataFrame:
    """stream, epoch, label, prediction, probability (array) of a logistic regression or forest for each stream; is_test rows are predicted, the others fitted."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = None
    for s in streams:
        d = rows.filter(F.col("stream") == s).withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
        model = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=25) if kind == "logistic" else RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, subsamplingRate=share, seed=1)
        got = model.fit(d.filter("NOT is_test")).transform(d.filter("is_test")).select("stream", "epoch", label, "prediction", vector_to_array("probability").alias("probability"))
        out = got if out is None else out.unionByName(got)
    return out


def walk_forward(rows: DataFrame, steps: list[int], width: int, features: str = "x", label: str = "label") -> DataFrame:
    """epoch, label, prediction of one logistic regression over all streams for each step: fitted on epochs before it, applied to the next `width`."""
    got = None
    for s in steps:
        part = rows.filter(F.col("epoch") < s + width).withColumn("is_test", F.col("epoch") >= s).withColumn("stream", F.lit(0))
        one = stream_classifiers(part, [0], "logistic", features, label)
        got = one if got is None else got.unionByName(one)
    return got.select("epoch", label, "prediction")


def dump_line(x: Column) -> Column:
    """All features of an array as one line of a text dump, five decimals each, the label to be put last."""
    return F.array_join(F.transform(x, lambda v: F.round(v.cast("double"), 5).cast("decimal(18,5)").cast("string")), " ")
