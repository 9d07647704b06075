"""Multinomial naive Bayes on long-form features, fitted and applied relationally.

The sums of weights by class and term are the whole model: a smoothing value
turns them into log-likelihoods, and subtracting a fold's sums gives the model
without that fold, so models for several smoothing values and all folds come
from one aggregation.  Class totals (a few numbers) go through the driver; the
sums, a row for each term of a bounded vocabulary (and fold), are broadcast to the
features, so that no task gets a frequent term's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.session import reliable_checkpoint


def class_sums(weights: DataFrame, classes: list[int], label_col: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, term, s0, s1, ...)``: the sum of weights of each class's documents."""
    return weights.groupBy(*by, "term").agg(*[
        F.sum(F.when(F.col(label_col) == c, F.col("weight")).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(classes)])


def over_vocabulary(sums: DataFrame, vocab: DataFrame, classes: list[int]) -> DataFrame:
    """The sums of every term of the vocabulary, zero where no document has it."""
    return vocab.select("term").join(sums, "term", "left").na.fill(0.0, [f"s{i}" for i in range(len(classes))])


def totals(sums: DataFrame, classes: list[int]) -> tuple[list[float], int]:
    """Each class's total and the number of terms."""
    r = sums.agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(classes))], F.count("*").alias("v")).first()
    return [float(r[f"t{i}"] or 0.0) for i in range(len(classes))], int(r["v"])


def log_priors(docs: DataFrame, classes: list[int], label_col: str = "label") -> list[float]:
    """``ln`` of each class's share; a class without documents has none (-inf)."""
    n = {r[label_col]: r["n"] for r in docs.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
    all_ = sum(n.values())
    return [math.log(n[c] / all_) if n.get(c) else float("-inf") for c in classes]


def log_theta(s: Column, total: Column, n_terms, alpha: float) -> Column:
    return F.log((s + alpha) / (total + alpha * F.lit(n_terms).cast("double")))


def joint_scores(docs: DataFrame, weights: DataFrame, sums: DataFrame, priors: list[float], total: list[float],
                 n_terms: int, alphas: dict[str, float], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with an array of joint log-probabilities, one a class, for each
    named smoothing value.  A document without known terms gets the priors."""
    k = len(priors)
    parts = []
    for name, alpha in alphas.items():
        parts += [(F.sum(F.col("weight") * log_theta(F.col(f"s{i}"), F.lit(total[i]), n_terms, alpha))).alias(f"_{name}{i}")
                  for i in range(k)]
    found = weights.select(id_col, "term", "weight").join(F.broadcast(sums), "term").groupBy(id_col).agg(*parts)
    out = docs.join(found, id_col, "left")
    scores = [F.array(*[F.coalesce(F.col(f"_{name}{i}"), F.lit(0.0)) + F.lit(priors[i]) for i in range(k)]).alias(name)
              for name in alphas]
    return out.select(*docs.columns, *scores)


def fold_scores(docs: DataFrame, weights: DataFrame, vocab: DataFrame, classes: list[int], alpha: float,
                id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """MOD10: ``docs`` (with ``fold``) with ``scores`` of the model fitted on the other folds."""
    k = len(classes)
    by_fold = reliable_checkpoint(class_sums(weights, classes, label_col, by=("fold",)))
    whole = by_fold.groupBy("term").agg(*[F.sum(f"s{i}").alias(f"w{i}") for i in range(k)])
    all_total, _ = totals(whole.select("term", *[F.col(f"w{i}").alias(f"s{i}") for i in range(k)]), classes)
    n_terms = vocab.count()
    part = {r["fold"]: [float(r[f"t{i}"] or 0.0) for i in range(k)] for r in by_fold.groupBy("fold").agg(
        *[F.sum(f"s{i}").alias(f"t{i}") for i in range(k)]).collect()}
    n = {(r["fold"], r[label_col]): r["n"] for r in docs.groupBy("fold", label_col).agg(F.count("*").alias("n")).collect()}
    folds = sorted({f for f, _ in n})
    rest = {f: [sum(v for (g, c), v in n.items() if g != f and c == cl) for cl in classes] for f in folds}

    def per_fold(values: dict[int, float]) -> Column:
        out = F.lit(None).cast("double")
        for f, v in values.items():
            out = F.when(F.col("fold") == f, F.lit(v)).otherwise(out)
        return out

    left = [F.col(f"w{i}") - F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(k)]
    left_total = [per_fold({f: all_total[i] - part.get(f, [0.0] * k)[i] for f in folds}) for i in range(k)]
    prior = [per_fold({f: math.log(rest[f][i] / sum(rest[f])) if rest[f][i] else float("-inf") for f in folds}) for i in range(k)]
    # a document's own fold has each of its terms
    joined = weights.select(id_col, "fold", "term", "weight").join(F.broadcast(whole), "term").join(
        F.broadcast(by_fold), ["fold", "term"], "left")
    found = joined.groupBy(id_col).agg(*[
        F.sum(F.col("weight") * log_theta(left[i], left_total[i], n_terms, alpha)).alias(f"_{i}") for i in range(k)])
    out = docs.join(found, id_col, "left")
    return out.select(*docs.columns, F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) + prior[i] for i in range(k)]).alias("scores"))
