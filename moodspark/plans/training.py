"""Model training and comparison jobs (MOD1-MOD12, SNK2, SNK4, SNK5).

The corpus is prepared once (clean -> tokens -> hash-ranked split), the feature
chain is fitted on the train split only, the transformed train set is cached
for the fits and released afterwards.  Every model is a Spark ML estimator, two of
Spark's and three of this library's (``linear_svm``, ``forest``, ``boosting``): passes over
the training rows are jobs whose partial sums add up.

Regularisation follows the reference's ``C``: a penalty ``C * sum(loss) +
|w|^2 / 2`` equals Spark's ``mean(loss) + regParam * |w|^2 / 2`` with
``regParam = 1 / (C * n_train)``.
"""

from __future__ import annotations

import datetime as _dt
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from moodspark.functions import text as T
from moodspark.operators import evaluate, features, sampling
from moodspark.operators.boosting import MultiClassBoosting
from moodspark.operators.ensemble import ConfidenceRouter, WeightedEnsemble
from moodspark.operators.forest import RandomForest
from moodspark.operators.joins import collect_bounded
from moodspark.operators.linear_svm import SquaredHingeSVC
from moodspark.plans import naive_bayes
from moodspark.session import reliable_checkpoint
from moodspark.sources.commit_log import CommitLog

SEED = 42
# Rows kept per class before splitting (0/None: no cap).
SAMPLE_PER_CLASS = 200_000
# Reference model configurations (fixed values).  The linear models' stopping
# tolerance is the reference library's default.
TOL = 1e-4
LOGREG = dict(C=1.0, max_iter=1000)
NAIVE_BAYES = dict(alpha=0.1)
SVM = dict(C=1.0, max_iter=2000)
FOREST = dict(n_trees=200, max_depth=20)
BOOSTING = dict(n_trees=50, max_depth=3, learning_rate=0.1)
GRID_C = [0.5, 1.0, 1.5, 2.0]
GRID_NGRAM = [2, 3]
GRID_FOLDS = 3
CV_FOLDS = 5
ENSEMBLE_WEIGHTS = [0.65, 0.35]
ROUTER_THRESHOLD = 0.35


# ---------------------------------------------------------------------------
# Relational helpers used by the SQL-checked queries
# ---------------------------------------------------------------------------

#: Classes that a model may have; class counts and priors go through the driver.
MAX_CLASSES = 10_000


def balanced_weights(df: DataFrame, label: str, out: str = "weight", max_classes: int = MAX_CLASSES) -> DataFrame:
    """MOD6: ``n / (k * n_c)`` per row.  Class counts are a partial aggregate of
    at most ``max_classes`` rows, turned into a literal map (no join, no window)."""
    rows = collect_bounded(df.groupBy(label).agg(F.count("*").alias("n")), max_classes, "classes")
    n = sum(r["n"] for r in rows)
    k = len(rows)
    kv = []
    for r in rows:
        kv += [F.lit(r[label]), F.lit(n / (k * r["n"]))]
    m = F.create_map(*kv) if kv else F.create_map()
    return df.withColumn(out, F.element_at(m, F.col(label)).cast("double"))


def naive_bayes_long(weights: DataFrame, vocab: DataFrame, label_col: str, smoothing: float = 0.1,
                     max_classes: int = MAX_CLASSES) -> DataFrame:
    """MOD2 closed form on long-form features that carry their label: per (class,
    term) ``ln((sum_w + a) / (class_total + a * V))`` over the whole vocabulary."""
    classes = sorted(r[label_col] for r in collect_bounded(weights.select(label_col).distinct(), max_classes, "classes"))
    sums = naive_bayes.over_vocabulary(naive_bayes.class_sums(weights, classes, label_col), vocab, classes)
    total, v = naive_bayes.totals(sums, classes)
    theta = F.array(*[F.struct(F.lit(c).alias(label_col), naive_bayes.log_theta(
        F.col(f"s{i}"), F.lit(total[i]), v, smoothing).alias("log_theta")) for i, c in enumerate(classes)])
    return sums.select("term", F.inline(theta)).select(label_col, "term", "log_theta")


def per_group_summary(pred: DataFrame, group: str) -> DataFrame:
    """Accuracy and F1 (weighted, macro) per group value (e.g. per fold)."""
    return evaluate.summary(pred, group=(group,))


def comparison_from_predictions(pred: DataFrame) -> DataFrame:
    """Comparison table from (model, run_order, label, split, prediction)."""
    s = evaluate.summary(pred.where(F.col("split") != "train"), group=("model", "run_order", "split"))
    return (s.groupBy("model", "run_order").agg(
        F.max(F.when(F.col("split") == "val", F.col("accuracy"))).alias("accuracy_val"),
        F.max(F.when(F.col("split") == "val", F.col("f1_weighted"))).alias("f1_val"),
        F.max(F.when(F.col("split") == "test", F.col("accuracy"))).alias("accuracy_test"),
        F.max(F.when(F.col("split") == "test", F.col("f1_weighted"))).alias("f1_test")))


def best_model(cmp: DataFrame, by: str = "f1_test") -> DataFrame:
    """MOD11: highest ``by``; ties go to the earliest run."""
    return cmp.orderBy(F.desc(by), F.asc("run_order")).limit(1)


# ---------------------------------------------------------------------------
# Corpus and features
# ---------------------------------------------------------------------------

def prepare_corpus(df: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id",
                   sample_per_class: int | None = SAMPLE_PER_CLASS, sample_first: bool = False,
                   tokenised: bool = False, materialize: bool = True) -> DataFrame:
    """(doc_id, label, tokens, split) of any labelled table: cleaned, non-empty,
    split 70/15/15 per class by hash rank.  ``tokenised`` says that the text is
    cleaned tokens already (joined by spaces, as ``load_labelled`` gives them).

    ``sample_per_class`` bounds the rows to fit on; val and test rows are all
    kept, unless ``sample_first`` asks for the sample to be drawn before the split.

    With ``materialize`` the cleaned, non-empty token table is written to the
    shared checkpoint folder (``checkpoint()``, lineage cut) before the split -
    so the regex chain runs once although the split's histogram and ranking
    both read it - and the split result is checkpointed too: fits, vocabulary
    and evaluations read materialised tokens, and a lost executor re-reads a
    checkpoint instead of recomputing cleaning and ranking.
    """
    tokens = T.split_words(F.col(text_col)) if tokenised else T.tokenize(T.guard_text(df, text_col))
    t = df.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), T.once(tokens).alias("tokens")).where(
        F.col("label").isNotNull() & (F.size("tokens") > 0))
    keep = reliable_checkpoint if materialize else (lambda x: x)
    return keep(sampling.stratified_split(keep(t), "label", "doc_id", cap=sample_per_class, sample_first=sample_first))


class TfidfNgram(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator wrapper of :func:`features.fit_tfidf` (so a grid search refits
    the vocabulary inside every fold)."""

    inputCol = Param(Params._dummy(), "inputCol", "token array column", typeConverter=TypeConverters.toString)
    ngramMax = Param(Params._dummy(), "ngramMax", "largest n", typeConverter=TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary size", typeConverter=TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "1+ln(tf)", typeConverter=TypeConverters.toBoolean)
    minDf = Param(Params._dummy(), "minDf", "min document frequency", typeConverter=TypeConverters.toFloat)
    maxDf = Param(Params._dummy(), "maxDf", "max document fraction", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="tokens", ngramMax=2, maxFeatures=50_000, sublinear=False, minDf=1.0, maxDf=1.0):
        super().__init__()
        self._setDefault(inputCol="tokens", ngramMax=2, maxFeatures=50_000, sublinear=False, minDf=1.0, maxDf=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        g = self.getOrDefault
        min_df = g(self.minDf)
        min_df = int(min_df) if min_df >= 1 else min_df
        max_df = g(self.maxDf)
        return features.fit_tfidf(dataset, g(self.inputCol), ngram_max=g(self.ngramMax),
                                  max_features=g(self.maxFeatures), sublinear=g(self.sublinear),
                                  min_df=min_df, max_df=float(max_df))


def tfidf_estimator(config: dict) -> TfidfNgram:
    return TfidfNgram(ngramMax=config["ngram_max"], maxFeatures=config["max_features"],
                      sublinear=config["sublinear"], minDf=float(config["min_df"]), maxDf=float(config["max_df"]))


# ---------------------------------------------------------------------------
# Classifiers (reference configurations)
# ---------------------------------------------------------------------------

def classifier(name: str, n_train: int, C: float | None = None):
    if name == "logreg":
        c = C or LOGREG["C"]
        return LogisticRegression(family="multinomial", regParam=1.0 / (c * n_train), elasticNetParam=0.0,
                                  standardization=False, maxIter=LOGREG["max_iter"], tol=TOL)
    if name == "naive_bayes":
        return NaiveBayes(modelType="multinomial", smoothing=NAIVE_BAYES["alpha"])
    if name == "svm":
        return SquaredHingeSVC(C=C or SVM["C"], maxIter=SVM["max_iter"], tol=TOL)
    if name == "forest":
        return RandomForest(numTrees=FOREST["n_trees"], maxDepth=FOREST["max_depth"], weightCol="weight", seed=SEED)
    if name == "boosting":
        return MultiClassBoosting(maxIter=BOOSTING["n_trees"], maxDepth=BOOSTING["max_depth"],
                                  stepSize=BOOSTING["learning_rate"])
    raise ValueError(f"unknown model {name}")


MODELS = ["svm", "logreg", "naive_bayes", "forest", "boosting"]


def fit_features(train: DataFrame, config=features.NOTEBOOK_CONFIG) -> PipelineModel:
    return features.fit_tfidf(train, "tokens", **config)


# Rows per partition of a cached training set.  Iterative optimisers run one
# job per iteration; partitions much smaller than this make every iteration
# scheduling-bound, larger ones limit parallelism.
ROWS_PER_PARTITION = 20_000
# Where a pass over a partition is long the partitions are smaller: a forest leads each
# row down all trees, tokens become n-grams and vectors, and a logistic regression makes
# hundreds of passes.
FOREST_ROWS, TOKEN_ROWS, LOGREG_ROWS = 500, 1000, 2000


def rows_per_partition(name: str) -> int:
    return {"forest": FOREST_ROWS, "svm": TOKEN_ROWS, "logreg": LOGREG_ROWS}.get(name, ROWS_PER_PARTITION)


def cache_for_fit(x: DataFrame, n: int | None = None, rows: int | None = None) -> tuple[DataFrame, int]:
    """Repartition a training set to partitions of ``rows`` (``ROWS_PER_PARTITION``)
    and cache it; returns (df, rows)."""
    n = x.count() if n is None else n
    parts = max(1, -(-n // (rows or ROWS_PER_PARTITION)))
    y = x.repartition(parts).persist()
    y.count()
    return y, n


def fit_classifier(name: str, feats: PipelineModel, train: DataFrame) -> tuple[PipelineModel, float]:
    """Fit one classifier on cached features; returns the full scoring
    pipeline (features + classifier) and the fit seconds."""
    x = feats.transform(train)
    if name == "forest":
        x = balanced_weights(x, "label")
    x, n = cache_for_fit(x.withColumn("label", F.col("label").cast("double")), rows=rows_per_partition(name))
    try:
        t0 = time.perf_counter()
        m = classifier(name, n).fit(x)
        secs = time.perf_counter() - t0
    finally:
        x.unpersist()
    return PipelineModel(stages=list(feats.stages) + [m]), secs


def predict(model: PipelineModel, df: DataFrame, keep=("doc_id", "split", "label")) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def train_and_predict(corpus: DataFrame, name: str) -> DataFrame:
    """Fit ``name`` on the train split of a prepared corpus; predictions for val and test rows."""
    train = corpus.where(F.col("split") == "train")
    feats = fit_features(train)
    model, _ = fit_classifier(name, feats, train)
    return predict(model, corpus.where(F.col("split") != "train"))


# ---------------------------------------------------------------------------
# Evaluation of fitted models, cross-validation, comparison
# ---------------------------------------------------------------------------

class MacroF1Evaluator(Evaluator):
    """Macro-averaged F1 (EVA3), computed from confusion counts."""

    def __init__(self, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset):
        row = evaluate.summary(dataset, self.labelCol, self.predictionCol).first()
        return float(row["f1_macro"]) if row else 0.0

    def isLargerBetter(self):
        return True


class WeightedF1Evaluator(MacroF1Evaluator):
    def _evaluate(self, dataset):
        row = evaluate.summary(dataset, self.labelCol, self.predictionCol).first()
        return float(row["f1_weighted"]) if row else 0.0


def metrics(model: PipelineModel, corpus: DataFrame) -> dict:
    """Accuracy and F1 (weighted and macro) on val and test, plus inference
    milliseconds per row (timed around the metric action)."""
    held = corpus.where(F.col("split") != "train")
    t0 = time.perf_counter()
    s = evaluate.summary(predict(model, held), group=("split",)).collect()
    ms = (time.perf_counter() - t0) * 1000.0
    out = {}
    n = 0
    for r in s:
        sp = r["split"]
        n += r["n"]
        out[f"accuracy_{sp}"] = float(r["accuracy"])
        out[f"f1_{sp}"] = float(r["f1_weighted"])
        out[f"f1_macro_{sp}"] = float(r["f1_macro"])
    out["inference_ms"] = ms / max(n, 1)
    return out


def cross_validate(name: str, corpus: DataFrame, k: int = CV_FOLDS,
                   feats: PipelineModel | None = None) -> tuple[float, float]:
    """MOD10: mean and population std of k weighted-F1 scores.  As in the
    reference, the features are fitted once on all train rows (the folds share
    vocabulary and IDF); folds are hash-ranked per class.  The folds' fits run side by
    side: one alone often has fewer tasks than there are cores."""
    train = corpus.where(F.col("split") == "train")
    feats = feats or fit_features(train)
    x = feats.transform(sampling.stratified_folds(train, "label", "doc_id", k))
    if name == "forest":
        x = balanced_weights(x, "label")
    x, n = cache_for_fit(x.withColumn("label", F.col("label").cast("double")), rows=rows_per_partition(name))
    try:
        held = {r["fold"]: r["n"] for r in x.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        if any(held.get(f, 0) in (0, n) for f in range(k)):
            raise ValueError(f"a fold without rows to fit on or to score: {held}")

        def score(f: int) -> float:
            m = classifier(name, int(n * (k - 1) / k)).fit(x.where(F.col("fold") != f))
            return WeightedF1Evaluator().evaluate(m.transform(x.where(F.col("fold") == f)))

        with ThreadPoolExecutor(max_workers=k) as pool:
            scores = list(pool.map(score, range(k)))
        return float(np.mean(scores)), float(np.std(scores))
    finally:
        x.unpersist()


def compare_models(corpus: DataFrame, models=None, folds: int = CV_FOLDS, with_cv: bool = True) -> DataFrame:
    """MOD1-MOD5, MOD10, MOD11 inputs: one comparison row per model.  The features
    are fitted once and shared by all fits and cross-validations."""
    models = models or MODELS
    rows = []
    train = corpus.where(F.col("split") == "train")
    feats = fit_features(train)
    for order, name in enumerate(models):
        model, secs = fit_classifier(name, feats, train)
        m = metrics(model, corpus)
        cv_mean, cv_std = cross_validate(name, corpus, folds, feats) if with_cv else (None, None)
        rows.append((name, order, m.get("accuracy_val"), m.get("f1_val"), m.get("accuracy_test"),
                     m.get("f1_test"), m.get("f1_macro_test"), cv_mean, cv_std, secs))
    schema = ("model string, run_order int, accuracy_val double, f1_val double, accuracy_test double, "
              "f1_test double, f1_macro_test double, cv_f1_mean double, cv_f1_std double, train_seconds double")
    return corpus.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# Grid search and CLI variants (MOD9, MOD12)
# ---------------------------------------------------------------------------

def grid_search(train: DataFrame, folds: int = GRID_FOLDS, Cs=GRID_C, ngrams=GRID_NGRAM,
                parallelism: int = 4):
    """MOD9: C x n-gram grid, macro F1, k folds (hash-ranked per class), the
    vectoriser refitted inside every fold; refit of the best on all train rows.

    The vectoriser depends only on (n-gram, fold): one count of terms by fold gives
    all of them, and that of the refit.  Its output is cached; the C values are then
    fitted on that cached set, in passes that they share, and the folds of an n-gram
    size side by side.  Ties go to the first grid point (n-gram major, C minor).
    """
    x, n = cache_for_fit(sampling.stratified_folds(train, "label", "doc_id", folds).withColumn(
        "label", F.col("label").cast("double")), rows=TOKEN_ROWS)

    def fold_scores(ng: int, f: int) -> list[float]:
        """The score of each C on fold ``f``."""
        tr, feats = x.where(F.col("fold") != f), fitted[ng, f]
        trv, n_tr = cache_for_fit(feats.transform(tr), rows=rows_per_partition("svm"))
        vav = feats.transform(x.where(F.col("fold") == f)).persist()

        try:
            models = classifier("svm", n_tr).fit_each(trv, Cs, parallelism)
            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                return list(pool.map(lambda m: MacroF1Evaluator().evaluate(m.transform(vav)), models))
        finally:
            trv.unpersist()
            vav.unpersist()

    scores = {(ng, c): [] for ng in ngrams for c in Cs}
    try:
        config = {k: v for k, v in features.CLI_CONFIG.items() if k != "ngram_max"}
        fitted = features.fit_tfidf_folds(x, "tokens", "fold", folds, ngrams, **config)
        for ng in ngrams:
            with ThreadPoolExecutor(max_workers=folds) as pool:
                for found in pool.map(lambda f: fold_scores(ng, f), range(folds)):
                    for c, v in zip(Cs, found):
                        scores[(ng, c)].append(v)
        grid = [(ng, c) for ng in ngrams for c in Cs]
        mean = {g: sum(v) / len(v) for g, v in scores.items()}
        best_ng, best_c = max(grid, key=lambda g: (mean[g], -grid.index(g)))
        feats = fitted[best_ng, None]
        xv, nx = cache_for_fit(feats.transform(x), rows=rows_per_partition("svm"))
        try:
            m = classifier("svm", nx, best_c).fit(xv)
        finally:
            xv.unpersist()
        params = {"best_C": best_c, "best_ngram_max": best_ng, "cv_f1_macro": mean[(best_ng, best_c)]}
        return PipelineModel(stages=list(feats.stages) + [m]), params
    finally:
        x.unpersist()


def cli_variants(skip_tuning: bool = False) -> dict:
    """MOD12: the CLI's variants as estimators over CLI features."""
    def svc(n):
        return classifier("svm", n)

    def lr(n):
        return LogisticRegression(family="multinomial", regParam=1.0 / (LOGREG["C"] * n), standardization=False,
                                  maxIter=LOGREG["max_iter"], tol=TOL)

    # fixed values: the variants' names
    v = {
        "linearsvc_baseline": lambda n: svc(n),
        "ensemble_vote_pondere": lambda n: WeightedEnsemble(estimators=[svc(n), lr(n)], weights=ENSEMBLE_WEIGHTS),
        "routage_confiance": lambda n: ConfidenceRouter(primary=svc(n), fallback=lr(n), threshold=ROUTER_THRESHOLD),
    }
    if not skip_tuning:
        v["linearsvc_tuned"] = None
    return v


def variant_compare(corpus: DataFrame, skip_tuning: bool = False, runs_path: str | None = None,
                    export_path: str | None = None) -> DataFrame:
    """MOD12 + MOD11 + SNK4 (+ SNK2): fit each variant, macro F1 on val/test, train
    seconds, inference ms/row, fallback rate; every run is logged with its report,
    and the variant with the best test F1 (the first of equals) is saved."""
    spark = corpus.sparkSession
    rows, best = [], (-1.0, None)
    train = corpus.where(F.col("split") == "train")
    held = corpus.where(F.col("split") != "train")
    t0 = time.perf_counter()
    feats = features.fit_tfidf(train, "tokens", **features.CLI_CONFIG)
    feature_seconds = time.perf_counter() - t0
    for order, (name, make) in enumerate(cli_variants(skip_tuning).items()):
        params = {"variant": name}
        t0 = time.perf_counter()
        if make is None:
            model, extra = grid_search(train)
            params.update({k: str(v) for k, v in extra.items()})
            secs = time.perf_counter() - t0
        else:
            x, nx = cache_for_fit(feats.transform(train).withColumn("label", F.col("label").cast("double")))
            try:
                m = make(nx).fit(x)
            finally:
                x.unpersist()
            model = PipelineModel(stages=list(feats.stages) + [m])
            secs = time.perf_counter() - t0 + feature_seconds
        out = model.transform(held)
        t1 = time.perf_counter()
        s = evaluate.summary(out.select("split", "label", F.col("prediction").cast("int").alias("prediction")),
                             group=("split",)).collect()
        ms = (time.perf_counter() - t1) * 1000.0 / max(sum(r["n"] for r in s), 1)
        met = {f"f1_{r['split']}": float(r["f1_macro"]) for r in s}
        fb = None
        test = out.where(F.col("split") == "test")
        if "use_fallback" in out.columns:
            fb = float(test.agg(F.avg(F.col("use_fallback").cast("double"))).first()[0] or 0.0)
        rows.append((name, order, met.get("f1_val"), met.get("f1_test"), ms, secs, fb))
        if met.get("f1_test", 0.0) > best[0]:
            best = (met["f1_test"], model)
        if runs_path:
            report = evaluate.report_lines(test.select("label", F.col("prediction").cast("int").alias("prediction")))
            log_run(spark, runs_path, name, params,
                    {**met, "train_seconds": secs, "inference_ms": ms,
                     **({"fallback_rate": fb} if fb is not None else {})}, report, model)
    if export_path and best[1] is not None:
        save_model(best[1], export_path)
    schema = ("variant string, run_order int, f1_val double, f1_test double, inference_ms double, "
              "train_seconds double, fallback_rate double")
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# Sinks: run log, model artefacts, registry (SNK2, SNK4, SNK5)
# ---------------------------------------------------------------------------

RUN_SCHEMA = TY.StructType([
    TY.StructField("run", TY.StringType()),
    TY.StructField("params", TY.MapType(TY.StringType(), TY.StringType())),
    TY.StructField("metrics", TY.MapType(TY.StringType(), TY.DoubleType())),
    TY.StructField("report", TY.ArrayType(TY.StringType())),
    TY.StructField("model_path", TY.StringType()),
    TY.StructField("ts", TY.TimestampType()),
])


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def log_run(spark: SparkSession, path: str, run: str, params: dict, metrics_: dict,
            report: DataFrame | None = None, model: PipelineModel | None = None) -> None:
    """SNK4: append one run to a Parquet table: string params, float metrics only,
    the lines of its classification report and, beside the table, the fitted model."""
    m = {k: v for k, v in metrics_.items() if isinstance(v, float)}
    p = {k: str(v) for k, v in params.items()}
    lines = [r["line"] for r in report.orderBy("line_no").collect()] if report is not None else None
    # each run's model in a folder of its own, written before the row that names it
    saved = save_model(model, f"{path.rstrip('/')}-models/{run}-{uuid.uuid4().hex[:12]}") if model is not None else None
    spark.createDataFrame([(run, p, m, lines, saved, _now())], RUN_SCHEMA).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    """SNK2: one artefact holding features and classifier."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """SRC6."""
    return PipelineModel.load(path)


REGISTRY_SCHEMA = TY.StructType([
    TY.StructField("name", TY.StringType()),
    TY.StructField("version", TY.LongType()),
    TY.StructField("path", TY.StringType()),
    TY.StructField("params", TY.MapType(TY.StringType(), TY.StringType())),
    TY.StructField("metrics", TY.MapType(TY.StringType(), TY.DoubleType())),
    TY.StructField("report", TY.ArrayType(TY.StringType())),
    TY.StructField("ts", TY.TimestampType()),
])


def register(spark: SparkSession, registry_path: str, name: str, model_path: str, metrics_: dict,
             params: dict | None = None, report: DataFrame | None = None) -> int:
    """SNK5: adds the next version of ``name``; any number of writers may do so at once
    and each gets a number of its own.  The registry is a folder of one-row Parquet
    files and is read as a table."""
    lines = [r["line"] for r in report.orderBy("line_no").collect()] if report is not None else None
    own = {k: str(v) for k, v in (params or {}).items()}, {k: float(v) for k, v in metrics_.items()}, lines, _now()
    return CommitLog(spark, registry_path).append(
        name, lambda version: _one_row((name, version, model_path, *own)))


def _one_row(row: tuple) -> bytes:
    """A Parquet file of one row of the registry, as bytes."""
    text = pa.string()
    arrow = pa.schema([("name", text), ("version", pa.int64()), ("path", text), ("params", pa.map_(text, text)),
                       ("metrics", pa.map_(text, pa.float64())), ("report", pa.list_(text)), ("ts", pa.timestamp("us", tz="UTC"))])
    values = [list(v.items()) if isinstance(v, dict) else v for v in row]
    out = pa.BufferOutputStream()
    pq.write_table(pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow), out)
    return out.getvalue().to_pybytes()


def class_metrics(pred: DataFrame) -> dict[str, float]:
    """``precision_``, ``recall_`` and ``f1_`` of each named class (at most a few rows)."""
    rows = evaluate.named(evaluate.class_report(pred)).collect()
    return {f"{m}_{r['name']}": float(r[m]) for r in rows for m in ("precision", "recall", "f1")}
