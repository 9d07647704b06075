"""TF-IDF n-gram features (FEA1-FEA7) in two equal forms.

* **Long form** ``(doc, term, weight)`` built relationally - the inspectable,
  SQL-checkable form.
* **Vector form** - a persisted ``PipelineModel`` of stateless, row-local stages
  (n-gram expression -> frozen ``CountVectorizerModel`` -> optional sublinear
  TF -> IDF scaling -> L2 normaliser).  No shuffle at transform time, so it is
  what training, batch scoring and streaming use.

Both share one fitted vocabulary: terms with ``min_df <= df <= max_df * n_docs``,
the ``max_features`` most frequent by total count (ties by term), indexed in
term order.  IDF is smoothed: ``ln((1 + n) / (1 + df)) + 1``.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Normalizer,
                                SQLTransformer)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.functions.text import once
from moodspark.operators.joins import collect_bounded
from moodspark.session import reliable_checkpoint, scratch_path

# Configurations (fixed values of the reference's two vectorisers).
NOTEBOOK_CONFIG = dict(ngram_max=2, max_features=50_000, sublinear=True, min_df=3, max_df=0.95)
CLI_CONFIG = dict(ngram_max=2, max_features=50_000, sublinear=False, min_df=1, max_df=1.0)
# Tokens shorter than this are not terms (word pattern of two or more characters).
MIN_TERM_LEN = 2
#: Occurrences of terms that a task of the long form counts, about.
TASK_OCCURRENCES = 1_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngrams(tokens, ngram_max: int = 2) -> Column:
    """FEA1: all 1-grams, then all 2-grams, ... up to ``ngram_max``.

    n-grams are zipped from shifted slices, so no lambda re-reads the token
    array (linear in the document length).
    """
    t = F.filter(_col(tokens), lambda x: F.length(x) >= MIN_TERM_LEN)
    parts = [t]
    for n in range(2, ngram_max + 1):
        ln = F.greatest(F.size(t) - (n - 1), F.lit(0))
        g = F.slice(t, 1, ln)
        for j in range(1, n):
            g = F.zip_with(g, F.slice(t, j + 1, ln), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(g)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ngram_sql(tokens_col: str, out_col: str, ngram_max: int) -> str:
    """The same n-gram expression as a Spark SQL statement (for SQLTransformer)."""
    t = f"filter({tokens_col}, x -> length(x) >= {MIN_TERM_LEN})"
    parts = [t]
    for n in range(2, ngram_max + 1):
        ln = f"greatest(size({t}) - {n - 1}, 0)"
        g = f"slice({t}, 1, {ln})"
        for j in range(1, n):
            g = f"zip_with({g}, slice({t}, {j + 1}, {ln}), (a, b) -> concat(a, ' ', b))"
        parts.append(g)
    expr = parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"
    return f"SELECT *, {expr} AS {out_col} FROM __THIS__"


def term_stats(df: DataFrame, terms_col: str, count_docs: bool = False) -> DataFrame:
    """(term, df, ctf) in one pass: each doc emits its occurrences in term order, the
    first of each term marked; map-side partial aggregation before the shuffle.

    With ``count_docs`` every document also emits one row with a null term,
    so the null-term row's ``df`` is the number of documents (no extra pass).
    """
    # the n-grams are worked out and sorted once; a null comes first
    terms = F.concat(F.array(F.lit(None).cast("string")), _col(terms_col)) if count_docs else _col(terms_col)
    # posexplode_outer: see stats.word_frequencies (no inferred size filter that
    # would re-evaluate the token expression)
    ex = df.select(once(F.sort_array(terms)).alias("_t")).select("_t", F.posexplode_outer("_t").alias("_i", "term"))
    again = (F.col("_i") > 0) & F.col("term").eqNullSafe(F.get("_t", F.col("_i") - 1))
    return ex.where(F.col("_i").isNotNull()).groupBy("term").agg(
        F.sum(F.when(again, 0).otherwise(1)).cast("long").alias("df"),
        F.count("term").alias("ctf"))


def idf_value(df_col, n_docs: int) -> Column:
    """FEA5: smoothed IDF."""
    return F.log(F.lit(1.0 + n_docs) / (F.col(df_col) + 1.0)) + 1.0


def fit_vocabulary(df: DataFrame, terms_col: str, min_df=1, max_df=1.0,
                   max_features: int | None = 50_000) -> tuple[DataFrame, int]:
    """FEA2 + FEA3: (term, df, ctf, idf[, idx]) and the number of documents.

    One pass over the documents counts terms and documents; the counts are
    checkpointed (one short row a term, of terms in too few documents none where
    ``min_df`` says it as a number), because the choice of the top terms
    reads them twice: a histogram of total counts gives the least count among the
    ``max_features`` most frequent, and only terms from there on (the chosen ones
    and ties) are ordered, so no task gathers more than that.
    """
    counted = term_stats(df, terms_col, count_docs=True)
    if not isinstance(min_df, float):
        counted = counted.where(F.col("term").isNull() | (F.col("df") >= min_df))
    counted = reliable_checkpoint(counted)
    row = counted.where(F.col("term").isNull()).select("df").first()
    n_docs = int(row["df"]) if row else 0
    return chosen_terms(counted.where(F.col("term").isNotNull()), n_docs, min_df, max_df, max_features), n_docs


def chosen_terms(counted: DataFrame, n_docs: int, min_df=1, max_df=1.0, max_features: int | None = 50_000) -> DataFrame:
    """The vocabulary among counted terms (term, df, ctf) of ``n_docs`` documents."""
    # integers are document counts, floats are fractions of the documents
    lo = min_df * n_docs if isinstance(min_df, float) else min_df
    hi = max_df * n_docs if isinstance(max_df, float) else max_df
    kept = counted.where((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features:
        cut = least_count(kept, "ctf", max_features)
        kept = kept.where(F.col("ctf") >= cut).orderBy(F.desc("ctf"), F.asc("term")).limit(max_features)
        # at most max_features rows: a single ordered window is bounded
        kept = kept.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    return kept.withColumn("idf", idf_value("df", n_docs))


def least_count(df: DataFrame, count_col: str, k: int) -> int:
    """The greatest count that at least ``k`` rows reach (the least count if there are fewer rows).

    Rows are counted by the power of two of their count, then by count within
    the one power where the ``k``-th row lies, largest first and cut off where
    ``k`` is reached: a few dozen rows and at most ``k`` come to the driver.
    """
    power = F.floor(F.log2(F.col(count_col).cast("double")))
    by_power = sorted(((int(r["p"]), r["n"]) for r in df.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    above = 0
    for p, n in by_power:
        if above + n >= k:
            inside = (df.where(power == p).groupBy(count_col).agg(F.count("*").alias("n"))
                      .orderBy(F.desc(count_col)).limit(k).collect())
            for r in inside:
                above += r["n"]
                if above >= k:
                    return int(r[count_col])
        above += n
    return 0


def occurrences(vocab: DataFrame) -> int:
    """How often the terms of a fitted vocabulary occur in the documents it was fitted on."""
    return int(vocab.agg(F.sum("ctf")).first()[0] or 0)


def tfidf_long(df: DataFrame, id_col: str, terms_col: str, vocab: DataFrame, sublinear: bool, normalise: bool = True,
               carry: tuple[str, ...] = (), bounded: bool = True, occurs: int | None = None) -> DataFrame:
    """FEA4-FEA7 long form: (id, *carry, term, weight).  Unseen terms are dropped; a
    row whose terms are all unseen has no output rows (a zero vector).  ``carry``
    names columns that depend on the id (a label, a split).

    A ``bounded`` vocabulary (``max_features``) is broadcast, so that no task gets a
    frequent term's occurrences; else that is left to size statistics and adaptive execution.

    A task counts, sorts and normalises its documents' occurrences in memory.  ``occurs``
    says about how many there are in all: then the documents are dealt out to tasks of
    ``TASK_OCCURRENCES``, and what crosses the shuffle is what ``terms_col`` reads, not
    a row for each occurrence.  Without it occurrences are shuffled and the tasks' number
    is adaptive execution's, which goes by compressed bytes.
    """
    # one shuffle: hash-partitioning documents or their occurrences by document satisfies
    # both the (doc, term) count and the per-document norm window below
    if occurs is not None:
        df = df.repartition(max(1, -(-occurs // TASK_OCCURRENCES)), id_col)
    ex = df.select(id_col, *carry, _col(terms_col).alias("_terms"))
    ex = ex.select(id_col, *carry, F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
    v = vocab.select("term", "idf")
    ex = ex.join(F.broadcast(v) if bounded else v, "term")
    if occurs is None:
        ex = ex.repartition(id_col)
    tf = ex.groupBy(id_col, *carry, "term", "idf").agg(F.count("*").alias("tf"))
    tfw = (1.0 + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    w = tf.select(id_col, *carry, "term", (tfw * F.col("idf")).alias("w"))
    if normalise:
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
        w = w.select(id_col, *carry, "term", (F.col("w") / norm).alias("w"))
    return w.withColumnRenamed("w", "weight")


# ---------------------------------------------------------------------------
# Vector form
# ---------------------------------------------------------------------------

def _sublinear_udf():
    """Build the UDF from a closure so it is shipped to executors by value
    (workers do not need this package installed).

    A vector is a struct of its parts in Arrow, so a batch's non-zeros are one
    array and take one vectorised logarithm.
    """
    import pyarrow as pa

    def sublinear(vectors: pa.Array) -> pa.Array:
        import numpy as np

        kind, size, indices, values = (vectors.field(i) for i in range(4))
        x = values.values.to_numpy(zero_copy_only=False)
        y = np.where(x > 0, 1.0 + np.log(np.maximum(x, 1e-300)), x)
        changed = pa.ListArray.from_arrays(values.offsets, pa.array(y), type=values.type,
                                           mask=values.is_null() if values.null_count else None)
        return pa.StructArray.from_arrays([kind, size, indices, changed], fields=list(vectors.type),
                                          mask=vectors.is_null() if vectors.null_count else None)

    sublinear.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(sublinear, VectorUDT())


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """FEA4 sublinear term frequency ``1 + ln(tf)`` on a sparse count vector.

    The one Python step of the feature chain (there is no JVM element-wise log
    for ML vectors): a whole Arrow batch's non-zeros at a time, never a row.
    """

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.withColumn(self.getOutputCol(), _sublinear_udf()(F.col(self.getInputCol())))


class DropColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drop the intermediate columns of the feature chain."""

    cols = Param(Params._dummy(), "cols", "columns to drop", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, cols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.drop(*self.getOrDefault(self.cols))


def frozen_count_vectorizer(words: list[str], input_col: str, output_col: str) -> CountVectorizerModel:
    """``CountVectorizerModel`` over a fixed vocabulary.

    Equivalent to ``CountVectorizerModel.from_vocabulary`` but the Java string
    array is built inside the JVM from one joined string (terms never contain
    a newline), instead of one gateway call per term - for a 50,000-term
    vocabulary that is seconds of driver time saved per fit.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None or getattr(sc, "_jvm", None) is None:
        return CountVectorizerModel.from_vocabulary(words, inputCol=input_col, outputCol=output_col)
    jvocab = sc._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(words))
    model = CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel", jvocab)
    model.setInputCol(input_col)
    model.setOutputCol(output_col)
    model._set(vocabSize=len(words))
    return model


def fit_tfidf(df: DataFrame, tokens_col: str, ngram_max=2, max_features=50_000, sublinear=False,
              min_df=1, max_df=1.0, features_col: str = "features") -> PipelineModel:
    """Fit the vocabulary/IDF on ``df`` and return the stateless vector pipeline.

    The vocabulary is collected to build the frozen ``CountVectorizerModel``;
    it is bounded by ``max_features``.
    """
    if not max_features:
        raise ValueError("the vector form needs max_features (a bounded vocabulary)")
    ngr = SQLTransformer(statement=ngram_sql(tokens_col, "_terms", ngram_max))
    terms = ngr.transform(df.select(tokens_col))
    vocab, n_docs = fit_vocabulary(terms, "_terms", min_df, max_df, max_features)
    return _vector_form(ngr, vocab, n_docs, max_features, sublinear, features_col)


def _vector_form(ngr: SQLTransformer, vocab: DataFrame, n_docs: int, max_features: int, sublinear: bool,
                 features_col: str = "features") -> PipelineModel:
    rows = collect_bounded(vocab.select("term", "idx", "df").orderBy("idx"), max_features, "vocabulary")
    words = [r["term"] for r in rows]
    idf = [math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in rows]
    stages = [ngr,
              frozen_count_vectorizer(words, "_terms", "_tf"),
              ]
    tf_col = "_tf"
    if sublinear:
        stages.append(SublinearTF(inputCol="_tf", outputCol="_tfs"))
        tf_col = "_tfs"
    if not words:  # degenerate: empty vocabulary -> zero-length vectors
        idf = []
    stages += [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=tf_col, outputCol="_tfidf"),
               Normalizer(p=2.0, inputCol="_tfidf", outputCol=features_col),
               DropColumns(cols=["_terms", "_tf", "_tfidf"] + (["_tfs"] if sublinear else []))]
    return PipelineModel(stages=stages)


def fit_tfidf_folds(df: DataFrame, tokens_col: str, fold_col: str, folds: int, ngram_maxes: list[int], max_features=50_000,
                    sublinear=False, min_df=1, max_df=1.0) -> dict[tuple[int, int | None], PipelineModel]:
    """``fit_tfidf`` of the documents outside of each fold, and of all (fold None), for each
    largest n, from one count of terms by fold (tokens hold no spaces).

    All n-grams and folds choose among the same few terms: those that occur at least as
    often as ``max_features`` terms do outside of each fold; one pass finds that number, or
    rather the power of two below it.
    """
    ngr = {n: SQLTransformer(statement=ngram_sql(tokens_col, "_terms", n)) for n in ngram_maxes}
    # a document's row with a null term counts the document
    terms = F.concat(F.array(F.lit(None).cast("string")), ngrams(tokens_col, max(ngram_maxes)))
    ex = (df.select(F.col(fold_col).alias("_f"), once(F.sort_array(terms)).alias("_t"))
          .select("_f", "_t", F.posexplode_outer("_t").alias("_i", "term")).where(F.col("_i").isNotNull()))
    again = (F.col("_i") > 0) & F.col("term").eqNullSafe(F.get("_t", F.col("_i") - 1))
    own = [F.col("_f") == f for f in range(folds)]
    path = scratch_path(df.sparkSession, "fold-terms")
    ex.groupBy("term").agg(
        *[F.sum(F.when(o & ~again, 1).otherwise(0)).cast("long").alias(f"df{f}") for f, o in enumerate(own)],
        *[F.sum(F.when(o & F.col("term").isNotNull(), 1).otherwise(0)).cast("long").alias(f"ctf{f}") for f, o in enumerate(own)],
    ).write.parquet(path)
    counted = df.sparkSession.read.parquet(path)

    def outside(kind: str, fold: int | None):
        return sum((F.col(f"{kind}{f}") for f in range(folds) if f != fold), F.lit(0).cast("long"))

    docs = counted.where(F.col("term").isNull()).first()
    sizes = {None: 0, **{f: 0 for f in range(folds)}}
    if docs:
        sizes = {f: sum(docs[f"df{g}"] for g in range(folds) if g != f) for f in sizes}
    n_of = F.length("term") - F.length(F.replace(F.col("term"), F.lit(" "), F.lit(""))) + 1
    counted = counted.where(F.col("term").isNotNull()).withColumn("n", n_of)

    def within(kept: DataFrame, fold: int | None, n: int) -> DataFrame:
        return kept.where(F.col("n") <= n).select("term", outside("df", fold).alias("df"), outside("ctf", fold).alias("ctf")).where("df > 0")

    def bounded(fold: int | None):
        size, found = sizes[fold], outside("df", fold)
        lo, hi = (b * size if isinstance(b, float) else b for b in (min_df, max_df))
        return (F.col("n") <= min(ngram_maxes)) & (found > 0) & (found >= F.lit(lo)) & (found <= F.lit(hi))

    powers = range(1, 31)
    seen = counted.agg(*[F.count(F.when(bounded(f) & (outside("ctf", f) >= 2 ** p), 1)).alias(f"{f}_{p}")
                         for f in sizes for p in powers]).first()
    least = max([2 ** p for p in powers if all(seen[f"{f}_{p}"] >= max_features for f in sizes)], default=1)
    kept = reliable_checkpoint(counted.where(outside("ctf", None) >= least))
    return {(n, f): _vector_form(ngr[n], chosen_terms(within(kept, f, n), sizes[f], min_df, max_df, max_features),
                                 sizes[f], max_features, sublinear) for n in ngram_maxes for f in sizes}


def vector_to_long(df: DataFrame, id_col: str, features_col: str, vocabulary: list[str]) -> DataFrame:
    """Vector form -> long form (id, term, weight) for comparing the two forms."""
    vocab = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "idx int, term string")
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(features_col))
    ex = df.select(id_col, F.posexplode(arr).alias("idx", "weight")).where(F.col("weight") != 0)
    return ex.join(vocab, "idx").select(id_col, "term", "weight")
