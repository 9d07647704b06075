"""Classification metrics from confusion counts (EVA1-EVA7).

Everything starts from ``groupBy(label, prediction).count()`` - partially
aggregated in every task, at most classes^2 rows after the shuffle - so the
metric jobs cost one pass over the predictions whatever their size.  Zero
denominators give 0.  Classes are the union of true and predicted values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodspark.functions.labels import LABEL_NAMES


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     group: tuple = ()) -> DataFrame:
    return pred.groupBy(*group, F.col(label).cast("int").alias("label"),
                        F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def _div(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                 cm: DataFrame | None = None, group: tuple = ()) -> DataFrame:
    """EVA4: per class (and per ``group``) precision, recall, F1, support."""
    group = tuple(group)
    cm = cm if cm is not None else confusion_counts(pred, label, prediction, group)
    both = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    per = (cm.select(*group, F.explode(both).alias("e")).select(*group, "e.*")
           .groupBy(*group, "cls").agg(F.sum("support").cast("long").alias("support"),
                               F.sum("predicted").cast("long").alias("predicted"),
                               F.sum("tp").cast("long").alias("tp")))
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    out = per.select(*group, F.col("cls").alias("class"), "support", p.alias("precision"), r.alias("recall"))
    f1 = _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def summary(pred: DataFrame, label: str = "label", prediction: str = "prediction",
            group: tuple = ()) -> DataFrame:
    """EVA1-EVA3 and the macro / weighted averages of EVA4, one row per group."""
    group = tuple(group)
    rep = class_report(pred, label, prediction, group=group)
    n = F.sum("support")
    return rep.groupBy(*group).agg(
        n.cast("long").alias("n"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVA1."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes=(0, 1, 2)) -> DataFrame:
    """EVA5: rows true class, one column per predicted class, zeros filled."""
    cm = confusion_counts(pred, label, prediction)
    cols = [f"pred_{c}" for c in classes]
    piv = cm.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n"))
    piv = piv.toDF("label", *cols).na.fill(0, cols)
    return piv.select("label", *[F.col(c).cast("long") for c in cols])


def demo_accuracy(df: DataFrame, flag_col: str = "correct", yes: str = "Oui") -> DataFrame:
    """EVA6: correct / total and percent."""
    ok = F.sum(F.when(F.col(flag_col) == yes, 1).otherwise(0)).cast("long")
    total = F.count("*")
    return df.agg(ok.alias("correct"), total.alias("total"),
                  (ok * 100.0 / total).alias("pct"))


def metric_extremes(df: DataFrame, higher_better: list[str], lower_better: list[str]) -> DataFrame:
    """EVA7: flag the best row per metric (max, or min for times)."""
    w = Window.partitionBy()  # comparison tables hold one row per model
    out = df
    for m in higher_better:
        out = out.withColumn(f"best_{m}", F.col(m) == F.max(m).over(w))
    for m in lower_better:
        out = out.withColumn(f"best_{m}", F.col(m) == F.min(m).over(w))
    return out


def named(report: DataFrame) -> DataFrame:
    return report.withColumn("name", F.try_element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]),
                                                      F.col("class") + 1))


def fixed(c, places: int = 2):
    """A non-negative number with a fixed number of decimals, as text (half up
    on the product, so that no two engines' formatting rules can differ)."""
    scale = 10 ** places
    n = F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    return F.concat((F.floor(n / scale)).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))


REPORT_WIDTH = 12


def report_lines(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """SNK3: ``(line_no, line)`` of a classification report: a header, a line for
    each class, accuracy, and macro and weighted averages; a handful of rows."""
    rep = named(class_report(pred, label, prediction))
    total = summary(pred, label, prediction)

    def line(name, *cells):
        return F.concat(F.rpad(name, REPORT_WIDTH, " "), *[F.lpad(c, REPORT_WIDTH, " ") for c in cells])

    none = F.lit("")
    per_class = rep.select((F.col("class") + 1).alias("line_no"), line(
        F.coalesce("name", F.col("class").cast("string")), fixed(F.col("precision")), fixed(F.col("recall")),
        fixed(F.col("f1")), F.col("support").cast("string")).alias("line"))
    n = F.col("n").cast("string")
    def row(number, *cells):
        return F.struct(F.lit(number).alias("line_no"), line(*cells).alias("line"))

    averages = [row(1002 + i, F.lit(f"{k} avg"), *[fixed(F.col(f"{m}_{k}")) for m in ("precision", "recall", "f1")], n)
                for i, k in enumerate(("macro", "weighted"))]
    rest = total.select(F.inline(F.array(
        row(0, none, *map(F.lit, ("precision", "recall", "f1-score", "support"))),
        row(1001, F.lit("accuracy"), none, none, fixed(F.col("accuracy")), n), *averages)))
    return per_class.unionByName(rest)
