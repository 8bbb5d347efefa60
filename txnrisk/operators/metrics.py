"""Classifier evaluation (A10–A13) and global renumbering (L4).

Curve metrics need cumulative counts in score order. A window without a
partition would pull every row into one task, so instead rows collapse to one
row per distinct score (partial aggregation), those are cut into ranges of the
score by rows, and the ranges' totals (one row per range) give each range's
offset; a window partitioned by range gives the rest.

Counts stay integers until the final division, so ROC AUC is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.operators.ranking import in_ranges, range_starts


def score_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score, descending thresholds: ``threshold, pos, neg,
    tp, fp, prev_tp, prev_fp, P, N`` (tp/fp = counts with score ≥ threshold)."""
    t = (scored.filter(F.col(score).isNotNull())
         .groupBy(F.col(score).alias("threshold"))
         .agg(F.sum((F.col(label) == 1).cast(T.LongType())).alias("pos"),
              F.sum((F.col(label) != 1).cast(T.LongType())).alias("neg")))
    t = in_ranges(t, [F.col("threshold").desc()], "_part", "_local").drop("_local")
    starts = range_starts(t, "_part", {"pos": F.sum("pos"), "neg": F.sum("neg")})
    t = t.join(F.broadcast(starts), "_part")     # one row per range
    run = Window.partitionBy("_part").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"tp": F.col("pos_before") + F.sum("pos").over(run), "fp": F.col("neg_before") + F.sum("neg").over(run)})
    return t.select(
        "threshold", "pos", "neg", "tp", "fp",
        (F.col("tp") - F.col("pos")).alias("prev_tp"),
        (F.col("fp") - F.col("neg")).alias("prev_fp"),
        F.col("pos_all").alias("P"), F.col("neg_all").alias("N"),
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC with tied scores counted half (Mann–Whitney). One row;
    NULL when a class is absent (AUC undefined)."""
    pts = score_points(scored, label, score)
    # the factors are decimals, so that their product can't overflow a BIGINT
    neg, ranked = F.col("neg").cast(T.DecimalType(19, 0)), (F.col("prev_tp") * 2 + F.col("pos")).cast(T.DecimalType(19, 0))
    num = F.sum((neg * ranked).cast(T.DecimalType(38, 0)))
    agg = pts.agg(num.alias("_num"), F.max("P").alias("_P"), F.max("N").alias("_N"))
    den = F.col("_P").cast(T.DoubleType()) * F.col("_N").cast(T.DoubleType()) * F.lit(2.0)
    return agg.select(
        F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_num").cast(T.DoubleType()) / den)
        .alias("roc_auc"))


def _precision(tp, fp):
    return F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp.cast(T.DoubleType()) / (tp + fp).cast(T.DoubleType()))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct threshold, and the curve's
    end point (recall 0, precision 1), which has no threshold."""
    pts = score_points(scored, label, score).select(
        "threshold",
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P")).alias("recall"),
    )
    end = scored.sparkSession.range(1).select(F.lit(None).cast(pts.schema["threshold"].dataType).alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.union(end)


def pr_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoid area under the precision–recall curve, which starts at
    (recall 0, precision 1) and visits every distinct threshold."""
    pts = score_points(scored, label, score)
    P = F.col("P").cast(T.DoubleType())
    r, r0 = F.col("tp") / P, F.col("prev_tp") / P
    p, p0 = _precision(F.col("tp"), F.col("fp")), _precision(F.col("prev_tp"), F.col("prev_fp"))
    area = F.sum((r - r0) * (p + p0) / F.lit(2.0))
    return pts.agg(F.when(F.max("P") > 0, area).alias("pr_auc"))


def _row(name, p, r, f, s):
    return F.struct(F.lit(name).alias("class"), p.cast(T.DoubleType()).alias("precision"),
                    r.cast(T.DoubleType()).alias("recall"), f.cast(T.DoubleType()).alias("f1_score"),
                    s.cast(T.LongType()).alias("support"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A10: per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages (0 where a denominator is 0), as rows keyed by ``class``."""
    y = F.col(label).cast(T.IntegerType())
    yhat = F.col(prediction).cast(T.IntegerType())
    c = pred.agg(
        F.sum(((y == 1) & (yhat == 1)).cast(T.LongType())).alias("tp1"),
        F.sum(((y == 0) & (yhat == 1)).cast(T.LongType())).alias("fp1"),
        F.sum(((y == 1) & (yhat == 0)).cast(T.LongType())).alias("fn1"),
        F.sum(((y == 0) & (yhat == 0)).cast(T.LongType())).alias("tp0"),
    ).na.fill(0)

    def div(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast(T.DoubleType()) / b.cast(T.DoubleType()))

    def f1(p, r):
        return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))

    tp1, fp1, fn1, tp0 = (F.col(x) for x in ("tp1", "fp1", "fn1", "tp0"))
    s1, s0 = tp1 + fn1, tp0 + fp1
    p1, r1 = div(tp1, tp1 + fp1), div(tp1, s1)
    p0, r0 = div(tp0, tp0 + fn1), div(tp0, s0)
    base = c.select(p0.alias("p0"), r0.alias("r0"), p1.alias("p1"), r1.alias("r1"),
                    s0.alias("s0"), s1.alias("s1"), (tp0 + tp1).alias("ok"))
    base = base.withColumns({"f0": f1(F.col("p0"), F.col("r0")), "f1": f1(F.col("p1"), F.col("r1"))})
    n = F.col("s0") + F.col("s1")

    def wavg(a, b):
        return F.when(n == 0, F.lit(0.0)).otherwise((F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / n)

    acc = div(F.col("ok"), n)
    rows = F.array(
        _row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        _row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        _row("accuracy", F.lit(None).cast(T.DoubleType()), F.lit(None).cast(T.DoubleType()), acc, n),
        _row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
             (F.col("f0") + F.col("f1")) / 2, n),
        _row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), n),
    )
    return base.select(F.inline(rows))


def renumber_by(df: DataFrame, order_col: str, tiebreak: str, out: str = "row_number") -> DataFrame:
    """L4: 0-based position of each row in ``(order_col, tiebreak)`` order.

    Rows are cut into ranges of both columns together, so a hot timestamp is
    spread by its tiebreak; a row's number is its place in its range plus the
    rows of the ranges before.
    """
    x = in_ranges(df, [F.col(order_col), F.col(tiebreak)], "_part", "_local")
    starts = range_starts(x, "_part", {"n": F.count("*")}).drop("n_all")
    return x.join(F.broadcast(starts), "_part").withColumn(out, F.col("n_before") + F.col("_local")).drop("_part", "_local", "n_before")
