"""Confusion counts, scores, and their comparison with the clean baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions.parsing import parse_condition
from tremolo.schemas import CLASSES, CLEAN

METRICS = ["precision", "recall", "f1", "mcc"]


def prediction_counts(predictions: DataFrame) -> DataFrame:
    """One row for each (split, prediction, label): the only wide shuffle, of partial counts."""
    return predictions.groupBy("split", "prediction", "label").agg(F.count(F.lit(1)).alias("n"))


def confusion_from_counts(counts: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """split, class, TP, FP, FN, TN. Nulls are unequal to every class, so the four add up to the split's rows; every
    class is there for every split, and a null split is a split."""
    each = counts.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    p, a = (F.col(c).eqNullSafe(F.col("class")) for c in ("prediction", "label"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("split", "class").agg(total(p & a).alias("TP"), total(p & ~a).alias("FP"), total(~p & a).alias("FN"), total(~p & ~a).alias("TN"))


def confusion_metrics(predictions: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    return confusion_from_counts(prediction_counts(predictions), classes)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


def score(metric: str) -> Column:
    """A score from the counts, as double throughout (the product under the root is beyond bigint); 0 where the
    denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("TP", "FP", "FN", "TN"))
    if metric == "precision":
        return _ratio(tp, tp + fp)
    if metric == "recall":
        return _ratio(tp, tp + fn)
    if metric == "f1":
        p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        return _ratio(2 * p * r, p + r)
    if metric == "mcc":
        return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")


def scores(metrics: DataFrame, names: list[str] = METRICS) -> DataFrame:
    return metrics.withColumns({m: score(m) for m in names})


def long_scores(scored: DataFrame, names: list[str] = METRICS) -> DataFrame:
    """split, class, metric, score."""
    return scored.unpivot(["split", "class"], names, "metric", "score")


def extract_class(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.filter(F.col("class") == name)


def score_table(scored: DataFrame, metric: str, classes: list[str] = CLASSES) -> DataFrame:
    """One row for each condition, one column for each class."""
    named = scored.withColumn("condition", parse_condition(F.col("split"))["condition"])
    return named.groupBy("condition").pivot("class", classes).agg(F.first(metric))


def compare_to_baseline(scored: DataFrame, metric: str) -> DataFrame:
    """condition, class, score, baseline, delta for every noisy condition. A class without a clean score has none."""
    named = scored.select(parse_condition(F.col("split"))["condition"].alias("condition"), "class", F.col(metric).alias("score"))
    clean = named.filter(F.col("condition") == CLEAN).select("class", F.col("score").alias("baseline"))  # a row for each class
    noisy = named.filter(F.coalesce(F.col("condition") != CLEAN, F.lit(True)))
    return noisy.join(F.broadcast(clean), "class", "left").withColumn("delta", F.col("score") - F.col("baseline"))
