"""Stacking prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators.evaluate import confusion_metrics
from tremolo.schemas import PREDICTIONS

SPLIT_NAMES = {"train": "train_split", "dev": "dev_splits_complete", "test": "output_repeated_splits_test"}


def merge_labeled(spark: SparkSession, tables: list[tuple[DataFrame, str]], label: str = "source") -> DataFrame:
    """The tables one after the other, each with its label as a constant column (which replaces one of that name);
    columns that a table lacks are null. No tables give an empty table."""
    if not tables:
        return spark.createDataFrame([], PREDICTIONS).withColumn(label, F.lit(None).cast("string"))
    named = [df.withColumn(label, F.lit(name)) for df, name in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def merge_splits(spark: SparkSession, train: DataFrame, dev: DataFrame, test: DataFrame) -> DataFrame:
    """Predictions of the three splits, with split overwritten by the split's full name."""
    return merge_labeled(spark, [(train, SPLIT_NAMES["train"]), (dev, SPLIT_NAMES["dev"]), (test, SPLIT_NAMES["test"])], "split")


def combine_runs(clean: DataFrame, *noisy: DataFrame) -> DataFrame:
    """Confusion metrics over one or two noisy runs and the clean one."""
    return confusion_metrics(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), noisy, clean))
