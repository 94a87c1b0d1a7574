from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tremolo.operators.predict import with_outcome
from tremolo.schemas import ERRORS, METRICS, PREDICTIONS


def write_predictions(predictions: DataFrame, path: str, batch: str | None = None) -> None:
    """Add predictions to a table, in fixed columns, partitioned by condition (a "=" in it is escaped in the folder's name, and
    restored). A batch is a folder of the table: written again under its name, it replaces what it wrote before, so that
    a job that is run twice adds its rows once. Without a name each call adds a batch. (A table of folders for conditions
    alone, without batches, must be read and written anew.)"""
    predictions.select(*PREDICTIONS.names).write.mode("overwrite").partitionBy("split").parquet(f"{path}/batch={quote(batch or uuid.uuid4().hex, safe='')}")


def write_outcomes(results: DataFrame, path: str, batch: str) -> dict[str, int]:
    """Predictions and errors of a batch_predict in one write, a folder for either, so that the predictor runs once; and how
    many rows were ok, failed, and all, counted on the way. A batch that is written again replaces what it wrote before."""
    seen = Observation()
    rows = with_outcome(results).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={quote(batch, safe='')}")
    n = seen.get
    return {"ok": n["total"] - n["failed"], "failed": n["failed"], "total": n["total"]}


def write_errors(errors: DataFrame, path: str) -> None:
    have = [F.col(c) if c in errors.columns else F.lit(None).cast("string").alias(c) for c in ERRORS.names]
    errors.select(*have).write.mode("append").parquet(path)


def write_corrupted(rows: DataFrame, path: str) -> None:
    """One folder for each modality, corruption and severity. Rows are gathered by these into tasks of the session's
    advisory size, so that a condition has as many files as its size asks for, and not one from each task."""
    parts = ["modality", "corruption", "severity"]
    rows.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A few rows for each condition: one CSV with a header, overwritten."""
    metrics.select(*METRICS.names).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
