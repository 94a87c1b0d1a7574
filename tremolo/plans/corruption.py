from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions.parsing import condition_name, output_paths


def corruption_plan(files: DataFrame, catalog: DataFrame, root: str, severity: int = 3) -> DataFrame:
    """Every file under every corruption of the catalogue at a severity (clamped to 1..5), with its parameters and
    output paths. files: name, path. The catalogue is a few rows, so the rows fan out where they are."""
    level = max(1, min(5, severity))
    some = catalog.filter((F.col("severity") == level) & F.col("modality").isin("A", "V")).dropDuplicates(["modality", "corruption"])
    each = some.select("modality", "corruption", "severity", "params")
    out = files.join(F.broadcast(each))
    out = out.withColumn("condition", condition_name(F.col("modality"), F.col("corruption"), F.col("severity")))
    video, mp4, wav = output_paths(F.col("name"), F.lit(root), F.col("condition"))
    return out.withColumns({"out_path": video, "mp4_path": mp4, "wav_path": wav})


def pending_work(plan: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """The part of a plan whose output does not exist; all of it with overwrite."""
    return plan if overwrite else plan.join(existing.select("out_path"), "out_path", "left_anti")


def ordered_sample(files: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n files by config order, then path: a top-k, never a global window."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    return files.withColumn("split_order", rank).orderBy("split_order", "path").limit(n)
