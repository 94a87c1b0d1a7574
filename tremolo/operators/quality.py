"""Audio checks and accounting of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions.parsing import parse_probe, silence_flag


def probe(files: DataFrame) -> DataFrame:
    """Measurements of each file from the columns streams_json, volume_log, silence_log, avg_frame_rate, duration."""
    return files.withColumns(parse_probe(*[F.col(c) for c in ("streams_json", "volume_log", "silence_log", "avg_frame_rate", "duration")]))


def audio_report(probed: DataFrame) -> DataFrame:
    """file, reason, mean_db, max_db, silence_coverage of the files that are to be reported. Coverage is null without a
    duration; measurements stand only where the audio was judged silent."""
    coverage = F.when(F.col("duration") > 0, F.col("silence_seconds") / F.col("duration"))
    rows = probed.withColumn("silence_coverage", coverage)
    rows = rows.withColumn("reason", silence_flag(F.col("probe_error"), F.col("n_streams"), F.col("mean_db"), F.col("max_db"), F.col("silence_coverage"))).filter("reason is not null")
    measured = lambda c: F.when(F.col("reason") == "silent", F.col(c)).alias(c)
    return rows.select("file", "reason", measured("mean_db"), measured("max_db"), measured("silence_coverage"))


def job_accounting(plan: DataFrame, existing: DataFrame, errors: DataFrame) -> DataFrame:
    """condition, ok, skipped, failed, total of a plan (condition, out_path). An output that existed is skipped; else a
    path in the error table failed; else it is ok."""
    had = existing.select("out_path").distinct().withColumn("_had", F.lit(True))
    bad = errors.select("out_path").distinct().withColumn("_bad", F.lit(True))
    rows = plan.join(had, "out_path", "left").join(bad, "out_path", "left")
    status = F.when(F.col("_had"), "skipped").when(F.col("_bad"), "failed").otherwise("ok")
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.withColumn("status", status).groupBy("condition").agg(of("ok"), of("skipped"), of("failed"), F.count(F.lit(1)).alias("total"))
