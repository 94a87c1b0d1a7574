"""Running confusion metrics over prediction files as they arrive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators.evaluate import confusion_from_counts, prediction_counts
from tremolo.schemas import CLASSES, METRICS, PREDICTIONS
from tremolo.sources.shared import exists, names_in, remove

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_confusion(spark: SparkSession, source: str, target: str, checkpoint: str, classes: list[str] = CLASSES, files_per_trigger: int | None = None, within: str = "30 days") -> list[dict]:
    """Take in what has arrived in `source` (Parquet predictions) and publish the metrics of all so far in `target`, where
    read_running finds them. Returns the batches' progress reports.

    A prediction counts once for each (split, file), however often it arrives within the time that `within` states, by
    the clock of the batches; later it counts again. So the state is bounded by what arrives in that time, and lies in
    RocksDB, outside the heap; that of the counts is one row for each (split, prediction, label). With the checkpoint, a
    restart goes on where the last run ended."""
    own = spark.newSession()  # with settings of its own
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    reader = own.readStream.schema(PREDICTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    arrived = reader.parquet(source).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", within)
    once = arrived.dropDuplicatesWithinWatermark(["split", "file"])
    query = prediction_counts(once).writeStream.outputMode("complete").foreachBatch(lambda counts, batch: publish(confusion_from_counts(counts, classes), target, batch))
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [dict(x) for x in query.recentProgress]


def publish(metrics: DataFrame, target: str, batch: int) -> None:
    """Write a batch's metrics to a folder of its own, and then delete those of earlier batches but the last before, which a
    reader may just be reading: a crash at any point leaves one complete folder at least. A batch that comes again after
    it was completed is run for its state, but not written again."""
    spark, path = metrics.sparkSession, f"{target}/batch={batch}"
    if exists(spark, f"{path}/_SUCCESS"):
        metrics.write.format("noop").mode("overwrite").save()
    else:
        metrics.write.mode("overwrite").parquet(path)
    for old in [b for b in batches_in(spark, target) if b < batch][:-1]:
        remove(spark, f"{target}/batch={old}")


def batches_in(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(m[1]) for name in names_in(spark, target) if (m := re.fullmatch(r"batch=(\d+)", name)))


def read_running(spark: SparkSession, target: str) -> DataFrame:
    """The metrics of the last complete batch; no rows before the first."""
    done = [b for b in batches_in(spark, target) if exists(spark, f"{target}/batch={b}/_SUCCESS")]
    return spark.read.schema(METRICS).parquet(f"{target}/batch={done[-1]}") if done else spark.createDataFrame([], METRICS)
