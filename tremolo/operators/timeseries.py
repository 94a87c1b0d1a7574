"""Silent runs, thinning and trailing blur of time series (key, ts, value).

Runs and blur need the readings in order. All series are cut into ranges of (key, time, value) of a bounded number of
readings, however dense or long a series is: a range is a task's work. What goes over an edge is put together from the
ranges' ends; only one or two rows of a range meet in the order of the whole series. Of readings at one time, the smaller
value comes first, and null before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.sources.shared import written

# Fixed values by severity.
FPS = [24, 15, 8, 4, 2]
BLUR = [
    [1, 0.7, 0.45, 0.3],
    [1, 0.85, 0.7, 0.55, 0.42, 0.32, 0.24, 0.18],
    [1, 0.9, 0.82, 0.74, 0.66, 0.58, 0.50, 0.43, 0.36, 0.30, 0.24, 0.19, 0.15, 0.12],
    [1, 0.96, 0.92, 0.88, 0.84, 0.80, 0.76, 0.72, 0.68, 0.64, 0.60, 0.56, 0.52, 0.48, 0.44, 0.40, 0.36, 0.32],
    [1, 0.97, 0.94, 0.91, 0.88, 0.85, 0.82, 0.79, 0.76, 0.73, 0.70, 0.67, 0.64, 0.61, 0.58, 0.55, 0.52, 0.49, 0.46, 0.43, 0.40, 0.37],
]


#: Readings of a range, and of a block.
READINGS, BLOCK = 1_000_000, 4096


def micros(ts: str = "ts") -> Column:
    """A timestamp (without a zone too) as microseconds; the session's zone should be UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_ranges(df: DataFrame, key: str, readings: int = READINGS) -> DataFrame:
    """key, us, value, slice: the range that a reading is in; ranges follow each other in the order of (key, us, value).

    Ranges are cut by Spark's sample of the rows, for half the stated number on average, and written, which fixes them.
    Only readings that are equal in all three can make a range larger. The table stays until shared.sweep()."""
    rows = df.select(key, micros().alias("us"), "value")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows.count() // readings))
    return written(rows.repartitionByRange(parts, key, "us", "value").withColumn("slice", F.spark_partition_id()), "series")


def silence_runs(df: DataFrame, key: str, below: float, least_us: int, readings: int = READINGS) -> DataFrame:
    """key, start_us, end_us, seconds of maximal runs of readings below a value. A run ends at the next loud reading, or
    at the series' last one; runs shorter than least_us are left out."""
    w = Window.partitionBy(key, "slice").orderBy("us", "value")
    cut = in_ranges(df, key, readings)
    r = cut.withColumn("quiet", F.coalesce(F.col("value") < below, F.lit(False)))
    r = r.withColumns({"turn": (F.col("quiet") != F.lag("quiet").over(w)).cast("int"), "until": F.lead("us").over(w)})
    r = r.withColumn("run", F.sum(F.coalesce("turn", F.lit(0))).over(w))
    runs = r.groupBy(key, "slice", "run", "quiet").agg(F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.max("until").alias("until"), F.max(F.col("until").isNull()).alias("at_end"))
    runs = written(runs.filter("quiet"), "runs")  # once: both those at edges and the others are taken from it
    # one row for each range tells what goes on before and behind it
    slices = cut.groupBy(key, "slice").agg(F.min("us").alias("first_us"))
    along = Window.partitionBy(key).orderBy("slice")
    slices = slices.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), F.lag("slice").over(along).alias("slice_before"), F.lead("first_us").over(along).alias("next_us"))
    runs = runs.join(slices, runs[key].eqNullSafe(slices["_key"]) & runs["slice"].eqNullSafe(slices["_slice"])).drop("_key", "_slice")
    end = F.when(F.col("at_end"), F.coalesce("next_us", "last_us")).otherwise(F.col("until"))
    runs = runs.withColumn("end_us", end).withColumn("edge", (F.col("run") == 0) | F.col("at_end"))
    order = Window.partitionBy(key).orderBy("slice", "run")
    goes_on = (F.col("run") == 0) & F.lag("at_end").over(order) & F.lag("slice").over(order).eqNullSafe(F.col("slice_before"))
    edges = runs.filter("edge").withColumn("new", 1 - F.coalesce(goes_on, F.lit(False)).cast("int"))
    edges = edges.withColumn("chain", F.sum("new").over(order)).groupBy(key, "chain").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    whole = runs.filter("not edge").select(key, "start_us", "end_us").unionByName(edges.select(key, "start_us", "end_us"))
    whole = whole.filter(F.col("end_us") - F.col("start_us") >= least_us)
    return whole.select(key, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds"))


def silence_coverage(df: DataFrame, key: str, below: float, least_us: int) -> DataFrame:
    """key, coverage: the share of a series that is in silent runs; null for a series of no duration."""
    runs = silence_runs(df, key, below, least_us).groupBy(key).agg(F.sum("seconds").alias("quiet_s"))
    whole = df.groupBy(key).agg(((F.max(micros()) - F.min(micros())) / 1e6).alias("all_s"))
    out = whole.join(runs, key, "left")
    return out.select(key, F.when(F.col("all_s") > 0, F.coalesce("quiet_s", F.lit(0.0)) / F.col("all_s")).alias("coverage"))


def fps_drop(df: DataFrame, key: str, bucket_us: int) -> DataFrame:
    """The first reading of each bucket (aligned to the epoch): key, us, value; an aggregation, not a sort."""
    r = df.select(key, micros().alias("us"), "value").withColumn("bucket", F.floor(F.col("us") / bucket_us))
    return r.groupBy(key, "bucket").agg(F.min(F.struct("us", "value")).alias("m")).select(key, "m.us", "m.value")


def fps_bucket(severity: int) -> int:
    return 1_000_000 // FPS[max(1, min(5, severity)) - 1]


def numbered(df: DataFrame, key: str, readings: int = READINGS) -> DataFrame:
    """key, us, value, place: each reading's place in its series, from 0 on; ranges are numbered on their own, behind the
    number of readings before them."""
    r = in_ranges(df, key, readings)
    counts = r.groupBy(F.col(key).alias("_key"), F.col("slice").alias("_slice")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(key, "slice").orderBy("us", "value")
    r = r.withColumn("place", F.row_number().over(within) - 1)
    r = r.join(counts, r[key].eqNullSafe(counts["_key"]) & r["slice"].eqNullSafe(counts["_slice"]))
    return r.select(key, "us", "value", (F.col("place") + F.col("before")).alias("place"))


def motion_blur(df: DataFrame, key: str, severity: int, readings: int = READINGS, block: int = BLOCK) -> DataFrame:
    """key, us, value, blurred: the weighted mean of the last readings, the newest first in the weights; where there are
    fewer readings, or some are null, the weights of the others make up the whole. Readings go in blocks of a number of
    them, each with the last ones of the block before; one sort serves all lags."""
    weights = BLUR[max(1, min(5, severity)) - 1]
    r = numbered(df, key, readings).withColumn("own", F.floor(F.col("place") / block))
    tail = F.col("place") % block > block - len(weights)
    r = r.withColumn("block", F.explode(F.when(tail, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    w = Window.partitionBy(key, "block").orderBy("place").rowsBetween(1 - len(weights), 0)
    r = r.withColumn("back", F.reverse(F.collect_list(F.struct("value")).over(w))).filter("block = own")
    bank = F.array(*[F.lit(float(x)) for x in weights])
    pairs = F.transform("back", lambda v, i: F.struct((v["value"] * F.get(bank, i)).alias("v"), F.when(v["value"].isNotNull(), F.get(bank, i)).alias("w")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(p[f], F.lit(0.0)))
    return r.select(key, "us", "value", F.try_divide(total("v"), total("w")).alias("blurred"))
