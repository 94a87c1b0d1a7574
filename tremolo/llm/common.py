"""Shared pieces of the training-data operators: the shared folder, tables written to it, joins on skewed keys and
distributed running totals."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo.sources.shared import shared_dir

#: White space as the operators' contracts have it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scopes(threading.local):
    """Paths that saved() wrote in this thread, by scope; settled() opens and closes one."""

    def __init__(self):
        self.open: list[list[str]] = []


class Cleanup:
    """The session's setting that a query's shuffle files go when it is done, while saved() writes; as before when the last
    of several threads has written."""

    def __init__(self):
        self.lock, self.users, self.before = threading.Lock(), {}, {}

    def begin(self, spark: SparkSession) -> None:
        key = str(spark._jsparkSession.hashCode())
        with self.lock:
            if not self.users.get(key):
                self.before[key] = spark.conf.get(CLEANUP, "false")
                spark.conf.set(CLEANUP, "true")
            self.users[key] = self.users.get(key, 0) + 1

    def end(self, spark: SparkSession) -> None:
        key = str(spark._jsparkSession.hashCode())
        with self.lock:
            self.users[key] -= 1
            if not self.users[key]:
                spark.conf.set(CLEANUP, self.before.pop(key))


SCOPES, WRITES = Scopes(), Cleanup()


def saved(df: DataFrame, name: str, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor then costs only reading again. The write's own
    shuffle files go when it is done; the session's setting for that is as before then.
    by: a column whose values are folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremolo-{name}-{uuid.uuid4().hex}"
    WRITES.begin(spark)
    try:
        df.write.option("compression", compression).parquet(path, partitionBy=by)
    finally:
        WRITES.end(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    if SCOPES.open:
        SCOPES.open[-1].append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that saved() wrote. Nothing that is not yet written itself may depend on them."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("saved_path")
        if path:
            delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """saved(make()); what make() saved on its way is deleted."""
    SCOPES.open.append([])
    try:
        out = saved(make(), name)
    finally:
        paths = SCOPES.open.pop()
    for path in paths:
        if path != out.saved_path:
            delete(out.sparkSession, path)
    if SCOPES.open:
        SCOPES.open[-1].append(out.saved_path)
    return out


def sliced_arrow(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts become Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows go to a Python worker at once, for what the session runs from here on; a smaller setting of
    its own stands. Texts can be long, results are lazy, and Spark has no setting for a single query: with its 10,000
    rows, executors that ran several operators after each other came to exceed their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: What a worker process keeps from task to task (models, counters), for one operator at a time.
BUILT: dict = {}


def release() -> None:
    """Free what this worker keeps for an earlier operator. (As a function of the module, it is the worker's own.)"""
    BUILT.clear()


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def held_out(modulus: int, remainder: int) -> Column:
    """True for documents of the hold-out fold: crc32 of the id as text, taken by the modulus. A null id counts as
    the empty text."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return crc % modulus == remainder


def hash60(*parts: Column) -> Column:
    """60 bits of an MD5, as a non-negative bigint; DuckDB computes the same from the same text."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


#: A key with over 1/PIECES of the rows is dealt out in pieces of about that size.
PIECES = 2000


def join_unique(rows: DataFrame, by_key: DataFrame, key: str, count: str, total: int, spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined to by_key, which has one row for each key. counts, or by_key itself, says how many of all rows have a
    key; it should be a written table, as it is read more than once. No hot key meets in one task: keys with over 1/2000
    of the total are 2000 at most, and a broadcast of these tells in how many pieces their rows are dealt, by a hash of
    `spread`; by_key's row is there for each piece."""
    hot = (by_key if counts is None else counts).filter(F.col(count) * PIECES > total)
    hot = F.broadcast(hot.select(key, F.ceil(F.col(count) * PIECES / total).cast("int").alias("__pieces")))
    piece = F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__pieces"))).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__piece", piece).drop("__pieces")
    each = by_key.join(hot, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)))
    return dealt.join(each.drop("__pieces"), [key, "__piece"], how).drop("__piece")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int) -> DataFrame:
    """Adds, for each new column name -> existing column, the inclusive running total in the given order.

    Rows are range-partitioned and written, which fixes the ranges; each range is summed on its own, and a window over
    one row per range gives the offsets. No task sees more than one range."""
    cut = saved(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    offsets = offsets.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    out = cut.join(F.broadcast(offsets), "__range")
    out = out.withColumns({n: F.sum(c).over(within) + F.col(f"__o_{n}") for n, c in sums.items()})
    return out.drop("__range", *[f"__o_{n}" for n in sums])


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
