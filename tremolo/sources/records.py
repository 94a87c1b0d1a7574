"""Quoted CSV with line breaks inside fields, read by many tasks.

A split of a file starts anywhere, perhaps inside a quoted field. Each line is a function of that one bit: does the next
line start inside quotes, if this one does, or does not? Functions compose, so a first pass sums up each split for either
bit; a scan over these summaries, one row for each split, tells with which bit a split starts and how many records came
before; and a second pass cuts the splits into records. No line is shuffled but those of records that go over the edge of
a split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line that starts outside quotes and ends inside: whole fields, then one whose quotes stay open. A quote inside an
#: unquoted field is text, and so is what follows closed quotes up to the comma. Possessive, so that no line is tried twice.
OPEN = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')
#: Records of a batch.
ROWS = 1000


def behind(line: str, inside: bool) -> bool:
    """Does the next line start inside quotes?"""
    if '"' not in line:
        return inside
    return OPEN.match('"' + line if inside else line) is not None


def of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list]]:
    """(tag, file, block), is it the split's first, rows: the rows of a batch that are of one split. Rows of a split follow each
    other, in the order of the file."""
    last = None
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        a = 0
        for b in range(1, len(rows) + 1):
            if b == len(rows) or rows[b][:3] != rows[a][:3]:
                yield rows[a][:3], rows[a][:3] != last, rows[a:b]
                last, a = rows[a][:3], b


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: lines (tag, file, block, value) to a row for each split: the bit behind it and the records that start in it,
    for either bit before it, and whether its first line ends with CR."""
    key, now = None, []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v]) for v in (*key, *now)], names=["tag", "file", "block", "out", "in", "n_out", "n_in", "crlf"])

    for split, first, rows in of_splits(batches):
        if first:
            if key:
                yield out()
            key, now = split, [False, True, 0, 0, rows[0][3].endswith("\r")]
        for *_, line in rows:
            full = line not in ("", "\r")
            for k in (0, 1):
                now[2 + k] += full and not now[k]
            now[0], now[1] = (behind(line, now[0]), behind(line, now[1])) if now[0] != now[1] else (behind(line, now[0]),) * 2
    if key:
        yield out()


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: lines (tag, file, block, value, inside, own, pos) to records, or parts of them (whole is false), without each
    file's first. own: records of the file before the split; pos: records of all files of the tag, without their firsts."""
    done: list[tuple] = []
    key = held = None
    inside = begun = False
    own = pos = 0

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["tag", "file", "block", "pos", "record", "whole"])
        done.clear()
        return batch

    def end(whole: bool) -> None:
        nonlocal held
        if held and own > 1:
            done.append((*key, pos, "\n".join(held), whole and begun))
        held = None

    for split, first, rows in of_splits(batches):
        if first:
            end(False)
            key, inside, own, pos, begun = split, rows[0][4], rows[0][5], rows[0][6] - 1, False
            held = [] if inside else None
        for line in (r[3] for r in rows):
            if not inside:
                if line in ("", "\r"):
                    continue
                held, begun, own, pos = [], True, own + 1, pos + 1
            held.append(line)
            inside = behind(line, inside)
            if not inside:
                end(True)
        while len(done) >= ROWS:
            yield out()
    end(False)
    if done:
        yield out()


def bit_before(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """rows (out, in: the bit behind a row that starts out of quotes, or in them) with a column inside: the bit before the row,
    if the first one starts outside. Rows of one result for both bits forget what was before; those that swap are counted."""
    w = Window.partitionBy(*partition).orderBy(*order)
    swap = (F.col("out") & ~F.col("in")).cast("int")
    rows = rows.withColumn("__swaps", F.sum(swap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("bit"), F.col("__swaps").alias("swaps")))
    rows = rows.withColumn("__fixed", fixed).withColumn("__last", F.last("__fixed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    since = F.col("__swaps") - swap
    odd: Callable[[Column], Column] = lambda n: n % 2 == 1
    return rows.withColumn("inside", F.coalesce(F.col("__last.bit") != odd(since - F.col("__last.swaps")), odd(since))).drop("__swaps", "__fixed", "__last")


def csv_records(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """tag, file, pos, record: each record of the CSV files at each tag's path, without line break at its end. pos counts a tag's
    records over its files in the order of their names, from 0 on; a file's first record, its header, and empty lines are
    left out. In a file whose first line ends with CR LF, CR LF inside quotes is LF, as in Spark's own reader."""
    text = [spark.read.option("lineSep", "\n").text(path).select(F.lit(tag).alias("tag"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value") for tag, path in paths.items()]
    lines = reduce(DataFrame.unionByName, text)
    splits = lines.mapInArrow(summed, "tag string, file string, block long, out boolean, in boolean, n_out long, n_in long, crlf boolean")
    # one row for each split; those of a tag are put in order in one task, with no further shuffle
    splits = bit_before(splits.repartition("tag"), ["tag", "file"], ["block"]).withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    file, tag = Window.partitionBy("tag", "file").orderBy("block"), Window.partitionBy("tag").orderBy("file", "block")
    place = earlier(tag) - F.dense_rank().over(Window.partitionBy("tag").orderBy("file"))
    splits = splits.select("tag", "file", "block", "inside", earlier(file).alias("own"), place.alias("pos"), F.first("crlf").over(file).alias("crlf"))
    named = lines.withColumn("at", F.monotonically_increasing_id()).join(splits.drop("crlf"), ["tag", "file", "block"]).sortWithinPartitions("tag", "file", "block", "at")
    parts = named.select("tag", "file", "block", "value", "inside", "own", "pos").mapInArrow(cut, "tag string, file string, block long, pos long, record string, whole boolean")
    first = splits.filter("crlf").select("tag", "file").distinct().withColumn("crlf", F.lit(True))
    edges = parts.filter("not whole").groupBy("tag", "file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"))
    edges = edges.select("tag", "file", "pos", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    out = parts.filter("whole").select("tag", "file", "pos", "record").unionByName(edges).join(first, ["tag", "file"], "left")
    record = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    return out.select("tag", "file", "pos", F.regexp_replace(record, r"\r\z", "").alias("record"))


def read_records(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """tag, pos and the fields of each record, by position; a field that a record lacks is null."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true"}).alias("__row")
    return csv_records(spark, paths).select("tag", "pos", parsed).select(F.col("tag").alias("_tag"), F.col("pos").alias("_pos"), "__row.*")
