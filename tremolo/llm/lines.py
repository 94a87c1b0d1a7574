"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; keys found in many documents are
boilerplate and lose all their lines.

1. Each document's distinct keys become 128-bit hashes, once; what follows reads these, not the texts.
2. Documents come in batches. A batch's hashes, with the number of its documents that hold them, are merge-anti-joined
   with the runs: what a run already knows to be frequent needs no more counting. The rest is the batch's own run, a
   table bucketed and sorted by hash. Two runs of one level are compacted into one of the next: a merge join of
   sorted buckets, without a shuffle.
3. The last run's frequent hashes go back to the documents that hold them, and these drop the lines.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import delete, join_unique, saved, small_batches, whole_row, width
from tremolo.sources.shared import shared_dir

BLANK = b" \t\n\x0b\x0c\r"
#: Hashes that a task counts before it hands them on.
HELD = 500_000


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def code_points(key: bytes) -> int:
    return sum(b & 0xC0 != 0x80 for b in key)


def counts_for(key: bytes, min_chars: int) -> bool:
    """Is the key long enough? Keys of fewer code points are never dropped."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or code_points(key) >= min_chars)


def hash_of(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def hashed(min_chars: int):
    """UDF: the hashes of a text's distinct keys."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                out.append([hash_of(k) for k in dict.fromkeys(map(line_key, lines)) if counts_for(k, min_chars)])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.BinaryType()))


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of hashes to (h, n), counted within a task before the shuffle."""
    schema = pa.schema([("h", pa.binary()), ("n", pa.int64())])
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)
        held.clear()
        return batch

    for batch in batches:
        held.update(batch.column(0).flatten().to_pylist())
        if len(held) >= HELD:
            yield out()
    yield out()


class Runs:
    """Runs (h, n) by level: n documents, or more, hold the key of hash h. A run is a table in the shared folder, bucketed and
    sorted by hash, so that runs are joined bucket by bucket.

    least: documents from which on a key is frequent. Counting ends there: of a frequent key n may be less than the
    number of documents, but never less than `least`."""

    def __init__(self, spark: SparkSession, least: int, buckets: int | None = None):
        self.spark, self.least, self.buckets = spark, least, buckets or width(spark)
        self.levels: list[str | None] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"tremolo_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, self.paths.pop(name))

    def _merged(self, a: str, b: str) -> str:
        x, y = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m").hint("merge")
        return self._write(x.join(y, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))

    def add(self, batch: DataFrame) -> None:
        """batch: h, n, counted in parts. It must not hold documents that were added before."""
        new = batch.repartition(self.buckets, "h").groupBy("h").agg(F.sum("n").alias("n"))
        for run in filter(None, self.levels):
            known = self.spark.table(run).filter(F.col("n") >= self.least).select("h").hint("merge")
            new = new.join(known, "h", "left_anti")
        self._settle(self._write(new))

    def _settle(self, run: str) -> None:
        """Put a run in the lowest level; where one is there, both become one of the next level, and so on."""
        level = 0
        while level < len(self.levels) and self.levels[level]:
            both = (self.levels[level], run)
            run, self.levels[level] = self._merged(*both), None
            self._drop(*both)
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def frequent(self) -> DataFrame:
        """h, n of the keys that are in `least` documents or more; what is in several levels is merged first."""
        left = [run for run in self.levels if run]
        while len(left) > 1:
            both, left = left[:2], left[2:]
            left = [self._merged(*both), *left]
            self._drop(*both)
        self.levels = left
        return self.spark.table(left[0]).filter(F.col("n") >= self.least)

    def close(self) -> None:
        self._drop(*list(self.paths))


def dropped(text: str | None, found: set[bytes]) -> tuple[str, int, int]:
    """What is left of a text, its lines, and how many are dropped."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    kept = [line for line in lines if hash_of(line_key(line)) not in found] if found else lines
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


DROPPED = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


@F.pandas_udf(DROPPED)
def drop_found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, found in batches:
        rows = [dropped(t, set() if f is None else set(f)) for t, f in zip(texts, found, strict=True)]
        yield pd.DataFrame(rows, columns=DROPPED.names)


def scan(docs: DataFrame, least: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """row (all columns of docs), lines: struct kept (the text that is left), n_lines, n_dropped.

    Each row is a document, rows that repeat an id or a text too; a null or empty text is one empty line, whose key is
    empty and stays. Lines end at a line feed only. Equal hashes of 128 bits count as equal keys. An empty table gives an
    empty table. `batches` says in how many parts the documents are added to the runs; it changes no result."""
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select("doc_id", F.xxhash64("text").alias("th"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), hashed(min_chars)("text").alias("hs"))
    log = saved(body, "line-hashes", by="batch")
    runs = Runs(spark, least)
    for b in range(batches):
        part = log.filter(F.col("batch") == b).select("hs")
        runs.add(part.mapInArrow(combined, "h binary, n long"))
    frequent = saved(runs.frequent(), "frequent")
    runs.close()
    held = log.select("doc_id", "th", F.explode("hs").alias("h"))
    total = log.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0)).alias("n")).first()["n"]
    # distinct rows: those that repeat an id and a text are alike; a document's keys are bounded by its text
    found = join_unique(held, frequent, "h", "n", total, "th").groupBy("doc_id", "th").agg(F.collect_set("h").alias("found"))
    found = saved(found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "found"), "found")
    packed = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__t"), whole_row(docs))
    # both sides are shuffled and sorted whatever their sizes: the plan is the same for few documents and for many
    named = packed.join(found.hint("merge"), packed["__doc"].eqNullSafe(found["__id"]) & (packed["__t"] == found["__th"]), "left")
    return named.select("row", drop_found("row.text", "found").alias("lines"))


def report(docs: DataFrame, least: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = scan(docs.select("doc_id", "text"), least, min_chars, batches)
    return out.select("row.doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, least: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """docs with the lines dropped; documents that lose none stay as they are, a null text too, and n_chars, where there
    is one, follows the text."""
    out = scan(docs, least, min_chars, batches)
    some = F.col("lines.n_dropped") > 0
    fields = {c: F.col("row")[c] for c in docs.columns} | {"text": F.when(some, F.col("lines.kept")).otherwise(F.col("row.text"))}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(some, F.length("lines.kept").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*[v.alias(k) for k, v in fields.items()])


def report_sql(least: int = 10, min_chars: int = 1) -> str:
    """The same in DuckDB's SQL: one row for each line, counted by key."""
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, i, l[CAST(i AS BIGINT)] AS line
  FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, string_split(text, chr(10)) AS l FROM numbered))),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT r) >= {least}),
kept AS (
  SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM keyed LEFT JOIN frequent f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM numbered JOIN kept USING (r)
"""
