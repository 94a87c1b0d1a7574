"""Exact deduplication with an extendible-hash index on shared files.

Every row has an entry (hash, id) in the index. The directory over the entries doubles where a bucket is overfull
(sharding.directory). Each bucket, a range of hashes, belongs to one owner task: it gets the bucket's texts sorted by
hash, chains those whose hashes collide, and compares their bytes. Texts that a task has several times leave it once,
with the smallest id and their number, so that a large group of copies is never together. A row finds its group by the
SHA-256 of its text; an owner that meets two texts with one SHA-256 raises an error, so that what comes out rests on
the comparison of bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import SPACE, join_unique, saved, small_batches, width
from tremolo.llm.sharding import BITS, directory

#: Bytes of text that an owner's bucket holds at most (a single larger text apart), and that a task holds before it
#: hands on what it has combined.
BUCKET_BYTES = 8 << 20
HELD_BYTES = 8 << 20
#: Buckets that an owner task gets, more or less.
BUCKETS = 6
#: Rows of a batch that become Python objects at once.
ROWS = 256


def normalised() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body (the normalised text), sha, h (60 bits of it)."""
    body = docs.select("doc_id", normalised().alias("body")).withColumn("sha", F.sha2("body", 256))
    return body.withColumn("h", F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint"))


def _smaller(a, b):
    """The smaller id; null is larger than any."""
    return b if a is None else a if b is None else min(a, b)


def _chained(chain: list[list], sha: str, body: str, doc, n: int) -> bool:
    """Count a text in the chain of its hash; True if it is a new one there."""
    for entry in chain:
        if entry[1] == body:
            entry[2], entry[3] = _smaller(entry[2], doc), entry[3] + n
            return False
        if entry[0] == sha:
            raise ValueError(f"two texts have the SHA-256 {sha}")
    chain.append([sha, body, doc, n])
    return True


def sliced(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield list(zip(*[part.column(n).to_pylist() for n in names], strict=True))


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows h, sha, body, doc_id, n: those with equal bytes become one, with the smallest id and the sum of n.

    When more than HELD_BYTES are held, texts that came once go out first; those that came again stay, up to half of
    that size, so that a text with very many copies leaves the task about once."""
    held: dict[int, list[list]] = {}
    size = 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["h", "sha", "body", "doc_id", "n"])

    for rows in sliced(batches, "h", "sha", "body", "doc_id", "n"):
        for h, sha, body, doc, n in rows:
            chain = held.setdefault(h, [])
            if _chained(chain, sha, body, doc, n):
                size += len(body)
        if size > HELD_BYTES:
            gone, stay, size = [], {}, 0
            for h, chain in held.items():
                for entry in chain:
                    if entry[3] > 1 and size + len(entry[1]) <= HELD_BYTES // 2:
                        stay.setdefault(h, []).append(entry)
                        size += len(entry[1])
                    else:
                        gone.append((h, *entry))
            held = stay
            yield out(gone)
    yield out([(h, *entry) for h, chain in held.items() for entry in chain])


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's texts, sorted by hash: one row for each different text of a hash's chain, chained in the order of
    first ids. Only one chain is held."""
    at, chain, done = None, [], []

    def close():
        for link, (sha, _, doc, n) in enumerate(sorted(chain, key=lambda e: (e[2] is None, e[2] or 0))):
            done.append((at, link, sha, doc, n))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["h", "link", "sha", "keep_id", "group_size"])

    for rows in sliced(batches, "h", "sha", "body", "doc_id", "n"):
        for h, sha, body, doc, n in rows:
            if h != at:
                close()
                at, chain = h, []
            _chained(chain, sha, body, doc, n)
        if len(done) > 10_000:
            yield out()
            done.clear()
    close()
    yield out()


def groups(docs: DataFrame, entries: DataFrame, bucket_bytes: int) -> DataFrame:
    """One row for each different text: h, link (its place in the hash's chain), sha, keep_id, group_size."""
    # a hash counts once in the directory: an owner gets its text at most once from each task
    sizes = saved(entries.groupBy("h").agg(F.max("n_bytes").alias("n_bytes")), "keys")
    index = saved(directory(sizes, bucket_bytes).select("leaf_bits", "leaf", "shard_id"), "directory")
    owners = max(width(docs.sparkSession), math.ceil(index.select("shard_id").distinct().count() / BUCKETS))
    rows = keyed(docs).select("h", "sha", "body", F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("n"))
    packed = rows.mapInArrow(combine, rows.schema)
    bits = [r["leaf_bits"] for r in index.select("leaf_bits").distinct().orderBy("leaf_bits").collect()]  # one for each round of doubling
    if not bits:  # no rows
        owned = packed.withColumn("shard_id", F.lit("s"))
    elif len(bits) == 1:
        leaf = F.shiftright("h", BITS - bits[0])
        owned = packed.withColumn("leaf", leaf).join(index.select("leaf", "shard_id"), "leaf", "left")
    else:  # the longest entry that covers the hash
        owned = packed
        for b in bits:
            part = index.filter(F.col("leaf_bits") == b).select(F.col("leaf").alias(f"leaf{b}"), F.col("shard_id").alias(f"s{b}"))
            owned = owned.withColumn(f"leaf{b}", F.shiftright("h", BITS - b)).join(part, f"leaf{b}", "left")
        owned = owned.withColumn("shard_id", F.coalesce(*[F.col(f"s{b}") for b in bits]))
    owned = owned.select("shard_id", "h", "sha", "body", "doc_id", "n").repartition(owners, "shard_id").sortWithinPartitions("shard_id", "h")
    return owned.mapInArrow(own, "h long, link int, sha string, keep_id long, group_size long")


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of white space became one space; a null text counts as empty. The
    row with the smallest id stays; a null id counts as larger than any, and rows that repeat an id stay together
    (kept is true for all of them). An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    entries = saved(keyed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "sha", "h", F.octet_length("body").cast("bigint").alias("n_bytes")), "entries")
    found = saved(groups(docs, entries, bucket_bytes).select("sha", "keep_id", "group_size"), "groups")
    out = join_unique(entries, found, "sha", "group_size", entries.count(), "doc_id")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate_sql(table: str = "documents") -> str:
    return f"""
WITH body AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM {table})
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM body WINDOW w AS (PARTITION BY text_sha256)
"""
