"""Sharding by extendible hashing.

A directory is indexed by the first bits of a document's hash. A bucket whose documents exceed the byte limit is split
on one more bit, and only such a bucket, until every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import hash60, join_unique, running_totals, saved, whole_row, width

BITS = 60
#: Bits of the hash over which prefixes are summed at once.
LEVELS = 8


def climb(leaves: DataFrame, limit: int, floor_bits: int, bits: int) -> DataFrame:
    """leaves: leaf (the first `bits` bits of the hash), b, n. For each leaf the shortest prefix of floor_bits or more
    whose sum fits, if one does: leaf, depth, prefix, shard_bytes, shard_rows.

    Sums go bottom up, LEVELS bits at a time, so that no prefix is summed from more than 2**LEVELS rows; the next round
    is only needed where prefixes still fit at the top of this one."""
    nodes, top, out = leaves.withColumnRenamed("leaf", "node"), bits, None
    while True:
        low = max(floor_bits, top - LEVELS)
        above = nodes.select("node", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("depth"))
        above = above.withColumn("prefix", F.expr(f"shiftright(node, {top} - depth)"))
        sums = saved(above.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")), "sums")
        fit = F.col("shard_bytes") <= limit
        if top == bits:  # what is not told apart by more bits ends here
            fit = fit | ((F.col("depth") == bits) & ((F.col("shard_rows") == 1) | F.lit(bits == BITS)))
        best = above.select("node", "depth", "prefix").join(sums.filter(fit), ["depth", "prefix"])
        best = best.groupBy("node").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("x"))
        best = saved(best.select("node", "x.*"), "best")
        if out is None:
            out = best.withColumnRenamed("node", "leaf")
        else:
            higher = best.select(F.lit(top).alias("depth"), F.col("node").alias("prefix"), F.struct(*[F.col(c).alias(c) for c in best.columns[1:]]).alias("up"))
            met = out.join(higher, ["depth", "prefix"], "left")
            out = met.select("leaf", *[F.coalesce(f"up.{c}", c).alias(c) for c in best.columns[1:]])
        if low == floor_bits or best.filter(F.col("depth") == low).isEmpty():
            return out
        nodes, top = sums.filter(F.col("depth") == low).select(F.col("prefix").alias("node"), F.col("shard_bytes").alias("b"), F.col("shard_rows").alias("n")), low


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """sizes: h (60 bits), n_bytes. Returns the directory: leaf_bits, leaf, depth, shard_id, shard_bytes, shard_rows, more.

    A row's entry is that with leaf = h >> (60 - leaf_bits). Sums of bytes fall with every bit, so a bucket of
    extendible hashing is the shortest prefix of the hash whose sum fits. Rows are summed by leaf once, and prefixes from
    the leaves; leaves that are themselves too large go on with more bits. more marks what no bit can split: rows that
    agree in all 60 bits."""
    whole = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    bits = min(BITS, max(1, math.ceil(math.log2(max(1, whole["s"]) / limit + 1)) + 4))
    rows, floor_bits, found = sizes, 0, None
    while True:
        leaf = F.shiftright("h", BITS - bits)
        leaves = saved(rows.groupBy(leaf.alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "leaves")
        name = F.concat(F.lit("s"), F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END"))
        best = climb(leaves, limit, floor_bits, bits)
        best = best.select(F.lit(bits).alias("leaf_bits"), "leaf", "depth", name.alias("shard_id"), "shard_bytes", "shard_rows", ((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).alias("more"))
        found = best if found is None else found.unionByName(best)
        over = leaves.filter((F.col("b") > limit) & (F.col("n") > 1)).select("leaf")
        if bits == BITS or over.isEmpty():
            return found
        rows = saved(rows.withColumn("leaf", leaf).join(over, "leaf", "left_semi").drop("leaf"), "oversized")
        floor_bits, bits = bits + 1, min(BITS, bits + 6)


def assign(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with h) joined to their entry of the directory."""
    depths = [r["leaf_bits"] for r in found.select("leaf_bits").distinct().orderBy("leaf_bits").collect()]  # one for each round of the loop, at most 10
    left, out = rows, None
    for bits in depths:
        part = found.filter(F.col("leaf_bits") == bits).drop("leaf_bits")
        leaf = F.shiftright("h", BITS - bits)
        hit = left.withColumn("leaf", leaf).join(part, "leaf").drop("leaf")
        out = hit if out is None else out.unionByName(hit)
        if bits != depths[-1]:
            left = left.withColumn("leaf", leaf).join(part.select("leaf"), "leaf", "left_anti").drop("leaf")
    return out


def in_runs(hot: DataFrame, limit: int) -> DataFrame:
    """hot: rows of the directory's entries marked more, with h, doc_id and n_bytes. The rows of one hash are cut into
    runs by running totals, each a shard named by a suffix. Written, so that a row has one shard wherever it is read."""
    most = saved(hot.groupBy("h").agg(F.max("n_bytes").alias("most"), F.count(F.lit(1)).alias("n")), "most")
    total = most.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # rows that agree in id and size are told apart by their place, so that ranges can part them
    tied = hot.withColumn("tie", F.monotonically_increasing_id())
    runs = running_totals(tied, [F.col("h"), F.col("doc_id"), F.col("n_bytes"), F.col("tie")], {"upto": "n_bytes"}, width(hot.sparkSession))
    step = F.greatest(F.lit(1), F.when(2 * F.col("most") <= limit, limit - F.col("most")).otherwise(1))
    runs = join_unique(runs, most, "h", "n", total, "tie").drop("tie").withColumn("run", F.floor((F.col("upto") - F.col("n_bytes")) / step))
    return saved(runs.withColumn("shard_id", F.concat("shard_id", F.lit("-"), F.col("run").cast("string"))), "runs")


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return docs.select("doc_id", hash60(F.col("doc_id")).alias("h"), size.alias("n_bytes"))


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """Returns for each row of docs: doc_id, n_bytes, shard_id ("s" and the bucket's bits), depth, shard_bytes,
    shard_rows and oversized.

    Every shard's bytes are within the limit, but for a document that is above it on its own: that one has a shard to
    itself, marked oversized. Rows with one id have one hash, which no bit can split: if together they exceed the
    limit, they are cut into runs by running totals, named by a suffix. A null text has no bytes; a null id hashes as
    the empty text. An empty table gives an empty table."""
    base = saved(sized(docs), "sized")
    if base.isEmpty():
        return base.select("doc_id", "n_bytes", F.lit("s").alias("shard_id"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("shard_bytes"), F.lit(0).cast("bigint").alias("shard_rows"), F.lit(False).alias("oversized"))
    found = saved(directory(base.select("h", "n_bytes"), limit), "directory")
    out = saved(assign(base, found), "assigned")
    plain = out.filter("not more").select("doc_id", "n_bytes", "shard_id", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))
    hot = out.filter("more")
    if hot.isEmpty():
        return plain
    runs = in_runs(hot, limit)
    fill = runs.groupBy("shard_id").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    runs = runs.drop("shard_bytes", "shard_rows").join(fill, "shard_id")
    return plain.unionByName(runs.select("doc_id", "n_bytes", "shard_id", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized")))


def shard_documents(docs: DataFrame, limit: int) -> DataFrame:
    """The documents with shard_id, in place of a column of that name, row by row as in shard(): rows that repeat an id stay together where they fit the
    limit, and are cut into runs where they don't. Only the latter's texts are sorted."""
    rows = docs.drop("shard_id")
    base = saved(sized(docs), "sized")
    if base.isEmpty():
        return rows.withColumn("shard_id", F.lit("s"))
    found = saved(directory(base.select("h", "n_bytes"), limit), "directory")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    packed = rows.select("doc_id", hash60(F.col("doc_id")).alias("h"), size.alias("n_bytes"), whole_row(rows))
    out = assign(packed, found)
    plain = out.filter("not more").select("row.*", "shard_id")
    if found.filter("more").isEmpty():
        return plain
    return plain.unionByName(in_runs(out.filter("more"), limit).select("row.*", "shard_id"))


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Write each shard to a folder of its own under path; one task writes a shard, which the limit bounds."""
    out = shard_documents(docs, limit)
    out.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def shard_sql(limit: int, table: str = "documents") -> str:
    """The same in DuckDB's SQL where no two rows share an id."""
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {table}),
up AS (
  SELECT doc_id, n_bytes, h, d.depth::INTEGER AS depth, h >> ({BITS} - d.depth) AS prefix
  FROM sized, (SELECT unnest(range(0, 41)) AS depth) d),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM up GROUP BY ALL),
best AS (
  SELECT u.doc_id, u.n_bytes, u.depth, u.prefix, s.shard_bytes, s.shard_rows,
         row_number() OVER (PARTITION BY u.doc_id ORDER BY u.depth) AS r
  FROM up u JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {limit})
SELECT doc_id, n_bytes, 's' || CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard_id,
       depth, shard_bytes, shard_rows, false AS oversized
FROM best WHERE r = 1
"""
