"""The prefix trie of conversations.

1. Turns are numbered in ranges of (conversation, turn), so that one conversation may be many tasks. A prefix's digest is
   the xor of 128-bit hashes of its (position, role, text): a running xor, which goes over the edges of ranges by one row
   for each range.
2. A count-min sketch counts the digests of all prefixes. An estimate of one proves a prefix to be in one conversation
   only: such tails are emitted where they stand, as all that their nodes need is in their row. What remains, the
   possibly shared prefixes, is shuffled and grouped exactly; prefixes that the sketch only took for shared come out
   right there too.
3. Sums over subtrees need no walk: what a node adds counts for its smallest member. The sum over a subtree is that of
   its members' totals, less what the smallest member has above the node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import WORD, discard, join_unique, running_totals, saved, settled, width

#: A conversation takes the first turns, HEAD at most, of the one whose id is the next multiple of EVERY.
EVERY, HEAD = 20, 3
#: Counters in each of a sketch's two rows: 2**BITS; those of a segment are put together at once.
BITS, SEGMENT = 25, 1 << 16
#: Characters of ids that go on together to be hashed.
CHUNK = 1 << 16


def zero() -> Column:
    return F.lit(0).cast("long")


def digest(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def turn_hash(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """128 bits for a turn at a position."""
    return F.xxhash64(place.cast("long"), a, b), F.xxhash64(b, F.lit(1), a, place.cast("long"))


def before(ends: DataFrame, values: dict[str, str]) -> DataFrame:
    """What a conversation has in earlier ranges: conv_id, range, before_<name> for each aggregate function by name.

    Ranges follow each other in the order of conversations, so that a range has one conversation at most that began in an
    earlier one: the rows to broadcast are fewer than the ranges."""
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    out = ends.select("conv_id", "range", *[F.expr(f"{how}({name})").over(earlier).alias(f"before_{name}") for name, how in values.items()])
    return F.broadcast(out.filter(F.col(f"before_{next(iter(values))}").isNotNull()))


def numbered(conversations: DataFrame, parts: int) -> DataFrame:
    """conv_id, place (from 1 on), range, a, b (hashes of role and text), words; written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text("role"), text("text"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    slim = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    # the number of a row tells its range and its place there
    cut = saved(dealt.select("conv_id", *slim, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "turns")
    within = Window.partitionBy("range", "conv_id").orderBy("at")
    ends = cut.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    rows = cut.withColumn("local", F.row_number().over(within)).join(before(ends, {"n": "sum"}), ["conv_id", "range"], "left")
    place = (F.col("local") + F.coalesce("before_n", F.lit(0))).cast("long")
    out = saved(rows.select("conv_id", place.alias("place"), "range", "a", "b", "words"), "places")
    discard(cut)
    return out


def heads(turns: DataFrame, rebuild: bool) -> DataFrame:
    """One row for each conversation, written: conv_id, n (turns of its own), h (of these, those that are replaced), head
    (what replaces them: digest before and at each depth, words), k (its size), length, hx, hy (its digest)."""
    taken = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int") if rebuild else F.lit(0)
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    first = turns.filter((F.col("conv_id") % EVERY == 0) & (F.col("place") <= HEAD))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "words"))).alias("first"))
    rows = convs.join(first, "base", "left").withColumn("k", F.least("h", F.coalesce(F.array_size("first"), F.lit(0))))
    x, y, head = zero(), zero(), []
    for i in range(HEAD):
        t = F.get("first", F.lit(i))
        gx, gy = turn_hash(F.lit(i + 1), t["a"], t["b"])
        above, x, y = digest(x, y), x.bitwiseXOR(gx), y.bitwiseXOR(gy)
        head.append(F.struct(digest(x, y).alias("node"), above.alias("parent"), t["words"].alias("words")))
    rows = rows.withColumn("head", F.slice(F.array(*head), F.lit(1), F.col("k")))
    last = F.get("head", F.col("k") - 1)["node"]
    length = (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long")
    return saved(rows.select("conv_id", "n", "h", "k", "head", length.alias("length"), F.coalesce(last["x"], zero()).alias("hx"), F.coalesce(last["y"], zero()).alias("hy")), "heads")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation but the empty one, written: conv_id, depth, node and parent (digests),
    words (of the last turn), ended (is it the whole conversation?)."""
    own = join_unique(turns, convs.drop("head"), "conv_id", "n", turns.count(), "place").filter(F.col("place") > F.col("h"))
    own = own.withColumn("depth", F.col("place") - F.col("h") + F.col("k"))
    gx, gy = turn_hash(F.col("depth"), F.col("a"), F.col("b"))
    own = saved(own.select("conv_id", "range", "depth", "words", "length", "hx", "hy", gx.alias("gx"), gy.alias("gy")), "placed")
    so_far = Window.partitionBy("range", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ends = own.groupBy("conv_id", "range").agg(F.bit_xor("gx").alias("gx"), F.bit_xor("gy").alias("gy"))
    rows = own.withColumns({"sx": F.bit_xor("gx").over(so_far), "sy": F.bit_xor("gy").over(so_far)})
    rows = rows.join(before(ends, {"gx": "bit_xor", "gy": "bit_xor"}), ["conv_id", "range"], "left")
    x, y = (F.col(f"h{c}").bitwiseXOR(F.coalesce(f"before_g{c}", zero())).bitwiseXOR(F.col(f"s{c}")) for c in "xy")
    above = digest(x.bitwiseXOR(F.col("gx")), y.bitwiseXOR(F.col("gy")))
    ended = (F.col("depth") == F.col("length")).alias("ended")
    rows = rows.select("conv_id", "depth", digest(x, y).alias("node"), above.alias("parent"), "words", ended)
    taken = convs.select("conv_id", "length", F.posexplode("head").alias("at", "t")).withColumn("depth", (F.col("at") + 1).cast("long"))
    rows = rows.unionByName(taken.select("conv_id", "depth", "t.node", "t.parent", "t.words", ended))
    out = saved(rows, "prefixes")
    discard(own)
    return out


# ---- the sketch


def counters(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """The counters of digests: one in each row; the second row stands behind the first."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack((x.view(np.uint64) & mask, (y.view(np.uint64) & mask) + np.uint64(1 << bits))).astype(np.int64)


def counting(bits: int):
    """mapInArrow: digests (x, y) to a task's own sketch (segment, counts), with counts up to two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 << bits, np.uint8)
        touched = np.zeros(max(1, len(counts) // SEGMENT), bool)
        for batch in batches:
            at, n = np.unique(counters(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
            touched[at // SEGMENT] = True
        for s in np.flatnonzero(touched):
            packed = zlib.compress(counts[s * SEGMENT : (s + 1) * SEGMENT].tobytes(), 1)
            yield pa.record_batch([pa.array([int(s)], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "counts"])

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the tasks' counts of some segments, one after the other, to a bit for each counter: is it two or more?"""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), np.uint8)
            sums[s] = np.minimum(sums[s] + counts, 2) if s in sums else counts
    for s, counts in sums.items():
        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["segment", "bits"])


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """A bit for each counter: 2**bits / 4 bytes, whatever the number of rows. The segments come to the driver."""
    parts = rows.select("node.x", "node.y").mapInArrow(counting(bits), "segment int, counts binary")
    found = parts.repartition(min(width(rows.sparkSession), max(1, (2 << bits) // SEGMENT)), "segment").mapInArrow(added, "segment int, bits binary")
    out = np.zeros((2 << bits) // 8, np.uint8)
    for s, packed in found.collect():
        piece = np.frombuffer(packed, np.uint8)
        out[s * SEGMENT // 8 : s * SEGMENT // 8 + len(piece)] = piece
    return out


ALONE = T.StructType([T.StructField("own", T.BooleanType()), T.StructField("parent", T.BooleanType())])


def alone(shared, bits: int):
    """UDF: is the estimate one, for a prefix and for its parent?"""

    def one(twice: np.ndarray, x: pd.Series, y: pd.Series) -> np.ndarray:
        at = counters(x.to_numpy(np.int64), y.to_numpy(np.int64), bits)
        return ~((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y, px, py in batches:
            yield pd.DataFrame({"own": one(shared.value, x, y), "parent": one(shared.value, px, py)})

    return F.pandas_udf(run, ALONE)


# ---- ends


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (x, y, conv_id) in this order to (x, y, first, ids): ids of a node, comma-joined, in chunks."""
    node, ids, size = None, [], 0

    def out() -> pa.RecordBatch:
        arrays = [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.record_batch(arrays, names=["x", "y", "first", "ids"])

    for batch in batches:
        for x, y, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if ids and (node != (x, y) or size > CHUNK):
                yield out()
                ids, size = [], 0
            node = (x, y)
            ids.append(conv)
            size += 12
    if ids:
        yield out()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: chunks in the order of (x, y, first) to (x, y, sha); one chunk is held at a time."""
    node, sha = None, None
    out = lambda: pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["x", "y", "sha"])
    for batch in batches:
        for x, y, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if node == (x, y):
                sha.update(b",")
            else:
                if node is not None:
                    yield out()
                node, sha = (x, y), hashlib.sha256()
            sha.update(ids.encode())
    if node is not None:
        yield out()


def ends_of(rows: DataFrame, parts: int) -> DataFrame:
    """node, sha: SHA-256 of the ids of the conversations that end there. A node's ids may be very many: they are sorted over
    ranges and joined in chunks; only the chunks of a node meet, in order, and go through one hash."""
    ids = rows.filter("ended").select("node.x", "node.y", "conv_id").repartitionByRange(parts, "x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    chunks = ids.mapInArrow(chunked, "x long, y long, first long, ids string")
    out = chunks.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(hashed, "x long, y long, sha string")
    return out.select(digest(F.col("x"), F.col("y")).alias("node"), "sha")


# ---- nodes


def prefix_trie(conversations: DataFrame, rebuild: bool = True, bits: int = BITS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by `turn`, null first; those of one number by role, then text. Rows without a conv_id belong to no
    conversation. Null roles and texts are empty; a text without words has no tokens. With rebuild, a conversation c first
    takes what stands at its first h places in conversation c - c % 20 (all if that is shorter, none if there is none),
    h being the unsigned crc32 of c's decimals modulo 4, and then has its own turns from h + 1 on. An empty table gives
    an empty table; any other has a root. Digests of 128 bits that are equal count as equal prefixes.

    The sketch has 2 * 2**bits counters (bits >= 15), of which 2**bits / 4 bytes are broadcast. The more prefixes there
    are, the fewer are proved to be alone; `bits` changes no result."""
    spark = conversations.sparkSession
    parts = width(spark)
    turns = numbered(conversations, parts)
    convs = heads(turns, rebuild)
    every = prefixes(turns, convs)
    discard(turns)
    shared = spark.sparkContext.broadcast(sketch(every, bits))
    rows = every.withColumn("alone", alone(shared, bits)("node.x", "node.y", "parent.x", "parent.y"))
    rows = saved(rows.select("conv_id", "depth", "node", "parent", "words", "ended", F.col("alone.own").alias("alone"), (F.col("alone.parent") & (F.col("depth") > 1)).alias("parent_alone")), "screened")
    discard(every)
    empty_hash = F.sha2(F.lit(""), 256)

    # tails: all that a node needs is in its row, but for the name of a parent that may be shared
    tails = rows.filter("alone").select(
        "conv_id", "depth", "parent", "parent_alone", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("ended"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("ended"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty_hash).alias("ends_sha256"),
    )

    # what may be shared, with the root
    root = digest(zero(), zero())
    members = rows.filter("not alone").select("conv_id", "depth", "node", "parent", "words", "ended")
    members = members.unionByName(convs.select("conv_id", zero().alias("depth"), root.alias("node"), root.alias("parent"), zero().alias("words"), (F.col("length") == 0).alias("ended")))
    groups = members.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.min("parent").alias("parent"))
    groups = saved(groups, "groups")
    children = groups.filter("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("c")).unionByName(tails.filter("not parent_alone").groupBy("parent").agg(F.count(F.lit(1)).alias("c")))
    children = children.groupBy(F.col("parent").alias("node")).agg(F.sum("c").alias("n_children"))
    valued = groups.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = valued.withColumns({"tokens": (F.col("n_convs") - 1) * F.col("words"), "forks": F.greatest(F.col("n_children") - 1, F.lit(0))})

    # what a node adds counts for its smallest member; leaves of a subtree are its forks and one
    chain = settled(lambda: running_totals(valued, [F.col("conv_id"), F.col("depth")], {"tokens_to": "tokens", "forks_to": "forks"}, parts), "chain")
    start = lambda v: F.min_by(F.col(f"{v}_to") - F.col(v), F.col("depth")).alias(f"{v}_from")
    own = saved(chain.groupBy("conv_id").agg(F.sum("tokens").alias("all_tokens"), F.sum("forks").alias("all_forks"), start("tokens"), start("forks")), "own")
    often = saved(members.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "often")
    n_members = often.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    totals = own.filter("all_tokens > 0 or all_forks > 0").select("conv_id", "all_tokens", "all_forks")
    within = join_unique(members.select("conv_id", "node", "depth"), totals, "conv_id", "n", n_members, "depth", counts=often)
    within = within.groupBy("node").agg(F.sum("all_tokens").alias("under_tokens"), F.sum("all_forks").alias("under_forks"))
    nodes = join_unique(chain, own.select("conv_id", "tokens_from", "forks_from"), "conv_id", "n", n_members, "depth", counts=often)
    nodes = nodes.join(within, "node", "left").join(ends_of(members, parts), "node", "left")
    under = lambda v: F.coalesce(f"under_{v}", F.lit(0)) - (F.col(f"{v}_to") - F.col(v) - F.col(f"{v}_from"))
    nodes = saved(nodes.select("conv_id", "depth", "node", "parent", "n_convs", "n_children", (1 + under("forks")).alias("n_leaves"), under("tokens").alias("saved_tokens"), F.coalesce("sha", empty_hash).alias("ends_sha256")), "nodes")
    discard(groups, chain, own, often, convs)

    # the parents' names; a parent that is no group is one conversation's own
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = nodes.filter("depth > 0").drop("node").unionByName(tails.filter("not parent_alone").drop("parent_alone"))
    names = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("name"), F.col("n_children").alias("n"))
    below = join_unique(below, names, "parent", "n", nodes.agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n")).first()["n"], "conv_id", "left").drop("n")
    below = below.withColumn("parent_conv_id", F.coalesce("name", "conv_id")).select(*out)
    return below.unionByName(tails.filter("parent_alone").withColumn("parent_conv_id", F.col("conv_id")).select(*out)).unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out))


def prefix_trie_sql() -> str:
    """The same in DuckDB's SQL: prefixes as lists, and each node's ancestors through its smallest member."""
    return r"""
WITH RECURSIVE steps AS (
  SELECT b, b AS v, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT b, v FROM steps WHERE k = 8),
crc AS (
  SELECT DISTINCT conv_id, CAST(4294967295 AS BIGINT) AS v, 0 AS i FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, xor(crc.v // 256, bytes.v), i + 1 FROM crc JOIN bytes ON bytes.b = xor(crc.v % 256, CAST(ascii(CAST(conv_id AS VARCHAR)[i + 1]) AS BIGINT))
  WHERE i < length(CAST(conv_id AS VARCHAR))),
takes AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(CAST(conv_id AS VARCHAR))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS l FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.l, 1, h), []), list_slice(a.l, h + 1, len(a.l))) AS l
  FROM lists a JOIN takes USING (conv_id) LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 20),
members AS (
  SELECT conv_id, d, d = len(l) AS ended, md5(CAST(list_slice(l, 1, d) AS JSON)) AS node, md5(CAST(list_slice(l, 1, d - 1) AS JSON)) AS parent,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(l[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM members GROUP BY node, d),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node AND k.d = n.d),
under AS (
  SELECT m.node, m.d, sum((v.n_convs - 1) * v.words) AS saved_tokens, count_if(v.n_children = 0) AS n_leaves
  FROM valued v JOIN members m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.node, m.d)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN under USING (node, d) LEFT JOIN nodes p ON v.d > 0 AND p.node = v.parent AND p.d = v.d - 1
"""
