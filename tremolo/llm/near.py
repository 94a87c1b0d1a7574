"""MinHash near-deduplication with bottom-k sketches from one hash function.

1. Documents with the same shingle set are one class; from here on, only classes count.
2. Each class has a sketch, its k smallest shingle hashes. Inverted lists (hash -> classes) generate overlaps. Classes
   that are similar enough share `share` sketch values all but surely, so each class needs to stand only in the lists
   of its rarest values, all but share - 1 of them: what a passage puts into many unrelated documents stays out.
3. A list is not expanded into pairs. In each round every class of a list is paired with the list's leader; candidates
   are filtered by the estimate from the union of the sketches, confirmed by exact Jaccard similarity on the texts'
   full sets, and linked classes become one component. A list that lies in one component is done. What is left after
   the rounds is searched exactly, over whole sets, for links across components, so that none is lost.
4. Components are smallest ids over links, and come back to the documents through their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import PIECES, discard, join_unique, release, saved, small_batches, whole_row

K = 64
#: The chance, unless it is stated, that two classes at the threshold share fewer sketch values than is asked for.
RISK = 1e-7
WIDTH = 5
#: Classes with one shingle in their prefixes, of one band of sizes, that meet in a task (with all others of the bands).
DEALT = 2000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64, and their inverses, as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(2 * n, 4096)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


POWERS = Powers(0x5851F42D4C957F2D)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of lower-cased text: differences of a polynomial hash of all prefixes."""
    b = np.frombuffer(data, np.uint8)
    space = SPACES[b]
    word = np.concatenate(([False], ~space, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = POWERS.get(len(b))
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULTIPLIER)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words than the width, the whole sequence is one."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if n == 0:
        return words
    w = min(width, n)
    acc = np.full(n - w + 1, w, np.uint64) * MULTIPLIER
    for j in range(w):
        acc = mix64(acc + words[j : n - w + 1 + j])
    return np.unique(acc)


def share_of(percent: int, risk: float = RISK, k: int = K) -> int:
    """Sketch values that two classes share at the least. The union's k smallest values hold Binomial(k, J) common ones;
    fewer than this many (28 for J = 0.75 and a risk of 1e-7) come with a probability below the risk."""
    p, below, n = percent / 100, 0.0, 0
    while n < k and below + math.comb(k, n) * p**n * (1 - p) ** (k - n) < risk:
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        n += 1
    return max(1, n)


SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def sketches(width: int, k: int):
    import hashlib

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for texts in batches:
            rows = []
            for text in texts:
                s = shingles(text, width)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:k].view(np.int64)))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_id", "sketch"])

    return F.pandas_udf(run, SKETCH)


def lists(classes: DataFrame, percent: int, risk: float) -> DataFrame:
    """value, id, n_shingles, weight: the inverted lists, each class in those of its rarest values only. weight is the
    length of a class's lists together: that of a text that many others are copies of is large."""
    values = classes.select("id", "n_shingles", F.size("sketch").alias("m"), F.explode("sketch").alias("value")).select("value", "id", "n_shingles", "m")
    often = saved(values.groupBy("value").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    total = classes.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)).alias("n")).first()["n"]
    seen = join_unique(values, often, "value", "often", total, "id")
    # sketches are bounded, so is what is collected for a class; a small set needs its share of values in common
    share = share_of(percent, risk)
    need = F.when(F.col("m") >= K, F.lit(share)).otherwise(F.least(F.lit(share), F.ceil(F.col("m") * percent / 100).cast("int")))
    own = seen.groupBy("id", "n_shingles", "m").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("v"), F.sum("often").alias("weight"))
    first = F.greatest(F.lit(0), F.col("m") - need + 1 - (F.col("m") - F.size("v")))
    own = own.withColumn("v", F.slice("v", F.lit(1), first)).select("id", "n_shingles", "weight", F.explode("v.value").alias("value"))
    own = saved(own, "lists")
    discard(often)
    return own


def in_several(todo: DataFrame, comp: DataFrame, total: int) -> DataFrame:
    """The lists (a written table of so many rows) whose classes lie in several components, with column comp."""
    named = todo.drop("comp").join(comp.select("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = named.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    split = saved(split.select("value", "n"), "split")
    out = saved(join_unique(named, split, "value", "n", total, "id").drop("n"), "todo")
    discard(split)
    return out


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, risk: float) -> DataFrame:
    """The pairs (a, b; a written table) that are similar enough: first by the sketches of their union (unless there is to be
    no risk), then by their full sets. One class may be in very many pairs: its sketch and text are there for each piece
    of them."""
    total = pairs.count()
    ends = pairs.select(F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("id")) for e in "ab"])).alias("x")).select("x.*")
    often = saved(ends.groupBy("end", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * PIECES > total), "often")

    def with_end(rows: DataFrame, end: str, to: DataFrame) -> DataFrame:
        counts = often.filter(F.col("end") == end).select(F.col("id").alias(end), "n")
        return join_unique(rows, to.withColumnRenamed("id", end), end, "n", total, "b" if end == "a" else "a", counts=counts)

    likely = pairs
    if risk:
        both = pairs
        for end in "ab":
            both = with_end(both, end, classes.select("id", F.col("sketch").alias(f"s{end}"), F.col("n_shingles").alias(f"n{end}")))
        likely = saved(both.filter(estimate(percent, risk)("sa", "sb", "na", "nb")).select("a", "b"), "likely")
    left = with_end(with_end(likely, "b", texts.withColumnRenamed("text", "tb")), "a", texts.withColumnRenamed("text", "ta"))

    def exact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ta, tb in batches:
            out, last, sx = [], None, None
            for x, y in zip(ta, tb, strict=True):
                if x != last:
                    last, sx = x, shingles(x, width)
                sy = shingles(y, width)
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                out.append(100 * both >= percent * (len(sx) + len(sy) - both))
            yield pd.Series(out, dtype=bool)

    return left.filter(F.pandas_udf(exact, T.BooleanType())("ta", "tb")).select("a", "b").distinct()


def estimate(percent: int, risk: float):
    """Could the pair be similar? Of the k smallest values of the union, as many as chance asks for are in both."""
    share = share_of(percent, risk)

    def run(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, y, m, n in zip(sa, sb, na, nb, strict=True):
            x, y = np.sort(x.view(np.uint64)), np.sort(y.view(np.uint64))
            union = np.union1d(x, y)
            whole = m <= K and n <= K
            union = union if whole else union[:K]
            common = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
            out.append(100 * len(common) >= percent * len(union) if whole else len(common) >= min(share, len(union)))
        return pd.Series(out, dtype=bool)

    run.__annotations__ = {k: pd.Series for k in ("sa", "sb", "na", "nb", "return")}
    return F.pandas_udf(run, T.BooleanType())


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, comp, degree: the smallest id that is reachable over links (a, b), by smallest neighbours and pointer jumping.

    known: components found before; links then join these. An id may have very many links, and a component very many
    ids: both are dealt out."""
    if known is not None:
        k = known.select(F.col("id").alias("x"), F.col("comp").alias("y"))
        links = links.select("a", "b").unionByName(k.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    total = edges.count()
    comp = saved(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp"), F.count(F.lit(1)).alias("degree")), "comp")
    last = comp
    while True:
        near = join_unique(edges, comp.select(F.col("id").alias("b"), F.col("comp").alias("c"), "degree"), "b", "degree", total, "a").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = saved(comp.join(near, "id").select("id", "comp", "degree", F.least("comp", "c").alias("new")), "near")
        goals = step.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
        goals = saved(goals.join(comp.select(F.col("id").alias("new"), F.col("comp").alias("far")), "new"), "goals")
        jump = saved(join_unique(step, goals, "new", "n", total, "id").select("id", "comp", "degree", F.least("new", "far").alias("new")), "step")
        discard(step, goals)
        if jump.filter("new <> comp").isEmpty():
            discard(jump, edges)
            return comp
        discard(last)
        comp, last = jump.select("id", F.col("new").alias("comp"), "degree"), jump


def residual(todo: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """id, id2: what can still be linked across components, among the classes of the lists that are left.

    Here the lists are over whole sets, with the bounds of exact similarity joins: in an order from rare shingles to
    frequent ones, a pair that is similar enough has its first common shingle within the first quarter of both sets,
    and from there on there must be room for all that they need in common. A class whose rare shingles are its own has
    no candidates, whatever it shares with a large group."""
    members = saved(todo.select("id", "comp").distinct(), "members")
    body = texts.join(members, "id").select("id", "comp", "text")

    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, width).view(np.int64))

    # not deterministic for the optimizer, or it runs twice: below the join too, on all texts, to drop empty sets
    each = F.pandas_udf(whole, T.ArrayType(T.LongType())).asNondeterministic()
    sets = body.select("id", "comp", each("text").alias("s")).select("id", "comp", F.size("s").alias("n"), F.explode("s").alias("token"))
    often = saved(sets.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    total = often.agg(F.coalesce(F.sum("often"), F.lit(0)).alias("n")).first()["n"]
    seen = join_unique(sets, often, "token", "often", total, "id")
    # a set is bounded by its document; shingles that no other member has come before those collected here
    own = seen.groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("v"))
    own = own.select("id", "comp", "n", F.size("v").alias("m"), F.posexplode("v").alias("at", "x")).select("id", "comp", "n", (F.col("n") - F.col("m") + F.col("at") + 1).alias("place"), "x.token")
    own = saved(own.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), "prefixes")
    # sizes of similar sets are in the same band or in neighbouring ones; what many classes have in their prefixes is
    # dealt out in rows of at most DEALT classes
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n")
    own = own.withColumn("band", band)
    crowds = own.groupBy("token", "band").agg(F.count(F.lit(1)).alias("crowd"))
    crowds = saved(crowds.filter(F.col("crowd") > DEALT).select("token", "band", F.ceil(F.col("crowd") / DEALT).cast("int").alias("slots")), "crowds")
    slot = F.when(F.col("slots").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("slots"))).cast("int")
    x = own.join(crowds, ["token", "band"], "left").withColumn("slot", slot).drop("slots")
    y = own.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))).join(crowds, ["token", "band"], "left")
    y = y.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)))
    y = y.select("token", "band", "slot", F.col("id").alias("id2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    common = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-9)
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    on = (F.col("comp") < F.col("comp2")) & (room >= common) & (F.col("n") * 100 >= percent * F.col("n2")) & (F.col("n2") * 100 >= percent * F.col("n"))
    return x.join(y, ["token", "band", "slot"]).filter(on).select("id", "id2")


def empty(spark: SparkSession, *names: str) -> DataFrame:
    """No rows, of bigint columns. (Rows of the driver's, even none, would come through Python workers of their own.)"""
    return spark.range(0).select(*[F.lit(None).cast("bigint").alias(n) for n in names])


def link(docs: DataFrame, classes: DataFrame, width: int, percent: int, rounds: int, risk: float) -> DataFrame:
    """id, comp for the classes that have a link. Without a risk, all classes go to the exact search at once."""
    spark = docs.sparkSession
    comp = empty(spark, "id", "comp")
    if risk:
        first = lists(classes, percent, risk)
        todo = in_several(first, comp, first.count()).withColumn("led", F.lit(False))
        discard(first)
    else:
        todo, rounds = classes.select("id", F.col("id").alias("comp")), 0
    total = todo.count()
    # the texts that a candidate can have, written once
    ids = classes.select("set_id", "id").join(todo.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"))
    several = docs.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])  # an id may repeat, with other texts
    texts = saved(several.select(F.col("doc_id").alias("id"), "text"), "texts")
    tried = empty(spark, "a", "b")
    fits = (F.col("n_shingles") * 100 >= percent * F.col("n2")) & (F.col("n2") * 100 >= percent * F.col("n_shingles"))
    for r in range(rounds + 1):
        if not total:
            break
        if r < rounds:
            best = F.max(F.when(~F.col("led"), F.struct("weight", (-F.col("id")).alias("id"), "n_shingles"))).alias("x")
            lead = todo.groupBy("value").agg(best, F.count(F.lit(1)).alias("n"))
            lead = saved(lead.filter("x is not null").select("value", (-F.col("x.id")).alias("leader"), F.col("x.n_shingles").alias("n2"), "n"), "lead")
            led = join_unique(todo, lead, "value", "n", total, "id", "left").drop("n")
            led = saved(led.withColumn("led", F.col("led") | F.coalesce(F.col("id") == F.col("leader"), F.lit(False))), "led")
            pairs = led.filter((F.col("id") != F.col("leader")) & fits)
            other, todo = F.col("leader"), led.drop("leader", "n2")
        else:
            pairs, other = residual(todo, texts, width, percent), F.col("id2")
        pairs = pairs.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        links = saved(confirm(pairs, classes, texts, width, percent, risk), "links")
        tried = tried.unionByName(pairs)
        if links.isEmpty():
            continue
        comp = components(links, comp)
        if r < rounds:
            todo = in_several(todo, comp, total)
            total = todo.count()
            discard(led)
    return comp


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = 75, rounds: int = 2, risk: float = RISK) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    risk: the chance that the sketches miss a pair at the threshold; 0 means that they choose no candidates, and all classes
    are searched exactly, which takes longer.

    Words are runs of non-space characters, A-Z lower-cased. A text without words (or null) has no shingles and links
    with nothing; so does a row without an id, which is kept. Rows that repeat an id with one text are alike; if their
    texts differ, the id links what any of them links. Equality at the threshold links (in whole numbers). An empty
    table gives an empty table."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    udf = sketches(width, K)
    rows = saved(docs.select("doc_id", udf("text").alias("s")).select("doc_id", "s.*"), "sketches")
    real = rows.filter("n_shingles > 0 and doc_id is not null")
    sets = saved(real.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "sets")
    classes = real.join(sets.select("set_id", F.col("id").alias("doc_id")), ["set_id", "doc_id"], "left_semi")
    classes = saved(classes.dropDuplicates(["set_id"]).select("set_id", F.col("doc_id").alias("id"), "n_shingles", "sketch"), "classes")
    comp = link(docs, classes, width, percent, rounds, risk)
    named = sets.join(comp, "id", "left").select("set_id", "copies", F.coalesce("comp", "id").alias("component_id"))
    slim = rows.select("doc_id", "n_shingles", "set_id")
    alone = slim.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    known = slim.filter("n_shingles > 0 and doc_id is not null")
    out = join_unique(known, saved(named, "named"), "set_id", "copies", rows.count(), "doc_id").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(alone).select("*", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest id; one row of each id stays."""
    kept = deduplicate(docs, **how).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    packed = docs.select(F.col("doc_id").cast("bigint").alias("__id"), whole_row(docs))
    named = packed.join(kept, "__id", "left_semi").dropDuplicates(["__id"]).select("row.*")
    return named.unionByName(packed.filter("__id is null").select("row.*"))


def deduplicate_sql(table: str = "documents", width: int = WIDTH, percent: int = 75) -> str:
    """The same in DuckDB's SQL: all pairs that share a shingle, and reachability by recursion."""
    az = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({az}, '[^\x20\x09-\x0D]+') AS w FROM {table}),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + least(len(w), {width}) - 1 AS BIGINT)), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width} + 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= {percent} * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS id, a AS node FROM both_ways
  UNION
  SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.node = e.a),
comp AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN comp ON comp.id = w.doc_id
"""
