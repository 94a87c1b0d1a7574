"""Mixing sources to target weights, by DataFrame functions only.

Every document gets a hash-random key. Documents are range-sorted by (source, key); distributed prefix sums of their
sizes give each one's place in its source, and each source is cut at its exact budget, after as many whole epochs as
the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import WORD, join_unique, running_totals, saved, whole_row, width


def targets(totals: DataFrame, weights: Sequence[float], max_epochs: int, parts: int) -> DataFrame:
    """totals: source, source_size, n. Adds weight, target, epochs, rest and source_start (sizes of sources before).

    Weights go round the sources in code-point order, null last. A target is the weight's share of all sizes, but at
    most max_epochs times the source's size; what is above goes to the others by weight until none is above. With the
    sources sorted by size / weight, those that stop are a prefix: source i stops if the share that is left to it
    without the ones before is above its cap. Both sorts are running totals over one row for each source."""
    by_name = [F.col("source").asc_nulls_last()]
    named = running_totals(totals.withColumn("one", F.lit(1)), by_name, {"rank": "one", "upto": "source_size"}, parts)
    bank = F.array(*[F.lit(float(w)) for w in weights])
    named = named.select("source", "source_size", "n", F.get(bank, ((F.col("rank") - 1) % len(weights)).cast("int")).alias("weight"), (F.col("upto") - F.col("source_size")).alias("source_start"))
    named = named.withColumns({"cap": max_epochs * F.col("source_size"), "ratio": max_epochs * F.col("source_size") / F.col("weight"), "one": F.lit(1)})
    whole = named.groupBy("one").agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    filled = running_totals(named, [F.col("ratio"), *by_name], {"cap_upto": "cap", "weight_upto": "weight"}, parts)
    filled = filled.join(F.broadcast(whole), "one")
    left_size = F.col("all_size") - (F.col("cap_upto") - F.col("cap"))
    left_weight = F.col("all_weight") - (F.col("weight_upto") - F.col("weight"))
    filled = saved(filled.withColumn("stops", left_size / left_weight > F.col("ratio")), "targets")
    level = filled.groupBy("one").agg(F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).alias("stop_size"), F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0.0)).alias("stop_weight"))
    filled = filled.join(F.broadcast(level), "one")
    share = F.col("weight") * ((F.col("all_size") - F.col("stop_size")) / F.nullif(F.col("all_weight") - F.col("stop_weight"), F.lit(0.0)))
    filled = filled.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share))
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("cap"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    filled = filled.withColumns({"budget": budget, "epochs": epochs})
    return filled.select("source", "n", "weight", "source_size", "source_start", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"))


def rows_of(counted: DataFrame) -> int:
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def mix(sized: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: str = "mix", whole: bool = False) -> DataFrame:
    """sized: doc_id, source, size. Returns doc_id, source, size, source_size, target, epochs, taken.

    taken is the words that the mix takes of a document: epochs times its size, and in the last epoch what is left of
    the source's budget at the document's place, so that a source's sum is its budget exactly. With whole=True, the
    last epoch takes a document whole if half of it or more fits, else not.

    Null or negative sizes count as 0; a null source is a source of its own; a null id sorts as the empty text. Rows that agree in
    all three columns are taken one after the other. An empty table gives an empty table."""
    parts = width(sized.sparkSession)
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint")
    sized = sized.select("doc_id", "source", size.alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = saved(targets(totals, weights, max_epochs, parts), "plan")
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    placed = running_totals(keyed, order, {"upto": "size"}, parts)
    out = join_unique(placed.withColumn("of", F.struct("source")), plan.withColumn("of", F.struct("source")).drop("source"), "of", "n", rows_of(plan), "key")
    room = F.col("rest") - (F.col("upto") - F.col("size") - F.col("source_start"))
    if whole:
        last = F.when((F.col("size") > 0) & (2 * room >= F.col("size")), F.col("size")).otherwise(0)
    else:
        last = F.greatest(F.lit(0), F.least(F.col("size"), room))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("bigint").alias("epochs"), (F.col("epochs") * F.col("size") + last).cast("bigint").alias("taken"))


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """mix() over a documents table; the size is the number of words, and a null text has none."""
    sized = saved(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    return mix(sized, **how)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, each row as often as it takes it (whole documents), with the columns of docs.

    Rows that agree in id, source and size are alike to the mix: where it takes some of them once more than others,
    those are any of them, but as many."""
    taken = mix_documents(docs, whole=True, **how)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    taken = saved(taken.select("doc_id", "source", "size", times.alias("times")), "taken")
    by_id = saved(taken.groupBy(F.col("doc_id").alias("of")).agg(F.min("times").alias("lo"), F.max("times").alias("hi")), "times")
    row = whole_row(docs)
    even, uneven = by_id.filter("lo = hi and hi > 0"), by_id.filter("lo < hi").select("of")
    out = docs.select(F.col("doc_id").alias("id"), row).join(even, F.col("id").eqNullSafe(F.col("of"))).select("row", F.col("hi").alias("times"))
    if not uneven.isEmpty():
        out = out.unionByName(_uneven(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), "text", row), taken, uneven))
    return out.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _uneven(rows: DataFrame, taken: DataFrame, uneven: DataFrame) -> DataFrame:
    """row and times for the rows of ids whose rows are not all taken alike: by id, source and size.

    A source's budget ends within one group of these at most; the rows of such a group are numbered, and the first of
    them are taken once more."""
    some = taken.join(uneven, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    groups = some.groupBy("doc_id", "source", "size").agg(F.min("times").alias("lo"), F.max("times").alias("hi"), F.sum("times").alias("all"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups.withColumn("more", F.col("all") - F.col("lo") * F.col("n")), "groups")
    # null ids go without the join, which would bring them to one task
    kept = rows.filter("id is not null").join(uneven, F.col("id") == F.col("of"), "left_semi")
    if not uneven.filter("of is null").isEmpty():
        kept = kept.unionByName(rows.filter("id is null"))
    kept = kept.select("id", "src", word_count().alias("words"), "row")
    kept = kept.join(groups, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("src").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    out = kept.filter("lo = hi").select("row", F.col("hi").alias("times"))
    if groups.filter("lo < hi").isEmpty():
        return out
    cut = kept.filter("lo < hi").select("src", "lo", "hi", "more", "row", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("tie"))
    cut = saved(running_totals(cut, [F.col("src").asc_nulls_last(), F.col("tie")], {"place": "one"}, width(rows.sparkSession)), "placed")
    start = saved(cut.groupBy(F.struct("src").alias("of")).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), "starts")
    cut = join_unique(cut.withColumn("of", F.struct("src")), start, "of", "n", rows_of(start), "tie")
    return out.unionByName(cut.select("row", F.when(F.col("place") - F.col("start") < F.col("more"), F.col("hi")).otherwise(F.col("lo")).alias("times")))


def mix_sql(table: str = "documents", weights: Sequence[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: str = "mix") -> str:
    """The same in DuckDB's SQL, written row by row over the sources."""
    bank = ", ".join(f"CAST({float(w)} AS DOUBLE)" for w in weights)
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM {table}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT source, source_size, {max_epochs} * source_size AS cap,
         [{bank}][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)}) + 1] AS weight
  FROM totals),
filled AS (
  SELECT *, CAST(sum(cap) OVER w - cap AS DOUBLE) AS cap_before, sum(weight) OVER w - weight AS weight_before,
         CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, sum(weight) OVER () AS all_weight
  FROM named WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, (all_size - cap_before) / (all_weight - weight_before) > cap / weight AS stops FROM filled),
level AS (
  SELECT sum(CASE WHEN stops THEN cap ELSE 0 END) AS stop_size, sum(CASE WHEN stops THEN weight ELSE 0 END) AS stop_weight
  FROM marked),
target AS (
  SELECT source, source_size, cap,
         CASE WHEN stops THEN CAST(cap AS DOUBLE)
              ELSE weight * ((all_size - stop_size) / nullif(all_weight - stop_weight, 0)) END AS target
  FROM marked, level),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN b // source_size ELSE 0 END AS epochs
  FROM (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS b FROM target)),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(concat('{seed}|', doc_id)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
  FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(t.epochs * p.size + greatest(0, least(p.size, t.b - t.epochs * t.source_size - p.before)) AS BIGINT) AS taken
FROM placed p JOIN budget t ON p.source IS NOT DISTINCT FROM t.source
"""
