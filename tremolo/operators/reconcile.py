"""Reconciling metadata with the files that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions.parsing import parse_ids_lenient

PAIR = ["dialog_id", "utterance_id"]


def file_pairs(files: DataFrame) -> DataFrame:
    """Files with lenient ids; null where the name has none."""
    d, u = parse_ids_lenient(F.col("name"))
    return files.withColumns({"dialog_id": d, "utterance_id": u})


def duplicate_keys(metadata: DataFrame) -> DataFrame:
    """Pairs that occur more than once, with their number."""
    rows = metadata.filter("dialog_id is not null and utterance_id is not null")
    return rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def last_name_per_pair(files: DataFrame) -> DataFrame:
    """For each pair, the last file name in sort order."""
    return file_pairs(files).filter("dialog_id is not null").groupBy(*PAIR).agg(F.max("name").alias("name"))


def reconcile_pairs(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """dialog_id, utterance_id, n_meta, n_files, status: matched, meta_only, files_only; and a row with null ids and
    status unparsed for names without ids. Both sides are aggregated to pairs, then met in one full outer join."""
    meta = metadata.filter("dialog_id is not null and utterance_id is not null").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_meta"))
    parsed = file_pairs(files).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_files"))
    both = meta.join(parsed, PAIR, "full_outer")
    status = F.when(F.col("dialog_id").isNull(), "unparsed").when(F.col("n_files").isNull(), "meta_only").when(F.col("n_meta").isNull(), "files_only").otherwise("matched")
    return both.select(*PAIR, F.coalesce("n_meta", F.lit(0)).alias("n_meta"), F.coalesce("n_files", F.lit(0)).alias("n_files"), status.alias("status"))


def reconcile_summary(pairs: DataFrame) -> DataFrame:
    """One row of counts over reconcile_pairs."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return pairs.agg(
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("n_meta"), F.lit(0)).alias("meta_rows"),
        of("matched", "meta_only").alias("unique_meta_pairs"),
        of("matched", "files_only").alias("unique_file_pairs"),
        F.count_if(F.col("n_meta") > 1).alias("duplicate_meta_pairs_count"),
        of("meta_only").alias("meta_only_count"),
        of("files_only").alias("files_only_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "unparsed", F.col("n_files"))), F.lit(0)).alias("parse_errors"),
    )


def pair_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs of left that right lacks."""
    return left.select(*PAIR).filter("dialog_id is not null").subtract(right.select(*PAIR))


def examples(df: DataFrame, k: int, order: list[str] | None = None) -> DataFrame:
    """The first k rows in order: a top-k in each partition, then of these."""
    return df.orderBy(*(order or PAIR)).limit(k)
