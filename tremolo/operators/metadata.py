"""Looking up utterance text and label for media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions.parsing import clean_text, parse_ids, parse_ids_lenient, wav_path
from tremolo.schemas import UNKNOWN

KEYS = ["split", "dialog_id", "utterance_id"]


def whole_number(value: Column) -> Column:
    """A key as bigint; null where it is no whole number (1.0 is 1, 1.7 is none)."""
    number = value.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint"))


def metadata_from_csv(raw: DataFrame) -> DataFrame:
    """Rows of the metadata files with typed keys and the library's names."""
    return raw.select("split", whole_number(F.col("Dialogue_ID")).alias("dialog_id"), whole_number(F.col("Utterance_ID")).alias("utterance_id"), F.col("Utterance").alias("utterance"), F.col("Sentiment").alias("sentiment"), "_pos")


def first_metadata(metadata: DataFrame) -> DataFrame:
    """The first row of each key by position, in one aggregation with partial results."""
    values = [c for c in metadata.columns if c not in (*KEYS, "_pos")]
    best = metadata.groupBy(*KEYS).agg(F.min_by(F.struct("_pos", *values), "_pos").alias("m"))
    return best.select(*KEYS, "m.*")


def attach_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files (split, name, ...) with ids, utterance and label. The text is found by the strict ids, the label by the
    lenient ones; a miss gives "" and "unknown". Names without ids stay out of the join, as they would share one key."""
    first = first_metadata(metadata)
    strict, lenient = parse_ids(F.col("name")), parse_ids_lenient(F.col("name"))
    keyed = files.withColumns({"dialog_id": strict[0], "utterance_id": strict[1], "_ld": lenient[0], "_lu": lenient[1]})
    texts = first.select("split", F.col("dialog_id").alias("_td"), F.col("utterance_id").alias("_tu"), F.lit(True).alias("_t"), "utterance")
    labels = first.select("split", F.col("dialog_id").alias("_ld"), F.col("utterance_id").alias("_lu"), F.col("sentiment").alias("label"))
    keyed = keyed.withColumns({"_td": F.when(F.col("dialog_id") >= 0, F.col("dialog_id")), "_tu": F.when(F.col("dialog_id") >= 0, F.col("utterance_id"))})
    out = keyed.join(texts, ["split", "_td", "_tu"], "left").join(labels, ["split", "_ld", "_lu"], "left")
    out = out.withColumns({"utterance": clean_text(F.coalesce("utterance", F.lit(""))), "label": F.coalesce("label", F.lit(UNKNOWN))})
    return out.select(*files.columns, "dialog_id", "utterance_id", "utterance", "label")


def check_audio(files: DataFrame, wavs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose WAV exists, error rows for the others). wavs: wav_path."""
    keyed = files.withColumn("wav_path", wav_path(F.col("path")))
    have = wavs.select("wav_path").distinct()
    missing = keyed.join(have, "wav_path", "left_anti").withColumn("error", F.concat(F.lit("Missing audio wav: "), F.col("wav_path")))
    return keyed.join(have, "wav_path", "left_semi"), missing


def invalid_labels(labelled: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows whose label is outside the allowed set, null included."""
    return labelled.filter(~F.coalesce(F.col("label").isin(*allowed), F.lit(False)))
