from __future__ import annotations

import json
import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tremolo.functions.parsing import basename
from tremolo.operators.merge import merge_labeled
from tremolo.operators.metadata import metadata_from_csv
from tremolo.schemas import CLEAN, ERRORS, METADATA, METRICS, OLD_ERRORS, PREDICTIONS
from tremolo.sources.media import MediaSource, reaches
from tremolo.sources.records import read_records
from tremolo.sources.shared import exists

VIDEO = [".mp4", ".mkv", ".avi", ".mov", ".webm"]
ROOTS = {"train": "train_splits", "val": "dev_splits_complete", "test": "output_repeated_splits_test"}
META_CSV = {"train": "train_sent_emo.csv", "val": "dev_sent_emo.csv", "test": "test_sent_emo.csv"}


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV with a header and quoted fields, which may go over lines; a large file is read by many tasks."""
    return read_records(spark, {"": path}, schema).drop("_tag", "_pos")


def merge_csv(spark: SparkSession, files: list[tuple[str, str]], label: str = "source") -> DataFrame:
    """CSV files (path, label) one after the other, by column names, each with its label as a constant column; columns that
    a file lacks are null. The library's own columns have its types, others are text. No files give an empty table; a
    file that is not there is an error that names it, before anything is read."""
    for path, _ in files:
        if not exists(spark, path):
            raise FileNotFoundError(f"no such file: {path}")
    kinds = {f.name: f.dataType for s in (METRICS, ERRORS, PREDICTIONS) for f in s.fields}
    tables = []
    for path, name in files:
        header = header_of(spark, path)
        tables.append((read_csv(spark, path, StructType([StructField(c, kinds.get(c, StringType())) for c in header.names])), name))
    return merge_labeled(spark, tables, label)


def header_of(spark: SparkSession, path: str) -> StructType:
    """The columns that a CSV's header names, as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path).schema


def read_metadata(spark: SparkSession, paths: dict[str, str], need: tuple[str, ...] = ("Dialogue_ID", "Utterance_ID", "Utterance", "Sentiment")) -> DataFrame:
    """Metadata of several splits. A file that can't be read warns, and its split has no metadata; a file without a
    needed column is an error. Columns are found by the header; _pos is the row's place in its file (or its files, in the
    order of their names)."""
    alike: dict[tuple[str, ...], dict[str, str]] = {}
    for split, path in paths.items():
        try:
            header = header_of(spark, path)
        except AnalysisException as e:
            warnings.warn(f"no metadata for {split}: {str(e).splitlines()[0]}", stacklevel=2)
            continue
        missing = [c for c in need if c not in header.names]
        if missing:
            raise ValueError(f"{path} lacks the columns {missing}")
        alike.setdefault(tuple(header.names), {})[split] = path
    if not alike:
        return spark.createDataFrame([], METADATA)
    # files of one header are read together
    schemas = {names: StructType([StructField(c, StringType()) for c in names]) for names in alike}
    parts = [read_records(spark, files, schemas[names]).select(F.col("_tag").alias("split"), *need, "_pos") for names, files in alike.items()]
    return metadata_from_csv(reduce(DataFrame.unionByName, parts))


def with_suffix(files: DataFrame, suffixes: list[str] = VIDEO) -> DataFrame:
    """Files (path) whose suffix, in any case, is allowed, with their name."""
    name = basename(F.col("path"))
    return files.withColumn("name", name).filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*[x.lower() for x in suffixes]))


def list_media(spark: SparkSession, folder: str, recursive: bool = False, suffixes: list[str] = VIDEO) -> DataFrame:
    """name, path, length, modificationTime of a folder's files (or a single file), without reading their content.

    Tasks list the folders, so that neither the driver nor a task holds all files; empty ones count. A store that Python
    can't open is listed by Spark's own reader, whose driver holds them, without empty files. Names that start with "."
    or "_" are passed over."""
    if reaches(folder):
        spark.dataSource.register(MediaSource)
        listed = spark.read.format("media_files").option("recursive", str(recursive).lower()).option("suffixes", json.dumps(suffixes)).load(folder)
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return with_suffix(listed.select("path", "length", "modificationTime"), suffixes).select("name", "path", "length", "modificationTime")


def split_configs(paths: DataFrame, root: str, split: str, noisy: list[str] | None) -> DataFrame:
    """dir, metadata, condition: the clean folder without noise, else one row for each condition folder in the paths of a
    noisy modality. Text noise means clean media with the condition's own metadata."""
    base, meta = f"{root}/{ROOTS[split]}", META_CSV[split]
    if not noisy:
        rows = paths.select(F.lit(f"{base}/{CLEAN}").alias("dir"), F.lit(f"{base}/{meta}").alias("metadata"), F.lit(CLEAN).alias("condition"))
        return rows.distinct()
    letters = {"audio": "A", "video": "V", "text": "T"}
    found = paths.select(F.regexp_extract("path", r"/([AVT]=[^/]+_S=\d+)/", 1).alias("condition"), F.regexp_extract("path", r"^(.*/[AVT]=[^/]+_S=\d+)/", 1).alias("folder"))
    found = found.filter(F.substring("condition", 1, 1).isin(*[letters[m] for m in noisy])).distinct()
    text = F.substring("condition", 1, 1) == "T"
    return found.select(F.when(text, F.lit(f"{base}/{CLEAN}")).otherwise(F.col("folder")).alias("dir"), F.when(text, F.concat("folder", F.lit("/metadata.csv"))).otherwise(F.lit(f"{base}/{meta}")).alias("metadata"), "condition")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of all batches."""
    return spark.read.schema(PREDICTIONS).parquet(path).select(*PREDICTIONS.names)


def read_outcomes(spark: SparkSession, path: str, carry: StructType) -> tuple[DataFrame, DataFrame]:
    """(predictions, errors) that write_outcomes wrote; either reads its own folders only. carry: the columns beside."""
    schema = StructType(carry.fields + [StructField(c, StringType()) for c in ("error", "traceback", "prediction", "outcome")])
    rows = spark.read.schema(schema).parquet(path)
    names = carry.names
    return rows.filter("outcome = 'predicted'").select(*names, "prediction"), rows.filter("outcome = 'failed'").select(*names, "error", "traceback")


def read_errors_csv(spark: SparkSession, new: list[str], old: list[str] = ()) -> DataFrame:
    """Error files of both layouts; the older one has no traceback."""
    layouts = [({str(i): p for i, p in enumerate(files)}, schema) for files, schema in ((new, ERRORS), (old, OLD_ERRORS)) if files]
    parts = [read_records(spark, files, schema).drop("_tag", "_pos") for files, schema in layouts]
    if not parts:
        return spark.createDataFrame([], ERRORS)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


