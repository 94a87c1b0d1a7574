"""Stand-in views of the library's tables over the given ones, in Spark and in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# {ARR}: array of doubles; {STR}: string; {{ }}: braces
VIEWS = {
    "v1_utterances": """
SELECT CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
       conv_id AS dialog_id, turn AS utterance_id, text AS utterance,
       CASE (conv_id + turn) % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' END AS sentiment,
       conv_id * 1000 + turn AS _pos
FROM conversations
UNION ALL
SELECT CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END,
       conv_id, turn, concat('dup ', text), 'neutral', conv_id * 1000 + turn + 1000000000
FROM conversations WHERE conv_id % 13 = 0""",
    "v2_media": """
SELECT split, name, concat('/data/', split, '/unmodified/', name) AS path
FROM (SELECT CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
        CASE WHEN turn = 0 AND conv_id % 19 = 0 THEN concat('clip_', conv_id, '.mp4')
             WHEN conv_id % 17 = 0 THEN concat('final_videos_testdia', conv_id, '_utt', turn, '.mp4')
             WHEN conv_id % 23 = 0 THEN concat('DIA', conv_id, '_UTT', turn, '.MP4')
             WHEN conv_id % 5 = 0 AND turn = 0 THEN concat('dia', conv_id + 100000, '_utt', turn, '.mp4')
             ELSE concat('dia', conv_id, '_utt', turn, '.mp4') END AS name
      FROM conversations WHERE (conv_id * 7 + turn) % 11 <> 0) m""",
    "v3_predictions": """
SELECT d.doc_id AS dialog_id, 0 AS utterance_id, concat('dia', d.doc_id, '_utt0.mp4') AS file,
       CASE WHEN d.doc_id % 29 = 0 THEN NULL
            WHEN d.doc_id % 31 = 0 THEN 'Neutral'
            WHEN length(replace(d.text, 'e', '')) * 100 < length(d.text) * 88 THEN 'positive'
            WHEN length(replace(d.text, 'e', '')) * 100 < length(d.text) * 91 THEN 'neutral'
            ELSE 'negative' END AS prediction,
       CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.toxic = 1 THEN 'negative'
            WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
       CASE d.doc_id % 5 WHEN 0 THEN 'unmodified' WHEN 1 THEN 'T=keyboard_S=3' WHEN 2 THEN 'T=ocr_S=3'
            WHEN 3 THEN 'A=mp3_S=5' ELSE 'V=occlusion_S=5' END AS split
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v4_predictions_large": """
SELECT l_orderkey AS dialog_id, l_linenumber AS utterance_id,
       CASE l_partkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS prediction,
       CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS label,
       CASE WHEN l_suppkey % 4 = 0 THEN 'unmodified'
            ELSE concat('A=c', l_suppkey % 7, '_S=', 1 + l_suppkey % 5) END AS split
FROM lineitem""",
    "v5_signals": "SELECT vec_id AS clip_id, CAST(embedding AS {ARR}) AS samples, label FROM embeddings",
    "v6_series": "SELECT user_id AS series_id, ts, value FROM events",
    "v7_transcripts": """
SELECT dialog_id, CASE dialog_id % 6
   WHEN 0 THEN concat('system', chr(10), 'x', chr(10), 'user', chr(10), 'hi', chr(10), 'assistant', chr(10), label)
   WHEN 1 THEN concat('user: q', chr(10), 'Assistant: ', label, chr(10))
   WHEN 2 THEN concat('assistant - ', label, chr(10), 'assistant: again')
   WHEN 3 THEN concat('no marker', chr(10), label, chr(10), chr(10))
   WHEN 4 THEN concat('ends with assistant')
   ELSE '' END AS transcript
FROM v3_predictions""",
    "v8_probe": """
SELECT event_id, concat('clip', event_id, '.mp4') AS file,
  CASE WHEN event_id % 41 = 0 THEN 'ffprobe failed' END AS probe_error,
  CASE WHEN event_id % 37 = 0 THEN '{{"streams": []}}' WHEN event_id % 41 <> 0
       THEN concat('{{"streams": [{{"index": 1, "codec_name": "aac", "channels": 2, "sample_rate": "', 8000 * (1 + event_id % 6), '"}}]}}') END AS streams_json,
  concat('mean_volume: -', CAST(20 + event_id % 50 AS {STR}), '.5 dB max_volume: -', CAST(10 + event_id % 45 AS {STR}), '.0 dB') AS volume_log,
  CASE WHEN event_id % 3 = 0 THEN concat('silence_duration: ', CAST(1 + event_id % 5 AS {STR}), '.25 x silence_duration: 1') ELSE '' END AS silence_log,
  CASE WHEN event_id % 10 <> 0 THEN CAST(2 + event_id % 6 AS DOUBLE) END AS duration,
  CASE event_id % 4 WHEN 0 THEN '24000/1001' WHEN 1 THEN '25' WHEN 2 THEN '0/0' ELSE 'bad' END AS avg_frame_rate
FROM events""",
}
TABLES = ["documents", "labels", "conversations", "lineitem", "embeddings", "events"]


def with_views(sql: str) -> str:
    """DuckDB's SQL with the views that it uses as common table expressions."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if "v7_transcripts" in names and "v3_predictions" not in names:
        names = [n for n in VIEWS if n in (*names, "v3_predictions")]
    text = ", ".join(f"{n} AS ({VIEWS[n].format(ARR='DOUBLE[]', STR='VARCHAR')})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {text}, {sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {text}, {sql[5:]}"
    return f"WITH {text} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder; the SQL refers to them as parameters, so that nothing is registered."""
    sql = VIEWS[name].format(ARR="array<double>", STR="string")
    used = [t for t in [*TABLES, "v3_predictions"] if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    frames = {t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(sql, **frames)


def utterances(spark, d):
    return view(spark, d, "v1_utterances")


def media(spark, d):
    return view(spark, d, "v2_media")


def predictions(spark, d):
    p = view(spark, d, "v3_predictions")
    return p.withColumns({"dialog_id": F.col("dialog_id").cast("long"), "utterance_id": F.col("utterance_id").cast("long")})


def predictions_large(spark, d):
    return view(spark, d, "v4_predictions_large")


def signals(spark, d):
    return view(spark, d, "v5_signals")


def series(spark, d):
    return view(spark, d, "v6_series")


def transcripts(spark, d):
    return view(spark, d, "v7_transcripts")


def probe(spark, d):
    return view(spark, d, "v8_probe")


def toy(text: str) -> Column:
    """The toy predictor's rule on the share of the letter e."""
    rest, size = F.length(F.replace(F.col(text), F.lit("e"), F.lit(""))) * 100, F.length(text)
    return F.when(rest < size * 88, "positive").when(rest < size * 91, "neutral").otherwise("negative")
