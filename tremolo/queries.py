"""The operators as queries over the given tables, through stand-in views, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo import views as V
from tremolo.functions import parsing as P
from tremolo.functions import signals as S
from tremolo.functions import textnoise as N
from tremolo.functions.catalog import catalog_sql, corruption_catalog
from tremolo.operators import evaluate, merge, metadata, predict, quality, reconcile, timeseries
from tremolo.plans import corruption as plans
from tremolo.schemas import CLEAN, ERRORS, METRICS
from tremolo.sources import readers, writers
from tremolo.sources.shared import shared_dir
from tremolo.streaming.confusion import read_running, stream_confusion

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LABELS = ["neutral", "positive", "negative"]
BELOW, HOUR = 15.0, 3_600_000_000


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _round(*cols: str, places: int = 9):
    return [F.round(F.col(c), places).alias(c) for c in cols]


# ---- evaluation

A1_SQL = """
SELECT split, class,
       count(*) FILTER (prediction IS NOT DISTINCT FROM class AND label IS NOT DISTINCT FROM class) AS "TP",
       count(*) FILTER (prediction IS NOT DISTINCT FROM class AND label IS DISTINCT FROM class) AS "FP",
       count(*) FILTER (prediction IS DISTINCT FROM class AND label IS NOT DISTINCT FROM class) AS "FN",
       count(*) FILTER (prediction IS DISTINCT FROM class AND label IS DISTINCT FROM class) AS "TN"
FROM {table}, (VALUES ('positive'), ('negative'), ('neutral')) AS c(class) GROUP BY split, class
"""
SCORES_SQL = """
SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1,
       CASE WHEN d = 0 THEN 0 ELSE (tp * tn - fp * fn) / d END AS mcc
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
             sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS d
      FROM (SELECT split, class, "TP"::DOUBLE AS tp, "FP"::DOUBLE AS fp, "FN"::DOUBLE AS fn, "TN"::DOUBLE AS tn FROM ({a1})))
"""


def _a1(view: str) -> str:
    return A1_SQL.format(table=view)


def _scores_sql(view: str) -> str:
    return SCORES_SQL.format(a1=_a1(view))


@register("a1_confusion_metrics", V.with_views(_a1("v3_predictions")))
def a1(spark, d):
    return evaluate.confusion_metrics(V.predictions(spark, d))


@register("a1_confusion_metrics_large", V.with_views(_a1("v4_predictions_large")))
def a1_large(spark, d):
    return evaluate.confusion_metrics(V.predictions_large(spark, d))


@register("a2_scores", V.with_views(f"SELECT split, class, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, round(mcc, 9) AS mcc FROM ({_scores_sql('v3_predictions')})"))
def a2(spark, d):
    scored = evaluate.scores(evaluate.confusion_metrics(V.predictions(spark, d)))
    return scored.select("split", "class", *_round(*evaluate.METRICS))


@register("a2_long_scores", V.with_views(f"SELECT split, class, metric, round(score, 9) AS score FROM (UNPIVOT (SELECT split, class, p::DOUBLE AS precision, r::DOUBLE AS recall, f1::DOUBLE AS f1, mcc::DOUBLE AS mcc FROM ({_scores_sql('v4_predictions_large')})) ON precision, recall, f1, mcc INTO NAME metric VALUE score)"))
def a2_long(spark, d):
    scored = evaluate.scores(evaluate.confusion_metrics(V.predictions_large(spark, d)))
    return evaluate.long_scores(scored).select("split", "class", "metric", *_round("score"))


@register("a6_score_table", V.with_views(f"SELECT split AS condition, round(max(f1) FILTER (class = 'positive'), 9) AS positive, round(max(f1) FILTER (class = 'negative'), 9) AS negative, round(max(f1) FILTER (class = 'neutral'), 9) AS neutral FROM ({_scores_sql('v3_predictions')}) GROUP BY split"))
def a6(spark, d):
    table = evaluate.score_table(evaluate.scores(evaluate.confusion_metrics(V.predictions(spark, d))), "f1")
    return table.select("condition", *_round("positive", "negative", "neutral"))


@register("a6_extract_class", V.with_views(f"SELECT * FROM ({_a1('v3_predictions')}) WHERE class = 'negative'"))
def a6_class(spark, d):
    return evaluate.extract_class(evaluate.confusion_metrics(V.predictions(spark, d)), "negative")


@register("j6_compare_to_baseline", V.with_views(f"""
SELECT n.split AS condition, n.class, round(n.mcc, 9) AS score, round(b.mcc, 9) AS baseline, round(n.mcc - b.mcc, 9) AS delta
FROM ({_scores_sql('v4_predictions_large')}) n LEFT JOIN (SELECT * FROM ({_scores_sql('v4_predictions_large')}) WHERE split = '{CLEAN}') b USING (class)
WHERE n.split <> '{CLEAN}'"""))
def j6(spark, d):
    scored = evaluate.scores(evaluate.confusion_metrics(V.predictions_large(spark, d)))
    return evaluate.compare_to_baseline(scored, "mcc").select("condition", "class", *_round("score", "baseline", "delta"))


@register("m1_merge_labeled", V.with_views("SELECT dialog_id, prediction, label, split, NULL AS file, 'large' AS source FROM v4_predictions_large UNION ALL SELECT dialog_id, prediction, label, split, file, 'small' FROM v3_predictions"))
def m1(spark, d):
    large = V.predictions_large(spark, d).select("dialog_id", "prediction", "label", "split")
    small = V.predictions(spark, d).select("dialog_id", "prediction", "label", "split", "file")
    return merge.merge_labeled(spark, [(large, "large"), (small, "small")])


@register("m1_merge_files", V.with_views("SELECT dialog_id::BIGINT AS dialog_id, prediction, label, split, NULL AS file, 'large' AS source FROM v4_predictions_large UNION ALL SELECT dialog_id::BIGINT, prediction, label, split, file, 'small' FROM v3_predictions"))
def m1_files(spark, d):
    """The same from labelled CSV files."""
    base = _folder(spark, "labelled")
    V.predictions_large(spark, d).select("dialog_id", "prediction", "label", "split").write.option("header", True).csv(f"{base}/large")
    V.predictions(spark, d).select("dialog_id", "prediction", "label", "split", "file").write.option("header", True).csv(f"{base}/small")
    return readers.merge_csv(spark, [(f"{base}/large", "large"), (f"{base}/small", "small")])


@register("m2_merge_splits", V.with_views("SELECT dialog_id, file, prediction, label, CASE dialog_id % 3 WHEN 0 THEN 'train_split' WHEN 1 THEN 'dev_splits_complete' ELSE 'output_repeated_splits_test' END AS split FROM v3_predictions"))
def m2(spark, d):
    p = V.predictions(spark, d).select("dialog_id", "file", "prediction", "label", "split")
    return merge.merge_splits(spark, *[p.filter(F.col("dialog_id") % 3 == i) for i in range(3)])


@register("m3_combine_runs", V.with_views(_a1("(SELECT split, prediction, label FROM v3_predictions UNION ALL SELECT split, prediction, label FROM v4_predictions_large)")))
def m3(spark, d):
    p = V.predictions(spark, d)
    clean, noisy = p.filter(F.col("split") == CLEAN), p.filter(F.col("split") != CLEAN)
    return merge.combine_runs(clean, noisy, V.predictions_large(spark, d))


@register("p8_parse_condition", V.with_views(r"""
SELECT dialog_id, split_part(split, '/', 1) AS condition, nullif(regexp_extract(split, '^([AVT])=(.+)_S=(-?\d+)$', 1), '') AS modality,
       nullif(regexp_extract(split, '^([AVT])=(.+)_S=(-?\d+)$', 2), '') AS corruption, TRY_CAST(nullif(regexp_extract(split, '^([AVT])=(.+)_S=(-?\d+)$', 3), '') AS INTEGER) AS severity
FROM v3_predictions"""))
def p8(spark, d):
    p = V.predictions(spark, d).withColumn("label_path", F.concat("split", F.lit("/x")))
    return p.select("dialog_id", *[c.alias(k) for k, c in P.parse_condition(F.col("label_path")).items()])


@register("p9_severity_rate", V.with_views("SELECT dialog_id, greatest(1, least(5, dialog_id % 9 - 2))::INTEGER AS severity, [0.03, 0.1, 0.2, 0.4, 0.5][greatest(1, least(5, dialog_id % 9 - 2))]::DOUBLE AS rate FROM v3_predictions"))
def p9(spark, d):
    s = (F.col("dialog_id") % 9 - 2).cast("int")
    return V.predictions(spark, d).select("dialog_id", P.clamp_severity(s).alias("severity"), P.severity_rate(s).alias("rate"))


# ---- names and lookups

IDS_SQL = r"""
coalesce(TRY_CAST(nullif(regexp_extract(name, '(?i)\bdia(\d+)_utt(\d+)\b', {g}), '') AS BIGINT), -1)"""
LENIENT_SQL = r"TRY_CAST(nullif(regexp_extract(name, '(?i)dia(\d+)_utt(\d+)', {g}), '') AS BIGINT)"


@register("p1_parse_ids", V.with_views(f"SELECT split, name, {IDS_SQL.format(g=1)} AS dialog_id, {IDS_SQL.format(g=2)} AS utterance_id FROM v2_media"))
def p1(spark, d):
    a, b = P.parse_ids(F.col("path"))
    return V.media(spark, d).select("split", "name", a.alias("dialog_id"), b.alias("utterance_id"))


@register("p2_parse_ids_lenient", V.with_views(f"SELECT split, name, {LENIENT_SQL.format(g=1)} AS dialog_id, {LENIENT_SQL.format(g=2)} AS utterance_id FROM v2_media"))
def p2(spark, d):
    a, b = P.parse_ids_lenient(F.col("path"))
    return V.media(spark, d).select("split", "name", a.alias("dialog_id"), b.alias("utterance_id"))


REPLY_SQL = r"""
CASE WHEN regexp_extract(t, '(?i)\bassistant\b\s*[:\-]?\s*([\s\S]+)$', 1) <> ''
     THEN regexp_replace(regexp_extract(t, '(?i)\bassistant\b\s*[:\-]?\s*([\s\S]+)$', 1), '^\s+|\s+$', '', 'g')
     ELSE coalesce(regexp_replace(list_filter(regexp_split_to_array(t, '\r\n|[\n\r]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')[-1], '^\s+|\s+$', '', 'g'), '') END"""


@register("p3_extract_reply", V.with_views(f"SELECT dialog_id, {REPLY_SQL} AS reply FROM (SELECT dialog_id, transcript AS t FROM v7_transcripts)"))
def p3(spark, d):
    return V.transcripts(spark, d).select("dialog_id", P.extract_reply(F.col("transcript")).alias("reply"))


@register("p4_clean_text", V.with_views(r"SELECT dialog_id, utterance_id, _pos, regexp_replace(chr(9) || utterance || chr(10), '^\s+|\s+$', '', 'g') AS utterance FROM v1_utterances"))
def p4(spark, d):
    return V.utterances(spark, d).select("dialog_id", "utterance_id", "_pos", P.clean_text(F.concat(F.lit("\t"), "utterance", F.lit("\n"))).alias("utterance"))


@register("p5_paths", V.with_views(r"""
SELECT split, name, '/data/' || split || '/unmodified/audio_only/' || s || '.wav' AS wav, '/out/A=mp3_S=3/' || s || '.mkv' AS out_path,
       '/out/A=mp3_S=3/' || s || '.mp4' AS mp4_path, '/out/A=mp3_S=3/audio_only/' || s || '.wav' AS out_wav
FROM (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS s FROM v2_media)"""))
def p5(spark, d):
    video, mp4, wav = P.output_paths(F.col("name"), F.lit("/out"), F.lit("A=mp3_S=3"))
    return V.media(spark, d).select("split", "name", P.wav_path(F.col("path")).alias("wav"), video.alias("out_path"), mp4.alias("mp4_path"), wav.alias("out_wav"))


@register("p6_normalize_modalities", V.with_views("""
SELECT dialog_id, CASE WHEN bad = '' AND n > 0 THEN array_to_string(o, ',') END AS modalities, CASE WHEN bad <> '' THEN 'unknown: ' || bad WHEN n = 0 THEN 'nothing selected' END AS error
FROM (SELECT *, array_to_string(list_filter(o, lambda x: x NOT IN ('audio', 'text', 'video')), ',') AS bad, len(o) AS n
      FROM (SELECT dialog_id, list_sort(list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS o
            FROM (SELECT dialog_id, CASE dialog_id % 5 WHEN 0 THEN ' Text,video, text' WHEN 1 THEN 'AUDIO' WHEN 2 THEN ' , ' WHEN 3 THEN 'text,' || label END AS s FROM v3_predictions)))"""))
def p6(spark, d):
    k = F.col("dialog_id") % 5
    options = F.when(k == 0, " Text,video, text").when(k == 1, "AUDIO").when(k == 2, " , ").when(k == 3, F.concat(F.lit("text,"), "label"))
    chosen, error = P.normalize_modalities(options)
    return V.predictions(spark, d).select("dialog_id", F.array_join(chosen, ",").alias("modalities"), error.alias("error"))


@register("p6_normalize_splits", V.with_views("""
SELECT dialog_id, CASE WHEN bad = '' AND n > 0 THEN array_to_string(o, ',') END AS splits, CASE WHEN bad <> '' THEN 'unknown: ' || bad WHEN n = 0 THEN 'nothing selected' END AS error
FROM (SELECT *, array_to_string(list_filter(o, lambda x: x NOT IN ('test', 'train', 'val')), ',') AS bad, len(o) AS n
      FROM (SELECT dialog_id, list_sort(list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS o
            FROM (SELECT dialog_id, CASE dialog_id % 4 WHEN 0 THEN ' Val,train ,VAL' WHEN 1 THEN ',' WHEN 2 THEN 'test, ' || split END AS s FROM v3_predictions)))"""))
def p6_splits(spark, d):
    k = F.col("dialog_id") % 4
    options = F.when(k == 0, " Val,train ,VAL").when(k == 1, ",").when(k == 2, F.concat(F.lit("test, "), "split"))
    chosen, error = P.normalize_splits(options)
    return V.predictions(spark, d).select("dialog_id", F.array_join(chosen, ",").alias("splits"), error.alias("error"))


@register("p7_build_request", V.with_views("""
SELECT dialog_id, utterance_id, pos, role, type, text, video, audio FROM (
  SELECT dialog_id, utterance_id, _pos, 0 AS pos, 'system' AS role, 'text' AS type, NULL AS text, NULL AS video, NULL AS audio FROM v1_utterances
  UNION ALL SELECT dialog_id, utterance_id, _pos, 1, 'user', 'video', NULL, 'v/' || dialog_id, NULL FROM v1_utterances WHERE dialog_id % 2 = 0
  UNION ALL SELECT dialog_id, utterance_id, _pos, CASE WHEN dialog_id % 2 = 0 THEN 2 ELSE 1 END, 'user', 'text', utterance, NULL, NULL FROM v1_utterances)"""))
def p7(spark, d):
    u = V.utterances(spark, d)
    chosen = F.when(F.col("dialog_id") % 2 == 0, F.array(F.lit("text"), F.lit("video"))).otherwise(F.array(F.lit("text")))
    request = predict.build_request(chosen, F.col("utterance"), F.concat(F.lit("v/"), "dialog_id"), F.lit("a"))
    flat = u.select("dialog_id", "utterance_id", F.explode(request).alias("m"))
    flat = flat.select("dialog_id", "utterance_id", "m.role", F.posexplode("m.content").alias("at", "c"))
    pos = F.when(F.col("role") == "system", 0).otherwise(F.col("at") + 1)
    text = F.when(F.col("role") == "user", F.col("c.text"))
    return flat.select("dialog_id", "utterance_id", pos.alias("pos"), "role", "c.type", text.alias("text"), "c.video", "c.audio")


@register("p10_parse_probe", V.with_views(r"""
SELECT event_id, TRY_CAST(nullif(regexp_extract(volume_log, 'mean_volume:\s*(-?[0-9]+\.?[0-9]*) dB', 1), '') AS DOUBLE) AS mean_db,
       TRY_CAST(nullif(regexp_extract(volume_log, 'max_volume:\s*(-?[0-9]+\.?[0-9]*) dB', 1), '') AS DOUBLE) AS max_db,
       coalesce(list_sum(list_transform(regexp_extract_all(silence_log, 'silence_duration:\s*([0-9]+\.?[0-9]*)', 1), lambda x: x::DOUBLE)), 0) AS silence_seconds,
       coalesce(json_array_length(streams_json, '$.streams'), 0)::INTEGER AS n_streams, (streams_json->>'$.streams[0].channels')::INTEGER AS channels, (streams_json->>'$.streams[0].sample_rate')::INTEGER AS sample_rate,
       round(CASE avg_frame_rate WHEN '24000/1001' THEN 24000.0 / 1001 ELSE 25 END, 9) AS fps, coalesce(duration, 1.0) AS seconds
FROM v8_probe"""))
def p10(spark, d):
    out = quality.probe(V.probe(spark, d))
    return out.select("event_id", "mean_db", "max_db", "silence_seconds", "n_streams", "channels", "sample_rate", *_round("fps"), "seconds")


P11_SQL = r"""
SELECT file, reason, CASE WHEN reason = 'silent' THEN mean_db END AS mean_db, CASE WHEN reason = 'silent' THEN max_db END AS max_db,
       round(CASE WHEN reason = 'silent' THEN coverage END, 9) AS silence_coverage
FROM (SELECT *, CASE WHEN probe_error IS NOT NULL THEN 'error: ' || probe_error WHEN n = 0 THEN 'no_audio'
                     WHEN coalesce(max_db < -50, false) OR coalesce(mean_db < -60, false) OR coalesce(coverage > 0.9, false) THEN 'silent' END AS reason
      FROM (SELECT *, quiet / duration AS coverage FROM (
        SELECT file, probe_error, duration, regexp_extract(volume_log, 'mean_volume:\s*(-?[0-9.]+) dB', 1)::DOUBLE AS mean_db, regexp_extract(volume_log, 'max_volume:\s*(-?[0-9.]+) dB', 1)::DOUBLE AS max_db,
               coalesce(list_sum(list_transform(regexp_extract_all(silence_log, 'silence_duration:\s*([0-9.]+)', 1), lambda x: x::DOUBLE)), 0) AS quiet,
               coalesce(json_array_length(streams_json, '$.streams'), 0) AS n FROM v8_probe)))
WHERE reason IS NOT NULL"""


@register("p11_silence_flag", V.with_views(P11_SQL))
def p11(spark, d):
    return quality.audio_report(quality.probe(V.probe(spark, d))).select("file", "reason", "mean_db", "max_db", *_round("silence_coverage"))


# ---- metadata and files

FIRST_SQL = "SELECT split, dialog_id, utterance_id, _pos, utterance, sentiment FROM v1_utterances QUALIFY row_number() OVER (PARTITION BY split, dialog_id, utterance_id ORDER BY _pos) = 1"


@register("w1_first_metadata", V.with_views(FIRST_SQL))
def w1(spark, d):
    return metadata.first_metadata(V.utterances(spark, d))


J1_SQL = rf"""
SELECT m.split, m.name, m.path, m.dialog_id, m.utterance_id, regexp_replace(coalesce(t.utterance, ''), '^\s+|\s+$', '', 'g') AS utterance, coalesce(l.sentiment, 'unknown') AS label
FROM (SELECT *, {IDS_SQL.format(g=1)} AS dialog_id, {IDS_SQL.format(g=2)} AS utterance_id, {LENIENT_SQL.format(g=1)} AS ld, {LENIENT_SQL.format(g=2)} AS lu FROM v2_media) m
LEFT JOIN ({FIRST_SQL}) t ON m.split = t.split AND m.dialog_id = t.dialog_id AND m.utterance_id = t.utterance_id
LEFT JOIN ({FIRST_SQL}) l ON m.split = l.split AND m.ld = l.dialog_id AND m.lu = l.utterance_id"""


@register("j1_attach_metadata", V.with_views(J1_SQL))
def j1(spark, d):
    return metadata.attach_metadata(V.media(spark, d), V.utterances(spark, d))


@register("p12_invalid_labels", V.with_views(f"SELECT split, name, dialog_id, utterance_id, label FROM ({J1_SQL}) WHERE label NOT IN ('neutral', 'positive', 'negative')"))
def p12(spark, d):
    return metadata.invalid_labels(j1(spark, d), LABELS).select("split", "name", "dialog_id", "utterance_id", "label")


def _wavs(spark, d):
    """WAVs of the files of even length of name."""
    return V.media(spark, d).filter(F.length("name") % 2 == 0).select(P.wav_path(F.col("path")).alias("wav_path"))


@register("j2_missing_audio", V.with_views(r"""
WITH w AS (SELECT *, '/data/' || split || '/unmodified/audio_only/' || regexp_replace(name, '\.[^.]*$', '') || '.wav' AS wav_path FROM v2_media)
SELECT split, name, 'Missing audio wav: ' || wav_path AS error FROM w WHERE wav_path NOT IN (SELECT wav_path FROM w WHERE length(name) % 2 = 0)"""))
def j2(spark, d):
    return metadata.check_audio(V.media(spark, d), _wavs(spark, d))[1].select("split", "name", "error")


@register("j2_present_audio", V.with_views(r"""
WITH w AS (SELECT *, '/data/' || split || '/unmodified/audio_only/' || regexp_replace(name, '\.[^.]*$', '') || '.wav' AS wav_path FROM v2_media)
SELECT split, name, wav_path FROM w WHERE wav_path IN (SELECT wav_path FROM w WHERE length(name) % 2 = 0)"""))
def j2_present(spark, d):
    return metadata.check_audio(V.media(spark, d), _wavs(spark, d))[0].select("split", "name", "wav_path")


FILES_SQL = f"(SELECT name, {LENIENT_SQL.format(g=1)} AS dialog_id, {LENIENT_SQL.format(g=2)} AS utterance_id FROM v2_media)"
PAIRS_SQL = f"""
SELECT coalesce(m.dialog_id, f.dialog_id) AS dialog_id, coalesce(m.utterance_id, f.utterance_id) AS utterance_id, coalesce(n_meta, 0) AS n_meta, coalesce(n_files, 0) AS n_files,
       CASE WHEN coalesce(m.dialog_id, f.dialog_id) IS NULL THEN 'unparsed' WHEN n_files IS NULL THEN 'meta_only' WHEN n_meta IS NULL THEN 'files_only' ELSE 'matched' END AS status
FROM (SELECT dialog_id, utterance_id, count(*) AS n_meta FROM v1_utterances GROUP BY ALL) m
FULL JOIN (SELECT dialog_id, utterance_id, count(*) AS n_files FROM {FILES_SQL} GROUP BY ALL) f ON m.dialog_id = f.dialog_id AND m.utterance_id = f.utterance_id"""


@register("j3_reconcile_pairs", V.with_views(PAIRS_SQL))
def j3(spark, d):
    return reconcile.reconcile_pairs(V.utterances(spark, d), V.media(spark, d))


@register("a3_duplicate_keys", V.with_views("SELECT dialog_id, utterance_id, count(*) AS n FROM v1_utterances GROUP BY ALL HAVING count(*) > 1"))
def a3(spark, d):
    return reconcile.duplicate_keys(V.utterances(spark, d))


@register("a4_reconcile_summary", V.with_views(f"""
SELECT CAST(sum(n_files) AS BIGINT) AS total_files, CAST(sum(n_meta) AS BIGINT) AS meta_rows, count(*) FILTER (status IN ('matched', 'meta_only')) AS unique_meta_pairs,
       count(*) FILTER (status IN ('matched', 'files_only')) AS unique_file_pairs, count(*) FILTER (n_meta > 1) AS duplicate_meta_pairs_count,
       count(*) FILTER (status = 'meta_only') AS meta_only_count, count(*) FILTER (status = 'files_only') AS files_only_count,
       CAST(coalesce(sum(n_files) FILTER (status = 'unparsed'), 0) AS BIGINT) AS parse_errors FROM ({PAIRS_SQL})"""))
def a4(spark, d):
    return reconcile.reconcile_summary(j3(spark, d))


@register("w2_last_name_per_pair", V.with_views(f"SELECT dialog_id, utterance_id, max(name) AS name FROM {FILES_SQL} WHERE dialog_id IS NOT NULL GROUP BY ALL"))
def w2(spark, d):
    return reconcile.last_name_per_pair(V.media(spark, d))


@register("m4_meta_without_file", V.with_views(f"SELECT dialog_id, utterance_id FROM v1_utterances EXCEPT SELECT dialog_id, utterance_id FROM {FILES_SQL}"))
def m4(spark, d):
    return reconcile.pair_difference(V.utterances(spark, d), reconcile.file_pairs(V.media(spark, d)))


@register("m4_file_without_meta", V.with_views(f"SELECT dialog_id, utterance_id FROM {FILES_SQL} WHERE dialog_id IS NOT NULL EXCEPT SELECT dialog_id, utterance_id FROM v1_utterances"))
def m4_files(spark, d):
    return reconcile.pair_difference(reconcile.file_pairs(V.media(spark, d)), V.utterances(spark, d))


@register("l2_examples", V.with_views(f"SELECT dialog_id, utterance_id FROM ({PAIRS_SQL}) WHERE status = 'meta_only' ORDER BY dialog_id, utterance_id LIMIT 50"))
def l2(spark, d):
    pairs = reconcile.reconcile_pairs(V.utterances(spark, d), V.media(spark, d))
    return reconcile.examples(pairs.filter(F.col("status") == "meta_only").select("dialog_id", "utterance_id"), 50)


@register("l1_ordered_sample", V.with_views("SELECT split, path FROM v2_media ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, path LIMIT 200"))
def l1(spark, d):
    return plans.ordered_sample(V.media(spark, d), 200, ["test", "val", "train"]).select("split", "path")


# ---- plans

CATALOG = f"(SELECT * FROM {catalog_sql()} WHERE severity = 3 AND modality IN ('A', 'V'))"
PLAN_SQL = rf"""
SELECT name, path, modality, corruption, severity, params, modality || '=' || corruption || '_S=3' AS condition,
       '/out/' || modality || '=' || corruption || '_S=3/' || regexp_replace(name, '\.[^.]*$', '') || '.mkv' AS out_path
FROM v2_media, {CATALOG}"""


def _text(params):
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@register("j5_corruption_plan", V.with_views(PLAN_SQL))
def j5(spark, d):
    plan = plans.corruption_plan(V.media(spark, d).select("name", "path"), corruption_catalog(spark), "/out", 3)
    return plan.select("name", "path", "modality", "corruption", "severity", _text("params").alias("params"), "condition", "out_path")


def _existing(plan):
    return plan.filter((F.length("out_path") % 3 == 0) & (F.col("modality") == "A")).select("out_path")


EXISTING = "length(out_path) % 3 = 0 AND modality = 'A'"


@register("j4_pending_work", V.with_views(f"SELECT name, condition, out_path FROM ({PLAN_SQL}) WHERE out_path NOT IN (SELECT out_path FROM ({PLAN_SQL}) WHERE {EXISTING})"))
def j4(spark, d):
    plan = j5(spark, d)
    return plans.pending_work(plan, _existing(plan)).select("name", "condition", "out_path")


@register("a5_job_accounting", V.with_views(f"""
WITH p AS ({PLAN_SQL}), s AS (
  SELECT condition, CASE WHEN out_path IN (SELECT out_path FROM p WHERE {EXISTING}) THEN 'skipped' WHEN out_path IN (SELECT out_path FROM p WHERE length(out_path) % 5 = 0) THEN 'failed' ELSE 'ok' END AS status FROM p)
SELECT condition, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM s GROUP BY condition"""))
def a5(spark, d):
    plan = j5(spark, d)
    return quality.job_accounting(plan, _existing(plan), plan.filter(F.length("out_path") % 5 == 0).select("out_path"))


@register("g6_corruption_catalog", V.with_views(rf"""
SELECT c.modality, c.corruption, c.severity, c.params, count(p.dialog_id) AS n FROM {catalog_sql()} c
LEFT JOIN v3_predictions p ON p.split = c.modality || '=' || c.corruption || '_S=' || c.severity GROUP BY ALL"""))
def g6(spark, d):
    """Every entry of the catalogue with the number of predictions made under it."""
    cat = corruption_catalog(spark).withColumn("split", P.condition_name(F.col("modality"), F.col("corruption"), F.col("severity")))
    made = V.predictions(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    out = cat.join(made, "split", "left")
    return out.select("modality", "corruption", "severity", _text("params").alias("params"), F.coalesce("n", F.lit(0)).alias("n"))


@register("s3_split_configs", V.with_views(r"""
SELECT DISTINCT regexp_extract(path, '^(.*/[AVT]=[^/]+_S=\d+)/', 1) AS dir, 'r/train_splits/train_sent_emo.csv' AS metadata, regexp_extract(path, '/([AVT]=[^/]+_S=\d+)/', 1) AS condition
FROM (SELECT 'r/train_splits/audio/' || split || '/' || file AS path FROM v3_predictions) WHERE regexp_matches(path, '/A=[^/]+_S=\d+/')
UNION ALL SELECT DISTINCT 'r/train_splits/unmodified', regexp_extract(path, '^(.*/T=[^/]+_S=\d+)/', 1) || '/metadata.csv', regexp_extract(path, '/(T=[^/]+_S=\d+)/', 1)
FROM (SELECT 'r/train_splits/audio/' || split || '/' || file AS path FROM v3_predictions) WHERE regexp_matches(path, '/T=[^/]+_S=\d+/')"""))
def s3(spark, d):
    paths = V.predictions(spark, d).select(F.concat(F.lit("r/train_splits/audio/"), "split", F.lit("/"), "file").alias("path"))
    return readers.split_configs(paths, "r", "train", ["audio", "text"])


@register("s2_media_suffix", V.with_views("SELECT split, name FROM v2_media WHERE lower(name) LIKE '%.mp4'"))
def s2(spark, d):
    return readers.with_suffix(V.media(spark, d).select("split", "path"), [".mp4"]).select("split", "name")


# ---- prediction

def toy_predictor():
    """The stand-in views' rule on the share of the letter e, as a predictor loaded once in each task."""

    def predict_batch(batch: pd.DataFrame) -> list:
        if (batch["text"].str.len() % 41 == 0).any():
            raise ValueError("text length is a multiple of 41")
        rest = batch["text"].str.len() - batch["text"].str.count("e")
        share, size = rest * 100, batch["text"].str.len()
        label = pd.Series("negative", index=batch.index)
        label[share < size * 91] = "neutral"
        label[share < size * 88] = "positive"
        return ("assistant: " + label).tolist()

    return predict_batch


TOY = "CASE WHEN length(replace({t}, 'e', '')) * 100 < length({t}) * 88 THEN 'positive' WHEN length(replace({t}, 'e', '')) * 100 < length({t}) * 91 THEN 'neutral' ELSE 'negative' END"


def _results(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return predict.batch_predict(docs, toy_predictor, ["doc_id"], ["text"])


@register("b1_batch_predict", f"SELECT doc_id, CASE WHEN length(text) % 41 <> 0 THEN 'assistant: ' || {TOY.format(t='text')} END AS transcript, CASE WHEN length(text) % 41 = 0 THEN 'text length is a multiple of 41' END AS error FROM documents")
def b1(spark, d):
    return _results(spark, d).select("doc_id", "transcript", "error")


def _routed(spark, d):
    """Predictions and errors, written in one pass; a second run of the batch replaces the first."""
    base, results = _folder(spark, "outcomes"), _results(spark, d)
    for _ in range(2):
        writers.write_outcomes(results, base, "first")
    return readers.read_outcomes(spark, base, results.select("doc_id").schema)


@register("b2_route_predictions", f"SELECT doc_id, {TOY.format(t='text')} AS prediction FROM documents WHERE length(text) % 41 <> 0")
def b2(spark, d):
    return _routed(spark, d)[0]


@register("b2_route_errors", "SELECT doc_id, 'text length is a multiple of 41' AS error FROM documents WHERE length(text) % 41 = 0")
def b2_errors(spark, d):
    return _routed(spark, d)[1].select("doc_id", "error")


@register("b2_outcome_counts", "SELECT count(*) FILTER (WHERE length(text) % 41 <> 0) AS ok, count(*) FILTER (WHERE length(text) % 41 = 0) AS failed, count(*) AS total FROM documents")
def b2_counts(spark, d):
    """What the write itself counts."""
    n = writers.write_outcomes(_results(spark, d), _folder(spark, "outcomes"), "first")
    return spark.createDataFrame([(n["ok"], n["failed"], n["total"])], "ok long, failed long, total long")


# ---- text noise

ELIGIBLE_SQL = {
    "keyboard": "regexp_full_match(c, '[A-Za-z]')",
    "char_replace": r"regexp_full_match(c, '\p{L}')",
    "ocr": "c IN (" + ", ".join(f"'{k}'" for k in N.CONFUSIONS) + ")",
    "char_delete": r"NOT regexp_full_match(c, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')",
}


def _draw_sql(x: str) -> str:
    p = N.PRIME
    return f"(((({x}) % {p}) * (({x}) % {p}) % {p}) * ((({x}) % {p}) * (({x}) % {p}) % {p}) % {p} * (({x}) % {p}) % {p})"


def _case_map(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def noise_sql(method: str, rate: float, source: str, seed: int = 123) -> str:
    """doc_id, text after corruption; source: a relation of (doc_id, text)."""
    at = f"({_draw_sql('h + n + i')})"
    if method == "ocr":
        new = _case_map(N.CONFUSIONS, "c")
    else:
        options = _case_map(N.NEIGHBORS, "lower(c)") if method == "keyboard" else f"'{N.LETTERS}'"
        one = f"substr({options}, CAST({at} % length({options}) + 1 AS BIGINT), 1)"
        new = f"CASE WHEN c <> lower(c) THEN upper({one}) ELSE {one} END"
    piece = f"CASE WHEN hit THEN '' ELSE c END" if method == "char_delete" else f"CASE WHEN hit THEN {new} ELSE c END"
    return f"""
SELECT doc_id, coalesce(out, text) AS text FROM (
  SELECT doc_id, any_value(text) AS text, string_agg({piece}, '' ORDER BY i) AS out FROM (
    SELECT *, coalesce(ok AND r <= k, false) AS hit FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, ok ORDER BY u) AS r FROM (
        SELECT *, {ELIGIBLE_SQL[method]} AS ok, {_draw_sql('h + i')} AS u FROM (
          SELECT doc_id, text, n, h, k, unnest(string_split(text, '')) AS c, unnest(range(n)) AS i FROM (
            SELECT doc_id, text, length(text) AS n, ('0x' || substr(md5('{seed}|{method}|' || doc_id), 1, 7))::BIGINT AS h,
                   greatest(1, floor(length(text) * {rate}::DOUBLE)::BIGINT) AS k FROM {source} WHERE text <> ''))))) GROUP BY doc_id)
UNION ALL SELECT doc_id, text FROM {source} WHERE text IS NULL OR text = ''"""


DIGEST = "length(text) AS n, md5(text) AS digest"


def _noise(method: str, severity: int) -> Query:
    def query(spark, d):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        new = N.corrupt(F.col("text"), F.col("doc_id"), method, P.severity_rate(F.lit(severity)))
        return docs.select("doc_id", new.alias("text")).select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))

    return query


for number, name in enumerate(N.METHODS, 1):
    register(f"n{number}_noise_{name}", f"SELECT doc_id, {DIGEST} FROM ({noise_sql(name, 0.2, 'documents')})")(_noise(name, 3))

UTTERANCES = "(SELECT _pos AS doc_id, utterance AS text FROM v1_utterances)"


@register("n5_corrupt_all", V.with_views(" UNION ALL ".join(f"SELECT n.doc_id AS _pos, u.sentiment, '{m}' AS corruption, 'T={m}_S=5' AS condition, n.text AS utterance FROM ({noise_sql(m, 0.5, UTTERANCES)}) n JOIN v1_utterances u ON u._pos = n.doc_id" for m in N.METHODS)))
def n5(spark, d):
    out = N.corrupt_all(V.utterances(spark, d), "utterance", F.col("_pos"), severity=9)
    return out.select("_pos", "sentiment", "corruption", "condition", "utterance")


# ---- signals

def _signal(column, *more) -> Query:
    def query(spark, d):
        s = V.signals(spark, d)
        out = s.select("clip_id", column(F.col("samples"), F.col("clip_id")).alias("s"))
        return out.select("clip_id", F.size("s").cast("bigint").alias("n"), F.array_join(F.transform("s", lambda v: (F.round(v * 1e6) + 0.0).cast("bigint").cast("string")), ",").alias("samples"))

    return query


def _signal_sql(expr: str) -> str:
    return V.with_views(f"SELECT clip_id, len(s) AS n, array_to_string(list_transform(s, lambda v: CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR)), ',') AS samples FROM (SELECT clip_id, {expr} AS s FROM (SELECT *, ('0x' || substr(md5('123|{{m}}|' || clip_id), 1, 7))::BIGINT AS h, len(samples) AS n FROM v5_signals))")


RATE = 100
register("g1_snr_white", _signal_sql(f"list_transform(samples, lambda x, i: greatest(-0.98, least(0.98, x + {10 ** (-10 / 20)!r} * (2.0::DOUBLE * {_draw_sql('h + i - 1')} / {N.PRIME} - 1.0))))").replace("{m}", "snr_white"))(_signal(lambda s, k: S.snr_white(s, k, 3)))
register("g2_bitcrush", _signal_sql(f"list_transform(range(1, n + 1), lambda i: floor(0.5 * tanh(16.0::DOUBLE * {10 ** (48 / 20)!r} * samples[i - (i - 1) % 8]) * 1.0 + 0.5) / 1.0::DOUBLE)"))(_signal(lambda s, k: S.bitcrush(s, 4)))
register("g2_bitcrush_mild", _signal_sql(f"list_transform(samples, lambda x: floor(0.5 * tanh(5.0::DOUBLE * {10 ** (26 / 20)!r} * x) * 64.0 + 0.5) / 64.0::DOUBLE)"))(_signal(lambda s, k: S.bitcrush(s, 1)))
register("g3_echo", _signal_sql("list_transform(samples, lambda x, i: 0.9::DOUBLE * (0.8::DOUBLE * x + 0.65::DOUBLE * coalesce(CASE WHEN i > 12 THEN samples[i - 12] END, 0) + 0.4::DOUBLE * coalesce(CASE WHEN i > 20 THEN samples[i - 20] END, 0)))"))(_signal(lambda s, k: S.echo(s, RATE, 3)))
register("g4_compress_silence", _signal_sql("list_concat(list_transform(range(n - floor(n / 1.6::DOUBLE)::BIGINT), lambda i: 0.0::DOUBLE), list_transform(range(floor(n / 1.6::DOUBLE)::BIGINT), lambda j: samples[CAST(floor(j * 1.6::DOUBLE) AS BIGINT) + 1]))"))(_signal(lambda s, k: S.compress_silence(s, RATE, 2)))


def _jitter_sql(size: int, half: str) -> str:
    u = _draw_sql("h + i")
    return V.with_views(f"""
SELECT clip_id, count(*) AS n, string_agg(CAST(CAST(round(samples[spot + 1] * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY u, spot) AS samples FROM (
  SELECT clip_id, samples, spot, CASE WHEN i < {half} THEN {u} ELSE {N.PRIME} + i END AS u FROM (
    SELECT clip_id, samples, h, spot, spot // {size} AS i, CAST(ceil(n / {size}.0::DOUBLE) AS BIGINT) AS m FROM (
      SELECT clip_id, samples, len(samples) AS n, ('0x' || substr(md5('123|jitter|' || clip_id), 1, 7))::BIGINT AS h, unnest(range(len(samples))) AS spot FROM v5_signals))) GROUP BY clip_id""")


# 64 samples: a rate of 10 gives segments of 4 and 8 samples at severities 4 and 5, of 1 and 2 below
register("g5_jitter_half", _jitter_sql(4, "m // 2"))(_signal(lambda s, k: S.jitter(s, k, 10, 4)))
register("g5_jitter_all", _jitter_sql(8, "m"))(_signal(lambda s, k: S.jitter(s, k, 10, 5)))


def _swaps_sql(size: int, percent: int, adjacent: bool) -> str:
    i, j = f"{_draw_sql('h + 2 * t')} % {'(m - 1)' if adjacent else 'm'}", f"{_draw_sql('h + 2 * t + 1')} % m"
    return V.with_views(f"""
WITH RECURSIVE clips AS (
  SELECT clip_id, samples, len(samples) AS n, CAST(ceil(len(samples) / {size}.0::DOUBLE) AS BIGINT) AS m, ('0x' || substr(md5('123|jitter|' || clip_id), 1, 7))::BIGINT AS h FROM v5_signals),
steps AS (
  SELECT clip_id, m, h, CAST(0 AS BIGINT) AS t, range(m) AS o FROM clips
  UNION ALL
  SELECT clip_id, m, h, t + 1, list_transform(o, lambda x, k: CASE WHEN k = i + 1 THEN o[j + 1] WHEN k = j + 1 THEN o[i + 1] ELSE x END)
  FROM (SELECT *, {i} AS i, {i + ' + 1' if adjacent else j} AS j FROM steps WHERE m > 1 AND t < greatest(1, m * {percent} // 100))),
last AS (SELECT clip_id, o FROM steps QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY t DESC) = 1)
SELECT clip_id, n, array_to_string(list_transform(flatten(list_transform(o, lambda b: samples[b * {size} + 1 : b * {size} + {size}])), lambda v: CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR)), ',') AS samples
FROM clips JOIN last USING (clip_id)""")


register("g5_jitter_few", _swaps_sql(1, 1, True))(_signal(lambda s, k: S.jitter(s, k, 10, 1)))
register("g5_jitter_swaps", _swaps_sql(1, 5, True))(_signal(lambda s, k: S.jitter(s, k, 10, 2)))
register("g5_jitter_any", _swaps_sql(2, 20, False))(_signal(lambda s, k: S.jitter(s, k, 10, 3)))


# ---- time series

RUNS_SQL = f"""
SELECT series_id, start_us, end_us, (end_us - start_us) / 1e6::DOUBLE AS seconds FROM (
  SELECT series_id, run, min(us) AS start_us, max(until) AS end_us FROM (
    SELECT *, sum(turn) OVER (PARTITION BY series_id ORDER BY us, value NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT series_id, us, value, quiet, coalesce(CAST(quiet <> lag(quiet) OVER w AS INTEGER), 0) AS turn, coalesce(lead(us) OVER w, us) AS until
      FROM (SELECT series_id, epoch_us(ts) AS us, value, coalesce(value < {BELOW}, false) AS quiet FROM v6_series) WINDOW w AS (PARTITION BY series_id ORDER BY us, value NULLS FIRST)))
  WHERE quiet GROUP BY ALL) WHERE end_us - start_us >= {HOUR}"""


@register("w3_silence_runs", V.with_views(f"SELECT series_id, start_us, end_us, round(seconds, 6) AS seconds FROM ({RUNS_SQL})"))
def w3(spark, d):
    return timeseries.silence_runs(V.series(spark, d), "series_id", BELOW, HOUR).select("series_id", "start_us", "end_us", *_round("seconds", places=6))


@register("a7_silence_coverage", V.with_views(f"""
SELECT a.series_id, round(CASE WHEN all_s > 0 THEN coalesce(quiet_s, 0) / all_s END, 9) AS coverage
FROM (SELECT series_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE AS all_s FROM v6_series GROUP BY series_id) a
LEFT JOIN (SELECT series_id, sum(seconds) AS quiet_s FROM ({RUNS_SQL}) GROUP BY series_id) q USING (series_id)"""))
def a7(spark, d):
    return timeseries.silence_coverage(V.series(spark, d), "series_id", BELOW, HOUR).select("series_id", *_round("coverage"))


@register("w4_fps_drop", V.with_views(f"SELECT series_id, us, value FROM (SELECT series_id, epoch_us(ts) AS us, value FROM v6_series) QUALIFY row_number() OVER (PARTITION BY series_id, floor(us / {6 * HOUR}::DOUBLE) ORDER BY us, value) = 1"))
def w4(spark, d):
    return timeseries.fps_drop(V.series(spark, d), "series_id", 6 * HOUR)


def _blur_sql(weights: list[float]) -> str:
    v = " + ".join(f"coalesce(lag(value, {i}) OVER w * {x}::DOUBLE, 0)" for i, x in enumerate(weights))
    t = " + ".join(f"CASE WHEN lag(value, {i}) OVER w IS NULL THEN 0 ELSE {x}::DOUBLE END" for i, x in enumerate(weights))
    return f"SELECT series_id, us, round(({v}) / nullif({t}, 0), 6) AS blurred FROM (SELECT series_id, epoch_us(ts) AS us, value FROM v6_series) WINDOW w AS (PARTITION BY series_id ORDER BY us, value NULLS FIRST)"


@register("w5_motion_blur", V.with_views(_blur_sql(timeseries.BLUR[1])))
def w5(spark, d):
    return timeseries.motion_blur(V.series(spark, d), "series_id", 2).select("series_id", "us", *_round("blurred", places=6))


# ---- streaming

@register("r1_stream_confusion", V.with_views(_a1("v3_predictions")))
def r1(spark, d):
    """Predictions arrive in two lots, the second with all of the first again; the counts are those of the batch."""
    base = _folder(spark, "stream")
    p = V.predictions(spark, d)
    p.filter(F.col("dialog_id") % 2 == 0).write.mode("append").parquet(f"{base}/in")
    stream_confusion(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    p.write.mode("append").parquet(f"{base}/in")
    stream_confusion(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    return read_running(spark, f"{base}/out")


# ---- files: each query writes, reads back and returns what it read

def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tremolo-{name}-{uuid.uuid4().hex}"


@register("s1_read_metadata", V.with_views("SELECT split, dialog_id, utterance_id, utterance, sentiment FROM v1_utterances"))
def s1(spark, d):
    base, rows = _folder(spark, "metadata"), V.utterances(spark, d)
    named = rows.select("split", F.col("dialog_id").alias("Dialogue_ID"), F.col("utterance_id").alias("Utterance_ID"), F.col("utterance").alias("Utterance"), F.col("sentiment").alias("Sentiment"))
    quoted = {"header": True, "escape": '"', "quoteAll": True, "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    named.write.partitionBy("split").options(**quoted).csv(base)
    return readers.read_metadata(spark, {s: f"{base}/split={s}" for s in ("train", "val", "test")}).drop("_pos")


@register("s2_list_media", V.with_views("SELECT split, '.txt' AS suffix, true AS named, CAST(sum(strlen(name) + 1) AS BIGINT) AS bytes FROM v2_media GROUP BY split"))
def s2_list(spark, d):
    """The names of the media, written as text in a folder for each split, whose files are listed."""
    base = _folder(spark, "listed")
    V.media(spark, d).select("split", "name").write.partitionBy("split").text(base)
    files = readers.list_media(spark, base, recursive=True, suffixes=[".TXT"])
    at = F.regexp_extract("path", r"/split=([^/]*)/([^/]*)$", 1), F.regexp_extract("path", r"/split=([^/]*)/([^/]*)$", 2)
    rows = files.select(at[0].alias("split"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("suffix"), (at[1] == F.col("name")).alias("same"), "length")
    return rows.groupBy("split", "suffix").agg(F.bool_and("same").alias("named"), F.sum("length").alias("bytes"))


@register("s4_write_predictions", V.with_views("SELECT dialog_id::BIGINT AS dialog_id, utterance_id::BIGINT AS utterance_id, file, prediction, label, split FROM v3_predictions"))
def s4(spark, d):
    base, p = _folder(spark, "predictions"), V.predictions(spark, d)
    for batch, part in (("clean", p.filter(F.col("split") == CLEAN)), ("noisy", p.filter(F.col("split") != CLEAN)), ("clean", p.filter(F.col("split") == CLEAN))):  # one batch twice
        writers.write_predictions(part, base, batch)
    return readers.read_predictions(spark, base)


@register("s5_write_errors", V.with_views(r"""
SELECT dialog_id, utterance_id, name AS file, 'Missing audio wav: ' || wav_path AS error, CASE WHEN dialog_id % 2 = 0 THEN 'line one' || chr(10) || '"line" two of ' || name END AS traceback
FROM (SELECT *, '/data/' || split || '/unmodified/audio_only/' || regexp_replace(name, '\.[^.]*$', '') || '.wav' AS wav_path FROM (""" + J1_SQL + r"""))
WHERE wav_path NOT IN (SELECT '/data/' || split || '/unmodified/audio_only/' || regexp_replace(name, '\.[^.]*$', '') || '.wav' FROM v2_media WHERE length(name) % 2 = 0)"""))
def s5(spark, d):
    """Error rows as Parquet, and from there as CSV files of both layouts, which are read as one table."""
    base = _folder(spark, "errors")
    missing = metadata.check_audio(j1(spark, d), _wavs(spark, d))[1]
    trace = F.when(F.col("dialog_id") % 2 == 0, F.concat(F.lit('line one\n"line" two of '), "name"))
    writers.write_errors(missing.select("dialog_id", "utterance_id", F.col("name").alias("file"), "error", trace.alias("traceback")), f"{base}/errors")
    errors = spark.read.schema(ERRORS).parquet(f"{base}/errors")
    for name, part in (("new", errors.filter("traceback is not null")), ("old", errors.filter("traceback is null").drop("traceback"))):
        part.write.option("header", True).option("escape", '"').csv(f"{base}/{name}")
    return readers.read_errors_csv(spark, [f"{base}/new"], [f"{base}/old"])


@register("s6_write_corrupted", V.with_views(" UNION ALL ".join(f"SELECT n.doc_id AS _pos, '{m}' AS corruption, CAST(2 AS INTEGER) AS severity, md5(n.text) AS digest FROM ({noise_sql(m, 0.1, UTTERANCES)}) n" for m in N.METHODS)))
def s6(spark, d):
    base = _folder(spark, "corrupted")
    writers.write_corrupted(N.corrupt_all(V.utterances(spark, d), "utterance", F.col("_pos"), severity=2), base)
    return spark.read.parquet(base).select("_pos", "corruption", "severity", F.md5("utterance").alias("digest"))


@register("s7_write_metrics", V.with_views(_a1("v4_predictions_large")))
def s7(spark, d):
    base = _folder(spark, "metrics")
    writers.write_metrics(evaluate.confusion_metrics(V.predictions_large(spark, d)), base)
    return readers.read_csv(spark, base, METRICS)


@register("s7_write_report", SQL["p11_silence_flag"])
def s7_report(spark, d):
    base, report = _folder(spark, "report"), p11(spark, d)
    writers.write_report(report, base)
    return readers.read_csv(spark, base, report.schema)


# ---- the flagship

FLAG_TEXTS = " UNION ALL ".join(f"SELECT doc_id, 'T={m}_S=3' AS split, text FROM ({noise_sql(m, 0.2, 'documents')})" for m in N.METHODS)
FLAG_SQL = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, '{CLEAN}' AS split, text FROM documents UNION ALL {FLAG_TEXTS}),
predicted AS MATERIALIZED (
  SELECT p.split, {TOY.format(t="p.text")} AS prediction,
         CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label
  FROM texts p LEFT JOIN labels l ON l.doc_id = p.doc_id),
scored AS MATERIALIZED ({SCORES_SQL.format(a1=A1_SQL.format(table="predicted"))})
SELECT n.split AS condition, n.class, round(n.f1, 9) AS score, round(b.f1, 9) AS baseline, round(n.f1 - b.f1, 9) AS delta
FROM scored n JOIN scored b ON n.class = b.class AND b.split = '{CLEAN}' WHERE n.split <> '{CLEAN}'"""


@register("flagship_text_robustness", FLAG_SQL)
def flagship(spark, d):
    """Corrupt the texts, predict on clean and corrupted ones, count, score, compare with the clean baseline."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    noisy = N.corrupt_all(docs, "text", F.col("doc_id"), 3).select("doc_id", F.col("condition").alias("split"), "text")
    both = docs.select("doc_id", F.lit(CLEAN).alias("split"), "text").unionByName(noisy)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    label = F.when(F.col("toxic").isNull(), "unknown").when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    named = both.select("doc_id", "split", V.toy("text").alias("prediction")).join(labels, "doc_id", "left").select("split", "prediction", label.alias("label"))
    scored = evaluate.scores(evaluate.confusion_metrics(named))
    return evaluate.compare_to_baseline(scored, "f1").select("condition", "class", *_round("score", "baseline", "delta"))
