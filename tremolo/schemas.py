"""Schemas of the tables. Files are always read with these, never with inferred types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType, "string": T.StringType, "double": T.DoubleType}
    return T.StructType([T.StructField(n, kinds[k]()) for n, k in (f.split(":") for f in spec.split())])


METADATA_CSV = _struct("Dialogue_ID:string Utterance_ID:string Utterance:string Sentiment:string")
METADATA = _struct("split:string dialog_id:long utterance_id:long utterance:string sentiment:string _pos:long")
PREDICTIONS = _struct("dialog_id:long utterance_id:long file:string prediction:string label:string split:string")
ERRORS = _struct("dialog_id:long utterance_id:long file:string error:string traceback:string")
OLD_ERRORS = _struct("dialog_id:long utterance_id:long file:string error:string")
METRICS = _struct("split:string class:string TP:long FP:long FN:long TN:long")
AUDIO_REPORT = _struct("file:string reason:string mean_db:double max_db:double silence_coverage:double")
EXTRACTION_ERRORS = _struct("file:string mp4_path:string wav_path:string error:string")

#: Classes of the metrics, in their order; labels that a corpus may hold; what a failed lookup gives.
CLASSES = ["positive", "negative", "neutral"]
UNKNOWN = "unknown"
CLEAN = "unmodified"
