"""Columns parsed from names, transcripts, labels, option lists and media probes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of ids in file names and of a reply in a transcript.
STRICT = r"(?iU)\bdia(\d+)_utt(\d+)\b"
LENIENT = r"(?iU)dia(\d+)_utt(\d+)"
REPLY = r"(?iU)\bassistant\b\s*[:\-]?\s*([\s\S]+)$"
EDGES = r"(?U)^\s+|\s+$"
STREAMS = "streams array<struct<index: int, codec_name: string, channels: int, sample_rate: string>>"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def _id(name: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(basename(name), pattern, group), F.lit("")).try_cast("bigint")


def parse_ids(name: Column) -> tuple[Column, Column]:
    """(dialog, utterance) of a file name between word boundaries; (-1, -1) where there is none."""
    return tuple(F.coalesce(_id(name, STRICT, g), F.lit(-1).cast("bigint")) for g in (1, 2))


def parse_ids_lenient(name: Column) -> tuple[Column, Column]:
    """The same without word boundaries; null where there is no match."""
    return tuple(_id(name, LENIENT, g) for g in (1, 2))


def clean_text(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, EDGES, "")


def extract_reply(transcript: Column) -> Column:
    """What follows the first word "assistant", else the last line that isn't blank; "" for null and empty texts."""
    text = F.coalesce(transcript, F.lit(""))
    after = F.regexp_extract(text, REPLY, 1)
    lines = F.filter(F.split(text, r"\R"), lambda s: clean_text(s) != "")
    return F.when(after != "", clean_text(after)).otherwise(F.coalesce(clean_text(F.try_element_at(lines, F.lit(-1))), F.lit("")))


def wav_path(path: Column, subdir: str = "audio_only") -> Column:
    """The WAV beside a video: <parent>/<subdir>/<stem>.wav."""
    return F.concat(parent(path), F.lit(f"/{subdir}/"), stem(basename(path)), F.lit(".wav"))


def output_paths(name: Column, root: Column, condition: Column, ext: str = ".mkv") -> tuple[Column, Column, Column]:
    """(corrupted video, its MP4 copy, its WAV) of a file under <root>/<condition>."""
    base = F.concat(root, F.lit("/"), condition)
    return (
        F.concat(base, F.lit("/"), stem(name), F.lit(ext)),
        F.concat(base, F.lit("/"), stem(name), F.lit(".mp4")),
        F.concat(base, F.lit("/audio_only/"), stem(name), F.lit(".wav")),
    )


def normalize_list(options: Column, valid: list[str]) -> tuple[Column, Column]:
    """A comma list as (sorted distinct options in small letters, error). Null stays null without an error."""
    parts = F.filter(F.transform(F.split(options, ","), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    chosen = F.array_sort(F.array_distinct(parts))
    bad = F.array_except(chosen, F.array(*[F.lit(v) for v in valid]))
    error = F.when(F.size(bad) > 0, F.concat(F.lit("unknown: "), F.array_join(bad, ","))).when(options.isNotNull() & (F.size(chosen) == 0), F.lit("nothing selected"))
    return F.when(error.isNull(), chosen), error


def normalize_modalities(options: Column) -> tuple[Column, Column]:
    return normalize_list(options, ["audio", "text", "video"])


def normalize_splits(options: Column) -> tuple[Column, Column]:
    return normalize_list(options, ["test", "train", "val"])


def parse_condition(split: Column) -> dict[str, Column]:
    """condition (before the first slash), modality, corruption, severity of a split label such as A=mp3_S=5."""
    condition = F.split_part(split, F.lit("/"), F.lit(1))
    pattern = r"^([AVT])=(.+)_S=(-?\d+)$"
    part = lambda g: F.nullif(F.regexp_extract(condition, pattern, g), F.lit(""))
    return {"condition": condition, "modality": part(1), "corruption": part(2), "severity": part(3).try_cast("int")}


def condition_name(modality: Column, corruption: Column, severity: Column) -> Column:
    return F.concat(modality, F.lit("="), corruption, F.lit("_S="), clamp_severity(severity).cast("string"))


def clamp_severity(severity: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), severity))


def severity_rate(severity: Column) -> Column:
    """Share of a text's characters that a severity changes."""
    return F.element_at(F.array(*[F.lit(r) for r in (0.03, 0.1, 0.2, 0.4, 0.5)]), clamp_severity(severity).cast("int"))


def parse_probe(streams_json: Column, volume_log: Column, silence_log: Column, frame_rate: Column, duration: Column) -> dict[str, Column]:
    """Measurements from a media probe's output. A log without a number gives null; a frame rate of 0, or none, is 25;
    a duration of 0, or none, is 1."""
    db = lambda what: F.nullif(F.regexp_extract(volume_log, what + r":\s*(-?[0-9]+\.?[0-9]*) dB", 1), F.lit("")).try_cast("double")
    found = F.regexp_extract_all(silence_log, F.lit(r"silence_duration:\s*([0-9]+\.?[0-9]*)"), F.lit(1))
    streams = F.coalesce(F.from_json(streams_json, STREAMS)["streams"], F.array().cast("array<struct<index: int, codec_name: string, channels: int, sample_rate: string>>"))
    last = F.try_element_at(streams, F.lit(-1))
    rate = F.split(frame_rate, "/")
    num, den = F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    fps = F.try_divide(num, den)
    return {
        "mean_db": db("mean_volume"),
        "max_db": db("max_volume"),
        "silence_seconds": F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double")),
        "n_streams": F.size(streams),
        "channels": last["channels"],
        "sample_rate": last["sample_rate"].try_cast("int"),
        "fps": F.when(fps > 0, fps).otherwise(25.0),
        "seconds": F.when(duration > 0, duration).otherwise(1.0),
    }


def silence_flag(error: Column, n_streams: Column, mean_db: Column, max_db: Column, coverage: Column) -> Column:
    """Verdict of the audio check, null where there is nothing to report. A measurement that is null never counts."""
    quiet = F.coalesce(max_db < -50, F.lit(False)) | F.coalesce(mean_db < -60, F.lit(False)) | F.coalesce(coverage > 0.9, F.lit(False))
    return F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).when(n_streams == 0, F.lit("no_audio")).when(quiet, F.lit("silent"))
