"""The catalogue of corruptions: parameters by modality, corruption and severity, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremolo.functions import signals as S

SCHEMA = "modality string, corruption string, severity int, params map<string, string>"

# Fixed values by severity 1 to 5.
AUDIO = {
    "snr_white": {"snr_db": S.SNR_DB},
    "bitcrushing": {"pregain_db": S.PREGAIN_DB, "drive": S.DRIVE, "bits": S.BITS, "samples": S.HOLD},
    "reverb": {"in_gain": [S.IN_GAIN] * 5, "out_gain": [S.OUT_GAIN] * 5, "delays_ms": ["|".join(map(str, d)) for d in S.DELAYS_MS], "decays": ["0.25|0.20", "0.45|0.30", "0.65|0.40", "0.80|0.55", "0.90|0.70"]},
    "compress": {"tempo": S.TEMPO},
    "jitter": {"segment_s": S.SEGMENT_SECONDS},
    "mp3": {"bitrate": ["96k", "48k", "16k", "8k", "4k"], "highpass_hz": [200, 400, 600, 800, 1000], "lowpass_hz": [6000, 3000, 1500, 750, 375], "sample_rate": [22050, 16000, 8000, 5000, 3000], "noise": [0.02, 0.10, 0.30, 0.45, 0.80]},
    "bandlimit": {"low_hz": [100, 300, 500, 800, 1000], "high_hz": [6000, 3000, 1500, 1000, 500], "sample_rate": [16000, 8000, 4000, 2000, 1000], "bits": [None, None, 8, 6, 4], "noise": [0.01, 0.05, 0.20, 0.30, 0.60]},
}
VISUAL = {
    "moving_occlusion": {"box": [0.1, 0.2, 0.35, 0.50, 0.65], "speed": [0.02, 0.035, 0.06, 0.10, 0.16], "static_box": [0.05, 0.12, 0.25, 0.40, 0.65]},
    "motion_blur": {"frames": [4, 8, 14, 18, 22]},
    "zoom_blur": {"zoom": [1, 3, 5, 7, 10], "sigma": [2, 6, 10, 14, 18], "alpha": [0.75, 0.25, 0.01, 0.005, 0.001]},
    "gaussian_noise": {"strength": [8, 28, 60, 80, 100]},
    "pixelate": {"factor": [0.65, 0.4, 0.2, 0.1, 0.05]},
    "fps_drop": {"fps": [24, 15, 8, 4, 2]},
    "scale_down": {"ratio": [0.85, 0.55, 0.30, 0.20, 0.10]},
    "occlusion": {"box": [0.10, 0.26, 0.45, 0.66, 0.85]},
}
TEXT = {m: {"rate": [0.03, 0.1, 0.2, 0.4, 0.5]} for m in ("keyboard", "char_replace", "ocr", "char_delete")}


def rows() -> list[tuple]:
    out = []
    for modality, table in (("A", AUDIO), ("T", TEXT), ("V", VISUAL)):
        for corruption, params in table.items():
            for s in range(5):
                out.append((modality, corruption, s + 1, {k: str(v[s]) for k, v in sorted(params.items()) if v[s] is not None}))
    return out


def corruption_catalog(spark: SparkSession) -> DataFrame:
    """95 rows at most: a table to broadcast."""
    return spark.createDataFrame(rows(), SCHEMA)


def catalog_sql() -> str:
    """The catalogue as VALUES (modality, corruption, severity, params as text)."""
    values = ", ".join(f"('{m}', '{c}', {s}, '{';'.join(f'{k}={v}' for k, v in sorted(p.items()))}')" for m, c, s, p in rows())
    return f"(SELECT * FROM (VALUES {values}) AS t(modality, corruption, severity, params))"
