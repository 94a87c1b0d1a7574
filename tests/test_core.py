"""Edge cases of the robustness operators, with golden rows, and properties of the noise."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tremolo import schemas
from tremolo.functions import parsing as P
from tremolo.functions import signals as S
from tremolo.functions import textnoise as N
from tremolo.functions.catalog import corruption_catalog
from tremolo.operators import evaluate, merge, metadata, predict, quality, reconcile, timeseries
from tremolo.plans import corruption as plans
from tremolo.sources import media, readers, records, shared, writers
from tremolo.streaming import confusion


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in rows.select(f(F.col("x"))).collect()]


# ---- parsing

def test_ids(spark):
    names = ["dia0_utt1.mp4", "a/DIA12_UTT3.MP4", "x-dia1_utt2.mp4", "final_videos_testdia93_utt6.mp4", "dia1_utt2_x.mp4", "junk.mp4", "dia99999999999999999999_utt1.mp4"]
    strict = list(zip(*[one(spark, names, lambda c, g=g: P.parse_ids(c)[g]) for g in (0, 1)], strict=True))
    assert strict == [(0, 1), (12, 3), (1, 2), (-1, -1), (-1, -1), (-1, -1), (-1, 1)]
    lenient = list(zip(*[one(spark, names, lambda c, g=g: P.parse_ids_lenient(c)[g]) for g in (0, 1)], strict=True))
    assert lenient == [(0, 1), (12, 3), (1, 2), (93, 6), (1, 2), (None, None), (None, 1)]


def test_reply(spark):
    cases = {
        "user assistant: a\nassistant: b": "a\nassistant: b", "assistant:": ":", "foo assistant": "foo assistant", "no\nlast\n\n": "last",
        "": "", "ASSISTANT -  x ": "x", "system\nx\nassistant\npositive": "positive", "my_assistant: x": "my_assistant: x", " \n\t": "", "a\r\nb \r\n": "b",
    }
    assert one(spark, list(cases), P.extract_reply) == list(cases.values())
    assert one(spark, [None], P.extract_reply) == [""]


def test_paths_lists_conditions(spark):
    assert one(spark, ["/d/train/unmodified/dia1_utt2.mp4", "/a/b.c.mp4"], P.wav_path) == ["/d/train/unmodified/audio_only/dia1_utt2.wav", "/a/audio_only/b.c.wav"]
    assert one(spark, [" Text,video, text", None, " , ", "text,smell"], lambda c: P.normalize_modalities(c)[0]) == [["text", "video"], None, None, None]
    assert one(spark, [" Text,video", None, " , ", "text,smell"], lambda c: P.normalize_modalities(c)[1]) == [None, None, "nothing selected", "unknown: smell"]
    assert one(spark, ["Train,VAL", "dev", "", None], lambda c: P.normalize_splits(c)[0]) == [["train", "val"], None, None, None]
    assert one(spark, ["Train,VAL", "dev,x", "", None], lambda c: P.normalize_splits(c)[1]) == [None, "unknown: dev,x", "nothing selected", None]
    parts = P.parse_condition(F.lit("A=mp3_S=5/x"))
    assert tuple(spark.range(1).select(*parts.values()).first()) == ("A=mp3_S=5", "A", "mp3", 5)
    assert tuple(spark.range(1).select(*P.parse_condition(F.lit("unmodified")).values()).first()) == ("unmodified", None, None, None)
    assert one(spark, [0, 3, 9, -4], P.severity_rate, "int") == [0.03, 0.2, 0.5, 0.03]
    assert one(spark, ["  a b\n"], P.clean_text) == ["a b"]


def test_silence_flag_is_strict(spark):
    rows = [(None, 1, -60.0, -50.0, 0.9), (None, 1, None, None, None), (None, 1, -60.1, -1.0, None), (None, 1, 0.0, -50.5, 0.0), (None, 1, 0.0, 0.0, 0.91), ("x", 0, None, None, None), (None, 0, -99.0, None, None)]
    df = spark.createDataFrame(rows, "e string, n int, mean double, max double, cov double")
    got = [r[0] for r in df.select(P.silence_flag(*[F.col(c) for c in df.columns])).collect()]
    assert got == [None, None, "silent", "silent", "silent", "error: x", "no_audio"]


# ---- evaluation

def test_confusion_is_null_safe(spark):
    rows = [(None, "positive"), ("positive", None), ("Neutral", "neutral"), ("negative", "negative"), (None, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "prediction string, label string, split string")
    got = {r["class"]: (r.TP, r.FP, r.FN, r.TN) for r in evaluate.confusion_metrics(df).collect()}
    assert got == {"positive": (0, 1, 1, 3), "neutral": (0, 0, 1, 4), "negative": (1, 0, 0, 4)}
    null_split = evaluate.confusion_metrics(df.withColumn("split", F.lit(None).cast("string"))).collect()
    assert all(r.split is None and r.TP + r.FP + r.FN + r.TN == 5 for r in null_split)
    assert evaluate.confusion_metrics(df.limit(0)).count() == 0


def test_scores(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(0, 0, 0, 0), (5, 0, 0, 0), (big, big, big, big)], "TP long, FP long, FN long, TN long")
    got = [tuple(r) for r in evaluate.scores(df).select("precision", "recall", "f1", "mcc").collect()]
    assert got == [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 0.0), (0.5, 0.5, 0.5, 0.0)]
    with pytest.raises(ValueError):
        evaluate.score("accuracy")


def test_baseline_may_be_missing(spark):
    df = spark.createDataFrame([("unmodified", "positive", 0.9), ("A=mp3_S=1/x", "positive", 0.4), ("A=mp3_S=1", "neutral", 0.2)], "split string, class string, f1 double")
    got = {(r["class"], r.condition): (r.baseline, r.delta) for r in evaluate.compare_to_baseline(df, "f1").collect()}
    assert got == {("positive", "A=mp3_S=1"): (0.9, -0.5), ("neutral", "A=mp3_S=1"): (None, None)}


# ---- metadata

def test_first_metadata_and_lookup(spark):
    meta = spark.createDataFrame([("train", 1, 2, " later ", "neutral", 9), ("train", 1, 2, " first ", "positive", 3), ("train", 93, 6, "lenient", None, 4), ("train", None, None, "bad", "negative", 5)], schemas.METADATA)
    files = spark.createDataFrame([("train", n) for n in ("dia1_utt2.mp4", "final_testdia93_utt6.mp4", "clip.mp4", "dia7_utt7.mp4")], "split string, name string")
    got = {r.name: (r.dialog_id, r.utterance, r.label) for r in metadata.attach_metadata(files, meta).collect()}
    assert got == {"dia1_utt2.mp4": (1, "first", "positive"), "final_testdia93_utt6.mp4": (-1, "", "unknown"), "clip.mp4": (-1, "", "unknown"), "dia7_utt7.mp4": (7, "", "unknown")}
    assert one(spark, ["1", "1.0", "1.7", "x", None], metadata.whole_number) == [1, 1, None, None, None]


def test_reconcile(spark):
    meta = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "dialog_id long, utterance_id long")
    files = spark.createDataFrame([("dia1_utt1.mp4",), ("xdia1_utt1.mp4",), ("dia9_utt9.mp4",), ("junk",)], "name string")
    pairs = reconcile.reconcile_pairs(meta, files)
    assert {(r.dialog_id, r.status, r.n_meta, r.n_files) for r in pairs.collect()} == {(1, "matched", 2, 2), (1, "meta_only", 1, 0), (9, "files_only", 0, 1), (None, "unparsed", 0, 1)}
    assert tuple(reconcile.reconcile_summary(pairs).first()) == (4, 3, 2, 2, 1, 1, 1, 1)
    assert [tuple(r) for r in reconcile.duplicate_keys(meta).collect()] == [(1, 1, 2)]
    assert {r.name for r in reconcile.last_name_per_pair(files).collect()} == {"xdia1_utt1.mp4", "dia9_utt9.mp4"}


# ---- noise

LAWS = ["", "   ", "b", "naïve É", "😀 smile 😀", None, "Hello World, keyboards make mistakes " * 5, "12 34 !!"]


@pytest.mark.parametrize("method", N.METHODS)
def test_noise_laws(spark, method):
    able = {"keyboard": lambda c: c.isascii() and c.isalpha(), "char_replace": str.isalpha, "ocr": lambda c: c in N.CONFUSIONS, "char_delete": lambda c: not c.isspace()}[method]
    df = spark.createDataFrame(list(enumerate(LAWS)), "k long, t string")
    out = df.select("k", "t", N.corrupt(F.col("t"), F.col("k"), method, F.lit(0.2)).alias("n"))
    rows = out.collect()
    for r in rows:
        if not r.t or not any(map(able, r.t)):
            assert r.n == r.t
            continue
        k = min(max(1, int(len(r.t) * 0.2)), sum(map(able, r.t)))
        if method == "char_delete":
            assert len(r.n) == len(r.t) - k
        elif method != "ocr":
            assert len(r.n) == len(r.t)
            changed = [(a, b) for a, b in zip(r.t, r.n, strict=True) if a != b]
            assert len(changed) <= k and (method == "char_replace" or len(changed) == k)
            for a, b in changed:
                assert able(a) and (a != a.lower()) == (b != b.lower())
                assert method != "keyboard" or b.lower() in N.NEIGHBORS[a.lower()]
    again = df.repartition(3).select("k", "t", N.corrupt(F.col("t"), F.col("k"), method, F.lit(0.2)).alias("n"))
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))


def test_numpy_draws_are_the_columns_draws(spark):
    start = 268435455
    got = [r[0] for r in spark.range(200).select(N.draw(F.col("id") + start)).collect()]
    assert got == N.Kernel.draws(start, 200).tolist() and len(set(got)) == 200


def test_corrupt_all(spark):
    df = spark.createDataFrame([(1, "some text here", "keep")], "k long, t string, other string")
    out = N.corrupt_all(df, "t", F.col("k"), 9)
    assert {(r.condition, r.severity, r.other) for r in out.collect()} == {(f"T={m}_S=5", 5, "keep") for m in N.METHODS}
    with pytest.raises(ValueError):
        N.corrupt_all(df, "t", F.col("k"), 3, methods=["sing"])
    with pytest.raises(ValueError):
        N.corrupt_all(df, "missing", F.col("k"))


# ---- signals

def test_signals(spark):
    r = random.Random(1)
    clips = [(k, [r.uniform(-1, 1) for _ in range(n)]) for k, n in enumerate([0, 1, 7, 250])] + [(9, None)]
    df = spark.createDataFrame(clips, "k long, s array<double>")
    moved = 0
    for sev in range(1, 6):
        rows = df.select("k", "s", S.snr_white(F.col("s"), F.col("k"), sev).alias("w"), S.bitcrush(F.col("s"), sev).alias("b"), S.echo(F.col("s"), 100, sev).alias("e"), S.compress_silence(F.col("s"), 100, sev).alias("c"), S.jitter(F.col("s"), F.col("k"), 100, sev).alias("j")).collect()
        for x in rows:
            if x.s is None:
                assert x.w is x.b is x.e is x.j is None
                continue
            n = len(x.s)
            assert len(x.w) == len(x.b) == len(x.e) == len(x.j) == n and all(abs(v) <= 0.98 for v in x.w)
            assert sorted(x.j) == sorted(x.s)
            m = int(n / S.TEMPO[sev - 1])
            assert x.c == [0.0] * (n - m) + [x.s[int(j * S.TEMPO[sev - 1])] for j in range(m)] or n == 0
            d1, d2 = (ms * 100 // 1000 for ms in S.DELAYS_MS[sev - 1])
            g1, g2 = S.DECAYS[sev - 1]
            want = [0.9 * (0.8 * v + g1 * (x.s[i - d1] if i >= d1 else 0) + g2 * (x.s[i - d2] if i >= d2 else 0)) for i, v in enumerate(x.s)]
            assert x.e == pytest.approx(want)
        moved += sum(x.k == 3 and x.j != x.s for x in rows)
    assert moved >= 3  # a swap may hit one place twice, and a short shuffle may be the identity


def test_signals_with_null_samples_and_long_clips(spark):
    df = spark.createDataFrame([(1, [0.5, None, 0.25, 0.125]), (2, None), (3, []), (4, [None])], "k long, s array<double>").coalesce(1)
    got = {r.k: r for r in df.select("k", S.snr_white(F.col("s"), F.col("k"), 1).alias("w"), S.bitcrush(F.col("s"), 4).alias("b"), S.echo(F.col("s"), 10, 1).alias("e"), S.compress_silence(F.col("s"), 1, 3).alias("c"), S.jitter(F.col("s"), F.col("k"), 10, 5).alias("j")).collect()}
    assert [v is None for v in got[1].w] == [False, True, False, False] and len(got[1].b) == 4 and len(set(got[1].b)) == 1
    assert [v is None for v in got[1].e] == [False, True, True, False]  # 100 ms later
    assert got[1].c == [0.0, 0.0, 0.5, 0.25] and sorted(got[1].j, key=str) == sorted([0.5, None, 0.25, 0.125], key=str)
    assert list(got[2])[1:] == [None] * 5 and list(got[3])[1:] == [[]] * 5 and got[4].w == got[4].b == got[4].e == got[4].j == [None] and got[4].c == [0.0]
    # 20,000 swaps of 100,000 segments: one by one they took the square of that
    long = spark.range(2).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: x.cast("double")).alias("s"))
    moved = long.select(F.size("s").alias("n"), F.size(F.array_distinct(S.jitter(F.col("s"), F.col("k"), 10, 3))).alias("m"), (S.jitter(F.col("s"), F.col("k"), 10, 3) == F.col("s")).alias("same")).collect()
    assert [(r.n, r.m, r.same) for r in moved] == [(200_000, 200_000, False)] * 2
    assert S.swapped(5, 3, 20, False).tolist() != [0, 1, 2, 3, 4] or S.swapped(5, 4, 20, False).tolist() != [0, 1, 2, 3, 4]


def test_bitcrush_levels_are_those_of_sql_close_to_saturation(spark, tmp_path):
    import duckdb

    from tremolo import queries

    r = random.Random(2)
    clips = [(k, [r.choice((-1, 1)) * r.uniform(0.0034, 0.0056) for _ in range(1000)], 0) for k in range(20)]  # a tanh of 13.7 to 22.5 at severity 4
    spark.createDataFrame(clips, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("g2_bitcrush", "g2_bitcrush_mild"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.sql(f"SELECT clip_id, n, samples FROM ({queries.SQL[name]})").fetchall())
    df = spark.createDataFrame([(k, [x * f for x in s for f in (1, 0.125, 0.01)]) for k, s, _ in clips[:3]], "k long, s array<double>")
    for sev in range(1, 6):
        drive, steps, hold = S.DRIVE[sev - 1] * 10 ** (S.PREGAIN_DB[sev - 1] / 20), 2.0 ** (S.BITS[sev - 1] - 1), S.HOLD[sev - 1]
        for x in df.select("s", S.bitcrush(F.col("s"), sev).alias("b")).collect():
            assert x.b == [math.floor(0.5 * math.tanh(drive * x.s[i - i % hold]) * steps + 0.5) / steps for i in range(len(x.s))]


# ---- time series

def test_runs_and_coverage(spark):
    rows = [("a", 0, 1.0), ("a", 10, 0.0), ("a", 20, 9.0), ("a", 30, 0.0), ("a", 50, 0.0), ("b", 5, 0.0), ("c", 0, 9.0), ("c", 4, 9.0), ("d", 0, None), ("d", 9, 0.0)]
    df = spark.createDataFrame(rows, "k string, sec long, value double").withColumn("ts", F.timestamp_seconds("sec"))
    got = {(r.k, r.start_us // 10**6, r.end_us // 10**6) for r in timeseries.silence_runs(df, "k", 5.0, 1).collect()}
    assert got == {("a", 0, 20), ("a", 30, 50)}
    cov = {r.k: r.coverage for r in timeseries.silence_coverage(df, "k", 5.0, 1).collect()}
    assert cov == {"a": 0.8, "b": None, "c": 0.0, "d": 0.0}
    thin = {(r.k, r.us // 10**6) for r in timeseries.fps_drop(df, "k", 20_000_000).collect()}
    assert thin == {("a", 0), ("a", 20), ("a", 50), ("b", 5), ("c", 0), ("d", 0)}
    blur = {(r.k, r.us // 10**6): r.blurred for r in timeseries.motion_blur(df, "k", 1).collect()}
    assert blur["a", 10] == pytest.approx((0 + 0.7) / 1.7) and blur["d", 0] is None and blur["d", 9] == 0.0


def test_one_hot_series_over_many_ranges(spark):
    """Slices and blocks that are far shorter than the series, with gaps, equal times and nulls, against plain loops."""
    import random

    r = random.Random(7)
    rows = []
    for k, n in (("hot", 900), ("b", 40), (None, 25)):
        at = 0
        for _ in range(n):
            at += r.choice([0, 1, 2, 3, 40])
            rows.append((k, at, r.choice([None, 1.0, 2.0, 2.0, 9.0])))
    df = spark.createDataFrame(rows, "k string, sec long, value double").withColumn("ts", F.timestamp_seconds("sec")).repartition(5)
    runs, blur = set(), []
    for k in ("hot", "b", None):
        own = sorted(((s, v is not None, v or 0) for x, s, v in rows if x == k))
        quiet = [known and v < 5 for _, known, v in own]
        i = 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and quiet[j + 1] == quiet[i]:
                j += 1
            if quiet[i]:
                end = own[min(j + 1, len(own) - 1)][0]
                if end - own[i][0] >= 2:
                    runs.add((k, own[i][0], end))
            i = j + 1
        for i, (s, _, _) in enumerate(own):
            pairs = [(own[i - b][2], w) for b, w in enumerate(timeseries.BLUR[1]) if b <= i and own[i - b][1]]
            blur.append((k or "", s, sum(v * w for v, w in pairs) / sum(w for _, w in pairs) if pairs else -1.0))
    for readings in (10, 100, timeseries.READINGS):
        got = [(x.k, x.start_us // 10**6, x.end_us // 10**6) for x in timeseries.silence_runs(df, "k", 5.0, 2_000_000, readings).collect()]
        assert len(got) == len(set(got)) and set(got) == runs
        for block in (16, 100):
            out = [(x.k or "", x.us // 10**6, -1.0 if x.blurred is None else x.blurred) for x in timeseries.motion_blur(df, "k", 2, readings, block).collect()]
            for a, b in zip(sorted(out), sorted(blur), strict=True):
                assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_a_dense_series_is_cut_by_readings(spark):
    """A million readings of one series within a quarter of an hour, between two others: no range has over the stated number."""
    hot = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 900).alias("ts"), (F.col("id") % 1000 * 1.0).alias("value"))
    few = spark.range(100).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), F.timestamp_micros(F.col("id")).alias("ts"), F.lit(1.0).alias("value"))
    ranges = timeseries.in_ranges(hot.unionByName(few), "k", 50_000)
    sizes = ranges.groupBy("slice").agg(F.count("*").alias("n"), F.min(F.struct("k", "us")).alias("lo"), F.max(F.struct("k", "us")).alias("hi")).orderBy("slice").collect()
    assert len(sizes) > 20 and max(x.n for x in sizes) <= 50_000 and sum(x.n for x in sizes) == 1_000_100
    order = lambda x: (x.k is not None, x.k or "", x.us)
    assert all(order(a.hi) < order(b.lo) for a, b in zip(sizes, sizes[1:], strict=False))
    runs = timeseries.silence_runs(hot, "k", 500.0, 0, 50_000).agg(F.count("*"), F.sum("seconds")).first()
    assert runs[0] == 1000 and runs[1] == pytest.approx((999 * 500 + 500 - 0) * 900 / 1e6, rel=1e-3)


def test_what_is_written_is_swept(spark):
    shared.sweep(spark)
    df = shared.written(spark.range(5), "five")
    path = df.inputFiles()[0].rpartition("/")[0]
    assert df.count() == 5 and shared.sweep(spark) == 1 and shared.sweep(spark) == 0
    assert not shared.remove(spark, path)


def test_a_failing_batch_is_halved(spark):
    calls = []

    def load():
        def predictor(batch):
            calls.append(len(batch))
            if (batch["x"] == 37).any():
                raise ValueError("37")
            return ["ok"] * len(batch)

        return predictor

    out = predict.batch_predict(spark.range(64).coalesce(1).select(F.col("id").alias("x")), load, ["x"], ["x"]).collect()
    assert [(r.x, r.error) for r in out if r.error] == [(37, "37")] and sum(r.transcript == "ok" for r in out) == 63


def test_answers_that_do_not_fit_are_errors(spark):
    """Too few answers, too many, none at all, no list, no text: each row comes out once, as an error where it has no answer."""
    rows = spark.range(7).coalesce(1).select(F.col("id").alias("x"))

    def run(answer):
        out = predict.batch_predict(rows, lambda: answer, ["x"], ["x"]).collect()
        assert sorted(r.x for r in out) == list(range(7)) and all((r.transcript is None) == (r.error is not None) for r in out)
        return {r.x: r.error or r.transcript for r in out}

    assert run(lambda b: ["a"] * (len(b) - (5 in set(b["x"])))) == {i: "0 answers to 1 rows" if i == 5 else "a" for i in range(7)}
    assert run(lambda b: ["a"] * (len(b) + (5 in set(b["x"])))) == {i: "2 answers to 1 rows" if i == 5 else "a" for i in range(7)}
    assert run(lambda b: [None if v == 2 else 3 if v == 4 else "a" for v in b["x"]]) == {i: {2: "no answer", 4: "the answer is no text but int"}.get(i, "a") for i in range(7)}
    assert set(run(lambda b: None).values()) == {"'NoneType' object is not iterable"}
    assert run(lambda b: iter(["a"] * len(b))) == dict.fromkeys(range(7), "a")


def test_a_worker_loads_its_model_once_and_gets_bounded_batches(spark, tmp_path):
    def load():
        import os

        (tmp_path / f"{os.getpid()}-{len(os.listdir(tmp_path))}").touch()
        return lambda batch: [f"{sum(map(len, batch['t']))} {len(batch)}"] * len(batch)

    texts = spark.range(400).repartition(20).select(F.col("id").alias("x"), F.when(F.col("id") == 7, F.lit("y" * 500)).otherwise("éé").alias("t"))
    out = predict.batch_predict(texts, load, ["x"], ["t"], batch_bytes=40).collect()
    loads = [p.name.partition("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) <= 4
    sizes = {r.x: tuple(map(int, r.transcript.split())) for r in out}
    assert len(sizes) == 400 and sizes.pop(7) == (500, 1) and all(n <= 10 and 2 * n == size for size, n in sizes.values()) and max(n for _, n in sizes.values()) == 10


def test_outcomes_are_written_in_one_pass(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def predictor(batch):
            if (batch["x"] == 3).any() and len(batch) > 1:
                raise ValueError("a batch with three")
            import uuid

            (calls / f"{len(batch)}-{uuid.uuid4().hex}").touch()
            if (batch["x"] == 3).any():
                raise ValueError("three")
            return [f"assistant: {v}" for v in batch["x"]]

        return predictor

    rows = spark.range(40).select(F.col("id").alias("x"), F.lit("f").alias("file"))
    results = predict.batch_predict(rows, load, ["x", "file"], ["x"])
    assert writers.write_outcomes(results, f"{tmp_path}/out", "b 1/2") == {"ok": 39, "failed": 1, "total": 40}
    assert sum(int(p.name.partition("-")[0]) for p in calls.iterdir()) == 40
    for batch in ("b 1/2", "other"):
        writers.write_outcomes(results, f"{tmp_path}/out", batch)
    good, bad = readers.read_outcomes(spark, f"{tmp_path}/out", rows.schema)
    assert good.columns == ["x", "file", "prediction"] and bad.columns == ["x", "file", "error", "traceback"]
    assert sorted((r.x, r.prediction) for r in good.collect()) == sorted((i, str(i)) for i in range(40) if i != 3 for _ in range(2))
    assert [(r.x, r.error, "ValueError" in r.traceback) for r in bad.collect()] == [(3, "three", True)] * 2
    assert writers.write_outcomes(results.filter("x < 0"), f"{tmp_path}/none", "b") == {"ok": 0, "failed": 0, "total": 0}


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    def session(master, path=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: path), sparkContext=SimpleNamespace(master=master, applicationId=master))

    assert shared.shared_dir(session("spark://a:1", "s3://x/y/")) == "s3://x/y"
    with pytest.raises(ValueError):
        shared.shared_dir(session("spark://a:1"))
    assert shared.shared_dir(session("local[2]")) == shared.shared_dir(session("local[2]"))


# ---- plans, quality, prediction

def test_plan_and_accounting(spark):
    files = spark.createDataFrame([("dia1_utt1.mp4", "/d/dia1_utt1.mp4")], "name string, path string")
    plan = plans.corruption_plan(files, corruption_catalog(spark), "/out", 7)
    rows = plan.collect()
    assert len(rows) == 15 and {r.severity for r in rows} == {5}
    assert {r.out_path for r in rows if r.corruption == "mp3"} == {"/out/A=mp3_S=5/dia1_utt1.mkv"}
    done = plan.filter("corruption = 'mp3'").select("out_path")
    assert plans.pending_work(plan, done).count() == 14 and plans.pending_work(plan, done, overwrite=True).count() == 15
    bad = plan.filter("corruption in ('mp3', 'jitter')").select("out_path")
    got = {r.condition: (r.ok, r.skipped, r.failed) for r in quality.job_accounting(plan, done, bad).collect()}
    assert got["A=mp3_S=5"] == (0, 1, 0) and got["A=jitter_S=5"] == (0, 0, 1) and got["V=occlusion_S=5"] == (1, 0, 0)


def test_predictor_failures_are_rows(spark):
    def load():
        def run(batch):
            if (batch["x"] == 3).any():
                raise ValueError("three")
            return [f"assistant: {v}" for v in batch["x"]]

        return run

    out = predict.batch_predict(spark.range(6).select(F.col("id").alias("x"), F.lit("f").alias("file")), load, ["x", "file"], ["x"], slots=2)
    good, bad = predict.route_results(out)
    assert sorted((r.x, r.prediction) for r in good.collect()) == [(i, str(i)) for i in (0, 1, 2, 4, 5)]
    assert [(r.x, r.error, "ValueError" in r.traceback) for r in bad.collect()] == [(3, "three", True)]


def test_merge(spark):
    a = spark.createDataFrame([(1, "x")], "dialog_id long, prediction string")
    b = spark.createDataFrame([(2, "y")], "dialog_id long, label string")
    got = [tuple(r) for r in merge.merge_labeled(spark, [(a, "A"), (b, "B")]).collect()]
    assert got == [(1, "x", "A", None), (2, None, "B", "y")]
    assert merge.merge_labeled(spark, []).count() == 0
    assert [r.split for r in merge.merge_splits(spark, a, a, a).collect()] == list(merge.SPLIT_NAMES.values())


def test_merge_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('dialog_id,prediction,extra\n1,"positive\nor so",5\n2,,x\n')
    (tmp_path / "b.csv").write_text("label,dialog_id\nneutral,7\n")
    got = readers.merge_csv(spark, [(f"{tmp_path}/a.csv", "A"), (f"{tmp_path}/b.csv", "B")], "run")
    assert got.columns == ["dialog_id", "prediction", "extra", "run", "label"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "positive\nor so", "5", "A", None), (2, None, "x", "A", None), (7, None, None, "B", "neutral")]
    assert readers.merge_csv(spark, []).count() == 0
    with pytest.raises(FileNotFoundError, match="none.csv"):
        readers.merge_csv(spark, [(f"{tmp_path}/a.csv", "A"), (f"{tmp_path}/none.csv", "B")])


# ---- sources and sinks

def test_csv_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Sr,Dialogue_ID,Utterance_ID,Utterance,Sentiment\n1,0,1,"say ""hi"",\nthere",neutral\n2,1.0,2,,positive\n3,x,2,z,negative\n')
    with pytest.warns(UserWarning, match="no metadata for val"):
        rows = readers.read_metadata(spark, {"train": f"{tmp_path}/m.csv", "val": f"{tmp_path}/none.csv"}).orderBy("_pos").collect()
    assert [(r.split, r.dialog_id, r.utterance_id, r.utterance, r.sentiment) for r in rows] == [("train", 0, 1, 'say "hi",\nthere', "neutral"), ("train", 1, 2, None, "positive"), ("train", None, 2, "z", "negative")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.read_metadata(spark, {"train": f"{tmp_path}/bad.csv"})
    (tmp_path / "e.csv").write_text('dialog_id,utterance_id,file,error,traceback\n1,2,f,"a\nb","x\n\ny"\n')
    (tmp_path / "old.csv").write_text("dialog_id,utterance_id,file,error\n3,4,g,c\n")
    got = readers.read_errors_csv(spark, [f"{tmp_path}/e.csv"], [f"{tmp_path}/old.csv"]).collect()
    assert [(r.dialog_id, r.error, r.traceback) for r in got] == [(1, "a\nb", "x\n\ny"), (3, "c", None)]


def test_quoted_csv_is_read_by_many_tasks(spark, tmp_path):
    """Random quoting, stray quotes, both kinds of line ends, empty lines, short records, no last line end: as Spark's own
    one-task reader has it, with places in order."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    schema = schemas.T.StructType([schemas.T.StructField(c, schemas.T.StringType()) for c in "abc"])
    try:
        for k in before:
            spark.conf.set(k, "400")
        for seed in range(4):
            r = random.Random(seed)
            quoted = lambda r=r: '"' + "".join(r.choice(["x", '""', "\n", ",", "\r\n", " ", "é"]) for _ in range(r.randint(0, 30))) + '"'
            field = lambda r=r, quoted=quoted: r.choice(["", '""', "plain text", 'st"ray', quoted(), quoted()])
            end = ["\n", "\r\n"][seed % 2]
            text = end.join(["a,b,c", *[",".join(field() for _ in range(r.choice([3, 3, 2]))) + r.choice(["", "", end]) for _ in range(120)]]) + ("" if seed < 2 else end)
            path = tmp_path / f"{seed}.csv"
            path.write_bytes(text.encode())
            want = [tuple(x) for x in spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)).collect()]
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
            got = [tuple(x) for x in records.read_records(spark, {"t": str(path)}, schema).orderBy("_pos").collect()]
            assert got == [("t", i, *x) for i, x in enumerate(want)]
        some = records.csv_records(spark, {"all": str(tmp_path)}).orderBy("pos").collect()
        two = records.csv_records(spark, {"x": f"{tmp_path}/1.csv", "y": f"{tmp_path}/2.csv"}).orderBy("tag", "pos").collect()
        assert [(x.tag, x.pos) for x in two] == [(k, i) for k in "xy" for i in range(sum(x.file.endswith({"x": "/1.csv", "y": "/2.csv"}[k]) for x in some))]
        assert [x.pos for x in some] == list(range(len(some))) and [x.file[-5:] for x in some] == sorted(x.file[-5:] for x in some)
        (tmp_path / "none.csv").write_text("a,b,c\n")
        (tmp_path / "empty.csv").write_text("")
        assert records.read_records(spark, {"a": f"{tmp_path}/none.csv", "b": f"{tmp_path}/empty.csv"}, schema).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_long_line_of_fields():
    """A megabyte of fields or of quotes on one line."""
    lines = ["a," * 500_000, '"a""b",' * 150_000, '"' + '""' * 500_000, '"' + "x" * 1_000_000, "x" * 1_000_000 + '"']
    assert [records.behind(x, False) for x in lines] == [False, False, True, True, False]
    assert [records.behind(x, True) for x in lines[2:]] == [False, False, False]


def test_media_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.mp4", "B.MP4", "c.wav", "sub/d.mkv"):
        (tmp_path / n).write_bytes(b"x")
    assert {r.name for r in readers.list_media(spark, str(tmp_path)).collect()} == {"a.mp4", "B.MP4"}
    assert {r.name for r in readers.list_media(spark, str(tmp_path), recursive=True).collect()} == {"a.mp4", "B.MP4", "d.mkv"}
    assert {r.name for r in readers.list_media(spark, f"{tmp_path}/a.mp4").collect()} == {"a.mp4"}
    with pytest.raises(Exception, match="FileNotFound"):
        readers.list_media(spark, f"{tmp_path}/none").collect()


def test_media_are_listed_by_many_tasks(spark, tmp_path):
    """As Spark's own listing has it: path, length, time, names that are passed over; each folder once, deep ones too."""
    for k in range(12):
        folder = tmp_path / f"a{k % 4}" / f"split=b {k}" / ("_hidden" if k == 5 else "c")
        folder.mkdir(parents=True)
        for n in range(k):
            (folder / f"{n}.mp4").write_bytes(b"x" * (n + 1))
    (tmp_path / "top.MP4").write_bytes(b"xyz")
    (tmp_path / ".dot.mp4").write_bytes(b"")
    whole = lambda df: sorted(map(tuple, df.select("path", "length", "modificationTime").collect()))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", F.date_trunc("second", "modificationTime").alias("modificationTime"))
    second = lambda df: df.withColumn("modificationTime", F.date_trunc("second", "modificationTime"))
    got = readers.list_media(spark, f"file://{tmp_path}", recursive=True)
    assert whole(second(got)) == whole(want) and len(whole(want)) == sum(range(12)) - 5 + 1
    assert got.rdd.getNumPartitions() > 12
    for folders in (1, 3, 10):
        reader = media.MediaReader(str(tmp_path), True, [".mp4"], folders)
        parts = reader.partitions()
        assert sorted(x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()) == [x[0] for x in whole(want)]
    assert media.reaches(str(tmp_path)) and not media.reaches("viewfs://store/x")


def test_a_large_folder_is_streamed(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "ROWS", 100)
    for n in range(1050):
        (tmp_path / f"{n}.wav").touch()
    reader = media.MediaReader(str(tmp_path), True, [], 10)
    (part,) = reader.partitions()
    assert [b.num_rows for b in reader.read(part)] == [100] * 10 + [50]


def test_split_configs(spark):
    paths = spark.createDataFrame([("r/train_splits/audio/A=mp3_S=5/x.mp4",), ("r/train_splits/text/T=ocr_S=3/metadata.csv",), ("r/train_splits/unmodified/x.mp4",)], "path string")
    clean = [tuple(r) for r in readers.split_configs(paths, "r", "train", None).collect()]
    assert clean == [("r/train_splits/unmodified", "r/train_splits/train_sent_emo.csv", "unmodified")]
    got = {tuple(r) for r in readers.split_configs(paths, "r", "train", ["audio", "text"]).collect()}
    assert got == {("r/train_splits/audio/A=mp3_S=5", "r/train_splits/train_sent_emo.csv", "A=mp3_S=5"), ("r/train_splits/unmodified", "r/train_splits/text/T=ocr_S=3/metadata.csv", "T=ocr_S=3")}


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, 2, "f", "positive", None, "A=mp3_S=5"), (3, 4, "g", None, "neutral", "unmodified")], schemas.PREDICTIONS)
    for batch in (None, None, "a/b=1", "a/b=1"):
        writers.write_predictions(p, f"{tmp_path}/p", batch)
    back = readers.read_predictions(spark, f"{tmp_path}/p")
    assert sorted(map(str, back.collect())) == sorted(map(str, p.union(p).union(p).collect()))
    writers.write_errors(spark.createDataFrame([(1, 2, "f", "e")], schemas.OLD_ERRORS), f"{tmp_path}/e")
    assert [r.traceback for r in spark.read.parquet(f"{tmp_path}/e").collect()] == [None]
    texts = N.corrupt_all(spark.createDataFrame([(1, "hello there")], "k long, t string"), "t", F.col("k"))
    writers.write_corrupted(texts, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").filter("corruption = 'ocr' and severity = 3 and modality = 'T'").count() == 1
    metrics = evaluate.confusion_metrics(p)
    writers.write_metrics(metrics, f"{tmp_path}/m")
    assert readers.read_csv(spark, f"{tmp_path}/m", schemas.METRICS).count() == 6


def arriving(spark):
    return spark.createDataFrame([(i, 0, f"f{i}", ["positive", "negative", None][i % 3], "positive", f"s{i % 2}") for i in range(40)], schemas.PREDICTIONS)


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    p, provider = arriving(spark), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert confusion.read_running(spark, f"{tmp_path}/out").count() == 0
    for part in (p.filter("dialog_id < 10"), p, p.filter("dialog_id > 30")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        confusion.stream_confusion(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", files_per_trigger=3)
    got = confusion.read_running(spark, f"{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, evaluate.confusion_metrics(p).collect()))
    assert len(confusion.batches_in(spark, f"{tmp_path}/out")) == 2 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


@pytest.mark.parametrize("at", ["before the write", "while it is written", "after the write"])
def test_a_crash_leaves_metrics(spark, tmp_path, monkeypatch, at):
    """The second run dies in its first batch: the last metrics are still there, and a third run comes out right."""
    p = arriving(spark)
    first, publish = p.filter("dialog_id < 10"), confusion.publish
    run = lambda: confusion.stream_confusion(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    running = lambda: sorted(map(str, confusion.read_running(spark, f"{tmp_path}/out").collect()))
    rows = lambda df: sorted(map(str, evaluate.confusion_metrics(df).collect()))
    first.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    p.write.mode("append").parquet(f"{tmp_path}/in")

    def dies(metrics, target, batch):
        if at == "after the write":
            publish(metrics, target, batch)
        elif at == "while it is written":
            (tmp_path / "out" / f"batch={batch}").mkdir()
            (tmp_path / "out" / f"batch={batch}" / "part-0.parquet").write_bytes(b"half")
        raise RuntimeError("killed")

    monkeypatch.setattr(confusion, "publish", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert running() == (rows(p) if at == "after the write" else rows(first))
    monkeypatch.setattr(confusion, "publish", publish)
    run()
    assert running() == rows(p)


def test_stream_state_is_bounded(spark, tmp_path):
    """What arrived longer ago than `within` leaves the state, and counts again."""
    import time

    kept = []
    for k in range(4):
        spark.createDataFrame([(i, 0, f"f{k}-{i}", "positive", "positive", "s") for i in range(50)], schemas.PREDICTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress = confusion.stream_confusion(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", within="1 second")
        kept.append(max(op["numRowsTotal"] for x in progress[-1:] for op in x["stateOperators"]))
        time.sleep(1.5)
    assert kept[-1] <= 150 and sum(r.TP for r in confusion.read_running(spark, f"{tmp_path}/out").collect()) == 200
