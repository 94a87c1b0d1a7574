"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 6)))
    vocab = [word() for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = say(20)
    rows = [(i, say(80), "en", f"src{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1] + " tail", "en", "src0"), (101, None, "en", "src0"), (102, "12 34", "en", "src1"), (103, say(60) + " " + item, "en", "src1"), (104, item, "en", "src2")]
    docs = spark.createDataFrame([(i, t, k, s, len(t or ""), "x") for i, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        ids[name] = {x.doc_id for x in kept.collect()}
    assert ids["language_id"] == {i for i, *_ in rows} - {101, 102}
    assert ids["near_dedup"] == ids["language_id"] - {100}
    assert ids["decontamination"] == ids["near_dedup"] - {104}
    assert ids["mixing"] <= ids["decontamination"] and len(ids["mixing"]) > 30
    assert ids["sharding"] == ids["mixing"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
