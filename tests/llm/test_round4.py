"""What Python workers get in near-deduplication and decontamination: each text once, from one worker of a task."""

import random

from tremolo.llm import decontaminate, near


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark):
    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    item = say(20)
    rows = [(i, say(60), None) for i in range(30)] + [(100, say(40) + " " + item + " end", 7), (101, item, 7), (102, None, None), (103, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return docs, spark.createDataFrame([(1, item), (2, say(15))], "item_id long, text string")


def test_decontamination_scans_a_text_once(spark):
    docs, bench = corpus(spark)
    one, several = (decontaminate.decontaminate(docs, bench, block_bytes=b) for b in (4 << 20, 10))
    assert plan(one).count("ArrowEvalPython") == 1
    rows = {r.doc_id: (r.text, r.n_chars) for r in one.collect()}
    assert rows == {r.doc_id: (r.text, r.n_chars) for r in several.collect()}
    before = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    text = before[100][0].split()
    cut = " ".join(text[:40] + text[60:])
    assert rows == {k: v for k, v in before.items() if k != 101} | {100: (cut, len(cut))}


def test_exact_search_makes_the_sets_of_its_members_once(spark, monkeypatch):
    seen, saved = {}, near.saved
    monkeypatch.setattr(near, "saved", lambda df, name: seen.setdefault(name, plan(df)) and saved(df, name))
    words = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[::-1])), (4, "a b")], "id long, text string")
    todo = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, comp long")
    assert [tuple(r) for r in near.residual(todo, texts, 5, 75).distinct().collect()] == [(1, 2)]
    assert [seen[k].count("ArrowEvalPython") for k in ("often", "prefixes")] == [1, 1]


def test_empty_tables_of_near_deduplication_need_no_python(spark):
    none = near.empty(spark, "a", "b")
    assert none.dtypes == [("a", "bigint"), ("b", "bigint")] and none.isEmpty()
    assert "ExistingRDD" not in plan(none)
