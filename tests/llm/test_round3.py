"""The prefix trie, line deduplication and ranked search on small tables with nulls, empty and long texts, ties, repeated
rows, no rows and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tremolo.llm import licenses, lines, mixing, near, ranked, toxicity, trie

# ---- the prefix trie

TURNS = "conv_id long, turn long, role string, text string, node string, `a.b` string"


def conversation_rows(seed):
    """Shared beginnings, whole copies, one conversation with a third of all rows, ties, nulls, repeated rows."""
    r = random.Random(seed)
    say = lambda: " ".join(r.choice("abcd") for _ in range(r.randint(0, 4))) or None
    rows = []
    for c in [*range(0, 90), 200, 207, -20, -3, 1041]:
        if c % 20 == 0 and r.random() < 0.3:
            continue
        n = r.randint(1, 6)
        rows += [(c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", "assistant", None]), r.choice(["hi", "hi there", "", None, say()])) for t in range(n)]
    rows += [(c, t, "user", "same") for c in (300, 301, 302, 303, 304) for t in range(5)]
    rows += [(500, t, "user", "same" if t < 5 else f"turn {t}") for t in range(150)]
    rows += [(501, t, "user", "same" if t < 5 else f"turn {t}") for t in range(150)]
    rows += [(600, 1, "user", "tie"), (600, 1, "user", "tie"), (600, 1, "assistant", "tie"), (600, 1, None, None), (None, 1, "user", "no conversation")]
    r.shuffle(rows)
    return rows


def brute_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * words
    sha = lambda p, cs: hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(p, cs)) for p, cs in members.items())


def got_trie(spark, rows, **how):
    df = spark.createDataFrame([(*x, "n", "dotted") for x in rows], TURNS).repartition(3)
    out = trie.prefix_trie(df, **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"bits": 15}), (3, {"rebuild": False})])
def test_trie(spark, seed, how):
    rows = conversation_rows(seed)
    assert got_trie(spark, rows, **how) == brute_trie(rows, how.get("rebuild", True))


def test_trie_when_the_sketch_proves_nothing(spark, monkeypatch):
    """A full sketch takes all prefixes for shared; a group of one comes out as a tail would."""
    monkeypatch.setattr(trie, "sketch", lambda rows, bits: np.full((2 << bits) // 8, 255, np.uint8))
    rows = conversation_rows(4)
    assert got_trie(spark, rows) == brute_trie(rows)


def test_trie_when_the_sketch_errs_in_the_middle(spark, monkeypatch):
    """Some prefixes of one conversation are taken for shared below others that are proved to be alone."""
    true = trie.sketch

    def noisy(rows, bits):
        return true(rows, bits) | np.random.default_rng(1).choice(np.array([0, 255], np.uint8), (2 << bits) // 8)

    monkeypatch.setattr(trie, "sketch", noisy)
    rows = conversation_rows(5)
    assert got_trie(spark, rows) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert got_trie(spark, []) == []
    assert got_trie(spark, [(None, 1, "user", "x")]) == []
    assert got_trie(spark, [(7, 1, None, None)]) == brute_trie([(7, 1, None, None)])


def test_ids_are_hashed_in_chunks(spark, monkeypatch):
    import pyarrow as pa

    ids = [(1, 1, c) for c in range(-5, 30_000, 7)] + [(1, 2, 5), (2, 1, 8)]
    batches = [pa.record_batch([pa.array([x[k] for x in ids[a : a + 1000]], pa.int64()) for k in range(3)], names=["x", "y", "c"]) for a in range(0, len(ids), 1000)]
    chunks = list(trie.chunked(iter(batches)))
    assert len(chunks) == 3  # 65,536 characters make one
    out = {(b.column(0)[0].as_py(), b.column(1)[0].as_py()): b.column(2)[0].as_py() for b in trie.hashed(iter(chunks))}
    assert out[(1, 1)] == hashlib.sha256(",".join(map(str, range(-5, 30_000, 7))).encode()).hexdigest()
    assert out[(1, 2)] == hashlib.sha256(b"5").hexdigest() and out[(2, 1)] == hashlib.sha256(b"8").hexdigest()


# ---- line deduplication

DOCS = "doc_id long, text string, n_chars long, row string, h string, n string, `a.b` string"


def line_rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdé") for _ in range(3))
    common = ["Subscribe now", "  Subscribe NOW\t", "É", "é", "x\x0bx", "\x0bMenu \r", "menu", "Zehn", "  ", ""]
    rows = [(1, None), (2, ""), (3, "\n"), (4, " \n\n \t"), (5, "menu"), (6, "menu\nmenu\nMENU"), (7, "\r\n".join(["menu"] * 3000))]
    for i in range(10, 60):
        some = [r.choice(common) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))]
        rows.append((i, "\n".join(some)))
    rows += [(70, "Copy\nof copies")] * 6 + [(None, "Copy\nalone")] * 4 + [(None, None), (71, "one\ncopy"), (71, "another\nCOPY")]
    return rows


def brute_lines(rows, least, min_chars=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({a: a + 32 for a in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in rows]
    often = Counter(k for _, ls in split for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for i, ls in split:
        kept = [x for x in ls if often[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "r", "h", "n", "dotted") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize(("least", "min_chars", "batches"), [(10, 1, 4), (2, 1, 7), (3, 2, 1), (1, 1, 3)])
def test_lines(spark, least, min_chars, batches):
    rows = line_rows()
    got = sorted(map(tuple, lines.report(line_docs(spark, rows), least, min_chars, batches).collect()), key=str)
    assert got == brute_lines(rows, least, min_chars)


def test_clean_lines_keep_columns(spark):
    rows = line_rows()
    df = line_docs(spark, rows)
    out = lines.clean(df)
    assert out.columns == df.columns
    want = {(i, h) for i, _, _, h in brute_lines(rows, 10)}
    got = out.collect()
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got} == want
    assert all(r.n_chars == len(r.text or "") and r["a.b"] == "dotted" and r.row == "r" for r in got)
    assert [r.text for r in got if r.doc_id == 1] == [None]
    assert lines.report(line_docs(spark, [])).count() == 0


def test_runs_are_levelled(spark):
    """Batches become runs; two runs of a level one of the next; a frequent hash is not counted again."""
    runs = lines.Runs(spark, 5, buckets=2)
    batch = lambda *hs: spark.createDataFrame([(h.encode(), n) for h, n in hs], "h binary, n long")
    levels = []
    for _ in range(5):
        runs.add(batch(("often", 4), ("often", 1), ("rare", 1)))
        levels.append([run is not None for run in runs.levels])
    assert levels == [[True], [False, True], [True, True], [False, False, True], [True, False, True]]
    assert {tuple(r) for r in spark.table(runs.levels[0]).collect()} == {(b"rare", 1)}
    assert {bytes(r.h): r.n for r in runs.frequent().collect()} == {b"often": 5, b"rare": 5}
    runs.close()
    assert not runs.paths


def test_runs_are_joined_without_a_shuffle(spark):
    runs = lines.Runs(spark, 3, buckets=2)
    runs.add(spark.createDataFrame([(b"a", 1)], "h binary, n long"))
    a = spark.table(runs.levels[0])
    plan = a.join(a.withColumnRenamed("n", "m").hint("merge"), "h", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


# ---- ranked search


def brute_ranking(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({a: a + 32 for a in range(65, 91)}))
    held = [(i, term(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    total, out = sum(n for *_, n in held), []
    df = Counter(w for _, c, _ in held for w in c)
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in term(text) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def search_rows():
    r = random.Random(9)
    vocab = ["".join(r.choice("abcé9日") for _ in range(r.randint(1, 4))) for _ in range(60)]
    say = lambda n: r.choice([" ", "-", ". ", "\n", "_"]).join(r.choice(vocab) for _ in range(n))
    docs = [(i, say(r.randint(1, 60))) for i in range(60)] + [(100, None), (101, ""), (102, " .,-"), (103, say(5000)), (104, "Ä ä É é"), (105, vocab[0] * 3)]
    docs += [(200, docs[3][1])] * 3 + [(None, docs[3][1])] * 2 + [(i, docs[4][1].upper()) for i in range(210, 230)]
    items = [(i, say(r.randint(1, 12))) for i in range(15)] + [(20, docs[3][1]), (21, None), (22, ""), (23, "!?"), (24, "absentword"), (25, "ä Ä ä"), (5, "a"), (None, say(3))]
    return docs, items


def search_frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "r", "d") for i, t in docs], "doc_id long, text string, n string, `a.b` string").repartition(3),
        spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, score string"),
    )


@pytest.mark.parametrize("how", [{}, {"block_items": 4}, {"block_bytes": 60}, {"k": 3}])
def test_ranking(spark, how):
    docs, items = search_rows()
    got = ranked.search(*search_frames(spark, docs, items), **how)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranking(docs, items, how.get("k", 10))


def test_ranking_in_small_pieces(spark, monkeypatch):
    """Documents are scored in pieces that hold few scores and few products."""
    monkeypatch.setattr(ranked, "TRIPLES", 50)
    monkeypatch.setattr(ranked, "SCORES", 100)
    docs, items = search_rows()
    k, block = 10, [(i, Counter(ranked.terms_of(t))) for i, t in items]
    assert sorted((block[r.item][0], r.rank, r.doc_id, r.score) for r in ranked.search_block(spark, search_frames(spark, docs, [])[0], block[:10], 0, k).collect()) == sorted(brute_ranking(docs, items[:10]))


def test_ranking_of_nothing(spark):
    docs, items = search_rows()
    assert ranked.search(*search_frames(spark, [], items)).count() == 0
    assert ranked.search(*search_frames(spark, docs, [])).count() == 0
    assert ranked.search(*search_frames(spark, [(1, None), (2, "")], items)).count() == 0


def test_terms_are_found_between_separators():
    built = ranked.automaton([b"ab", b"b", "é".encode()])
    assert ranked.frequencies("AB ab,b abb bab é".encode(), built) == (6, {0: 2, 1: 1, 2: 1})
    assert ranked.frequencies(b"b b b", built) == (3, {1: 3})
    assert ranked.frequencies(None, built) == (0, {}) and ranked.frequencies(b" . ", built) == (0, {})
    assert ranked.frequencies(b"a b", ranked.automaton([])) == (2, {})


# ---- licences in long texts


def known_by_search(text, sentences):
    """Every way to cut a line's rest into known sentences, by recursion over words; the longest first."""
    lines_ = text.split("\n")
    words = [w for line in lines_ for w in line.split(" ")]
    first = {sum(len(x.split(" ")) for x in lines_[:k]) for k in range(len(lines_))} | {len(words)}

    def ways(i):
        for k, v in sorted(sentences.items(), key=lambda kv: -len(kv[1].split(" "))):
            j = i + len(v.split(" "))
            if words[i:j] == v.split(" ") and (j in first or ways(j)):
                return j, k
        return None

    out, i = [], 0
    while i < len(words):
        got = ways(i) if i in first else None
        while got:
            i = got[0]
            out.append(got[1])
            got = ways(i) if i not in first else None
            if not got:
                break
        else:
            i += 1
    return out


def test_known_sentences_by_search():
    r = random.Random(12)
    sentences = {"A": "x y", "B": "x", "C": "y z", "D": "x y z x", "E": "z z"}
    tree = licenses.known_tree(sentences)
    for _ in range(3000):
        text = "\n".join(" ".join(r.choice("xyzw") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4)))
        assert licenses.known_in(text, tree) == known_by_search(text, sentences), text
    assert licenses.known_in("", tree) == []


def test_licenses_in_long_texts(spark):
    """A megabyte without a mark, of one known sentence or of many: no recursion, and time in proportion."""
    one, half = "licensed under the mit license ", " ".join(list(licenses.SENTENCES.values())[:40]) + " "
    rows = [(1, one * 35_000), (2, half * 150), (3, "licensed under the mit " * 45_000), (4, (one * 20 + "agreement\n") * 1500), (5, one * 20_000 + "agreement"), (6, one[:-1] + ".")]
    got = {r.doc_id: (r.licenses, r.n_sentences, r.n_matches + r.n_unmatched) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", 1, 35_000) and got[3] == ("", 1, 0) and got[4] == ("", 1500, 0) and got[5] == ("", 1, 0) and got[6] == ("MIT", 1, 1)
    assert got[2][1] == 1 and got[2][2] > 0


# ---- toxicity without labels


def test_toxicity_needs_both_labels(spark):
    d = spark.createDataFrame([(i, f"some words {i}") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    for rows, share in (([], 0.5), ([(i, 0) for i in range(40)], None), ([(i, None) for i in range(40)], 0.5)):
        got = toxicity.report(d, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == 42 and len({x.score for x in got}) == 1
        assert got[0].score == share if share else got[0].score < 0.05 and not any(x.predicted for x in got)


# ---- near-dedup without a risk


def test_near_without_a_risk(spark):
    """No sketch chooses candidates: all classes are searched, with the same result as by sketches."""
    from test_operators import docs, near_brute, rows_of

    d = docs(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.deduplicate(d, risk=0).collect()}
    assert got == near_brute(rows_of(spark))


# ---- mixing very many sources


def test_mixing_of_very_many_sources(spark):
    """100,000 sources beside a hot one and rows without a source: each row once, each source's words near its target."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60_000, "hot").when(F.col("id") >= 100, F.concat(F.lit("s"), (F.col("id") % 100_000).cast("string"))).alias("source"), (F.col("id") % 7).alias("size"))
    rows = rows.withColumn("source", F.when(F.col("doc_id") % 50_000 != 1, F.col("source")))
    out = mixing.mix(rows).cache()
    assert out.count() == out.select("doc_id").distinct().count() == 200_000
    per = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size"), F.max("source_size").alias("source_size"))
    bad = per.filter((F.abs(F.col("taken") - F.col("target")) > 1) | (F.col("size") != F.col("source_size")))
    assert bad.count() == 0 and per.filter("source is null").count() == 1 and per.count() == 100_000
    assert out.filter("taken > 3 * size").count() == 0
    out.unpersist()


# ---- two runs in one driver


def test_two_threads_keep_their_own_tables(spark):
    """Each thread's settled() deletes what it wrote itself, and the session's setting is as before."""
    import threading

    from tremolo.llm import common

    before, both, results = spark.conf.get(common.CLEANUP, "false"), threading.Barrier(2), {}

    def work(k):
        def make():
            first = common.saved(spark.range(k), "first")
            both.wait(60)
            second = common.saved(first.filter("id >= 0"), "second")
            both.wait(60)
            return second

        results[k] = common.settled(make, "out").count()

    threads = [threading.Thread(target=work, args=(k,)) for k in (5, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert results == {5: 5, 9: 9} and spark.conf.get(common.CLEANUP, "false") == before and not common.SCOPES.open
