"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns,
against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tremolo.llm import decontaminate, exact, language, licenses, mixing, near, sharding, substrings, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, row string, key string, word string, `a.b` string"
SPACES = r"[\x20\x09-\x0D]+"


def texts(seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(120)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = say(40), say(120)
    out = [None, "", " \t\n ", "word", "one two three", "ÀÉ über naïve 日本語 😀 ▁ x", "a\x0bb\x0cc  d", say(3000), say(3000)]
    out += [say(r.randint(1, 150)) for _ in range(25)]
    out += [say(20) + "\n" + passage + "\n" + say(20) for _ in range(6)]
    for _ in range(6):
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    out += [out[10]] * 4 + [out[10].replace(" ", "\n")] + [out[10].upper()]
    return out


def docs(spark, rows=None):
    if rows is None:
        t = texts()
        order = random.Random(3).sample(range(1000), len(t))
        rows = [(i, x) for i, x in zip(order, t, strict=True)]
    sources = ["b", None, "a", "é", "b", "b"]
    full = [(i, x, "en" if k % 2 else None, sources[k % 6], len(x or ""), "9", "h", "r", "k", "w", "dotted") for k, (i, x) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def rows_of(spark):
    return [(r.doc_id, r.text) for r in docs(spark).collect()]


def empty(spark):
    return docs(spark, [])


# ---- exact deduplication

def test_exact(spark):
    for bucket in (8 << 20, 400):
        got = {r.doc_id: r for r in exact.deduplicate(docs(spark), bucket).collect()}
        groups = defaultdict(list)
        for i, t in rows_of(spark):
            groups[re.sub(SPACES, " ", t or "")].append(i)
        for body, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
                assert r.text_sha256 == hashlib.sha256(body.encode()).hexdigest()
    assert exact.deduplicate(empty(spark)).count() == 0


def test_exact_null_ids_and_repeated_rows(spark):
    d = docs(spark, [(None, "x y"), (4, "x  y"), (4, "x y"), (None, None), (None, "")])
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.deduplicate(d).collect())
    assert got == Counter({(4, 4, 3, True): 2, (None, 4, 3, False): 1, (None, None, 2, True): 2})


def test_exact_compares_bytes_of_one_hash():
    import pyarrow as pa

    names = ["h", "sha", "body", "doc_id", "n"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2]), pa.array(list("abac")), pa.array(["x", "y", "x", "x"]), pa.array([5, 6, 3, 9]), pa.array([1, 1, 1, 1])], names=names)
    out = [r for b in exact.own(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert out == [(1, 0, "a", 3, 2), (1, 1, "b", 6, 1), (2, 0, "c", 9, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array(list("aa")), pa.array(["x", "y"]), pa.array([5, 6]), pa.array([1, 1])], names=names)
    for step in (exact.own, exact.combine):
        with pytest.raises(ValueError, match="SHA-256"):
            list(step(iter([batch])))


# ---- near deduplication

def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(pairs):
    sets = {i: shingle_set(t) for i, t in pairs}
    comp = {i: i for i in sets}
    find = lambda i: i if comp[i] == i else find(comp[i])
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.deduplicate(docs(spark)).collect()}
    assert got == near_brute(rows_of(spark))
    assert near.deduplicate(empty(spark)).count() == 0


def test_near_group_without_centre(spark):
    """Copies that link only along a chain, and a crowd around a shared passage that does not link."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    chain = [word() for _ in range(200)]
    rows = []
    for k in range(14):
        rows.append((100 - k, " ".join(chain)))
        for _ in range(3):
            chain[r.randrange(200)] = word()
    passage = [word() for _ in range(60)]
    rows += [(200 + k, " ".join([word() for _ in range(r.choice([8, 25]))] + passage)) for k in range(30)]
    rows += [(300, None), (301, " "), (302, "a b"), (303, "A  b")]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near.deduplicate(docs(spark, rows)).collect()}
    assert got == near_brute(rows)
    # the exact search across components finds by itself what the rounds find
    alone = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near.deduplicate(docs(spark, rows), rounds=0).collect()}
    assert alone == got


def test_near_of_an_id_with_two_texts(spark):
    """The id links what any of its texts links."""
    r = random.Random(21)
    x, y = ([f"w{r.randrange(900)}" for _ in range(120)] for _ in range(2))
    edit = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (7, edit(x, 50)), (9, edit(y, 30)), (3, edit(y, 90)), (8, " ".join(r.sample(x, 120)))]
    got = {i: c for i, c in ((q.doc_id, q.component_id) for q in near.deduplicate(docs(spark, rows)).collect())}
    assert got == {5: 3, 7: 3, 9: 3, 3: 3, 8: 8}


def test_near_keep_one_keeps_columns(spark):
    d = docs(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "q"), (3, None)])
    out = near.keep_one(d)
    assert out.columns == d.columns and Counter(r.doc_id for r in out.collect()) == Counter([1, None, 3])


# ---- suffix arrays

def substring_brute(pairs, length=50):
    data = [(i, (t or "").encode()) for i, t in pairs]
    least = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("text_bytes, array_bytes, starts", [(8 << 20, 1 << 20, 20_000), (3000, 500, 20_000), (3000, 300, 40), (100_000, 1 << 20, 0)])
def test_substrings(spark, monkeypatch, text_bytes, array_bytes, starts):
    """With small blocks, small arrays and low limits for keys that are dealt string by string, results are the same."""
    monkeypatch.setattr(substrings, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(substrings, "ARRAY_BYTES", array_bytes)
    monkeypatch.setattr(substrings, "MOST_STARTS", starts)
    monkeypatch.setattr(substrings, "CHUNK", 70 if starts == 40 else 1 << 16)
    rows = rows_of(spark) + [(2000, "z" * 300), (2001, "y" * 20 + "z" * 120), (2002, "ab" * 200), (2003, "c" + "ab" * 60), (2004, "\0" * 80), (2005, "\0" * 60 + "z" * 60)]
    want = substring_brute(rows)
    out = substrings.deduplicate(docs(spark, rows), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    body = {i: (t or "").encode() for i, t in rows}
    for r in out:
        left, at = b"", 0
        for s in r.spans:
            left, at = left + body[r.doc_id][at : s.start], s.end
        assert left + body[r.doc_id][at:] == bytes(r.kept) and len(r.spans) == r.n_spans


def test_substrings_within_one_long_text_and_null_texts(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, None), (2, long), (3, long[1000:150_000] + "x"), (4, ""), (5, "short")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.deduplicate(docs(spark, rows)).collect()}
    assert got == {1: (0, 0, 0), 2: (300_000, 0, 0), 3: (149_001, 149_000, 1), 4: (0, 0, 0), 5: (5, 0, 0)}


def test_substrings_empty_and_null_ids(spark):
    assert substrings.deduplicate(empty(spark)).count() == 0
    t = "the quick brown fox jumps over the lazy dog and then some more"
    got = sorted((r.doc_id or -1, r.n_removed) for r in substrings.deduplicate(docs(spark, [(None, t), (5, t), (5, t)])).collect())
    assert got == [(-1, len(t)), (5, 0), (5, 0)]


def test_suffix_array_and_kasai():
    import numpy as np

    r = random.Random(2)
    for alphabet in ("ab", "abcdefgh"):
        text = np.frombuffer("".join(r.choice(alphabet) for _ in range(900)).encode(), np.uint8)
        starts = np.arange(len(text) - 49)
        order = substrings.suffix_array(text, starts, 50)
        raw = text.tobytes()
        assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in starts)
        common = substrings.kasai(text, order, np.array([0]), np.array([len(starts)]), 50)
        for x in range(1, len(order)):
            a, b = raw[order[x - 1] : order[x - 1] + 50], raw[order[x] : order[x] + 50]
            assert common[x] == next((i for i in range(50) if a[i] != b[i]), 50)


def test_arrays_of_one_key_are_merged_by_binary_search(monkeypatch):
    import numpy as np

    r = random.Random(4)
    piece = lambda k: "".join(r.choice("ab") for _ in range(r.randint(0, 3)))
    pairs = sorted({(k, (piece(k) + "?xyz"[k] * 60 + piece(k)).encode()) for k in (1, 2, 2, 2, 2, 3) for _ in range(12)}, key=lambda x: (x[0], r.random()))
    keys, spans = [k for k, _ in pairs], [s for _, s in pairs]
    ids = r.sample(range(1000), len(spans))
    least = {}
    for k, s, i in zip(keys, spans, ids, strict=True):
        for p in range(len(s) - 49):
            least[k, s[p : p + 50]] = min(least.get((k, s[p : p + 50]), i), i)
    want = [least[k, s[p : p + 50]] for k, s in zip(keys, spans, strict=True) for p in range(len(s) - 49)]
    for size in (100, 300, 1000, 1 << 20):
        monkeypatch.setattr(substrings, "ARRAY_BYTES", size)
        starts = np.array([len(s) - 49 for s in spans])
        got = substrings.smallest(np.array(keys, np.uint64), starts, np.array(ids), np.frombuffer(b"".join(spans), np.uint8), 50)
        assert got.tolist() == want


# ---- token counts

def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    d = docs(spark, rows_of(spark) + [(5000, "  two  blanks "), (5001, "<s> </s>\n\nx"), (5002, "a\n b")])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(d, path, 100).collect()}
    for r in d.collect():
        n = len(sp.encode(r.text or ""))
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 100)
    assert tokens.count_tokens(empty(spark), path).count() == 0
    short = d.filter(F.length("text") < 200)
    tables = {r.doc_id: r.prefix_tokens for r in tokens.prefix_table(short, path).collect()}
    cuts = {r.doc_id: r.text for r in tokens.truncate(short, path, 7).collect()}
    for r in short.collect():
        assert list(tables[r.doc_id]) == [len(sp.encode(r.text[:i])) for i in range(1, len(r.text) + 1)]
        fits = [i for i in range(len(r.text) + 1) if len(sp.encode(r.text[:i])) <= 7]
        assert cuts[r.doc_id] == r.text[: max(fits)]


def test_tokens_of_long_runs_without_blanks():
    P = pytest.importorskip("public_tokenizers")
    import tracemalloc
    from pathlib import Path

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(9)
    counter = tokens.PrefixCounter(Path(path).read_bytes())
    runs = ["".join(r.choice(a) for _ in range(400)) for a in ("abcdefghij", "語言日本字。", "aé日😀\n▁ZQ+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0123456789+/")]
    runs += [("thequickbrownfox" * 20)[:300], " " * 200 + "x", "x" + "\n" * 150, "x" + " " * 130, *["ab" * n for n in (31, 32, 33)]]
    for t in runs:
        for text in (t, "a word " + t + " and " + t[:70]):
            assert counter.prefix_counts(text) == [len(sp.encode(text[:i])) for i in range(1, len(text) + 1)]
            assert counter.count(text) == len(sp.encode(text))
    long = "".join(r.choice("abcdefghij語言日本字😀") for _ in range(200_000))
    counter.prefix.clear(), counter.word.clear()
    tracemalloc.start()
    n = counter.count(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(sp.encode(long)) and peak < 400 << 20
    assert not any(len(k) > 64 for k in [*counter.prefix, *counter.word])


# ---- decontamination

def decontamination_brute(pairs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])] |= {str(i)} - {'None'}
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in pairs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def bench_items(spark):
    t = [x for x in texts() if x and len(x.split()) > 60]
    items = [(10, " ".join(t[0].split()[5:25])), (9, " ".join(t[0].split()[15:30]).upper()), (8, "one, two: three!"), (7, "!!!"), (6, None), (5, "word"), (5, "word"), (4, " ".join(t[3].split()[:14])), (None, " ".join(t[1].split()[40:55])), (None, None)]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark):
    items, frame = bench_items(spark)
    want = decontamination_brute(rows_of(spark), items)
    for block in (4 << 20, 60):
        out = decontaminate.scan(docs(spark), frame, 10, block)
        got = {r.row.doc_id: (r.scan.n_words, r.scan.n_hit, len(r.scan["items"])) for r in out.collect()}
        assert got == {k: v[:3] for k, v in want.items()}
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs(spark), frame).collect()}
    assert got == want
    assert decontaminate.report(empty(spark), frame).count() == 0
    none = decontaminate.report(docs(spark), frame.filter("item_id < 0"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts())


def test_decontamination_of_repeated_words():
    """Thousands of equal words, in the item and in the text, take a moment."""
    import time

    a = decontaminate.Automaton([("x", [b"la"] * 6000), ("y", [b"la"] * 4), (None, [b"do"] * 12)], 10)
    began = time.time()
    hit, items = a.scan([b"so"] + [b"la"] * 20_000 + [b"so"] * 3 + [b"la"] * 5 + [b"do"] * 11)
    assert time.time() - began < 2 and items == {"x", "y"}
    assert hit.tolist() == [False] + [True] * 20_000 + [False] * 3 + [True] * 16
    hit, items = a.scan([b"do"] * 10)
    assert hit.all() and items == set()


def test_decontaminate_cuts_and_keeps(spark):
    items, frame = bench_items(spark)
    d = docs(spark)
    out = decontaminate.decontaminate(d, frame)
    assert out.columns == d.columns
    before, got = {r.doc_id: r for r in d.collect()}, {r.doc_id: r for r in out.collect()}
    for i, v in decontamination_brute(rows_of(spark), items).items():
        if v[1] == 0:
            assert got[i] == before[i]
        elif 2 * v[1] > v[0]:
            assert i not in got
        else:
            assert got[i].n_chars == len(got[i].text) < len(before[i].text)
    left = decontamination_brute([(i, r.text) for i, r in got.items()], items)
    assert not any(v[4] for v in left.values())


# ---- mixing

def mixing_brute(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in target]
        above = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]] if free else []
        if not above:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]


def test_mixing(spark):
    rows = [(i, t) for i, t in rows_of(spark)]
    d = docs(spark, rows)
    got = mixing.mix_documents(d).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in d.collect()}
    by_source = Counter()
    for r in d.collect():
        by_source[r.source] += words[r.doc_id]
    target = mixing_brute(by_source)
    taken = Counter()
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == by_source[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(d.repartition(3)).collect()))
    assert mixing.mix_documents(empty(spark)).count() == 0
    out = mixing.apply_mix(d)
    assert out.columns == d.columns and max(Counter(r.doc_id for r in out.collect()).values()) <= 3


def test_mixing_small_sources_stop(spark):
    rows = [(None, "a", 5), (1, "a", 5), (1, "a", 5), (2, "b", 0), (3, None, 1000), (4, "c", 7), (5, "d", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    target = mixing_brute({"a": 15, "b": 0, None: 1000, "c": 7, "d": 0})
    assert {r.source: r.target for r in got} == pytest.approx(target)
    assert sum(r.taken for r in got) == 1022


def test_apply_mix_takes_rows_of_one_id_apart(spark):
    r = random.Random(8)
    rows = [(None, s, " ".join(["w"] * r.choice([3, 3, 4, 9])) + f" {s}{i}") for s, n in (("a", 20), ("b", 60), ("c", 90), (None, 50)) for i in range(n)]
    rows += [(7, s, "two words") for s in "abc" * 15] + [(i, "b", "x y z") for i in range(100, 140)] + [(None, "a", ""), (8, "a", None)]
    d = spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, source string, text string, times string")
    want = Counter()
    for x in mixing.mix_documents(d, whole=True).collect():
        want[x.doc_id, x.source, x.size] += x.taken // x.size if x.size else 0
    out = mixing.apply_mix(d)
    assert out.columns == d.columns
    got = out.collect()
    have = Counter((x.doc_id, x.source, len(x.text.split())) for x in got)
    assert have == +want
    # no row is taken two times more than one that the mix can't tell from it
    each = Counter((x.doc_id, x.source, x.text) for x in got)
    by_size = defaultdict(list)
    for i, s, t in rows:
        if i is None and t:
            by_size[s, len(t.split())].append(each[i, s, t])
    assert all(max(v) - min(v) <= 1 for v in by_size.values())


# ---- sharding

def sharding_brute(sized, limit):
    out = {}

    def split(rows, bits):
        if sum(n for _, n, _ in rows) <= limit or len(rows) <= 1 or len(bits) == 60:
            for i, _, _ in rows:
                out[i] = "s" + bits
            return
        for b in "01":
            part = [r for r in rows if format(r[2], "060b")[len(bits)] == b]
            split(part, bits + b)

    split(sized, "")
    return out


@pytest.mark.parametrize("limit, levels", [(300, 8), (2000, 2), (1 << 20, 1)])
def test_sharding(spark, monkeypatch, limit, levels):
    monkeypatch.setattr(sharding, "LEVELS", levels)
    rows = rows_of(spark)
    sized = [(i, len((t or "").encode()), int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)) for i, t in rows]
    want, got = sharding_brute(sized, limit), sharding.shard(docs(spark), limit).collect()
    total = Counter()
    for r in got:
        total[r.shard_id] += r.n_bytes
    rows_in = Counter(r.shard_id for r in got)
    for r in got:
        assert r.shard_bytes == total[r.shard_id] and r.shard_rows == rows_in[r.shard_id]
        assert r.shard_bytes <= limit or (r.oversized and r.shard_rows == 1)
        if r.n_bytes <= limit:
            assert r.shard_id == want[r.doc_id]
    assert len(got) == len(rows)
    assert sharding.shard(empty(spark), limit).count() == 0


def test_sharding_repeated_ids(spark, tmp_path):
    d = docs(spark, [(1, "x" * 40)] * 30 + [(2, "y" * 10), (None, None)])
    got = sharding.shard(d, 100).collect()
    assert len(got) == 32 and all(r.shard_bytes <= 100 for r in got)
    out = sharding.shard_documents(docs(spark), 2000)
    assert out.columns == [*docs(spark).columns, "shard_id"] and out.count() == len(texts())
    sharding.write_shards(docs(spark), f"{tmp_path}/shards", 2000)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(texts())


def test_shard_documents_keeps_the_limit(spark, tmp_path):
    rows = [(1, f"{i:02d}" * 10) for i in range(30)] + [(None, "y" * (1 + i % 30)) for i in range(60)] + [(k, "z" * 30) for k in range(2, 30)] + [(50, None)] * 3
    d = docs(spark, rows)
    sharding.write_shards(d, f"{tmp_path}/shards", 100)
    out = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    filled = Counter()
    for r in out:
        filled[r.shard_id] += len(r.text or "")
    assert max(filled.values()) <= 100
    assert len({r.shard_id for r in out if r.doc_id == 50}) == 1


# ---- licences

def test_licenses(spark):
    mit = " ".join(licenses.SENTENCES[k] + "." for k in ("mit_grant", "mit_notice", "as_is", "no_liability"))
    bsd = [licenses.SENTENCES[k].capitalize() + ". " for k in ("bsd_grant", "bsd_source", "bsd_binary")]
    rows = [
        (1, "Intro.\n" + mit), (2, "".join(bsd)), (3, "".join(bsd[::-1])), (4, "Text\nReleased under the MIT License.\nmore. Licensed under CC BY-NC 4.0."),
        (5, None), (6, ""), (7, "released under the mit license agreement."), (8, bsd[0] + "A title. " + bsd[1] + bsd[2]),
        (9, "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0!"),
    ]
    got = {r.doc_id: (r.licenses, r.n_matches, r.n_unmatched) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", 1, 0), 2: ("BSD-2-Clause", 1, 0), 3: ("", 0, 3), 4: ("CC-BY-NC-4.0,MIT", 2, 0), 5: ("", 0, 0), 6: ("", 0, 0), 7: ("", 0, 0), 8: ("BSD-2-Clause", 1, 0), 9: ("Apache-2.0", 2, 0)}
    assert licenses.scan(empty(spark)).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment would be appreciated.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
LGPL = GPL.replace("This program", "This library").replace("this program", "this library").replace("GNU General", "GNU Lesser General").replace("software: you", "software; you").replace("version 3", "version 2.1")
AGPL = GPL.replace("GNU General", "GNU Affero General")
CC = "Text of the page.\n\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.\n"


def licences_plainly(text):
    """Sentence by sentence and rule by rule: names, matches, known sentences that no rule used."""
    words = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).split()
    parts = [w for w in map(words, re.split(r"[.!?;:]+(?=[ \t-\r]|$)|[\n\r]+", text or "")) if w]
    by_words = {tuple(v.split()): k for k, v in licenses.SENTENCES.items()}
    ids, i = [], 0
    while i < len(parts):
        for j in range(len(parts), i, -1):  # the longest run of whole sentences that gives a known one
            k = by_words.get(tuple(w for p in parts[i:j] for w in p))
            if k:
                ids.append(k)
                break
        i = j if k else i + 1
    names, n, free = set(), 0, [True] * len(ids)
    for name, seq in sorted(licenses.RULES, key=lambda r: -len(r[1])):
        for a in range(len(ids) - len(seq) + 1):
            if all(free[a : a + len(seq)]) and ids[a : a + len(seq)] == seq:
                free[a : a + len(seq)] = [False] * len(seq)
                names.add(name)
                n += 1
    return len(parts), ",".join(ids), ",".join(sorted(names)), n, sum(free)


def test_licenses_by_a_plain_matcher(spark):
    r = random.Random(11)
    say = lambda: " ".join(r.choice(["some", "other", "words", "stand", "here"]) for _ in range(r.randint(1, 6)))
    sentences = list(licenses.SENTENCES.values())
    rows = [(i, "\n".join(r.choice([r.choice(sentences).capitalize() + r.choice([".", "", "!"]), say(), "", "; ".join([say(), say()]), r.choice([MIT, APACHE, GPL, MPL, ZLIB, LGPL])]) for _ in range(r.randint(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, ". . ;"), (7, rows[7][1]), (None, MIT)]
    got = Counter((x.doc_id, x.n_sentences, x.sentence_ids, x.licenses, x.n_matches, x.n_unmatched) for x in licenses.scan(docs(spark, rows)).collect())
    assert got == Counter((i, *licences_plainly(t)) for i, t in rows)


def test_licenses_of_verbatim_notices(spark):
    notices = [(MIT, "MIT", 4), (APACHE, "Apache-2.0", 4), (GPL, "GPL-3.0-or-later", 4), (GPL2, "GPL-2.0-or-later", 4), (MPL, "MPL-2.0", 2), (ZLIB, "Zlib", 6), (LGPL, "LGPL-2.1-or-later", 4), (AGPL, "AGPL-3.0-or-later", 4), ("// SPDX-License-Identifier: LGPL-3.0-or-later\n", "LGPL-3.0-or-later", 1), (CC, "CC-BY-SA-4.0", 1)]
    rows, want = [], {}
    for i, (text, name, known) in enumerate(notices):
        commented = "#!/bin/sh\n" + "".join("# " + x + "\n" for x in text.split("\n")) + "echo x; exit\n"
        for k, t in enumerate((text, commented, text.replace("\n", "\r\n"), " ".join(text.split()) if i else text)):
            rows.append((10 * i + k, t))
            want[10 * i + k] = (name, known, 1, 0)
    rows.append((900, APACHE + "\n" + MPL + "\nReleased under\nthe MIT License\nof old\nReleased under the\nMIT license"))
    want[900] = ("Apache-2.0,MIT,MPL-2.0", 8, 4, 0)
    got = licenses.scan(docs(spark, rows)).collect()
    assert {r.doc_id: (r.licenses, len(r.sentence_ids.split(",")), r.n_matches, r.n_unmatched) for r in got} == want


# ---- language

def test_language(spark):
    r = random.Random(1)
    parts = {"aa": ["the", "ing", "tion", "er", "wh"], "bb": ["sch", "keit", "ung", "ver", "ß"], "cc": ["ción", "ado", "que", "ñ", "os"]}
    say = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(k, r.choice([3, 40, 900])), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !? 4", "cc"), (503, say("aa", 30), None), (None, say("bb", 30), None)]
    d = spark.createDataFrame([(i, t, k, "x") for i, t, k in rows], "doc_id long, text string, lang string, score string")
    got = language.report(d).collect()
    assert len(got) == len(rows)
    true = {i: k for i, _, k in rows}
    for x in got:
        if x.doc_id in (500, 501, 502):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif x.doc_id is not None:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1
    known = [x for x in got if x.doc_id is not None and x.held_out and x.doc_id < 500]
    assert sum(x.lang_pred == true[x.doc_id] for x in known) >= 0.95 * len(known)
    assert language.keep_identified(d).count() == len(rows) - 3
    assert language.report(d.filter("doc_id < 0")).count() == 0
    assert {x.lang_pred for x in language.report(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_a_hundred_labels(spark, monkeypatch):
    r = random.Random(2)
    vocab = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(30)] for k in range(100)}
    texts = {k: [" ".join(r.choice(v) for _ in range(75)) for _ in range(2)] for k, v in vocab.items()}
    rows = [(100 * i + n, " ".join(r.choice(vocab[k]) for _ in range(40)), k) for i, k in enumerate(vocab) for n in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    true = {i: k for i, _, k in rows}
    assert all(x.lang_pred == true[x.doc_id] for x in language.report(d).collect() if any(zlib.crc32(str(100 * (x.doc_id // 100) + n).encode()) % 3 != 1 for n in range(4)))
    said = [t for _, t, _ in rows] + ["", None]
    whole = language.Model(texts)
    monkeypatch.setattr(language, "TABLE_BYTES", 1 << 20)
    blocks = language.Model(texts)
    assert whole.kept is not None and blocks.kept is None
    assert blocks.predict(said) == whole.predict(said)
    batches = list(language.predicted(blocks, [said[:100], [], said[100:]], 1 << 20))
    assert [len(b) for b in batches] == [100, 0, 302] and [x for b in batches for x in b.lang_pred] == [x for x, _ in whole.predict(said)]


def test_language_letters_of_every_script():
    r = random.Random(4)
    scripts = {"ar": range(0x627, 0x63B), "el": range(0x3B1, 0x3C2), "ja": range(0x3041, 0x3090), "ko": range(0xAC00, 0xB500), "ru": range(0x430, 0x450), "th": range(0xE01, 0xE2E), "zh": range(0x4E00, 0x5300), "en": range(0x61, 0x7B)}
    words = {k: ["".join(chr(r.choice(v)) for _ in range(4)) for _ in range(60)] for k, v in scripts.items()}
    words["zz"] = [w[::-1] for w in words["zh"]]
    m = language.Model({k: [" ".join(v * 3)] * 2 for k, v in words.items()})
    letters = {c for v in words.values() for w in v for c in w}
    assert len({m.alphabet.codes(c).tobytes() for c in letters}) == len(letters)
    assert m.alphabet.codes("Б" + words["ru"][0].upper()).tolist() == m.alphabet.codes("б" + words["ru"][0]).tolist()
    for k, v in words.items():
        assert m.predict([" ".join(r.choice(v) for _ in range(30))])[0][0] == k


def test_language_keeps_texts_where_nothing_is_learnt(spark):
    d = spark.createDataFrame([(1, "some words", None), (2, "语言", None), (3, "12 !", None), (4, None, None)], "doc_id long, text string, lang string")
    assert {x.doc_id for x in language.keep_identified(d).collect()} == {1, 2}


def test_phrases_by_brute_force():
    m = language.Model({"a": ["abracadabra banana"], "b": ["zebra quagga zzz"]})

    def parse(codes, body):
        n = at = 0
        while at < len(codes):
            end = at + 1
            while end < len(codes) and codes[at : end + 1] in body:
                end += 1
            n, at = n + 1, end
        return n

    import numpy as np

    r = random.Random(6)
    texts = ["abra banana zebra", "qqq", "zzz zebra abracadabra", "q x w", *["".join(r.choice("abcdrz ") for _ in range(r.choice([1, 9, 700, 3000]))) for _ in range(120)]]
    codes = [m.alphabet.codes(x) for x in texts]
    bodies = [m.alphabet.codes(x).tobytes() for x in ("abracadabra banana", "zebra quagga zzz")]
    want = np.array([[parse(c.tobytes(), b) for c in codes] for b in bodies])
    assert (m.phrases(codes) == want).all()  # in lockstep, with the longest alone
    assert (np.concatenate([m.phrases([c]) for c in codes], axis=1) == want).all()  # each alone


def test_language_of_which_little_was_learnt():
    """60 words learnt of one language, 24,000 of another one: neither is predicted for the other."""
    r = random.Random(12)
    vocab = {k: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(800)] for k, letters in (("few", "abcdefghijkl"), ("many", "ghijklmnopqrst"))}
    say = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    m = language.Model({"few": [say("few", 60)], "many": [say("many", 160) for _ in range(150)]})
    for k in vocab:
        got = [x for x, _ in m.predict([say(k, r.choice([5, 20, 200])) for _ in range(100)])]
        assert got.count(k) >= 97


def test_language_model_is_built_once_in_a_worker(spark):
    d = spark.createDataFrame([(i, "some words of text" if i % 2 else "ein paar worte", "en" if i % 2 else "de") for i in range(400)], "doc_id long, text string, lang string").repartition(16)
    import os
    import tempfile

    seen = tempfile.mkdtemp()
    udf = language.predictor(d, d, 10, 10)

    def count(batches):
        for b in batches:
            for model in language.BUILT.values():
                if isinstance(model, language.Model):
                    open(f"{seen}/{os.getpid()}-{id(model)}", "w").close()
            yield b

    d.select("doc_id", udf("text").alias("x")).select("doc_id", "x.lang_pred").mapInPandas(count, "doc_id long, lang_pred string").collect()
    made = os.listdir(seen)
    assert len(made) == len({m.split("-")[0] for m in made})  # one model in a process, whatever the number of tasks


# ---- toxicity

def test_toxicity_gradients():
    import numpy as np

    words = [b"alpha", b"beta", b"gamma"]
    net = toxicity.Network({w: i for i, w in enumerate(words, 1)}, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    ids = r.integers(0, 4, (5, 4))
    chars = r.standard_normal((5, 4, toxicity.EMBED)) * 0.1
    mask = np.arange(5)[:, None] < np.array([5, 3, 4, 1])[None, :]
    owner, y = np.array([0, 0, 1, 1]), np.array([1.0, 0.0])
    _, g, d_x = net.gradients(ids, chars, mask, owner, y, 2.0)
    for k in ("uf", "ub", "xf", "xbb", "att", "att_b", "att_v", "out", "out_b"):
        p = net.p[k]
        at = tuple(0 for _ in p.shape)
        old, eps, values = p[at], 1e-5, []
        for e in (eps, -eps):
            p[at] = old + e
            values.append(net.gradients(ids, chars, mask, owner, y, 2.0)[0])
        p[at] = old
        assert abs((values[0] - values[1]) / (2 * eps) - g[k][at]) < 5e-4, k


def test_toxicity_scores_by_brute_force(monkeypatch):
    """Whole texts, window by window and word by word, against the packed scorer."""
    import numpy as np

    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(80)] + ["é", "日本"]
    net = toxicity.train([" ".join(r.choice(vocab[:40]) for _ in range(60)) for _ in range(20)], [0, 1] * 10)
    texts = [" ".join(r.choice(vocab) for _ in range(n)) for n in (1, 2, 11, 12, 13, 24, 25, 36, 37, 100, 1000)] + ["A-b! C", None, "", "..."]
    p, half = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(w):
        marked = b"^" + w + b"$"
        slots = [((marked[i] << 16 | marked[i + 1] << 8 | marked[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(w))]
        return p["word"][net.vocab.get(w, 0)] + np.mean([p["char"][s] for s in slots], axis=0)

    def read(xs, d):
        h, out = np.zeros(half), []
        for x in xs:
            i, u = x @ p[f"x{d}"] + p[f"xb{d}"], h @ p[f"u{d}"]
            z, g = sig(i[:half] + u[:half]), sig(i[half : 2 * half] + u[half : 2 * half])
            h = (1 - z) * np.tanh(i[2 * half :] + g * u[2 * half :]) + z * h
            out.append(h)
        return out

    def plain(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        best = []
        for a in range(0, max(1, len(words) - 12), 12) if words else ():
            xs = [vector(w) for w in words[a : a + 24]]
            hs = np.array([np.concatenate(x) for x in zip(read(xs, "f"), read(xs[::-1], "b")[::-1], strict=True)])
            e = np.exp(np.tanh(hs @ p["att"] + p["att_b"]) @ p["att_v"])
            best.append((e / e.sum()) @ hs @ p["out"] + p["out_b"][0])
        return sig(max(best)) if best else sig(min(np.log(net.prior / (1 - net.prior)), -1.0))

    want = [plain(x) for x in texts]
    for lanes in (toxicity.LANES, 5):
        monkeypatch.setattr(toxicity, "LANES", lanes)
        assert np.allclose(net.scorer().scores(texts), want, atol=1e-4)


def test_toxicity(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    bad = ["nasty", "vile", "rotten"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(vocab) for _ in range(r.choice([8, 60, 200]))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "some text"), (902, " ".join(vocab * 60)), (6, rows[3][1]), (6, rows[3][1]), (903, " ".join(vocab * 60) + " nasty vile rotten " + " ".join(vocab * 9))]
    labels += [(900, 1, 1), (None, 1, 1), (0, 0, None), (7777, 1, 1), (6, 0, 0), (6, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.report(docs(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    held = [x for x in got if x.doc_id is not None and x.held_out and x.doc_id < 400]
    assert sum(x.predicted == (x.doc_id % 3 == 0) for x in held) >= 0.9 * len(held)
    assert {x.doc_id: x.predicted for x in got if x.doc_id in (900, 901, 902, 903)} == {900: 0, 901: 0, 902: 0, 903: 1}
    assert len({round(x.score, 4) for x in got if x.doc_id in (3, 6)}) == 2
    assert toxicity.report(empty(spark), lab).count() == 0
