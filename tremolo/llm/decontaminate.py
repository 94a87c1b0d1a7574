"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training texts are streamed through the automaton word by word; the length of the longest match that ends at a word
tells which windows of an item occur. Benchmark items go through in blocks of bounded size, one after the other, so that
the automaton and what is broadcast are small whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import BUILT, saved, small_batches, whole_row

#: Letters A-Z become small; ASCII that is neither letter nor digit becomes a space; all bytes from 0x80 belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.BinaryType())])
CUT = T.StructType([*SCAN.fields, T.StructField("clean", T.StringType())])
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences.

    items_at[state] are the items that have the window of `window` words; shorter items count as one window. The items'
    names may be missing: their windows count all the same."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.short: dict[int, set[str | None]] = {}
        self.shortest = window
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # for each state, that of the last `window` words of its longest string (itself if they are no more)
        self.at_window = list(range(len(self.len)))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if self.len[self.link[s]] >= window:
                self.at_window[s] = self.at_window[self.link[s]]
        self.items_at: dict[int, set[str | None]] = {}
        for name, seq in coded:
            if len(seq) < window:
                self.shortest = min(self.shortest, len(seq))
                self.short.setdefault(self._walk(seq), set()).add(name)
            else:
                s = n = 0
                for c in seq:
                    s, n = self.step(s, n, c)
                    if n >= window:
                        self.items_at.setdefault(self.at_window[s], set()).add(name)
        self._chain: dict[int, list[int]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _walk(self, seq: list[int]) -> int:
        s = 0
        for c in seq:
            s = self.next[s][c]
        return s

    def step(self, s: int, n: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while s and c not in self.next[s]:
            s = self.link[s]
            n = self.len[s]
        t = self.next[s].get(c)
        return (0, 0) if t is None else (t, n + 1)

    def short_ends(self, s: int) -> list[int]:
        """States of short items that are suffixes of s."""
        if s not in self._chain:
            found, t = [], s
            while t > 0:
                if t in self.short:
                    found.append(t)
                t = self.link[t]
            self._chain[s] = found
        return self._chain[s]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are in an occurrence of a window (None: none is), and the items that occur."""
        n_words = len(words)
        if n_words < self.shortest or not self.vocab:
            return None, set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, n_words)
        # only runs of known words that are long enough can hold a window
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        window, step, at_window = self.window, self.step, self.at_window
        met: set[int] = set()
        found: list[tuple[int, int]] = []  # first word of an occurrence, and the one behind it
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            s = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                s, n = step(s, n, c)
                if n >= window:
                    found.append((i - window, i))
                    met.add(at_window[s])
                if self.short and n:
                    for t in self.short_ends(s):
                        if self.len[t] <= n:
                            found.append((i - self.len[t], i))
                            met.add(-t)
        if not found:
            return None, set()
        change = np.zeros(n_words + 1, np.int64)
        spans = np.array(found)
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, spans[:, 1], -1)
        items = set().union(*[self.short[-t] if t < 0 else self.items_at[t] for t in met])
        return np.cumsum(change[:-1]) > 0, items - {None}


def clean(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them; a space joins what is left."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORDS.finditer(data.translate(FOLD))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    keep, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        keep.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    keep.append(data[at:])
    return b" ".join(x.strip() for x in keep if x.strip()).decode("utf-8", "surrogatepass")


def automaton_of(block, window: int) -> Automaton:
    """The worker's automaton, built when it is first asked for. (As a function of the module, it is the worker's own.)"""
    name, items = block.value
    if (name, window) not in BUILT:
        BUILT.clear()
        BUILT[name, window] = Automaton(items, window)
    return BUILT[name, window]


def scanner(block, window: int, cut: bool = False):
    """block: a broadcast of (name, [(item, words)]). cut: the text without its hit words comes too, if it has any.
    Then it is not deterministic for the optimizer, or a filter on what it finds goes below what else is made of it, and
    each text is scanned twice, by two workers for a task."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = automaton_of(block, window)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                hit, found = auto.scan(words)
                if hit is None:
                    rows.append((len(words), 0, [], None, None))
                else:
                    rows.append((len(words), int(hit.sum()), sorted(found), np.packbits(hit).tobytes(), clean(text, hit) if cut else None))
            yield pd.DataFrame(rows, columns=CUT.names)[kind.names]

    kind = CUT if cut else SCAN
    udf = F.pandas_udf(scan, kind)
    return udf.asNondeterministic() if cut else udf


@F.pandas_udf(SCAN)
def merged(blocks: pd.Series) -> pd.DataFrame:
    """One result out of those of several blocks."""
    rows = []
    for parts in blocks:
        hits = np.bitwise_or.reduce([np.frombuffer(p["hits"], np.uint8) for p in parts])
        rows.append((parts[0]["n_words"], int(np.unpackbits(hits).sum()), sorted({i for p in parts for i in p["items"]}), hits.tobytes()))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "hits"])


@F.pandas_udf(T.StringType())
def cleaned(texts: pd.Series, hits: pd.Series, n_words: pd.Series) -> pd.Series:
    return pd.Series([t if h is None or t is None else clean(t, np.unpackbits(np.frombuffer(h, np.uint8))[:n].astype(bool)) for t, h, n in zip(texts, hits, n_words, strict=True)], dtype=object)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[str, list[tuple[str | None, list[bytes]]]]]:
    """The benchmark in blocks of about block_bytes (a larger item is one by itself), one at a time."""
    block, size = [], 0
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text")

    def named() -> tuple[str, list]:
        return hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest(), block

    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield named()
            block, size = [], 0
        block.append((item, words_of(text)))
        size += len(text)
    yield named()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, cut: bool = False) -> DataFrame:
    """docs with a column `scan`: struct n_words, n_hit, items (sorted as strings), hits (a bit for each word); with
    `cut`, also clean, the text without its hit words (null if there are none).

    Texts and items are lower-cased A-Z and split into words of letters, digits and non-ASCII. A word is hit if it is
    in any occurrence of a window of an item; an item of fewer words is one window. Null and empty texts have no
    words, items without words no window; repeated items are one item; an item without an id hits, but is not named.
    Rows stay as they are, with all their columns. An empty benchmark hits nothing.

    One block of items is broadcast at a time. If there are several, rows are numbered and written, each block's hits are
    written before the next block comes, and are put together by row."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = docs.select(whole_row(docs))
    blocks = blocks_of(benchmark, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return packed.select("row", scanner(spark.sparkContext.broadcast(block), window, cut)("row.text").alias("scan"))
    rows = saved(packed.withColumn("at", F.monotonically_increasing_id()), "rows")
    parts = None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        part = rows.select("at", scanner(shared, window)("row.text").alias("scan"))
        kept = part.filter("scan.n_hit > 0") if parts is not None else part  # the first one also has the numbers of words
        kept = saved(kept, "hits")
        parts = kept if parts is None else parts.unionByName(kept)
        shared.destroy()
        block, after = after, next(blocks, None)
    hits = parts.filter("scan.n_hit > 0").groupBy("at").agg(F.collect_list("scan").alias("scans")).select("at", merged("scans").alias("all"))
    none = parts.filter("scan.n_hit = 0").select("at", "scan")
    whole = none.join(hits, "at", "full").select("at", F.coalesce("all", "scan").alias("scan"))
    out = rows.join(whole, "at").select("row", "scan")
    text = F.when(F.col("scan.n_hit") > 0, cleaned("row.text", "scan.hits", "scan.n_words"))
    return out.withColumn("scan", F.col("scan").withField("clean", text)) if cut else out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), benchmark, window)
    names = F.concat_ws(",", "scan.items")
    return out.select("row.doc_id", "scan.n_words", "scan.n_hit", F.size("scan.items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("scan.n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without contamination: hit words are cut out of the text (n_chars, where there is one, follows), and a
    document of which over `most` of the words are hit goes. Clean documents stay as they are."""
    out = scan(docs, benchmark, window, block_bytes, cut=True).filter(F.col("scan.n_hit") <= most * F.col("scan.n_words"))
    out = out.select("row", "scan", F.when(F.col("scan.n_hit") > 0, F.col("scan.clean")).otherwise(F.col("row.text")).alias("new"))
    fields = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("scan.n_hit") > 0, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*[v.alias(k) for k, v in fields.items()])


def report_sql(window: int = 10) -> str:
    """The same in DuckDB's SQL: windows of all items, joined to all windows of the documents of the same length."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    az = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({az.format("text")}, '{word}') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), {window}) AS size,
         array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + least(len(w), {window}) - 1 AS BIGINT)), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({az.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + size - 1 AS BIGINT)), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM docs, sizes)),
found AS (SELECT DISTINCT doc_id, i, g.size, item FROM grams g JOIN windows USING (win, size)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
