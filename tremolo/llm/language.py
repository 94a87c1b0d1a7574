"""Language identification by cross-parsing entropy.

For each language, labelled text is turned into a suffix automaton. A text is parsed against each automaton into the
longest phrases that occur in the language's text. Counts are normalised by the phrases that the language's own text
needs, as measured between pieces of what was learnt, so that a language of which more was learnt has no advantage.
The language with the fewest normalised phrases wins.

Parsing goes in lockstep over many texts at once: the automaton is a dense table, a phrase ends where the table has no
transition, and one numpy gather advances all texts by one character. Where few texts are left, each is parsed alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import BUILT, held_out, small_batches, whole_row

UNKNOWN = "und"
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
#: Characters of a passage that is learnt.
PASSAGE = 1000
#: Characters learnt below which a language's own phrases are measured with more than two pieces.
FOLDED = 32_000
#: Texts in lockstep at most, and below which each is parsed alone.
LANES, FEW = 4096, 48
#: Bytes of tables that a worker holds at once, but for one language's at least.
TABLE_BYTES = 384 << 20
#: Characters of text that are parsed together where the tables are built again for them.
TOGETHER = 16 << 20


def sample(docs: DataFrame, rows: int = 96, passages: int = 48) -> DataFrame:
    """lang, __h, doc_id, at, text: of each language, at most `passages` passages of 1000 characters, out of at most
    `rows` labelled documents; those with the smallest hashes of the id, and of the id and the passage's place.

    Ranks are first taken within 64 slices of each language, so that no task sorts a whole language."""
    labelled = docs.filter("lang is not null and text is not null").select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("__h"))
    ids = labelled.select("lang", "doc_id", "__h", F.pmod("__h", F.lit(64)).alias("__slice"))
    first = Window.partitionBy("lang", "__slice").orderBy("__h", "doc_id")
    last = Window.partitionBy("lang").orderBy("__h", "doc_id")
    best = ids.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= rows)
    best = best.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= rows).select("lang", "doc_id").distinct()
    whole = labelled.join(F.broadcast(best), ["lang", "doc_id"], "left_semi")
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / PASSAGE).cast("int")))
    cut = whole.select("lang", "doc_id", "text", F.explode(at).alias("at"))
    cut = cut.select("lang", "doc_id", "at", F.expr(f"substring(text, at * {PASSAGE} + 1, {PASSAGE})").alias("text"), F.xxhash64("doc_id", "at").alias("__h"))
    spread = Window.partitionBy("lang").orderBy("__h", "doc_id", "at", "text")
    return cut.withColumn("r", F.row_number().over(spread)).filter(F.col("r") <= passages).select("lang", "__h", "doc_id", "at", "text")


class Alphabet:
    """Characters to small codes: those of the letters of the training texts; 0 for all that is no letter, 1 for letters
    that no training text has. Letters are folded to small ones.

    If the texts have more letters than codes, half of the codes go to the most frequent ones, and every other letter is
    spelt by several of the other half, so that no two letters share their codes."""

    SPELT = 255

    def __init__(self, texts: dict[str, str], most: int = 62):
        folded = "".join(texts.values()).lower()
        points, counts = np.unique(np.frombuffer(folded.encode("utf-32-le", "replace"), np.uint32), return_counts=True)
        letters = [int(p) for p in points[np.argsort(-counts, kind="stable")] if chr(p).isalpha()]
        self.base, self.digits, rare = 0, 0, []
        if len(letters) > most:
            self.base = most // 2
            letters, rare = letters[: most - self.base], letters[most - self.base :]
            self.digits = 1
            while self.base**self.digits < len(rare):
                self.digits += 1
        self.first = len(letters) + 2
        self.size = self.first + self.base
        self.rank = np.zeros(0x110000 if rare else 0, np.int32)
        self.code = np.zeros(0x110000, np.uint8)
        for p in range(0x110000):
            if not 0xD800 <= p < 0xE000 and chr(p).isalpha():
                self.code[p] = 1
        for i, p in enumerate(sorted(letters), 2):
            self.code[p] = i
        for i, p in enumerate(sorted(letters), 2):
            up = chr(p).upper()
            if len(up) == 1:
                self.code[ord(up)] = i
        for i, p in enumerate(sorted(rare)):
            for c in {chr(p), chr(p).upper()}:
                if len(c) == 1:
                    self.code[ord(c)], self.rank[ord(c)] = self.SPELT, i

    def codes(self, text: str) -> np.ndarray:
        """Codes of a text, runs of non-letters as one 0."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.code[points]
        if self.digits:
            rare = out == self.SPELT
            widths = np.where(rare, self.digits, 1)
            at = (np.cumsum(widths) - widths)[rare]
            rank = self.rank[points[rare]]
            out = np.repeat(out, widths)
            for d in range(self.digits):
                out[at + d] = self.first + rank // self.base**d % self.base
        if len(out) > 1:
            keep = np.empty(len(out), bool)
            keep[0] = True
            keep[1:] = (out[1:] | out[:-1]) != 0
            out = out[keep]
        return out


def suffix_automaton(codes: np.ndarray, size: int) -> np.ndarray:
    """The dense table of a suffix automaton: next state by state and code. Where a state has no transition, the entry
    is that of the root, as a negative number: -1 - state. A phrase ends there and the next begins."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
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
            if length[q] != length[p] + 1:
                new = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = new
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = new
                    p = link[p]
            else:
                link[cur] = q
        last = cur
    table = np.full((len(nxt), size), -1, np.int32)
    for s, to in enumerate(nxt):
        if to:
            table[s, list(to)] = list(to.values())
    root = np.where(table[0] >= 0, table[0], 0)  # a character the language lacks is a phrase of its own
    table = np.where(table >= 0, table, -1 - root[None, :]).astype(np.int32)
    table[0] = -1 - root
    return np.ascontiguousarray(table)


def parsed(table: np.ndarray, size: int, codes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of phrases of each text. Texts are in codes, from `first` on, by falling length."""
    n = len(lengths)
    count, state, at = np.zeros(n, np.int64), np.zeros(n, np.int32), first.copy()
    longest = int(lengths[0]) if n else 0
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right") if n >= FEW else np.zeros(0, np.int64)
    t = 0
    for m in alive.tolist():
        if m < FEW:
            break
        got = table[state[:m] * size + codes[at[:m]]]
        ended = got < 0
        count[:m] += ended
        state[:m] = np.where(ended, -1 - got, got)
        at[:m] += 1
        t += 1
    view = memoryview(table)
    for k in range(int(np.searchsorted(-lengths, -t, side="left"))):
        s, ended = int(state[k]), 0
        for c in codes[at[k] : first[k] + lengths[k]].tolist():
            s = view[s * size + c]
            if s < 0:
                ended += 1
                s = -1 - s
        count[k] += ended
    return count


def rate(codes: np.ndarray, size: int) -> float:
    """Phrases for each character that a language's own text needs: what was learnt is cut into 2 to 10 pieces, the fewer
    of it the more, and each piece is parsed by the automaton of the others. Phrases grow with the logarithm of what was
    learnt, which makes up for the piece that is left out."""
    total = len(codes)
    if total < 2:
        return 1.0
    folds = min(total, 10, max(2, math.ceil(FOLDED / total)))
    pieces, ended = np.array_split(codes, folds), 0
    for i, piece in enumerate(pieces):
        table = suffix_automaton(np.concatenate(pieces[:i] + pieces[i + 1 :]), size).ravel()
        ended += int(parsed(table, size, piece, np.zeros(1, np.int64), np.array([len(piece)]))[0])
    return ended / total * math.log(total * (1 - 1 / folds) + 1) / math.log(total + 1)


def smoothed(rates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Half way (by logarithm) to what a language of that size has by the law that phrases shorten with the logarithm of
    what was learnt, as all languages together have it: a single rate is noisy where little was learnt."""
    if not len(rates):
        return rates
    shape = np.log(sizes + 2.0)
    return np.sqrt(rates / shape * np.exp(np.mean(np.log(rates * shape))))


class Model:
    """Automata for the languages of a sample: language -> passages.

    Tables are kept as long as all of them fit in TABLE_BYTES. If they do not, those that fit together are built, used
    and freed, one block of languages after the other."""

    def __init__(self, passages: dict[str, list[str]]):
        self.langs = sorted(passages)
        self.alphabet = Alphabet({k: "\n".join(v) for k, v in passages.items()})
        self.learnt = [self.alphabet.codes("\n".join(passages[k])) for k in self.langs]
        self.rates = smoothed(np.array([rate(c, self.alphabet.size) for c in self.learnt]), np.array([len(c) for c in self.learnt]))
        first, n = next(self._built(0), ([], 0))
        self.kept = first if n == len(self.langs) else None

    def _built(self, k: int) -> Iterator[tuple[list[np.ndarray], int]]:
        """Blocks of tables from language k on, each with the number of the language behind it."""
        tables: list[np.ndarray] = []
        room = TABLE_BYTES
        while k < len(self.learnt):
            # a suffix automaton has fewer than twice as many states as codes
            most = (2 * len(self.learnt[k]) + 1) * self.alphabet.size * 4
            if tables and most > room:
                yield tables, k
                tables, room = [], TABLE_BYTES
            tables.append(suffix_automaton(self.learnt[k], self.alphabet.size).ravel())
            room -= tables[-1].nbytes
            k += 1
        if tables:
            yield tables, k

    def blocks(self) -> Iterator[tuple[list[np.ndarray], int]]:
        return self._built(0) if self.kept is None else iter([(self.kept, len(self.langs))])

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases by language and text."""
        lengths = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([*[codes[i] for i in order.tolist()], np.zeros(0, np.uint8)])
        lengths = lengths[order]
        first = np.cumsum(lengths) - lengths
        out = np.zeros((len(self.langs), len(codes)), np.int64)
        for tables, behind in self.blocks():
            for k, table in enumerate(tables, behind - len(tables)):
                for a in range(0, len(order), LANES):
                    some = slice(a, a + LANES)
                    out[k, order[some]] = parsed(table, self.alphabet.size, flat, first[some], lengths[some])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [self.alphabet.codes(t) if t else np.zeros(0, np.uint8) for t in texts]
        known = [i for i, c in enumerate(codes) if c.any()]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if known and self.langs:
            sizes = np.array([len(codes[i]) for i in known])
            # a text of one character is one phrase in every language
            need = self.phrases([codes[i] for i in known]) / (1 + (sizes[None, :] - 1) * self.rates[:, None])
            best = need.argmin(axis=0)
            for x, i in enumerate(known):
                rest = np.delete(need[:, x], best[x])
                out[i] = self.langs[best[x]], float(1 - need[best[x], x] / rest.min()) if len(rest) else 1.0
        return out


def model_of(name: str, passages) -> Model:
    """The worker's model, built when it is first asked for. (As a function of the module, it is the worker's own.)"""
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = Model(passages.value)
    return BUILT[name]


def predicted(model: Model, batches: list[list[str | None]], step: int) -> Iterator[pd.DataFrame]:
    """The predictions of each batch; `step` texts are parsed together."""
    values = [t for batch in batches for t in batch]
    rows: list[tuple[str, float]] = []
    for a in range(0, len(values), step):
        rows += model.predict(values[a : a + step])
    at = 0
    for batch in batches:
        yield pd.DataFrame(rows[at : at + len(batch)], columns=["lang_pred", "score"])
        at += len(batch)


def predictor(docs: DataFrame, train: DataFrame, rows: int, passages: int):
    """A column function text -> (lang_pred, score), with automata of at most `passages` passages of each language, which
    bounds what comes to the driver and goes to the workers. All languages are learnt."""
    learnt: dict[str, list[str]] = {}
    for lang, _, _, _, text in sample(train, rows, passages).orderBy("lang", "__h", "doc_id", "at", "text").toLocalIterator():
        learnt.setdefault(lang, []).append(text)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    name = hashlib.sha256(repr(sorted(learnt.items())).encode("utf-8", "surrogatepass")).hexdigest()

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_of(name, shared)
        waiting: list[list[str | None]] = []
        size = 0
        for texts in batches:
            waiting.append(texts.tolist())
            size += sum(len(t or "") + 64 for t in waiting[-1])
            if model.kept is not None or size >= TOGETHER:
                yield from predicted(model, waiting, 1000 if model.kept is not None else 1 << 20)
                waiting, size = [], 0
        yield from predicted(model, waiting, 1 << 20)

    return F.pandas_udf(predict, PREDICTION)


def identify(docs: DataFrame, train: DataFrame, rows: int = 96, passages: int = 48) -> DataFrame:
    """docs with a column lang_id (struct lang_pred, score), learnt from the rows of train.

    lang_pred is "und", with score 0, for texts that are null or have no letter, and where nothing was learnt. The
    score is the share of normalised phrases that the best language saves against the second, 1 if it is the only one.
    Ties go to the first language by name. Rows stay as they are; whole texts are parsed."""
    udf = predictor(docs, train, rows, passages)
    return docs.select(whole_row(docs)).select("row", udf("row.text").alias("lang_id"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learnt from documents outside the fold that is held out."""
    fold = held_out(3, 1)
    out = identify(docs.select("doc_id", "text"), docs.filter(~fold))
    return out.select("row.doc_id", "lang_id.*").select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told: no text, or no letter in it. Where nothing was learnt, texts
    with a letter stay."""
    out = identify(docs, docs.filter(~held_out(3, 1)))
    return out.filter((F.col("lang_id.lang_pred") != UNKNOWN) | F.col("row.text").rlike(r"\p{L}")).select("row.*")
