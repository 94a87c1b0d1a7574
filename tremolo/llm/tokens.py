"""Exact token counts at every prefix of a text, by dynamic programming over a piece vocabulary with byte fallback.

Merging by rank has two properties that make this exact. No piece has the blank mark after another character, so the
text falls apart before each run of blanks into segments that do not influence each other. Within a segment, the
encoding of a prefix without its last piece is the encoding of the shorter prefix, and a piece can follow another one
exactly if the two, joined and encoded, come out as the two. So each prefix's last piece is found from those of the
shorter prefixes, and its count is theirs plus one; counts of whole texts are sums over segments.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import BUILT, small_batches

BLANK = "▁"


class PrefixCounter:
    """Token counts of prefixes for one SentencePiece BPE model with the identity normaliser."""

    #: Prefixes and words that are remembered. They only save work: what was forgotten is computed again.
    REMEMBERED = 600_000
    #: Characters of the longest segment whose prefixes are remembered; a longer one's are kept by position, not as
    #: texts, and only while it is counted.
    LONGEST = 64

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
        self.dummy = norm.add_dummy_prefix
        self.pieces = {p.piece for p in proto.pieces if p.type == 1}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces) or any(p.type == 4 for p in proto.pieces):
            raise ValueError("pieces that hold a blank after another character, or are defined by the user, are not supported")
        #: For three characters, the length of the longest piece that ends in them.
        self.reach: dict[str, int] = {}
        for p in self.pieces:
            if len(p) > 2:
                self.reach[p[-3:]] = max(self.reach.get(p[-3:], 0), len(p))
        #: A line break stands in no piece: what follows it starts afresh.
        self.breaks = not any("\n" in p for p in self.pieces)
        norm.add_dummy_prefix = False
        self.encode = SentencePieceProcessor(model_proto=proto.SerializeToString()).encode_as_pieces
        self.follows: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.prefix: dict[str, tuple[str, int]] = {}
        self.word: dict[str, int] = {}

    def _may_follow(self, before: str, piece: str) -> bool:
        key = before, piece
        ok = self.follows.get(key)
        if ok is None:
            if before:
                ok = self.encode(before + piece) == [before, piece]
            else:
                ok = self.encode(piece) == [piece]
            if len(self.follows) > 4 * self.REMEMBERED:
                self.follows.clear()
            self.follows[key] = ok
        return ok

    def _table(self, segment: str) -> list[int] | array:
        """For each prefix of the segment, from one character on: its count."""
        if len(segment) > self.LONGEST:
            return self._long(segment)
        self._last(segment)
        return [self.prefix[segment[:j]][1] for j in range(1, len(segment) + 1)]

    def _long(self, segment: str) -> array:
        """_table() for a segment of any length, in memory of a few bytes a character."""
        pieces, reach, follows = self.pieces, self.reach, self.follows
        n = len(segment)
        # by the prefix's length: where its last piece starts (its end where that is bytes), and its count
        starts, counts = array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
        for j in range(1, n + 1):
            k = j - reach.get(segment[j - 3 : j] if j > 2 else "", 2)
            for k in range(k if k > 0 else 0, j):
                piece = segment[k:j]
                if piece in pieces:
                    before = segment[starts[k] : k]
                    ok = follows.get((before, piece))
                    if ok is None:
                        ok = self._may_follow(before, piece)
                    if ok:
                        starts[j], counts[j] = k, counts[k] + 1
                        break
            else:
                starts[j], counts[j] = j, counts[j - 1] + len(segment[j - 1].encode("utf-8", "surrogatepass"))
        return counts[1:]

    def _last(self, segment: str) -> int:
        """The segment's count; fills in self.prefix for it and all its prefixes, if it is not a long one."""
        if len(segment) > self.LONGEST:
            return self._long(segment)[-1]
        seen = self.prefix
        if segment in seen:
            return seen[segment][1]
        if len(seen) > self.REMEMBERED:
            seen.clear()
        pieces, reach, follows = self.pieces, self.reach, self.follows
        start = n = len(segment)
        while start and segment[:start] not in seen:
            start -= 1
        for j in range(start + 1, n + 1):
            found = None
            k = j - reach.get(segment[j - 3 : j] if j > 2 else "", 2)
            for k in range(k if k > 0 else 0, j):
                piece = segment[k:j]
                if piece in pieces:
                    before, count = seen[segment[:k]] if k else ("", 0)
                    ok = follows.get((before, piece))
                    if ok is None:
                        ok = self._may_follow(before, piece)
                    if ok:
                        found = piece, count + 1
                        break
            if found is None:  # a character outside the vocabulary: its bytes, after which anything can follow
                count = seen[segment[: j - 1]][1] if j > 1 else 0
                found = "", count + len(segment[j - 1].encode("utf-8", "surrogatepass"))
            seen[segment[:j]] = found
        return found[1]

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        parts, blanks, out = text.replace(BLANK, " ").split(" "), int(self.dummy), []
        for i, w in enumerate(parts):
            blanks += i > 0
            if w:
                out.append(BLANK * blanks + w)
                blanks = 0
        if blanks:
            out.append(BLANK * blanks)
        return out

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of the table of every segment, added up."""
        if not text:
            return 0
        known = self.word
        if len(known) > self.REMEMBERED:
            known.clear()
        if self.dummy and self.breaks and text[0] not in " \n" and text[-1] != " " and BLANK not in text:
            marked = text.replace("\n", " \n")
            if "  " not in marked:  # the common case: every segment is one blank or line break, and a word
                words = marked.split(" ")
                counts = list(map(known.get, words))
                if None in counts:
                    for i, c in enumerate(counts):
                        if c is None:
                            w = words[i]
                            if w[:1] == "\n":
                                c = 1 + (self._last(w[1:]) if len(w) > 1 else 0)
                            else:
                                c = self._last(BLANK + w)
                            counts[i] = c
                            if len(w) <= self.LONGEST:
                                known[w] = c
                return sum(counts)
        return sum(map(self._last, self.segments(text)))

    def prefix_counts(self, text: str | None) -> list[int]:
        """The token count of text[:i] for every i from 1 to the text's length."""
        out, base, lead = [], 0, int(self.dummy)
        for s in self.segments(text or ""):
            table = self._table(s)
            out += [base + c for c in table[lead:]]
            base += table[-1]
            lead = 0
        return out

    def cut(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens, found in the prefix counts."""
        counts = self.prefix_counts(text)
        return max((i for i, c in enumerate(counts, 1) if c <= budget), default=0)


def _counter(model) -> PrefixCounter:
    data = model.value
    if data not in BUILT:
        BUILT.clear()
        BUILT[data] = PrefixCounter(data)
    return BUILT[data]


def _model(docs: DataFrame, path: str):
    """The vocabulary file is half a MB; it goes to the workers as a broadcast."""
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit. A null or empty text has none of either. Rows stay
    one by one, with no shuffle; special tokens' strings inside a text are ordinary text."""
    model = _model(docs, model_path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.pandas_udf(count, "long")("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id and prefix_tokens, whose i-th element (from 1) is the token count of the first i characters.
    Any later question on truncation or budgets is a lookup."""
    model = _model(docs, model_path)

    def tables(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model)
        for texts in batches:
            yield pd.Series([counter.prefix_counts(t) for t in texts], dtype=object)

    return docs.select("doc_id", F.pandas_udf(tables, "array<int>")("text").alias("prefix_tokens"))


def truncate(docs: DataFrame, model_path: str, budget: int) -> DataFrame:
    """docs with each text cut to its longest prefix of at most `budget` tokens; null stays null."""
    model = _model(docs, model_path)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model)
        for texts in batches:
            yield pd.Series([t if t is None else t[: counter.cut(t, budget)] for t in texts], dtype=object)

    return docs.withColumn("text", F.pandas_udf(cut, "string")("text"))
