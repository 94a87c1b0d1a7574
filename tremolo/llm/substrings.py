"""Deduplication of repeated passages with suffix arrays.

A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. Only strings that come
in several documents matter. Texts are packed into blocks of documents once; then three rounds go over the blocks:

1. Every string start is keyed by the smallest hash of the 20-byte grams in the string. Equal strings have equal keys,
   and neighbouring starts mostly share one, so a text becomes a few runs of starts. A block deals its keys, sorted and
   packed, to the parts of the key space; a part answers for each of them whether it comes in several documents.
2. A run of a shared key spans the bytes of its strings. A block deals each different span once, with the smallest id
   that has it, to the shard of its key. Since all occurrences of a string have one key, no match crosses shards. A key
   with very many starts is dealt string by string, over all shards, by the string's own hash.
   A shard puts its spans into suffix arrays by Larsson-Sadakane refinement: ranks by 8 bytes, then by 16, 32 and
   `length`, each time only within groups that are not told apart yet. Kasai's common prefixes show which neighbours
   agree in `length` bytes, and the smallest id of such a run is that of all its strings. An array holds about half a MB;
   where a key goes on in the next one, the strings of both are merged by binary search. The smallest ids are the
   answer to the block.
3. A block marks the bytes of the strings whose smallest id is below the document's own, and cuts them out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import saved, sliced_arrow, small_batches, width
from tremolo.llm.near import POWERS, mix64

LENGTH = 50
GRAM = 20
MIXER = np.uint64(0x9E3779B97F4A7C15)
#: A missing id counts as larger than any.
LAST = (1 << 63) - 1
#: Bytes of text in a block of documents (a larger text has one to itself), bytes of spans in one suffix array, and
#: starts of a key beyond which it is dealt string by string.
TEXT_BYTES, ARRAY_BYTES, MOST_STARTS = 8 << 20, 1 << 19, 20_000
#: Starts that are hashed at once.
CHUNK = 1 << 16
#: Leading bytes in which two words agree, by the number of bytes that the rest takes.
EQUAL = np.array([8, 7, 6, 5, 4, 3, 2, 1, 0, 0], np.int64)
#: Keys of a part on average, and parts that a task gets.
PART_KEYS, PARTS = 500_000, 4
BLOCK = "block long, n_bytes long, docs binary, sizes binary, data binary"


def words8(b: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number that sorts like them."""
    x = b.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, lowest ones first, so that equal upper bytes pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def table_of(kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


# ---- blocks of documents


def pack_blocks(batches: Iterator[pa.RecordBatch], text_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, data to blocks: ids, sizes and the bytes of their texts, compressed."""
    from pyspark import TaskContext

    kinds = [("block", pa.int64()), ("n_bytes", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]
    docs, data, size, n = [], [], 0, 0
    part = TaskContext.get().partitionId() << 32

    def out():
        whole = b"".join(data)
        row = part + n, size, np.array(docs, np.int64).tobytes(), np.fromiter(map(len, data), np.int64, len(data)).tobytes(), pa.compress(whole, "zstd", asbytes=True)
        return table_of(kinds, [row])

    for batch in sliced_arrow(batches):
        for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if docs and size + len(body) > text_bytes:
                yield out()
                docs, data, size, n = [], [], 0, n + 1
            docs.append(doc)
            data.append(body)
            size += len(body)
    if docs:
        yield out()


def unpacked(docs: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(sizes, np.int64)
    return np.frombuffer(docs, np.int64), n, np.frombuffer(pa.decompress(data, int(n.sum()), "zstd"), np.uint8)


def runs(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first starts, numbers of starts and hashes of the spans, for the runs of strings in a block's texts."""
    n, ends = len(data), np.cumsum(sizes)
    inside = np.ones(n, bool)  # starts of strings that do not go beyond their text
    for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        inside[max(a, e - length + 1) : e] = False
    up, down = POWERS.get(min(n, CHUNK + length))
    window, out = length - GRAM + 1, []
    for c in range(0, n - length + 1, CHUNK):
        b = data[c : c + CHUNK + length - 1]
        t = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * up[: len(b)], out=t[1:])
        m = t[GRAM:] - t[:-GRAM]
        m *= down[: len(m)]
        span = 1
        while 2 * span <= window:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < window:
            m = np.minimum(m[: len(m) - (window - span)], m[window - span :])
        ok = inside[c : c + len(m)]
        edge = ~ok
        edge[0] = True
        edge[1:] |= m[1:] != m[:-1]
        edge[1:] |= ~ok[:-1]
        at = np.flatnonzero(edge)
        count = np.diff(np.append(at, len(m)))
        good = ok[at]
        at, count = at[good], count[good]
        h = (t[at + count - 1 + length] - t[at]) * down[at]
        out.append((m[at], at + c, count, h))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key, first, count, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return mix64(key * MIXER), first, count, mix64(h + count.astype(np.uint64) * MIXER)  # smallest values are not uniform, keys are


def hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the string at each start."""
    up = POWERS.get(length)[0][:length]
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), CHUNK):
        some = starts[a : a + CHUNK]
        out[a : a + CHUNK] = (data[some[:, None] + np.arange(length)] * up).sum(axis=1, dtype=np.uint64)
    return mix64(out + MIXER)


def by_key(key: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The order by the upper bits of the key, then by some bits of the hash."""
    return np.argsort((key >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))


def expected(total: int, length: int) -> tuple[int, int]:
    """The number of runs in so many bytes, and the bits of a key that tell them apart."""
    records = int(total / (length - GRAM + 2) * 2) + 1
    return records, min(56, max(8, math.ceil(math.log2(records)) + 8))


def cuts(upper: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the parts of the key space begin and end among sorted upper bits of keys."""
    edges = [-(-(p << bits) // parts) for p in range(parts)]
    return np.append(np.searchsorted(upper, np.array(edges, np.uint64)), len(upper))


# ---- round 1: which keys come in several documents


def block_keys(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray, bits: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different keys (their upper bits, sorted), whether several ids have them, and the starts of their
    different spans."""
    key, first, count, h = runs(data, sizes, length)
    order = by_key(key, h, bits)
    k, h, n = key[order] >> np.uint64(64 - bits), h[order], count[order]
    d = docs[np.searchsorted(np.cumsum(sizes), first[order], side="right")]
    if not len(k):
        return k, np.zeros(0, bool), np.zeros(0, np.uint32)
    head = heads(k)
    new = np.zeros(len(k), bool)
    new[heads(k, h)] = True
    starts = np.minimum(np.add.reduceat(np.where(new, n, 0), head), MOST_STARTS + 1)
    return k[head], np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head), starts.astype(np.uint32)


def deal_keys(batches: Iterator[pa.RecordBatch], bits: int, parts: int, length: int) -> Iterator[pa.RecordBatch]:
    kinds = [("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("several", pa.binary()), ("starts", pa.binary())]
    for batch in sliced_arrow(batches, 1):
        block, *packed = (batch.column(c)[0].as_py() for c in ("block", "docs", "sizes", "data"))
        k, several, starts = block_keys(*unpacked(*packed), bits, length)
        at = cuts(k, bits, parts).tolist()
        yield table_of(kinds, [(p, block, planes(np.diff(k[a:b], prepend=np.uint64(0))), np.packbits(several[a:b]).tobytes(), planes(starts[a:b])) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a])


def grouped(batches: Iterator[pa.RecordBatch], by: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each value of a sorted column."""
    at, held = None, []
    for batch in sliced_arrow(batches):
        for value, *row in zip(*[batch.column(c).to_pylist() for c in (by, *columns)], strict=True):
            if value != at and held:
                yield at, held
                held = []
            at = value
            held.append(tuple(row))
    if held:
        yield at, held


def judge_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key of each block: 0, or 1 if it comes in several documents, 2 if it also has very many starts."""
    kinds = [("block", pa.int64()), ("part", pa.int32()), ("state", pa.binary())]
    for part, rows in grouped(batches, "part", ("block", "keys", "several", "starts")):
        keys = [np.cumsum(unplanes(r[1], np.uint64), dtype=np.uint64) for r in rows]
        sizes = [len(k) for k in keys]
        k = np.concatenate(keys)
        several = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8))[:n] for r, n in zip(rows, sizes, strict=True)])
        starts = np.concatenate([unplanes(r[3], np.uint32) for r in rows]).astype(np.int64)
        order = np.argsort(k)
        head = heads(k[order])
        many = np.diff(np.append(head, len(k)))
        met = (many > 1) | (np.add.reduceat(several[order], head, dtype=np.int64) > 0)
        hot = met & (np.add.reduceat(starts[order], head) > MOST_STARTS)
        state = np.empty(len(k), np.uint8)
        state[order] = np.repeat(met.astype(np.uint8) + hot, many)
        for a in range(0, len(rows), 1000):
            ends = np.cumsum(sizes)
            yield table_of(kinds, [(r[0], part, state[e - n : e].tobytes()) for r, n, e in zip(rows[a : a + 1000], sizes[a : a + 1000], ends[a : a + 1000].tolist(), strict=True)])


# ---- round 2: the smallest id of each string


class Spans:
    """The spans of a block whose keys are shared: for each occurrence its first start, number of starts, document and
    span; for each different span, sorted by key, its key, hash, first start, number of starts and smallest id."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, data: np.ndarray, state: np.ndarray, bits: int, length: int):
        key, first, count, h = runs(data, sizes, length)
        upper = key >> np.uint64(64 - bits)
        known, where = np.unique(upper, return_inverse=True)
        is_ = state[where]
        hot, cold = np.flatnonzero(is_ == 2), np.flatnonzero(is_ == 1)
        if len(hot):  # each string on its own
            one = np.repeat(first[hot], count[hot]) + ragged(count[hot])
            own = hashes(data, one, length)
            key, h = np.concatenate((key[cold], own)), np.concatenate((h[cold], own))
            first, count = np.concatenate((first[cold], one)), np.concatenate((count[cold], np.ones(len(one), np.int64)))
        else:
            key, h, first, count = key[cold], h[cold], first[cold], count[cold]
        order = by_key(key, h, bits)
        self.first, self.count, key, h = first[order], count[order], key[order], h[order]
        self.doc = docs[np.searchsorted(np.cumsum(sizes), self.first, side="right")]
        head = heads(key, h) if len(key) else np.zeros(0, np.int64)
        self.span = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
        self.key, self.hash, self.start, self.starts = key[head], h[head], self.first[head], self.count[head]
        self.least = np.minimum.reduceat(self.doc, head) if len(head) else np.zeros(0, np.int64)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each block with the answers to it, put together over the parts: block, docs, sizes, data, state, answers."""
    for block, rows in grouped(batches, "block", ("kind", "docs", "sizes", "data", "state", "n", "lengths", "values")):
        packed = next(r[1:4] for r in rows if r[0] == 0)
        state = np.frombuffer(b"".join(r[4] for r in rows if r[0] == 1), np.uint8)
        yield block, *unpacked(*packed), state, [r[5:8] for r in rows if r[0] == 2]


def deal_spans(batches: Iterator[pa.RecordBatch], bits: int, parts: int, length: int) -> Iterator[pa.RecordBatch]:
    kinds = [("part", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("keys", "hashes", "starts", "least", "bytes")]]
    for block, docs, sizes, data, state, _ in by_block(batches):
        s = Spans(docs, sizes, data, state, bits, length)
        at = cuts(s.key >> np.uint64(64 - bits), bits, parts).tolist()
        rows = []
        for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if b > a:
                size = s.starts[a:b] + length - 1
                body = data[np.repeat(s.start[a:b], size) + ragged(size)]
                rows.append((p, block, planes(s.key[a:b]), planes(s.hash[a:b]), planes(s.starts[a:b].astype(np.uint32)), planes(s.least[a:b]), pa.compress(body.tobytes(), "zstd", asbytes=True)))
        yield table_of(kinds, rows)


def suffix_array(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The starts, sorted by the `length` bytes from each on, by Larsson-Sadakane refinement: ranks by 8 bytes, then by
    twice as many, sorting in each round only what shares a rank with others."""
    n = len(text) - 7
    key = words8(text)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)  # the last round overlaps, so that it ends at `length`
        # ranks are places of a group's first member, so groups stay where they are
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank] > 1)
        open_ = open_[open_ + step < n]
        second = rank[open_ + step]
        sub = np.argsort(rank[open_] * n + second)
        at, first, second = open_[sub], rank[open_][sub], second[sub]
        head = np.concatenate(([True], first[1:] != first[:-1]))
        fresh = head | np.concatenate(([True], second[1:] != second[:-1]))
        index = np.arange(len(at))
        group = np.maximum.accumulate(np.where(head, index, 0))
        rank[at] = first + np.maximum.accumulate(np.where(fresh, index, 0)) - group
        depth += step
    return starts[np.argsort(rank[starts])]


def kasai(text: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Common prefixes, up to `length`, of each start in the array with the one before.

    Kasai's walk goes from a start to the next one, which keeps all but one byte of the last common prefix. That holds
    if the start before was told apart within `length` bytes and its own next start is in the array; else the count
    begins anew. The spans (first start, number of starts), in pieces of at most 32 starts, walk together, eight bytes
    at a time."""
    pieces = -(-count // 32)
    step = 32 * ragged(pieces)
    first, count = np.repeat(first, pieces) + step, np.minimum(np.repeat(count, pieces) - step, 32)
    words = words8(np.concatenate((text, np.zeros(15, np.uint8))))
    is_start = np.zeros(len(text) + 1, bool)
    is_start[order] = True
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(text), np.int64)
    lanes = np.argsort(-count, kind="stable")
    h = np.zeros(len(first), np.int64)
    alive = np.searchsorted(-count[lanes], -np.arange(1, int(count.max(initial=0)) + 1), side="right")
    for t, n in enumerate(alive.tolist()):
        lane = lanes[:n]
        i = first[lane] + t
        j = before[i]
        now = np.where(j < 0, 0, np.maximum(h[lane] - 1, 0))
        go = np.flatnonzero(j >= 0)
        while len(go):
            differ = words[i[go] + now[go]] ^ words[j[go] + now[go]]
            now[go] += EQUAL[(np.frexp(differ.astype(np.float64))[1] + 7) >> 3]
            go = go[(differ == 0) & (now[go] < length)]
        now = np.minimum(now, length)
        out[i] = now
        h[lane] = np.where((j >= 0) & (now < length) & is_start[j + 1], now, 0)
    return out[order]


class Array:
    """A suffix array of spans with common prefixes: the sorted different strings, their smallest ids, and each start's
    place among them."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int):
        size = starts + length - 1
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(starts)), starts)
        at = first[owner] + ragged(starts)
        order = suffix_array(text, at, length)
        common = kasai(text, order, first, starts, length)
        head = np.flatnonzero(np.concatenate(([True], common[1:] < length)))
        place = np.empty(len(text), np.int64)
        place[at] = np.arange(len(at))
        sorted_ = place[order]
        self.least = np.minimum.reduceat(docs[owner[sorted_]], head)
        self.of = np.empty(len(at), np.int64)
        self.of[sorted_] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        self.text, self.at, self.length = text, order[head], length

    def strings(self, which: np.ndarray) -> np.ndarray:
        # bytes of UTF-8 are never 0xFF: one more makes them safe for numpy's strings, which end at a 0
        return (self.text[self.at[which][:, None] + np.arange(self.length)] + np.uint8(1)).view(f"S{self.length}").ravel()


def smallest(key: np.ndarray, starts: np.ndarray, docs: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """For each start of spans sorted by key, the smallest id of its string."""
    ends = np.cumsum(starts + length - 1)
    number = np.cumsum(starts)
    arrays: list[tuple[int, int, Array]] = []
    out = np.empty(number[-1], np.int64)

    def close() -> None:
        for a, b, array in arrays:
            out[(number[a - 1] if a else 0) : number[b - 1]] = array.least[array.of]
        arrays.clear()

    a = 0
    while a < len(key):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + ARRAY_BYTES, side="right")))
        if arrays and key[arrays[-1][1] - 1] != key[a]:
            close()
        new = Array(text[base : ends[b - 1]], starts[a:b], docs[a:b], length)
        # a key that began in an array before: its strings there are sought among those here
        goes_on = int(np.searchsorted(key[a:b], key[a], side="right"))
        mine = np.unique(new.of[: starts[a : a + goes_on].sum()])
        for x, y, old in arrays:
            there = np.unique(old.of[number[x + np.searchsorted(key[x:y], key[a])] - starts[x + np.searchsorted(key[x:y], key[a])] - (number[x - 1] if x else 0) :])
            if len(there):
                known, sought = old.strings(there), new.strings(mine)
                where = np.minimum(np.searchsorted(known, sought), len(known) - 1)
                same = known[where] == sought
                low = np.minimum(new.least[mine[same]], old.least[there[where[same]]])
                new.least[mine[same]] = low
                old.least[there[where[same]]] = low
        arrays.append((a, b, new))
        a = b
    close()
    return out


def judge_spans(batches: Iterator[pa.RecordBatch], bits: int, length: int) -> Iterator[pa.RecordBatch]:
    """For each span of each block: runs of starts (their number, their lengths) and how far the smallest id of their
    strings is below the block's own."""
    kinds = [("block", pa.int64()), ("part", pa.int32()), ("n", pa.binary()), ("lengths", pa.binary()), ("values", pa.binary())]
    for part, rows in grouped(batches, "part", ("block", "keys", "hashes", "starts", "least", "bytes")):
        key, h = (np.concatenate([unplanes(r[i], np.uint64) for r in rows]) for i in (1, 2))
        starts = np.concatenate([unplanes(r[3], np.uint32) for r in rows]).astype(np.int64)
        own = np.concatenate([unplanes(r[4], np.int64) for r in rows])
        size = starts + length - 1
        ends = np.cumsum([len(r[1]) // 8 for r in rows]).tolist()
        text = np.frombuffer(b"".join(pa.decompress(r[5], int(size[a:b].sum()), "zstd") for r, a, b in zip(rows, [0, *ends], ends)), np.uint8)
        order = np.lexsort((h, key))
        head = heads(key[order], h[order])
        many = np.diff(np.append(head, len(key)))
        begin = np.cumsum(size) - size
        one = order[head]  # a span of each kind, with the smallest id over all blocks
        n = starts[one]
        body = text[np.repeat(begin[one], size[one]) + ragged(size[one])]
        values = smallest(key[one], n, np.minimum.reduceat(own[order], head), body, length)
        edge = np.zeros(len(values), bool)
        edge[np.cumsum(n) - n] = True
        edge[1:] |= values[1:] != values[:-1]
        at = np.flatnonzero(edge)
        lengths, values = np.diff(np.append(at, len(values))), values[at]
        which = np.searchsorted(np.cumsum(n), at, side="right")
        pieces = np.bincount(which, minlength=len(one))
        before = np.cumsum(pieces) - pieces
        kind = np.empty(len(key), np.int64)
        kind[order] = np.repeat(np.arange(len(one)), many)
        out = []
        for r, a, b in zip(rows, [0, *ends], ends):
            k = kind[a:b]
            get = np.repeat(before[k], pieces[k]) + ragged(pieces[k])
            below = np.repeat(own[a:b], pieces[k]) - values[get]
            out.append((r[0], part, planes(pieces[k].astype(np.uint32)), planes(lengths[get].astype(np.uint32)), planes(below)))
            if len(out) == 1000:
                yield table_of(kinds, out)
                out = []
        yield table_of(kinds, out)


# ---- round 3: what goes


def cut_out(batches: Iterator[pa.RecordBatch], bits: int, length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        kinds += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    for _, docs, sizes, data, state, answers in by_block(batches):
        gone = np.zeros(len(data) + 1, np.int32)
        if answers:
            s = Spans(docs, sizes, data, state, bits, length)
            pieces, lengths = (np.concatenate([unplanes(r[i], np.uint32) for r in answers]).astype(np.int64) for i in (0, 1))
            below = np.concatenate([unplanes(r[2], np.int64) for r in answers])
            offset = np.cumsum(lengths) - lengths
            offset -= np.repeat(offset[np.cumsum(pieces) - pieces], pieces)
            n = pieces[s.span]
            get = np.repeat((np.cumsum(pieces) - pieces)[s.span], n) + ragged(n)
            least = np.repeat(s.least[s.span], n) - below[get]
            hit = least < np.repeat(s.doc, n)
            a = (np.repeat(s.first, n) + offset[get])[hit]
            np.add.at(gone, a, 1)
            np.add.at(gone, a + lengths[get][hit] + length - 1, -1)
        removed = np.cumsum(gone[:-1]) > 0
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        stays = data[~removed].tobytes()
        total = np.concatenate(([0], np.cumsum(~removed)))
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        edge[firsts[sizes > 0]] = removed[firsts[sizes > 0]]
        starts = np.flatnonzero(edge)
        close = removed.copy()
        close[:-1] &= edge[1:] | ~removed[1:]
        stops = np.flatnonzero(close) + 1
        spans = np.searchsorted(starts, np.concatenate((firsts, ends)))
        rows = []
        for i, (doc, a, e, x, y) in enumerate(zip(docs.tolist(), firsts.tolist(), ends.tolist(), total[firsts].tolist(), total[ends].tolist(), strict=True)):
            kept = stays[x:y]
            p, q = spans[i], spans[len(docs) + i]
            row = (None if doc == LAST else doc, e - a, e - a - len(kept), int(q - p), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept, [{"start": u - a, "end": v - a} for u, v in zip(starts[p:q].tolist(), stops[p:q].tolist(), strict=True)]) if with_text else row)
        yield table_of(kinds, rows)


def deduplicate(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept (bytes) and spans.

    Texts are their UTF-8 bytes, null is empty. Strings are judged on the input: all their occurrences count, whatever
    else is removed there. A text below `length` bytes keeps everything. A null id counts as larger than any. Rows that
    repeat an id do not remove each other's strings. An empty table gives an empty table."""
    if length <= GRAM:
        raise ValueError(f"strings of more than {GRAM} bytes are needed")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), text.alias("data"))
    blocks = saved(rows.mapInArrow(lambda b: pack_blocks(b, TEXT_BYTES), BLOCK), "blocks", compression="uncompressed")
    whole = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")).first()
    records, bits = expected(whole["bytes"] or 0, length)
    tasks = max(width(docs.sparkSession), math.ceil(records / PART_KEYS / PARTS))
    parts = PARTS * tasks  # a task gets few of them, more or less
    wide = max(width(docs.sparkSession), math.ceil(whole["n"] / 4))

    dealt = blocks.mapInArrow(lambda b: deal_keys(b, bits, parts, length), "part int, block long, keys binary, several binary, starts binary")
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part")
    states = saved(dealt.mapInArrow(judge_keys, "block long, part int, state binary"), "states")

    def met(*answers: DataFrame) -> DataFrame:
        """The blocks, each together with the answers to it."""
        out = blocks.drop("n_bytes").withColumns({"kind": F.lit(0), "part": F.lit(-1)})
        for kind, a in enumerate(answers, 1):
            out = out.unionByName(a.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        for c in ("state", "n", "lengths", "values"):
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast("binary"))
        return out.repartition(wide, "block").sortWithinPartitions("block", "kind", "part")

    spans = met(states).mapInArrow(lambda b: deal_spans(b, bits, parts, length), "part int, block long, keys binary, hashes binary, starts binary, least binary, bytes binary")
    spans = spans.repartition(tasks, "part").sortWithinPartitions("part")
    least = saved(spans.mapInArrow(lambda b: judge_spans(b, bits, length), "block long, part int, n binary, lengths binary, values binary"), "least")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return met(states, least).mapInArrow(lambda b: cut_out(b, bits, length, with_text), schema + ", kept binary, spans array<struct<start: long, end: long>>" * with_text)


def deduplicate_sql(table: str = "documents", length: int = LENGTH) -> str:
    """The same in DuckDB's SQL: every string of every text (as hexadecimal digits of its bytes), grouped."""
    return f"""
WITH data AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM {table}),
strings AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, {2 * length}) AS s
  FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - {length} + 1, 0))) AS p FROM data)),
hashed AS (SELECT doc_id, p, md5_number(s) AS h FROM strings),
least AS (SELECT h, min(doc_id) AS lo, max(doc_id) AS hi FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, p FROM hashed JOIN least USING (h) WHERE lo < doc_id),
marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS head FROM starts),
islands AS (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked),
spans AS (SELECT doc_id, island, min(p) AS a, max(p) + {length} AS b FROM islands GROUP BY ALL),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS stopped FROM spans),
kept AS (
  SELECT d.doc_id, string_agg(substr(x, CAST(2 * stopped + 1 AS BIGINT), CAST(2 * (a - stopped) AS BIGINT)), '' ORDER BY a) AS body,
         max(b) AS stop, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN data d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN stop IS NULL THEN x ELSE body || substr(x, CAST(2 * stop + 1 AS BIGINT)) END)) AS kept_sha256
FROM data d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
