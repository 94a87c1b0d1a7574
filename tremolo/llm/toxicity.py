"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

The input of a word is the sum of its word embedding (for words of the training sample) and the mean embedding of its
character trigrams. A text is covered by overlapping windows; the network reads each one in both directions, pools the
states by attention and gives a logit. A text scores as its most toxic window. The network is trained on a bounded
sample of labelled documents on the driver, and its weights (about 1 MB) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import BUILT, held_out, small_batches, whole_row

#: A-Z become small; ASCII that is neither letter nor digit becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW, STEP = 24, 12
EMBED, HIDDEN, ATTEND = 12, 8, 8
TRIGRAMS = 4096
#: Distinct words whose input projections a worker remembers; what was forgotten is computed again.
REMEMBERED = 250_000
#: Windows that go through the network at once.
LANES = 4096


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    return np.arange(0, max(1, n - (WINDOW - STEP)), STEP) if n else np.zeros(0, np.int64)


def trigram_sums(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The mean embedding of each word's character trigrams, with a mark at either end."""
    b = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(20)
    start = np.concatenate(([0], np.cumsum(size + 2)[:-1]))
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.add.reduceat(table[slot[at]], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, vocab: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocab = vocab

        def w(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": (0.1 * rng.standard_normal((len(vocab) + 1, EMBED))).astype(np.float32),
            "char": (0.1 * rng.standard_normal((TRIGRAMS, EMBED))).astype(np.float32),
            "att": w(2 * HIDDEN, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": w(ATTEND), "out": w(2 * HIDDEN), "out_b": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        for d in "fb":
            self.p |= {f"x{d}": w(EMBED, 3 * HIDDEN), f"xb{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": w(HIDDEN, 3 * HIDDEN)}
        self.prior, self.trained = 0.5, True

    # -- forward over projected inputs: xs (direction) -> (step, lane, 3H), mask (step, lane)

    def _gru(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        u, h, states, saved = self.p[f"u{d}"], np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep:
                saved.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = np.where(m, new, h)
            states[t] = h
        return states, saved

    def _head(self, hs: np.ndarray, mask: np.ndarray):
        a = np.tanh(hs @ self.p["att"] + self.p["att_b"])
        e = np.where(mask, a @ self.p["att_v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tl,tlh->lh", alpha, hs)
        return a, alpha, pooled, pooled @ self.p["out"] + self.p["out_b"][0]

    def logits(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hs = np.concatenate([self._gru(x, mask, d, False)[0] for d, x in (("f", xf), ("b", xb))], axis=2)
        return self._head(hs, mask)[3]

    # -- training

    def gradients(self, ids: np.ndarray, chars: np.ndarray, mask: np.ndarray, owner: np.ndarray, labels: np.ndarray, sharp: float):
        """ids (step, lane) of words, chars (step, lane, E) trigram means, owner of each lane. Loss and gradients; those of
        the embeddings are by input."""
        p = self.p
        x = p["word"][ids] + chars
        xf, xb = (x @ p[f"x{d}"] + p[f"xb{d}"] for d in "fb")
        (hf, sf), (hb, sb) = self._gru(xf, mask, "f", True), self._gru(xb, mask, "b", True)
        hs = np.concatenate([hf, hb], axis=2)
        a, alpha, pooled, logit = self._head(hs, mask)
        # a document's logit: its windows' logits, weighted towards the largest
        n = len(labels)
        top = np.full(n, -np.inf, np.float32)
        np.maximum.at(top, owner, logit)
        wgt = np.exp(sharp * (logit - top[owner]))
        wgt /= np.bincount(owner, wgt, n)[owner]
        doc = np.bincount(owner, wgt * logit, n)
        prob = sigmoid(doc)
        loss = -np.mean(labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7))
        d_doc = (prob - labels) / n
        d_logit = (d_doc[owner] * wgt * (1 + sharp * (logit - doc[owner]))).astype(np.float32)
        g = {"out": d_logit @ pooled, "out_b": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["out"]
        d_hs = alpha[:, :, None] * d_pool
        d_alpha = np.einsum("tlh,lh->tl", hs, d_pool)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["att_v"] = np.einsum("tl,tla->a", d_e, a)
        d_a = d_e[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"] = np.tensordot(hs, d_a, ((0, 1), (0, 1)))
        g["att_b"] = d_a.sum(axis=(0, 1))
        d_hs = d_hs + d_a @ p["att"].T
        d_x = np.zeros_like(x)
        for d, saved, half in (("f", sf, slice(0, HIDDEN)), ("b", sb, slice(HIDDEN, None))):
            u, d_u, d_in = p[f"u{d}"], np.zeros_like(p[f"u{d}"]), np.zeros_like(xf)
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, cand, hu in reversed(saved):
                d_h = d_h + d_hs[t, :, half]
                m = mask[t][:, None]
                d_new = np.where(m, d_h, 0)
                d_n = d_new * (1 - z) * (1 - cand * cand)
                d_z = d_new * (h - cand) * z * (1 - z)
                d_r = d_n * hu * r * (1 - r)
                pre = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u += h.T @ pre
                d_h = np.where(m, d_new * z, d_h) + pre @ u.T
            g[f"u{d}"] = d_u
            g[f"x{d}"] = np.tensordot(x, d_in, ((0, 1), (0, 1)))
            g[f"xb{d}"] = d_in.sum(axis=(0, 1))
            d_x += d_in @ p[f"x{d}"].T
        return loss, g, d_x

    # -- scoring

    def scorer(self) -> "Scorer":
        return Scorer(self)


def coded(texts: Iterable[str | None]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """The different words of some texts, and each text as their numbers."""
    number: dict[bytes, int] = {}
    return number, [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]


def train(texts: Iterable[str | None], labels: list[int], epochs: int = 4, seed: int = 7) -> Network:
    """Adam on the binary cross-entropy of documents, over all windows of each of them. Words of three documents or more
    have embeddings of their own. Without texts of both labels nothing is learnt: every text scores as their share."""
    rng = np.random.default_rng(seed)
    number, docs = coded(texts)
    names = list(number)
    y = np.array(labels, np.float32)
    seen = np.zeros(len(names), np.int64)
    for ws in docs:
        seen[np.unique(ws)] += 1
    kept = np.flatnonzero(seen >= 3)
    net = Network({names[w]: i for i, w in enumerate(kept.tolist(), 1)}, seed)
    word_id = np.zeros(len(names), np.int64)
    word_id[kept] = np.arange(1, len(kept) + 1)
    net.prior = float((y.sum() + 1) / (len(y) + 2))
    use = np.array([i for i, ws in enumerate(docs) if len(ws)], np.int64)
    net.trained = len(set(y[use].tolist())) == 2
    if not net.trained:
        return net
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, half = 0, max(1, min(16, len(use) // 4))
    for epoch in range(epochs):
        order = rng.permutation(use)
        for a in range(0, len(order), 2 * half):
            some = order[a : a + 2 * half]
            flat = np.concatenate([docs[i] for i in some])
            size = np.array([len(docs[i]) for i in some])
            start = [windows_of(n) for n in size.tolist()]
            owner = np.repeat(np.arange(len(some)), list(map(len, start)))
            at = np.concatenate(start)[None, :] + np.arange(WINDOW)[:, None]
            mask = at < size[owner][None, :]
            distinct, local = np.unique(flat, return_inverse=True)
            local = local[np.minimum(at + (np.cumsum(size) - size)[owner][None, :], len(flat) - 1)]
            words = [names[w] for w in distinct.tolist()]
            ids = word_id[distinct]
            chars = trigram_sums(words, net.p["char"])
            loss, g, d_x = net.gradients(ids[local], chars[local], mask, owner, y[some], 1.0 + epoch)
            d_x[~mask] = 0
            by_word = np.stack([np.bincount(local.ravel(), d_x[:, :, k].ravel(), len(words)) for k in range(EMBED)], axis=1).astype(np.float32)
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], ids, by_word)
            g["word"][0] = 0
            g["char"] = trigram_gradient(words, by_word)
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                rate = 0.01 if k not in ("word", "char") else 0.004
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def trigram_gradient(words: list[bytes], grad: np.ndarray) -> np.ndarray:
    out = np.zeros((TRIGRAMS, EMBED), np.float32)
    b = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(20)
    start = np.concatenate(([0], np.cumsum(size + 2)[:-1]))
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    np.add.at(out, slot[at], np.repeat(grad / size[:, None].astype(np.float32), size, axis=0))
    return out


class Scorer:
    """Scores texts with a trained network; input projections of words are remembered."""

    def __init__(self, net: Network):
        self.net = net
        self.wx = np.concatenate([net.p["xf"], net.p["xb"]], axis=1)
        self.bias = np.concatenate([net.p["xbf"], net.p["xbb"]])
        self._reset()

    def _reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, 6 * HIDDEN), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        ids = np.array([self.net.vocab.get(w, 0) for w in words])
        x = (self.net.p["word"][ids] + trigram_sums(words, self.net.p["char"])) @ self.wx + self.bias
        n = len(self.row)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(words)] = x
        self.row.update(zip(words, range(n, n + len(words)), strict=True))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.row.get, words))
        if None in got:
            self._learn(list(dict.fromkeys(w for w, r in zip(words, got, strict=True) if r is None)))
            got = list(map(self.row.__getitem__, words))
        return np.array(got, np.int32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.net.trained:
            return np.full(len(texts), self.net.prior)
        best = np.full(len(texts), -np.inf, np.float32)
        queue: list[tuple[int, np.ndarray]] = []
        held = 0

        def run() -> None:
            nonlocal queue, held
            if not queue:
                return
            flat = np.concatenate([r for _, r in queue])
            size = np.array([len(r) for _, r in queue])
            first = np.cumsum(size) - size
            counts = np.array([len(windows_of(n)) for n in size])
            owner = np.repeat(np.arange(len(queue)), counts)
            start = np.concatenate([windows_of(n) for n in size])
            docs = np.array([i for i, _ in queue])
            for a in range(0, len(owner), LANES):
                o = owner[a : a + LANES]
                at = start[None, a : a + LANES] + np.arange(WINDOW)[:, None]
                mask = at < size[o][None, :]
                x = self.table[flat[np.minimum(at + first[o][None, :], len(flat) - 1)]]
                logit = self.net.logits(x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask)
                np.maximum.at(best, docs[o], logit)
            queue, held = [], 0

        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            if len(self.row) > REMEMBERED:
                run()
                self._reset()
            queue.append((i, self._rows(words)))
            held += len(words) // STEP + 1
            if held > LANES:
                run()
        run()
        base = np.log(self.net.prior / (1 - self.net.prior))
        return sigmoid(np.where(np.isneginf(best), min(base, -1.0), best).astype(np.float64))


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic, __h: at most `rows` documents of each label, those with the smallest hash of their id. Ranks are
    first taken within slices, so that no task sorts all documents of a label."""
    ids = labelled.select("doc_id", "toxic", F.xxhash64("doc_id").alias("__h"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("__slice")).distinct()
    best = ids.withColumn("r", F.row_number().over(Window.partitionBy("toxic", "__slice").orderBy("__h", "doc_id"))).filter(F.col("r") <= rows)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy("__h", "doc_id"))).filter(F.col("r") <= rows)
    return best.select("doc_id", "toxic", "__h")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 800, largest: int = 256 << 10) -> Network:
    """Train on whole texts of at most `rows` documents of each label, out of those of at most `largest` bytes: this
    bounds what comes to the driver. Labels that are null are left out; of an id with several labels, the largest holds."""
    clean = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    fits = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= largest)
    best = sample(fits.select("doc_id").join(clean, "doc_id"), rows)
    got = fits.select("doc_id", "text").join(F.broadcast(best), "doc_id").orderBy("__h", "doc_id", "text")
    marks: list[int] = []

    def texts() -> Iterator[str | None]:
        for text, toxic in got.select("text", "toxic").toLocalIterator():
            marks.append(toxic)
            yield text

    return train(texts(), marks)


def scorer_of(name: str, shared) -> Scorer:
    """The worker's scorer, made when it is first asked for. (As a function of the module, it is the worker's own.)"""
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = shared.value.scorer()
    return BUILT[name]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with a column toxicity (0 to 1), row by row. A text without words scores as the sample's share of toxic
    documents or less; whole texts are scored. If the sample lacks one of the labels, or both, all score as its share of
    toxic documents, (toxic + 1) / (all + 2)."""
    import uuid

    small_batches(docs.sparkSession)
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(name, shared)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))

    packed = docs.select(whole_row(docs))
    return packed.select("row", F.pandas_udf(run, "double")("row.text").alias("toxicity"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; learnt outside the fold that is held out."""
    fold = held_out(5, 0)
    docs = docs.select("doc_id", "text")
    net = fit(docs.filter(~fold), labels)
    out = score(docs, net).select(F.col("row.doc_id").alias("doc_id"), F.col("toxicity").alias("score"))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
