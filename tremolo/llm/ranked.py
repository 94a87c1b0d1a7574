"""Ranked lexical search by an Aho-Corasick scan of the documents.

There is no document index: the terms of a block of items make one automaton, which goes to all tasks and finds each
term, with a separator on either side, in a pass over a text. What a text shows, its length and its frequencies of the
block's terms, is a slim row. Over all these rows the corpus counts are summed (documents, terms, documents of each
term), and the same rows are then scored: terms map to the items that hold them, and tasks keep their ten best
documents for each item.

Items go in blocks of bounded size, one at a time, so that neither the automaton nor the scores of a batch grow with
the number of items.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo.llm.common import BUILT, discard, saved, sliced_arrow, small_batches

#: Every byte of UTF-8 as the scan sees it: letters, digits and non-ASCII stay, A-Z become small, all else a space.
SEEN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of items in a block, and items of one block at most.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 4096
#: Products of term and item that a task holds at once, and scores.
TRIPLES, SCORES = 1 << 21, 1 << 21
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SEEN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def measure(n: int, n_docs: int, n_terms: int) -> int:
    """A document's m: its length against the mean."""
    return 100 - 75 + 75 * n * n_docs // n_terms


def gain(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def automaton(terms: list[bytes]):
    """Finds terms between separators. Bytes stand as characters of Latin-1, so that any UTF-8 goes through."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        built.add_word(f" {term.decode('latin-1')} ", k)
    if terms:
        built.make_automaton()
    return built


def frequencies(data: bytes | None, built) -> tuple[int, dict[int, int]]:
    """Terms of a text, with repeats, and how often each of the automaton's is there."""
    if not data:
        return 0, {}
    seen = b" " + data.translate(SEEN) + b" "
    space = np.frombuffer(seen, np.uint8) == 32
    n = int(np.count_nonzero(space[:-1] & ~space[1:]))
    return n, Counter([k for _, k in built.iter(seen.decode("latin-1"))]) if n and len(built) else {}


def counted(terms, key: str):
    """mapInArrow: (doc_id, text as bytes) to doc_id, n, terms, tfs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in BUILT:  # once in a worker, for one block
            BUILT.clear()
            BUILT[key] = automaton(terms.value)
        for batch in sliced_arrow(batches):
            found = [frequencies(x, BUILT[key]) for x in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([list(f) for _, f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for _, f in found], pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


class Best:
    """The best documents of each item so far: most points first, then the smallest id."""

    def __init__(self, items: int, k: int):
        self.k, self.score, self.doc = k, np.zeros((items, k), np.int64), np.full((items, k), NO_ID)

    def take(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores: documents x items."""
        last, doc = self.score[:, -1], self.doc[:, -1]
        better = (scores > last) | ((scores == last) & (docs[:, None] < doc) & (scores > 0))
        for item in np.flatnonzero(better.any(axis=0)):
            at = np.flatnonzero(better[:, item])
            score, doc = np.concatenate((self.score[item], scores[at, item])), np.concatenate((self.doc[item], docs[at]))
            order = np.lexsort((doc, -score))[: self.k]
            self.score[item], self.doc[item] = score[order], doc[order]

    def rows(self, first: int) -> pa.RecordBatch:
        item, at = np.nonzero(self.score > 0)
        doc = self.doc[item, at]
        return pa.record_batch([pa.array(item + first, pa.int64()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(self.score[item, at], pa.int64())], names=["item", "doc_id", "score"])


def scored(shared, k: int):
    """mapInArrow: counted() rows to each task's best documents for each item (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n_items, weights, start, items, times, n_docs, n_terms = shared.value
        best, each = Best(n_items, k), np.diff(start)

        def take(docs: np.ndarray, n: list[int], offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
            """The scores of some documents, in doubles: all are whole numbers below 2**53 (see search)."""
            doc = np.repeat(np.arange(len(docs)), np.diff(offsets))
            m = np.array([measure(x, n_docs, n_terms) for x in n], np.int64)
            points = (weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))).astype(float)
            reach = each[terms]
            ends = np.cumsum(reach)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - reach, reach) + np.repeat(start[terms], reach)
            cell = np.repeat(doc * n_items, reach) + items[at]
            total = np.bincount(cell, np.repeat(points, reach) * times[at], len(docs) * n_items)
            best.take(docs, total.astype(np.int64).reshape(len(docs), n_items))

        rows = max(1, SCORES // max(1, n_items))
        for batch in batches:
            docs = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n, lists, tfs = batch.column(1).to_pylist(), batch.column(2), batch.column(3).flatten().to_numpy(zero_copy_only=False)
            offsets, terms = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)
            triples = np.concatenate(([0], np.cumsum(each[terms])))[offsets]
            a = 0
            while a < len(docs):
                b = min(a + rows, max(a + 1, int(np.searchsorted(triples, triples[a] + TRIPLES, "right")) - 1), len(docs))
                take(docs[a:b], n[a:b], offsets[a : b + 1] - offsets[a], terms[offsets[a] : offsets[b]], tfs[offsets[a] : offsets[b]])
                a = b
        yield best.rows(first)

    return run


def blocks_of(benchmark: DataFrame, block_bytes: int, block_items: int) -> Iterator[list[tuple]]:
    """(item_id, Counter of terms) in blocks; one partition of the benchmark is on the driver at a time."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        if block and (size + len(text or "") > block_bytes or len(block) >= block_items):
            yield block
            block, size = [], 0
        block.append((item, Counter(terms_of(text))))
        size += len(text or "")
    if block:
        yield block


def search_block(spark: SparkSession, docs: DataFrame, block: list[tuple], first: int, k: int) -> DataFrame:
    """item (a number from `first` on), doc_id, score: the k best documents of each item; written."""
    terms = sorted({t for _, c in block for t in c})
    number = {t: x for x, t in enumerate(terms)}
    shared = spark.sparkContext.broadcast(terms)
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hits = saved(body.mapInArrow(counted(shared, uuid.uuid4().hex), "doc_id long, n long, terms array<int>, tfs array<long>"), "term-counts")
    n_docs, n_terms = hits.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # as many rows as the block has terms
    weights = np.array([weight(n_docs, df.get(x, 0)) for x in range(len(terms))], np.int64)
    pairs = sorted((number[t], item, times) for item, (_, c) in enumerate(block) for t, times in c.items())
    if any(sum(int(weights[number[t]]) * times for t, times in c.items()) * 1_000_000 >= 1 << 53 for _, c in block):
        raise ValueError("an item is so long that its scores are not exact")
    start = np.searchsorted([t for t, _, _ in pairs], np.arange(len(terms) + 1)) if pairs else np.zeros(1, np.int64)
    items, times = np.array([i for _, i, _ in pairs], np.int64), np.array([x for _, _, x in pairs], float)
    table = spark.sparkContext.broadcast((first, len(block), weights, start, items, times, n_docs, max(1, n_terms)))
    found = hits.filter(F.size("terms") > 0).mapInArrow(scored(table, k), "item long, doc_id long, score long")
    # each task hands on k rows for an item; these meet in groups of tasks first, so that an item's rows do not grow with
    # the number of tasks
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("group", F.spark_partition_id() % F.lit(64))
    for by in (["item", "group"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    out = saved(found.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranking")
    discard(hits)
    shared.destroy()
    table.destroy()
    return out


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Per item its k best documents: item_id, rank (from 1), doc_id, score.

    Each benchmark row is an item of its own, rows that repeat an id or have none too; a null or empty text, or one
    without terms, finds nothing. Null and empty documents have no terms and are never found. Each row of docs is a
    document: repeated rows take a rank each; one without an id ranks behind others of its score. No documents or no
    items give an empty table. An item whose scores could pass 2**53 (over 100,000 terms) is an error."""
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "item_id " + benchmark.schema["item_id"].dataType.simpleString() + ", rank int, doc_id long, score long")
    first = 0
    for block in blocks_of(benchmark, block_bytes, block_items):
        found = search_block(spark, docs, block, first, k)
        names = spark.createDataFrame([(first + x, item) for x, (item, _) in enumerate(block)], "item long, item_id " + benchmark.schema["item_id"].dataType.simpleString())
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        first += len(block)
    return out


def search_sql(k: int = 10) -> str:
    """The same in DuckDB's SQL, where items have one row each."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {split} AS t FROM documents),
held AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM docs WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
wanted AS (SELECT item_id, t AS term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({split}) AS t FROM benchmark) GROUP BY ALL),
tfs AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM held)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
points AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS p
  FROM tfs JOIN weights USING (term) JOIN held USING (r), total),
scores AS (
  SELECT item_id, r, CAST(sum(times * p) AS BIGINT) AS score FROM wanted JOIN points USING (term) GROUP BY item_id, r HAVING sum(times * p) > 0),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores JOIN held USING (r))
SELECT * FROM ranked WHERE rank <= {k}
"""
