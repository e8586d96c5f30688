"""Ranked lexical search by hashed max-sketches.

A document scores the sum, over an item's terms with their repeats, of

    w(t) * ((1000000000 * tf) div (1000 * tf + 8 * m)),  w(t) = floor(1000 * ln((2 N + 2) / (2 df(t) + 1)))

where m = 25 + (75 * n * N) div L grows with the document's length. The second factor is a term's impact
in a document, at most a million. One job reads the texts and stores what each document holds: different terms, as sorted
64-bit hashes, and how often each stands there.

A document's sketch has `WIDTH` coordinates. Each of its terms falls into one, and the coordinate keeps the largest
impact that fell there. So an item's weights times the sketch's coordinates are never under the document's score. A task takes
its documents in blocks: one matrix product of the block's sketches with the weights of all items gives all upper bounds,
and each item's documents are scored exactly from the highest bound on, until the bound is under the score of the item's
last document so far. What a task keeps is each item's best documents; they are put together in two steps.

Items are searched in blocks of a bounded number of items and words, each a job over the stored documents, and a block is all that the
driver ever holds. Terms are 64-bit hashes: two that share one count as the same term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import each_text, stored
from .decontaminate import Terms, words_of

WIDTH = 4096  # coordinates of a sketch, a power of two
DOCS = 256  # documents that are bounded at a time
ROUND = 16  # documents that an item scores before its threshold moves
ITEMS = 1_000  # items of a block
WORDS = 200_000  # and their words
SALTS = 64


def index(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, n (terms with repeats), terms and counts (as bytes), for each document with a term; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms()
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                ids, n = np.unique(np.array([own[w] for w in words_of(text.as_py())], np.int64), return_counts=True)
                sizes.append(int(n.sum()))
                terms.append(ids.astype("<i8").tobytes())
                counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    return stored(slim.mapInArrow(run, "doc_id long, n long, terms binary, counts binary").filter("n > 0"), "postings", compression="zstd")


def query_items(items: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, terms of each row of items with a term; stored."""

    def terms():
        own = Terms()
        return lambda texts: ([[own[w] for w in words_of(t)] for t in texts],)

    found = each_text(terms, "terms array<long>")(F.col("text").cast("string"))
    return stored(items.select("item_id", found["terms"].alias("terms")).filter("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Of terms that stand tf times in documents of n terms; docs and terms are the corpus's totals. All in 64-bit integers."""
    m = 25 + (75 * n * docs) // terms
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def coordinates(terms: np.ndarray, width: int) -> np.ndarray:
    return (terms & (width - 1)).astype(np.int64)


def flat(buffers: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays one after another, and the length of each."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(buffers), kind).astype(np.int64), np.array([len(b) // size for b in buffers], np.int64)


def _document_counts(postings: DataFrame, names: np.ndarray) -> dict[int, int]:
    """In how many documents each of the terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(names), np.int64)
        for batch in batches:
            terms, _ = flat(batch.column("terms").to_pylist(), "<i8")
            at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
            n += np.bincount(at[names[at] == terms], minlength=len(names))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["at", "df"])

    rows = postings.select("terms").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    return {r["at"]: r["df"] for r in rows.collect()}  # as many as a block of items has terms, at most


@dataclass
class Queries:
    """A block of items: its different terms in order, and each item's terms with weight times repeats, one item after another."""

    names: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    terms: np.ndarray  # numbers of names
    weights: np.ndarray
    docs: int
    words: int

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.terms)))

    def table(self, width: int) -> np.ndarray:
        """What each item gives to each coordinate. Whole numbers; products with sketches stay under 2^53 and so are exact."""
        out = np.zeros((width, len(self.items)))
        np.add.at(out, (coordinates(self.names[self.terms], width), np.repeat(np.arange(len(self.items)), self.lengths)), self.weights)
        return out


def queries_of(rows: list, postings: DataFrame, docs: int, words: int) -> Queries:
    names = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))
    found = _document_counts(postings, names)
    w = np.array([weight(found.get(i, 0), docs) for i in range(len(names))], np.int64)
    own = [np.unique(np.searchsorted(names, np.array(r["terms"], np.int64)), return_counts=True) for r in rows]
    sizes = np.array([len(t) for t, _ in own])
    terms = np.concatenate([t for t, _ in own])
    return Queries(names, np.array([r["item"] for r in rows], np.int64), np.cumsum(sizes) - sizes, terms, w[terms] * np.concatenate([c for _, c in own]), docs, words)


class Best:
    """Each item's k best documents so far: by score, then documents with an id before those without, then by id."""

    def __init__(self, items: int, k: int):
        self.score, self.none, self.id = np.zeros((items, k), np.int64), np.ones((items, k), bool), np.zeros((items, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """A row of further documents for each item; a score of 0 stands for no document."""
        score, none, ids = (np.concatenate(x, axis=1) for x in ((self.score, score), (self.none, none), (self.id, ids)))
        order = np.lexsort((ids, none, -score), axis=1)[:, : self.score.shape[1]]
        self.score, self.none, self.id = (np.take_along_axis(x, order, axis=1) for x in (score, none, ids))


def rank_block(q: Queries, table: np.ndarray, best: Best, ids: np.ndarray, none: np.ndarray, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> int:
    """Fold a block of documents into best; the number of pairs that were scored exactly."""
    doc = np.repeat(np.arange(len(n)), sizes)
    impact = impacts(counts, n[doc], q.docs, q.words)
    width = len(table)
    sketch = np.zeros((len(n), width))
    np.maximum.at(sketch, (doc, coordinates(terms, width)), impact)
    bounds = sketch @ table
    at = np.minimum(np.searchsorted(q.names, terms), len(q.names) - 1)
    held = np.flatnonzero(q.names[at] == terms)  # ascending by document and term
    keys, values = doc[held] * len(q.names) + at[held], impact[held]
    order = np.argsort(-bounds, axis=0, kind="stable")
    ordered = np.take_along_axis(bounds, order, axis=0)
    lengths, scored = q.lengths, 0
    for a in range(0, len(n), ROUND):
        # a document at the threshold may have the smaller id
        open_ = (ordered[a : a + ROUND] >= np.maximum(best.last, 1)).T
        if not open_.any():
            break
        item, place = np.nonzero(open_)
        docs = order[a + place, item]
        size = lengths[item]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        entry = np.repeat(q.starts[item], size) + inner
        want = np.repeat(docs, size) * len(q.names) + q.terms[entry]
        found = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        part = np.where(keys[found] == want, values[found], 0) * q.weights[entry] if len(keys) else np.zeros(len(want), np.int64)
        exact = np.add.reduceat(part, np.cumsum(size) - size)
        score, lacks, id_ = np.zeros(open_.shape, np.int64), np.ones(open_.shape, bool), np.zeros(open_.shape, np.int64)
        score[item, place] = exact
        lacks[item, place], id_[item, place] = np.where(exact > 0, none[docs], True), np.where(exact > 0, ids[docs], 0)
        best.take(score, lacks, id_)
        scored += len(docs)
    return scored


def _ranked(postings: DataFrame, q: Queries, k: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best = q.table(width), Best(len(q.items), k)
        for batch in batches:
            for a in range(0, len(batch), DOCS):
                part = batch.slice(a, DOCS)
                ids = part.column("doc_id")
                terms, sizes = flat(part.column("terms").to_pylist(), "<i8")
                counts, _ = flat(part.column("counts").to_pylist(), "<u4")
                none = ids.is_null().to_numpy(zero_copy_only=False)
                rank_block(q, table, best, ids.fill_null(0).to_numpy(), none, part.column("n").to_numpy(), terms, counts, sizes)
        item, place = np.nonzero(best.score)
        found = pa.array(best.id[item, place], mask=best.none[item, place])
        yield pa.RecordBatch.from_arrays([pa.array(q.items[item]), found, pa.array(best.score[item, place])], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, width: int = WIDTH, block: tuple[int, int] = (ITEMS, WORDS)) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each row of items, equal scores by ascending doc_id.

    Null and empty texts have no terms and are never found, nor do such items find any. Repeated documents are ranked as
    often as they stand there; those without an id come after those of the same score that have one. Items of the same id are
    ranked one by one. Other columns of either table are not looked at.
    """
    postings, asked = index(docs), query_items(items)
    totals = postings.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    size = asked.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("words")).first()
    blocks = max(-(-size["items"] // block[0]), -(-size["words"] // block[1]))
    parts = []
    for b in range(blocks if totals["docs"] else 0):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect()
        if rows:
            parts.append(_ranked(postings, queries_of(rows, postings, totals["docs"], totals["words"]), k, width))
    if not parts:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = reduce(DataFrame.union, parts).withColumn("salt", F.spark_partition_id() % SALTS)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    for keys in (["item", "salt"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
