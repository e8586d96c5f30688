"""Benchmark passages in training texts, found by a stored positional inverted index.

Indexing reads the texts once. Each task cuts its texts into segments of about `TOKENS` words and writes
for each segment the posting list of every term: the places where it stands, ascending, as differences.
The table of (segment, term, list) lies in the shared folder, in the order of terms within a segment; a list of the
places where texts begin stands in it under `BEGIN`. Texts are apart by `GAP` places, so that no phrase reaches from
one into the next.

Test items are rows of terms with the terms' counts in the whole corpus, taken from the index. A phrase's rarest
term decides where it is looked for: joined with the index on that term, it goes only to segments that
have the term. There the lists of the phrase's terms are intersected, each shifted by the term's offset in the phrase, from the
rarest on, until none is left or the phrase is complete. That gives exact matches; a proximity match
asks only that all terms stand within a span of words of the rarest.

Terms are 64-bit hashes: two words that share one count as the same word, which for 10^9 different words and a test set of 10^5
is to be expected once in 10^5 runs.

Nothing of the corpus or of the test set passes the driver. Items are dealt to blocks of about `BLOCK` words,
and a segment meets each block that has items for it in a group of its own, so a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, if_small, stored

WINDOW = 10
TOKENS = 2_000_000  # words of a segment; making its lists takes a worker 24 bytes for each at once
GAP = 1
BLOCK = 500_000  # words of items that a segment meets at a time
CACHE = 200_000
BEGIN = 0  # the term under which the places of the texts' first words are listed

# letters A-Z in lower case, other letters and digits as they are, every other ASCII character a blank
_TABLE = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Terms(dict):
    """Word -> its number, a signed 64-bit hash other than BEGIN; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 8)
        self[word] = h = (h - (1 << 64) if h >> 63 else h) or 1
        return h


def posting_lists(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms in order, the lengths of their lists, and the lists as 32-bit differences (the first from 0).

    texts is emptied, and places are 32-bit, as a segment's words times the arrays that are held at once is what a worker needs.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + GAP) - (sizes + GAP)
    if len(begin) and begin[-1] + sizes[-1] >> 32:
        raise ValueError("a text is too long for 32-bit places")
    flat = np.concatenate([np.full(len(begin), BEGIN, np.int64), *texts])
    texts.clear()
    places = np.arange(len(flat) - len(begin), dtype=np.uint32)
    places += np.repeat((begin - (np.cumsum(sizes) - sizes)).astype(np.uint32), sizes)
    places = np.concatenate([begin.astype(np.uint32), places])
    order = np.argsort(flat, kind="stable").astype(np.uint32)
    flat = flat[order]
    steps = places[order]
    del places, order
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    terms = flat[first]
    del flat
    starts = steps[first]
    steps[1:] -= steps[:-1].copy()
    steps[first] = starts
    ends = np.append(first, len(steps))
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 4).astype("<i4")), pa.py_buffer(steps.astype("<u4", copy=False))])
    return terms, np.diff(ends), lists


def index(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> the stored index. Rows of two kinds.

    A text: segment, ord (its number there), doc_id, n. A posting list: segment, term, n (its length), places.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, n, number = Terms(), [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def flush(count: int) -> Iterator[pa.RecordBatch]:
            terms, lengths, lists = posting_lists(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(terms), task + number)), pa.nulls(len(terms), pa.int32()), pa.nulls(len(terms), ids.type), pa.array(lengths), pa.array(terms), lists],
                names=["segment", "ord", "doc_id", "n", "term", "places"],
            )

        for batch in batches:
            ids, first = batch.column("doc_id"), 0
            texts = batch.column("text")
            for i in range(len(texts) + 1):
                # a segment ends when it is full, and its texts' rows are sent with each batch
                if i == len(texts) or n >= TOKENS:
                    here = i - first
                    if here:
                        sizes = [len(t) for t in part[len(part) - here :]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(here, task + number)), pa.array(range(len(part) - here, len(part)), pa.int32()), ids[first:i], pa.array(sizes, pa.int64()), pa.nulls(here, pa.int64()), pa.nulls(here, pa.binary())],
                            names=["segment", "ord", "doc_id", "n", "term", "places"],
                        )
                    if n >= TOKENS:
                        yield from flush(n)
                        n, number = 0, number + 1
                    first = i
                if i < len(texts):
                    part.append(np.array([own[w] for w in words_of(texts[i].as_py())], np.int64))
                    n += len(part[-1]) + GAP
        if part:
            yield from flush(n)

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = slim.mapInArrow(run, f"segment long, ord int, doc_id {kind}, n long, term long, places binary")
    return stored(rows, "index", compression="zstd")


@dataclass
class Phrases:
    """Phrases of some items as rows of term numbers, -1 behind the end, -2 where the segment has no such term."""

    terms: np.ndarray
    counts: np.ndarray  # of the terms in the whole corpus
    lengths: np.ndarray
    items: np.ndarray  # the item of each phrase

    @property
    def rarest_first(self) -> np.ndarray:
        return np.argsort(np.where(self.terms == -1, np.iinfo(np.int64).max, self.counts), axis=1, kind="stable")


def windows_of(n: int, window: int) -> np.ndarray:
    """Where an item's phrases begin: each window of consecutive words, or the whole of a shorter item."""
    return np.arange(n - window + 1 if n >= window else min(n, 1))


def phrases_of(items: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, window: int) -> Phrases:
    """items: terms and counts of each. names: the terms that the segment has, in order."""
    terms, counts, owner = [], [], []
    for k, (ts, cs) in enumerate(items):
        at = windows_of(len(ts), window)
        places = at[:, None] + np.arange(window)
        inside = places < len(ts)
        places = np.minimum(places, max(len(ts) - 1, 0))
        found = np.minimum(np.searchsorted(names, ts), max(len(names) - 1, 0))
        number = np.where(names[found] == ts, found, -2) if len(names) else np.full(len(ts), -2)
        if len(at):
            terms.append(np.where(inside, number[places], -1))
            counts.append(cs[places])
            owner.append(np.full(len(at), k))
    if not terms:
        return Phrases(np.empty((0, window), np.int64), np.empty((0, window), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    table = np.concatenate(terms)
    return Phrases(table, np.concatenate(counts), (table != -1).sum(axis=1), np.concatenate(owner))


class Postings:
    """The lists of one segment in memory: terms in order, for each its places in order, and where texts begin."""

    def __init__(self, terms: np.ndarray, lengths: np.ndarray, lists: list[bytes]):
        order = np.argsort(terms, kind="stable")
        steps = np.frombuffer(b"".join([lists[i] for i in order.tolist()]), "<u4").astype(np.int64)
        lengths = lengths[order]
        first = np.cumsum(lengths) - lengths
        total = np.cumsum(steps)
        places = total - np.repeat(total[first] - steps[first], lengths) if len(steps) else steps
        own = terms[order] != BEGIN
        each = np.repeat(own, lengths)
        self.begin = places[~each]
        self.names, self.places = terms[order][own], places[each]
        self.first = np.concatenate([[0], np.cumsum(lengths[own])])
        self.span = int(places.max()) + 2 if len(places) else 1
        self.keys = np.repeat(np.arange(len(self.names)), lengths[own]) * self.span + self.places  # all lists as one ascending list

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.first[term] : self.first[term + 1]]

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at the place."""
        keys = terms * self.span + places
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (places >= 0) & (places < self.span)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, side="right") - 1

    def exact(self, p: Phrases, step: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrase numbers and places where they begin, in portions of about `step` postings."""
        order = p.rarest_first
        row = np.flatnonzero((p.terms != -2).all(axis=1))  # a term that the segment has not ends the search
        if not len(row):
            return
        term = p.terms[row, order[row, 0]]
        n = self.first[term + 1] - self.first[term]
        ends = np.cumsum(n)
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
            phrase = np.repeat(row[a:b], n[a:b])
            inner = np.arange(len(phrase)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            begin = self.places[np.repeat(self.first[term[a:b]], n[a:b]) + inner] - order[phrase, 0]
            for k in range(1, p.terms.shape[1]):
                offset = order[phrase, k]
                word = p.terms[phrase, offset]
                keep = (word < 0) | self.has(np.maximum(word, 0), begin + offset)
                phrase, begin = phrase[keep], begin[keep]
                if not len(phrase):
                    break
            yield phrase, begin
            a = b

    def near(self, p: Phrases, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrase numbers and places of their rarest term with every other term within slop words of it in the same text."""
        order = p.rarest_first
        for r in np.flatnonzero((p.terms != -2).all(axis=1)).tolist():
            terms = [int(p.terms[r, i]) for i in order[r] if p.terms[r, i] >= 0]
            places = self.list_of(terms[0])
            for t in terms[1:]:
                other = self.list_of(t)
                at = np.searchsorted(other, places)
                text, good = self.text_of(places), np.zeros(len(places), bool)
                for side in (np.minimum(at, len(other) - 1), np.maximum(at - 1, 0)):
                    good |= (np.abs(other[side] - places) <= slop) & (self.text_of(other[side]) == text)
                places = places[good]
                if not len(places):
                    break
            if len(places):
                yield np.full(len(places), r), places


def test_items(benchmark: DataFrame) -> DataFrame:
    """item, item_id (as text, null if null), terms for each item with a word; stored."""

    def terms():
        own = Terms()
        return lambda texts: ([[own[w] for w in words_of(t)] for t in texts],)

    found = each_text(terms, "terms array<long>")(F.col("text").cast("string"))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), found["terms"].alias("terms")).filter("size(terms) > 0")
    return stored(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def wanted_terms(items: DataFrame) -> DataFrame:
    """The different terms of the items, and BEGIN; stored, so that their size is known: a small table is broadcast, and the index is not shuffled for it."""
    terms = items.select(F.explode("terms").alias("term"))
    return stored(terms.union(items.limit(1).select(F.lit(BEGIN).cast("long"))).distinct(), "item-terms")


def counted_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """item, item_id, terms and counts (of the terms in the whole corpus)."""
    counts = known.groupBy("term").agg(F.sum("n").alias("count"))
    each = items.select("item", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    each = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("count", F.lit(0)).alias("count")))).alias("c"))
    return stored(items.join(each, "item").select("item", "item_id", "terms", F.col("c.count").alias("counts")), "items-counted")


def _anchors(items: DataFrame, window: int) -> DataFrame:
    """item, term: the rarest term of each phrase of which all terms occur, the first of equally rare ones."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
                w = min(window, len(terms))
                parts = np.lib.stride_tricks.sliding_window_view(counts, w)
                at = np.arange(len(parts)) + parts.argmin(axis=1)
                rare = np.unique(terms[at[counts[at] > 0]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), row["item"])), pa.array(rare)], schema=schema)

    return items.select("item", "terms", "counts").mapInArrow(run, "item long, term long")


def _matched(lists: DataFrame, items: DataFrame, slop: int | None, window: int, block: int) -> DataFrame:
    """segment, ord, hits (word numbers that a match covers), items (their item_ids) for each text with a match."""
    wanted = if_small(wanted_terms(items))
    # counts and routes both come from the lengths of the items' lists, so the index is read once for them
    known = stored(lists.select("segment", "term", "n").join(wanted, "term").filter(F.col("term") != BEGIN), "item-lists")
    words = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    items = counted_items(items, known).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(-(-words // block) or 1)))
    routed = stored(known.select("segment", "term").join(_anchors(items, window), "term").select("segment", "item").distinct(), "routes")
    asked = routed.join(items, "item").select("segment", "block", "item_id", "terms", "counts")
    # a segment sends a block the lists of the terms of those items that were routed to it, and of where its texts begin
    own = asked.select("segment", "block", F.explode("terms").alias("term"))
    by_block = stored(own.union(asked.select("segment", "block", F.lit(BEGIN).cast("long"))).distinct(), "asked-lists")
    needed = lists.join(wanted, "term").join(if_small(by_block), ["segment", "term"]).select("segment", "block", "term", "n", "places")
    asked = asked.select(F.col("segment").alias("s"), F.col("block").alias("b"), "item_id", "terms", "counts")
    shape = pa.schema([("segment", pa.int64()), ("ord", pa.int32()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def search(part: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(queries) or not len(part):
            return shape.empty_table()
        found = Postings(part["term"].to_numpy(), part["n"].to_numpy(), part["places"].to_pylist())
        names = queries["item_id"].to_pylist()
        asked_for = [(np.array(t, np.int64), np.array(c, np.int64)) for t, c in zip(queries["terms"].to_pylist(), queries["counts"].to_pylist())]
        p = phrases_of(asked_for, found.names, window)
        hits: dict[int, list[np.ndarray]] = {}
        items_: dict[int, set[int]] = {}
        for phrase, place in found.exact(p) if slop is None else found.near(p, slop):
            text = found.text_of(place)
            for t in np.unique(text).tolist():
                own = text == t
                start = place[own] - found.begin[t]
                length = p.lengths[phrase[own]] if slop is None else np.ones(int(own.sum()), np.int64)
                hits.setdefault(t, []).append(np.concatenate([np.arange(a, a + n) for a, n in set(zip(start.tolist(), length.tolist()))]))
                items_.setdefault(t, set()).update(p.items[phrase[own]].tolist())
        texts = sorted(hits)
        columns = [[part["segment"][0].as_py()] * len(texts), texts, [np.unique(np.concatenate(hits[t])) for t in texts], [[names[k] for k in sorted(items_[t])] for t in texts]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    found = needed.groupBy("segment", "block").cogroup(asked.groupBy("s", "b")).applyInArrow(search, "segment long, ord int, hits array<long>, items array<string>")
    return found.groupBy("segment", "ord").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")))


def matches(docs: DataFrame, benchmark: DataFrame, slop: int | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, hits, items for each row of docs.

    slop None: exact phrases. Otherwise proximity: hits are the places of a phrase's rarest term with
    all its other terms within slop words. Null texts have no words, null items no phrase; items
    with a null id are one item, null in the list. Repeated rows stay, repeated items count once by their id.
    """
    stored_index = index(docs)
    lists = stored_index.filter("places is not null").select("segment", "term", "n", "places")
    found = _matched(lists, test_items(benchmark), slop, window, block)
    texts = stored_index.filter("places is null").select("segment", "ord", "doc_id", F.col("n").alias("n_words"))
    none = {"hits": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}
    return texts.join(found, ["segment", "ord"], "left").select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) for c in none))


def summary(found: DataFrame) -> DataFrame:
    """The counts and digests of exact matches. An item without an id counts, but has no name in the digest."""
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose text no test phrase occurs. Columns stay as they are."""
    key = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    found = matches(docs.select(key.alias("doc_id"), "text"), benchmark)
    gone = stored(found.filter("size(hits) > 0").select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    return docs.join(if_small(gone), key == F.col("_gone"), "left_anti")
