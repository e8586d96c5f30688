"""What filters take from each other, in every order, by min-plus removal ranks.

A document's mask says which filters it fails. In an order of the filters it goes at the first one that it fails: the
minimum, over the filters, of mask plus position, where the mask is 0 for a failed filter and infinite for a passed one, and the positions
of the filters in the orders are the inverse permutations. That product of two small matrices (masks by filters, filters by orders) in
the algebra of minimum and plus gives the removal step of every mask in every order.

So documents are counted once, by part and mask (with their weights: good, toxic), and each part's counts
are scattered to the removal steps of each order. There are 2^5 masks, so a part is one short row whatever its documents.

A duplicate is a text that a smaller id has too, anywhere in the table. Texts are compared by SHA-256. The smallest id of each repeated text is an
aggregation that combines on the map side, and joins back to rows of digests and ids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, if_small, join_hot, stored

FILTERS = "ABCDE"
DUPLICATE = 16  # the bit of E
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
PARTS = 256  # parts whose orders are worked out at a time


def own_failures(text: str) -> int:
    """Bits of the filters that look at a text alone: A few words, B repetitive, C upper case, D symbols."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    failed = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * len(text), symbols > 0
    return sum(1 << i for i, f in enumerate(failed) if f)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of A to D), digest of each row of docs; stored, so texts are read once."""

    def make():
        def run(texts: list[str | None]):
            texts = [t or "" for t in texts]
            return [own_failures(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]

        return run

    found = each_text(make, "mask int, digest binary")(F.col("text").cast("string"))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), found.alias("_r"))
    return stored(rows.select("doc_id", "part", "_r.mask", "_r.digest"), "audit")


def duplicates(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has. A null id is smaller than none, and none is smaller than it."""
    texts = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    return join_hot(rows, texts, "digest", "n", rows.count()).filter(F.col("doc_id") > F.col("first")).select(rows.columns)


def marks(labels: DataFrame) -> DataFrame:
    """id, good, toxic: whether any label of the id says so; null ids mark nothing."""
    any_of = {"good": "quality", "toxic": "toxic"}
    sums = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for name, c in any_of.items()]
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*sums).filter("good + toxic > 0")


def orders(n: int = len(FILTERS)) -> list[tuple[int, ...]]:
    return list(permutations(range(n)))


def removal_steps(n: int = len(FILTERS)) -> np.ndarray:
    """masks x orders: the step, from 1, at which a mask's documents go; n + 1 for those that stay."""
    failed = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    mask = np.where(failed == 1, 0, n + 1)
    position = np.argsort(np.array(orders(n)), axis=1) + 1  # of each filter in each order
    return np.minimum((mask[:, None, :] + position[None, :, :]).min(axis=2), n + 1)


def interactions(counts: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """parts x orders x steps, for each count. counts: parts x masks x (all, good, toxic)."""
    masks, n_orders = steps.shape
    n = masks.bit_length() - 1
    failed = np.arange(masks)[:, None] >> np.arange(n) & 1
    by = np.array(orders(n))  # orders x steps: the filter of a step
    removed = np.zeros((n_orders, n + 1, len(counts), 3), np.int64)
    np.add.at(removed, (np.arange(n_orders)[None, :], steps - 1), counts.transpose(1, 0, 2)[:, None])
    removed = removed[:, :n].transpose(2, 0, 1, 3)
    total = counts[:, :, 0].sum(axis=1)
    fails = counts[:, :, 0] @ failed  # parts x filters
    alone = counts[:, 1 << np.arange(n), 0]
    shapley = np.zeros((len(counts), n), np.int64)
    np.add.at(shapley, (slice(None), by), removed[..., 0])
    here = removed[..., 0]
    return {
        "kept": total[:, None, None] - np.cumsum(here, axis=2),
        "removed": here,
        "redundant": fails[:, by] - here,
        "unique_fails": alone[:, by],
        "good_lost": removed[..., 1],
        "toxic_lost": removed[..., 2],
        "shapley": shapley[:, by],
    }


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask (bits of A to E)."""
    rows = judged(docs)
    again = duplicates(rows).select("doc_id", "part", "mask")
    # a duplicate counts under its full mask, and is taken back from the one without E
    moved = again.withColumn("sign", F.lit(-1)).union(again.withColumn("mask", F.col("mask") + DUPLICATE).withColumn("sign", F.lit(1)))
    signed = rows.select("doc_id", "part", "mask", F.lit(1).alias("sign")).union(moved)
    marked = signed.join(if_small(stored(marks(labels), "marks")), F.col("doc_id") == F.col("id"), "left")
    sums = [F.sum("sign").alias("n"), *(F.sum(F.col("sign") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    return marked.groupBy("part", "mask").agg(*sums).filter("n > 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS, for every source of docs, order of the five filters and step.

    Null texts are empty, a null source is the empty one, and zeros are there. Repeated rows count each; a row of the same id and
    text is no duplicate of the other. Several labels of an id count together. No document gives no row. Other columns are not looked at.
    """
    n = len(FILTERS)
    names = ["".join(FILTERS[i] for i in o) for o in orders()]
    by_part = counted(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 2^n entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = removal_steps()
        for batch in batches:
            for a in range(0, len(batch), PARTS):
                part = batch.slice(a, PARTS)
                counts = np.zeros((len(part), 1 << n, 3), np.int64)
                for i, entries in enumerate(part.column("c").to_pylist()):
                    for e in entries:
                        counts[i, e["mask"]] = e["n"], e["good"], e["toxic"]
                found = interactions(counts, steps)
                columns: Sequence = [
                    part.column("part").take(pa.array(np.repeat(np.arange(len(part)), len(names) * n))),
                    pa.array(np.tile(np.repeat(names, n), len(part))),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(part) * len(names))),
                    *(pa.array(found[c].reshape(-1)) for c in COUNTS),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
