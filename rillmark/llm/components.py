"""Connected components of a link table, in Spark: alternating large-star and small-star rounds.

Between rounds each task replaces the links that it holds by stars of their own (a union-find over PART links at most), so
few rounds are left for the shuffles, and small link tables lie in few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


PART = 200_000  # links that a task contracts
LEAST_PARTS = 8


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node of its component) that connect what the links a-b connect."""
    if not len(a):
        return a, b
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(names))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            break
        low, high = np.minimum(ru[open_], rv[open_]), np.maximum(ru[open_], rv[open_])
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """Each node's neighbours move to its smallest neighbour: the larger ones, or the smaller ones and itself.

    n is the number of links, or more. A hub's links are many rows of one key; join_hot keeps them apart.
    """
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n"))
    joined = join_hot(both, low, "a", "n", 2 * n if large else n)
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def _contracted(links: DataFrame, n: int) -> DataFrame:
    """The same components with no more links: each part's links become stars. n is about the number of links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= 2 * PART:  # parts are uneven
                held, rows = [_stars(held)], 0
        if held:
            yield _stars(held)

    return cut(links.coalesce(max(LEAST_PARTS, -(-n // PART))).mapInPandas(run, "a long, b long"))


def _stars(held: list[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(held, ignore_index=True)
    a, b = forest(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
    return pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """links a, b -> id, root for every linked node other than a root; root is the smallest node.

    The driver sees only the number of links and a checksum of them in each round.
    """
    links = cut(links.filter("a <> b"))
    links, before = _contracted(links, links.count()), None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if not now["n"] or now == before:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
        links = _contracted(_star(_star(links, True, now["n"]), False, now["n"]), now["n"])
