"""SimHash near-duplicates found through pivot distance tables.

A document's fingerprint is the bitwise majority of its shingle hashes. Two fingerprints link when
at most `radius` bits differ; a component is what links connect.

Pivot tables. `PIVOTS` reference fingerprints are fixed. A row of the table holds a fingerprint's Hamming
distances to all of them, one within each band of bits; a band's distances are its coordinates.

* Candidates. If x and y differ in at most r bits and the bits are cut into r + 2 bands, two bands at least
  are equal, and there all coordinates are. Rows that agree in all coordinates of
  two bands meet in one bucket (an equi-shuffle, no cross join).
* Discarding. By the triangle inequality |d(x, p) - d(y, p)| <= d(x, y) within each band and for each pivot p, so
  the largest coordinate differences of the bands sum to d(x, y) at most. A bucket's rows are in the order of
  their distance to the first pivot, and a row is compared only as long as that differs by r or less; then a
  pair is discarded if the sum exceeds r.
* What survives is verified by popcount.

A bucket of more than `BUCKET` fingerprints is not compared: its rows go to the next level, where
the bits that are still free are cut into r + 1 bands and one of those must be equal as well. A
bucket's free bits shrink at each level, so the
loop ends with every pair compared. A task emits a spanning forest of the links that it finds, not
the links; no pair list of a dense group is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, each_text, if_small, join_hot, partitions, stored, whole_row
from .components import components, forest

BITS = 64
PIVOTS = 16
BANDS = 8  # of the coordinates that discard pairs
BUCKET = 4096
PORTION = 500_000  # pairs listed at a time
COORDINATES = 4 << 20  # of each side of the pairs that are compared at a time
# wide fingerprints: words of 64 bits; the chance that a bit differs for texts of a similarity of just 0.8 (the angle
# arccos(2 * 0.8 / 1.8) as a part of a half turn); least bits of a table; the chance that such a pair meets in no table;
# differing bits of a candidate's two check words, of which 19 are expected at 0.8 with a spread of 4
WORDS = 4
DIFFERS = 0.1515
LEAST_BITS = 16
MISSED = 0.004
CHECK_RADIUS = 36
# similar texts share this part of their distinct shingles, as a fraction: shared ones over all of both
SIMILARITY = (4, 5)
# tables and neighbours in a bucket that families are found by at first
FIRST_TABLES = 12
NEIGHBOURS = 3
# rows of a block of a family, and differing bits of all 256 beyond which a pair of a family is not verified: 39 are
# expected at 0.8, with a spread of 6
FAMILY_BLOCK = 2048
FAMILY_PAIRS = 100_000  # pairs of a family looked at a time
FAMILY_CLOSE = 10_000  # of those that are to be verified, Python numbers at a time
# families of more nodes are split before they are compared, smaller ones are three pairs of blocks at most; nodes of a family whose
# keys a task makes, and that tell which shingles are common in it; width of a band of set sizes
SPLIT = 4096
KEY_BLOCK = 512
SAMPLED = 512
BAND = 1.03
WIDE_RADIUS = 62


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    return majority(shingle_hashes(text, shingle))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprint(text: str | None, shingle: int) -> list[int]:
    """WORDS 64-bit words of the set of shingles; the hashes of each but the first are those of the first, mixed."""
    return _wide_words(shingle_set(text, shingle))


def _wide_words(hashes: np.ndarray) -> list[int]:
    return [majority(hashes if w == 0 else _mix(_mix(hashes, np.full(len(hashes), w, np.uint64)), hashes >> np.uint64(32))) for w in range(WORDS)]


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), one row for each row of docs."""
    made = each_text(lambda: lambda texts: (np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64),), "fp long")
    return docs.select("doc_id", made(F.col("text").cast("string"))["fp"].alias("fp"))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def reference_fingerprints() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 7) for i in range(PIVOTS)], np.uint64)


def _masks(free: int, bands: int) -> list[int]:
    """The set bits of `free`, dealt to bands of nearly equal size."""
    at = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << int(i) for i in part) for part in np.array_split(at, bands) if len(part)]


def band_signature(fp: np.ndarray, mask: int) -> np.ndarray:
    """The distances to all pivots within one band, folded to one long. Equal bands have equal ones; what else has is discarded later."""
    m = np.uint64(mask)
    sig = np.zeros(len(fp), np.uint64)
    for p in reference_fingerprints():
        sig = _mix(sig, np.bitwise_count((fp ^ p) & m).astype(np.uint64))
    return sig


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """One row for each fingerprint of one word or more: bands x pivots, the bands of all words one after another."""
    masks = np.array(_masks(2**BITS - 1, BANDS), np.uint64)
    apart = fp.reshape(len(fp), -1)[:, :, None] ^ reference_fingerprints()[None, None, :]
    table = np.stack([np.bitwise_count(apart & m) for m in masks], axis=2)
    return table.astype(np.int8).reshape(len(fp), -1, PIVOTS)


def near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs i, j differ in at most radius bits: discarded by coordinates, then verified."""
    out, words = np.zeros(len(i), bool), fp.reshape(len(fp), -1)
    bands = table.shape[1]
    portion = COORDINATES // (bands * PIVOTS)
    for a in range(0, len(i), portion):
        rows = np.arange(a, min(a + portion, len(i)))
        least = np.zeros(len(rows), np.int64)
        for part in (slice(0, bands // 4), slice(bands // 4, bands)):
            x, y = table[i[rows], part], table[j[rows], part]
            least += np.abs(x - y).max(axis=2).sum(axis=1, dtype=np.int64)
            rows, least = rows[least <= radius], least[least <= radius]
        out[rows[np.bitwise_count(words[i[rows]] ^ words[j[rows]]).sum(axis=1, dtype=np.int64) <= radius]] = True
    return out


def _choices(free: int, radius: int, level: int) -> list[int]:
    """Masks that must be equal: two bands of radius + 2 at first, then one of radius + 1."""
    if level == 0:
        return [a | b for a, b in combinations(_masks(free, radius + 2), 2)]
    return _masks(free, radius + 1)


def _bucketed(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """fp, id, mask (bits that are equal so far) -> one row for each bucket that fp falls into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp_all, ids, masks = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy(np.int64), pdf["mask"].to_numpy(np.int64).view(np.uint64)
            for done in np.unique(masks):
                mine = masks == done
                fp, own = fp_all[mine], ids[mine]
                for choice in _choices(~int(done) & (2**BITS - 1), radius, level):
                    full = int(done) | choice
                    key = _mix(_mix(band_signature(fp, choice), fp & done), np.full(len(fp), full, np.uint64))
                    yield pd.DataFrame({"key": key.view(np.int64), "fp": fp.view(np.int64), "id": own, "mask": np.full(len(fp), full, np.uint64).view(np.int64)})

    n = partitions(rows.sparkSession)
    out = rows.mapInPandas(run, "key long, fp long, id long, mask long")
    return out.repartition(n, "key").sortWithinPartitions("key", "fp", "id")


def pairs_within(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal key whose fingerprints differ in at most radius bits."""
    table = pivot_table(fp)
    first = table[:, :, 0].sum(axis=1, dtype=np.int64)
    order = np.lexsort((first, key))
    key, fp, table, first = key[order], fp[order], table[order], first[order]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i, step = np.arange(len(key)), 1
    while True:
        i = i[i + step < len(key)]
        i = i[(key[i] == key[i + step]) & (first[i + step] - first[i] <= radius)]
        if not len(i):
            a, b = order[np.concatenate(left)], order[np.concatenate(right)]
            return np.minimum(a, b), np.maximum(a, b)
        good = i[near(fp, table, i, i + step, radius)]
        left.append(good)
        right.append(good + step)
        step += 1


def _link(rows: DataFrame, radius: int) -> DataFrame:
    """Sorted bucket rows -> links (hot false: a, b) and rows of buckets that are too large (hot true: id, fp, mask)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def hot(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"hot": True, "a": part["id"], "b": part["fp"], "mask": part["mask"]})

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            key, fp, ids = part["key"].to_numpy(np.int64), part["fp"].to_numpy(np.int64).view(np.uint64), part["id"].to_numpy(np.int64)
            a, b = pairs_within(key, fp, radius)
            a, b = forest(ids[a], ids[b])
            return pd.DataFrame({"hot": False, "a": a, "b": b, "mask": np.zeros(len(a), np.int64)})

        held: pd.DataFrame | None = None
        passing: int | None = None  # the key of a bucket that has already proved too large
        for pdf in batches:
            if passing is not None:
                own = pdf["key"].to_numpy() == passing
                if own.any():
                    yield hot(pdf[own])
                    pdf = pdf[~own]
            if not len(pdf):
                continue
            passing = None
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            last = pdf["key"].iloc[-1]
            key = pdf["key"].to_numpy()
            whole = int(np.searchsorted(key, last))
            sizes = np.unique(key[:whole], return_counts=True)
            big = np.isin(key[:whole], sizes[0][sizes[1] > BUCKET])
            done = pdf.iloc[:whole]
            if big.any():
                yield hot(done[big])
            yield solve(done[~big])
            held = pdf.iloc[whole:]
            if len(held) > BUCKET:
                yield hot(held)
                held, passing = None, last
        if held is not None and len(held):
            yield solve(held)

    return rows.mapInPandas(run, "hot boolean, a long, b long, mask long")


def near_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes: fp, id, one row for each distinct fingerprint. Links a, b of a spanning forest of each bucket."""
    rows, level, links = nodes.select("fp", "id", F.lit(0).cast("long").alias("mask")), 0, None
    while True:
        found = cut(_link(_bucketed(rows, radius, level), radius))
        part = found.filter("not hot").select("a", "b")
        links = part if links is None else links.union(part)
        hot = found.filter("hot")
        if hot.isEmpty():
            return links
        rows, level = hot.select(F.col("b").alias("fp"), F.col("a").alias("id"), "mask"), level + 1


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    component_id is the smallest doc_id that links reach, the document's own included. A null text
    has no words and the fingerprint zero; a null doc_id stays null and takes the component of its
    fingerprint (null if no other row has one). Repeated rows stay. An empty table gives no row.
    """
    fps = stored(with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    named = components(near_links(nodes.filter("id is not null"), radius))
    roots = cut(nodes.join(named, "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component_id")))
    return join_hot(fps, roots, "fp", "n").select("doc_id", "fp", "component_id")


def table_bits(nodes: int) -> int:
    """Sampled bits of a table: they grow with the logarithm of the number of fingerprints, so unrelated ones share a bucket with about four."""
    return max(LEAST_BITS, math.ceil(math.log2(max(nodes, 1))) - 2)


def table_masks(bits: int) -> list[tuple[int, int]]:
    """Word and mask of each table: fixed draws of bits of the word; as many tables as MISSED asks for."""
    tables = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFERS) ** bits)))
    draw = np.random.default_rng(2)
    return [(t % WORDS, sum(1 << int(i) for i in draw.choice(BITS, bits, replace=False))) for t in range(tables)]


W = [f"w{i}" for i in range(WORDS)]
CHECK = ["c0", "c1"]


def _words(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.ascontiguousarray(pdf[columns].to_numpy(np.int64)).view(np.uint64)


def _dealt(nodes: DataFrame, masks: list[tuple[int, int]], part: str) -> DataFrame:
    """nodes: id, w0 to w3, part -> a row for each table: key, id, part, c0, c1 (two words that the table does not sample)."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [pdf[w].to_numpy(np.int64).view(np.uint64) for w in W]
            for t, (w, mask) in enumerate(masks):
                key = _mix(band_signature(words[w], mask), np.full(len(pdf), t, np.uint64))
                yield pd.DataFrame({"key": key.view(np.int64), "id": pdf["id"], "part": pdf["part"], **{c: pdf[W[(w + k) % WORDS]] for k, c in enumerate(CHECK, 1)}})

    # ids, parts and words are never null, so they may pass through pandas
    rows = nodes.select("id", *W, F.col(part).alias("part")).mapInPandas(deal, "key long, id long, part long, c0 long, c1 long")
    return rows.repartition(partitions(nodes.sparkSession), "key")


def neighbour_links(nodes: DataFrame, masks: list[tuple[int, int]], radius: int = CHECK_RADIUS) -> DataFrame:
    """Links a, b of fingerprints that lie next to each other in a bucket and are near: the time is linear in the rows of a bucket."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            pdf = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
            key, fp, ids = pdf["key"].to_numpy(np.int64), _words(pdf, CHECK), pdf["id"].to_numpy(np.int64)
            table, found = pivot_table(fp), []
            for step in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero(key[:-step] == key[step:]) if len(key) > step else np.empty(0, np.int64)
                i = i[near(fp, table, i, i + step, radius)]
                found.append((ids[i], ids[i + step]))
            a, b = forest(*map(np.concatenate, zip(*found)))
            yield pd.DataFrame({"a": a, "b": b})
            last = pdf.iloc[-NEIGHBOURS:]

    dealt = _dealt(nodes, masks, "id").sortWithinPartitions("key", "c0", "id")
    return dealt.mapInPandas(link, "a long, b long").distinct()


def cross_pairs(key: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal key, different part and near fingerprints; rows are in the order of key and part."""
    n = len(key)
    new_key = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
    new_part = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if n else new_key
    key_end = np.repeat(np.append(new_key[1:], n), np.diff(np.append(new_key, n)))
    part_end = np.repeat(np.append(new_part[1:], n), np.diff(np.append(new_part, n)))
    some = np.flatnonzero(key_end > part_end)
    count = (key_end - part_end)[some]
    total = np.cumsum(count)
    table = pivot_table(fp)
    left, right, a = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PORTION, side="right")))
        i = np.repeat(some[a:b], count[a:b])
        j = np.repeat(part_end[some[a:b]], count[a:b]) + np.arange(len(i)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        good = near(fp, table, i, j, radius)
        left.append(i[good])
        right.append(j[good])
        a = b
    return np.concatenate(left), np.concatenate(right)


def part_links(nodes: DataFrame, masks: list[tuple[int, int]], radius: int = CHECK_RADIUS) -> DataFrame:
    """nodes: id, w0 to w3, part. Links a, b: spanning forests of the pairs of different parts that meet in a table and are near.

    A bucket of up to BUCKET rows is compared as a whole. A larger one is cut into blocks by a hash of
    the id, and each pair of blocks is a group of its own, so all pairs are compared in groups of
    some 2 * BUCKET rows. The rows of its largest part are not compared among themselves.
    """
    columns = ["key", "id", "part", *CHECK]

    def forest_of(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        a, b = forest(ids[a], ids[b])
        return pd.DataFrame({"a": a, "b": b})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "part"], kind="stable")
        key, ids, parts = (rows[c].to_numpy(np.int64) for c in columns[:3])
        return forest_of(ids, *cross_pairs(key, parts, _words(rows, CHECK), radius))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of whole buckets (hot false: a, b) and the rows of those that are too large (hot true)."""

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            return solve(rows).assign(hot=False, **dict.fromkeys(columns, 0))[["hot", "a", "b", *columns]]

        def hot(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.assign(hot=True, a=0, b=0)[["hot", "a", "b", *columns]]

        held: pd.DataFrame | None = None
        passing: int | None = None  # the key of a bucket that has already proved too large
        for pdf in batches:
            if passing is not None:
                more = pdf["key"].to_numpy() == passing
                if more.any():
                    yield hot(pdf[more])
                    pdf = pdf[~more]
            if not len(pdf):
                continue
            passing = None
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            key = pdf["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            at = np.flatnonzero(np.diff(key[:whole], prepend=key[0] - 1)) if whole else np.empty(0, np.int64)
            big = np.repeat(np.diff(at, append=whole) > BUCKET, np.diff(at, append=whole))
            done = pdf.iloc[:whole]
            if big.any():
                yield hot(done[big])
            yield links(done[~big])
            held = pdf.iloc[whole:]
            if len(held) > BUCKET:
                yield hot(held)
                held, passing = None, key[-1]
        if held is not None and len(held):
            yield links(held)

    def cross(rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks of a bucket; of two different blocks only the pairs between them."""
        if rows["lo"].iloc[0] == rows["hi"].iloc[0]:
            return solve(rows)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        low = (rows["block"] == rows["lo"]).to_numpy()
        ids, parts, fp = rows["id"].to_numpy(np.int64), rows["part"].to_numpy(np.int64), _words(rows, CHECK)
        table, one, two = pivot_table(fp), np.flatnonzero(low), np.flatnonzero(~low)
        step = max(1, PORTION // max(1, len(two)))
        for at in range(0, len(one), step):
            i, j = (x.ravel() for x in np.meshgrid(one[at : at + step], two, indexing="ij"))
            apart = parts[i] != parts[j]
            i, j = i[apart], j[apart]
            good = near(fp, table, i, j, radius)
            left.append(i[good])
            right.append(j[good])
        return forest_of(ids, np.concatenate(left), np.concatenate(right))

    slots = ", ".join(f"{c} long" for c in columns)
    dealt = _dealt(nodes, masks, "part").sortWithinPartitions("key", "part", "id")
    compared = cut(dealt.mapInPandas(link, f"hot boolean, a long, b long, {slots}"))
    links, hot = compared.filter("not hot").select("a", "b"), compared.filter("hot").select(*columns)
    if not hot.isEmpty():
        top = F.max(F.struct("n", "part"))
        sizes = hot.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("all"), top["part"].alias("largest"), top["n"].alias("most"))
        blocks = sizes.filter("all > most").select("key", "largest", F.ceil(F.col("most") / BUCKET).alias("low_blocks"), F.ceil((F.col("all") - F.col("most")) / BUCKET).alias("others"))
        # the largest part has the first blocks, and those meet only the blocks of the others
        rows = hot.join(blocks, "key").withColumn("is_low", F.col("part") == F.col("largest"))
        mixed = F.xxhash64("id")
        rows = rows.withColumn("block", F.when(F.col("is_low"), F.pmod(mixed, "low_blocks")).otherwise(F.col("low_blocks") + F.pmod(mixed, "others")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("is_low"), F.col("low_blocks")).otherwise(F.lit(0)), F.col("low_blocks") + F.col("others") - 1)))
        dealt_blocks = rows.select(*columns, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        links = links.union(dealt_blocks.groupBy("key", "lo", "hi").applyInPandas(cross, "a long, b long"))
    return links.distinct()


def shared_shingles(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def verified(rows: pa.Table) -> pa.Table:
    """A group's nodes (id, part, w0 to w3, block, lo, hi, shingles) -> links a, b: a spanning forest of the similar pairs of different parts.

    The sets of shingles stay as they came, eight bytes a shingle, and are not copied; beside them only FAMILY_PAIRS pairs are held at a time.
    """
    part_, whole = SIMILARITY
    ids, parts, block, lo, hi = (rows[c].to_numpy() for c in ("id", "part", "block", "lo", "hi"))
    words = [rows[w].to_numpy().view(np.uint64) for w in W]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
    n = np.array([len(x) for x in sets], np.int64)
    low, same = block == lo, lo[0] == hi[0]
    one = np.flatnonzero(low)
    two = one if same else np.flatnonzero(~low)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left, right, step = [], [], max(1, FAMILY_PAIRS // max(1, len(two)))
    for at in range(0, len(one), step):
        i, j = (x.ravel() for x in np.meshgrid(one[at : at + step], two, indexing="ij"))
        good = parts[i] != parts[j]
        good &= whole * np.minimum(n[i], n[j]) >= part_ * np.maximum(n[i], n[j])
        good &= i < j if same else good
        i, j = i[good], j[good]
        apart = np.zeros(len(i), np.int64)
        for w in words:
            apart += np.bitwise_count(w[i] ^ w[j])
        i, j = i[apart <= WIDE_RADIUS], j[apart <= WIDE_RADIUS]
        for k in range(0, len(i), FAMILY_CLOSE):
            roots = np.fromiter(map(find, range(len(root))), np.int64, len(root))
            x_, y_ = i[k : k + FAMILY_CLOSE], j[k : k + FAMILY_CLOSE]
            open_ = roots[x_] != roots[y_]
            for x, y in zip(x_[open_].tolist(), y_[open_].tolist()):
                a, b = find(x), find(y)
                if a != b:
                    both = shared_shingles(sets[x], sets[y])
                    if whole * both >= part_ * (len(sets[x]) + len(sets[y]) - both):
                        root[max(a, b)] = min(a, b)
                        left.append(max(ids[x], ids[y]))
                        right.append(min(ids[x], ids[y]))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def family_groups(families: DataFrame) -> DataFrame:
    """families: family, id, part, w0 to w3, doc_id, text_key. A row for each group (family, lo, hi) that a node is compared in, by `verified`.

    A family of more than FAMILY_BLOCK nodes is cut into blocks, and each pair of blocks is a group of its
    own. No pair of a family is written down.
    """
    sizes = cut(families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / FAMILY_BLOCK)))
    rows = join_hot(families, sizes, "family", "n").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("family", "id", "part", *W, "doc_id", "text_key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def band_edges(most: int) -> np.ndarray:
    """The least size of each band of set sizes, up to a size of `most`."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, np.int64)


def prefix_lengths(n: int, bands: np.ndarray, edges: np.ndarray) -> list[tuple[int, int]]:
    """(band, length) for each band of partners that a set of n shingles may be similar to.

    Similar sets of n and m shingles share a part / (part + whole) of n + m at least, so of two similar sets in one order of shingles
    the first n - share + 1 and m - share + 1 have one in common. A band's least size stands for m.
    """
    part_, whole = SIMILARITY
    out = []
    for band in bands.tolist():
        least, most = int(edges[band]), int(edges[band + 1]) - 1
        least = max(least, -(-part_ * n // whole))
        if least <= min(most, whole * n // part_):
            share = -(-part_ * (n + least) // (part_ + whole))
            out.append((band, n - share + 1))
    return out


def split_families(members: DataFrame, slim: DataFrame, shingle: int) -> DataFrame:
    """members with the families of more than SPLIT nodes split, so that similar nodes stay together; nodes that are similar to none go.

    Families are what candidates connect, so texts of one template may be one family although few of them are similar. A node's
    shingles stand in an order from the rarest in its family on. For each band of set sizes that partners may have, the first ones
    are keys; nodes that share a key are connected. Similar nodes share one (see prefix_lengths), whatever the order, which
    comes from a sample of the family. Keys are written once for each node and band; no pair is.
    """
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT)
    sizes = stored(sizes, "large-families")
    if sizes.isEmpty():
        return members
    small = members.join(if_small(sizes.select("family")), "family", "left_anti")
    big = stored(join_hot(members, sizes, "family", "n", members.count()), "large-members")
    made = each_text(lambda: lambda texts: ([shingle_set(x, shingle).tobytes() for x in texts],), "shingles binary")
    wanted = big.select("id", "doc_id", "text_key")
    texts = slim.join(if_small(wanted), ["doc_id", "text_key"]).select("id", made("text")["shingles"].alias("shingles")).dropDuplicates(["id"])
    sets = stored(big.select("family", "id", "n").join(texts, "id").withColumn("size", (F.length("shingles") / 8).cast("long")), "large-sets")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("family").to_numpy(), [len(x) for x in own])), pa.array(np.concatenate(own))], names=["family", "token"])

    sample = sets.filter(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SAMPLED)) == 0).select("family", "shingles")
    # what stands in few of the sampled nodes is as good as rare, so the list is bounded by their mean size
    counts = sample.mapInArrow(listed, "family long, token long").groupBy("family", "token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * 50 > SAMPLED)
    common = counts.groupBy("family").agg(F.collect_list(F.struct("token", "c")).alias("common"))
    edges_of = sets.groupBy("family").agg(F.collect_set("size").alias("sizes"), F.first("n").alias("n"))
    known = edges_of.join(common, "family", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / KEY_BLOCK).cast("long"))))
    known = known.select(F.col("family").alias("f"), F.col("block").alias("b"), "sizes", F.coalesce("common", F.array().cast("array<struct<token: bigint, c: bigint>>")).alias("common"))
    rows = sets.select("family", "id", "shingles", F.pmod(F.xxhash64("id"), F.floor(F.col("n") / KEY_BLOCK).cast("long") + 1).alias("block"))

    def keys(nodes: pa.Table, of_family: pa.Table) -> pa.Table:
        out_keys, out_ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        if len(nodes):
            entries = of_family["common"][0].as_py()
            token = np.array([e["token"] for e in entries], np.int64)
            count = np.array([e["c"] for e in entries], np.int64)[np.argsort(token)]
            token = np.sort(token)
            all_sizes = np.array(of_family["sizes"][0].as_py(), np.int64)
            edges = band_edges(int(all_sizes.max()) + 1)
            bands = np.unique(np.searchsorted(edges, all_sizes[all_sizes > 0], side="right") - 1)
            family = np.uint64(nodes["family"][0].as_py() % 2**64)
            for id_, raw in zip(nodes["id"].to_pylist(), nodes["shingles"].to_pylist()):
                own = np.frombuffer(raw, np.int64)
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
                often = np.where(token[at] == own, count[at], 0) if len(token) else np.zeros(len(own), np.int64)
                own_order = own[np.lexsort((own, often))].view(np.uint64)
                mine = int(np.searchsorted(edges, len(own), side="right")) - 1
                for band, length in prefix_lengths(len(own), bands, edges):
                    both = np.uint64(min(mine, band) << 32 | max(mine, band))
                    found = _mix(_mix(own_order[:length], np.full(length, family, np.uint64)), np.full(length, both, np.uint64))
                    out_keys.append(found)
                    out_ids.append(np.full(length, id_, np.int64))
        return pa.table({"key": np.concatenate(out_keys).view(np.int64), "id": np.concatenate(out_ids)})

    keyed = stored(rows.groupBy("family", "block").cogroup(known.groupBy("f", "b")).applyInArrow(keys, "key long, id long"), "prefix-keys")
    shared = stored(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-keys")
    links = join_hot(keyed, shared, "key", "n", keyed.count()).filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    named = stored(components(links), "split")
    roots = named.union(named.select("root", "root").distinct()).withColumnRenamed("root", "_root")
    again = big.drop("n").join(roots, "id").drop("family").withColumnRenamed("_root", "family")
    return small.unionByName(again)


def _text_key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _similar(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, root (one value for each component), component_id for each row of docs."""

    def fingerprints(texts: list[str | None]):
        sets = [shingle_set(x, shingle) for x in texts]
        words = np.array([_wide_words(x) for x in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
        node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        return node, *(words[:, i] for i in range(WORDS))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key().alias("text_key"))
    made = each_text(lambda: fingerprints, "node long, " + ", ".join(f"{w} long" for w in W))("text")
    fps = stored(slim.select("doc_id", "text_key", made.alias("_r")).select("doc_id", "text_key", "_r.*"), "fingerprints")
    # a node is a set of shingles
    nodes = cut(fps.groupBy("node", *W).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first"), F.count(F.lit(1)).alias("n")))
    nodes = nodes.select("node", *W, F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "n")
    points = nodes.filter("doc_id is not null").withColumnRenamed("node", "id")
    masks = table_masks(table_bits(points.count()))
    # families of what lies next to each other in a few tables: all their pairs are verified
    named = stored(components(neighbour_links(points, masks[:FIRST_TABLES])), "families")
    first = _family_links(slim, points.withColumn("part", F.col("id")), named, shingle)
    # then families of what meets in any table and is in none or in another of those
    parts = stored(points.join(named, "id", "left").select("id", *W, "doc_id", "text_key", F.coalesce("root", "id").alias("part")), "parts")
    second = _family_links(slim, parts, stored(components(part_links(parts, masks)), "families"), shingle)
    named = components(first.union(second)).withColumnRenamed("id", "node")
    roots = cut(nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id", "n"))
    lowest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    by_node = cut(join_hot(roots.select("node", "root", "n"), cut(lowest), "root", "nodes").select("node", "n", "root", "component_id"))
    return join_hot(fps, by_node, "node", "n").select("doc_id", "text_key", "root", "component_id")


def _family_links(slim: DataFrame, points: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """points: id, part, w0 to w3, doc_id, text_key; named: id, root. The verified links of all families, each text's shingles taken once for each pair of blocks."""
    members = named.select("id", F.col("root").alias("family")).union(named.select("root", "root").distinct())
    members = stored(points.select("id", "part", *W, "doc_id", "text_key").join(members, "id"), "members")
    rows = stored(family_groups(split_families(members, slim, shingle)), "blocks")
    made = each_text(lambda: lambda texts: ([shingle_set(x, shingle).tobytes() for x in texts],), "shingles binary")
    # each node goes by one row of its text; of repeated rows one is enough
    wanted = stored(rows.select("id", "doc_id", "text_key").distinct(), "wanted")
    texts = slim.join(if_small(wanted), ["doc_id", "text_key"]).select("id", made("text")["shingles"].alias("shingles")).dropDuplicates(["id"])
    grouped = rows.drop("doc_id", "text_key").join(texts, "id").groupBy("family", "lo", "hi")
    return cut(grouped.applyInArrow(verified, "a long, b long"))


def similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, component_id for each row of docs: near copies of a shingle similarity of SIMILARITY or more.

    64 bits cannot tell such pairs from others, as they differ in some ten bits; 256 bits find candidates. A
    table samples bits of one word: fingerprints whose pivot distances within those bits are equal meet in a bucket,
    are discarded by the largest coordinate differences of two other words and
    verified by their popcount. Pairs of a similarity of 0.8 meet with a chance of 1 - MISSED, more above; table_bits and
    table_masks let the tables grow with the rows. What candidates connect is a family, and a pair of a family links only if
    the texts' sets of shingles are similar; all pairs of a family are looked at, none is written down. Odd rows are as in
    near_duplicates.
    """
    return _similar(docs, shingle).select("doc_id", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs without those whose component of similar texts has a smaller doc_id, and without repeats of a doc_id in a component.

    Rows without a doc_id stay, and so do texts that share a doc_id but are not similar.
    """
    found = stored(_similar(docs, shingle), "components")
    gone = stored(found.filter("component_id <> doc_id").select("doc_id", "text_key").distinct(), "copies")
    repeated = stored(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), whole_row(docs).alias("_row"))
    kept = rows.join(if_small(gone), ["doc_id", "text_key"], "left_anti")
    if repeated.isEmpty():
        return kept.select("_row.*")
    once = kept.join(repeated, "doc_id", "left_anti").select("_row.*")
    roots = found.join(repeated, "doc_id", "left_semi").select("doc_id", "text_key", "root").distinct()
    again = kept.join(roots, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "root"]).select("_row.*")
    return once.union(again)
