"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

    P(w | u)  = max(c(u w) - D(c(u w)), 0) / c(u) + g(u) * Pc(w)
    Pc(w)     = max(k(w) - E(k(w)), 0) / k + g0 / (V + 1)

c counts bigrams, k(w) the different words before w, k their sum; D and E hold the three modified
discounts (counts 1, 2, and 3 or more) from the counts of counts; g(u) and g0 give the discounted
mass to the lower order; the last term is uniform over the V words and the unknown one. A text
starts behind a start mark, which is a context only, and closes with an end token.

Words stand for their XXH64. One job counts: each task sums its own bigrams in sorted arrays
(sorted by context, so a context is written once for its run), which are dealt by context; frequent
contexts, found in a sample that decides nothing else, are dealt by the whole bigram. There is a place for
each `PLACE_BYTES` of text, so what a task holds does not grow with the corpus. A task that
has all bigrams of a place writes them as one shard (sorted hashes, counts) to the shared folder and
passes on sums for its contexts and words; a second, smaller shuffle deals these by word, and the
word shards are written. Counts are 64-bit; one byte each is stored, and those beyond it in a list of
their own. The driver gets a dozen sums.

A shard is one file. Scoring tasks map shards into memory, so a worker pages in what its texts ask for. A batch's words and pairs are
sorted by place before they are looked up, so each shard is opened once for a batch of `BATCH` tokens, and a worker holds `OPEN` of
them at most, however many there are. From a store that cannot be mapped, a worker reads shards whole and keeps
those last used, up to `KEPT` bytes.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, new_folder

END = xxhash.xxh64_intdigest(b"\nend", 1)
START = xxhash.xxh64_intdigest(b"\nstart", 1)
HELD = 3_000_000  # bigrams that a counting task holds before it sends them
CACHE = 200_000
SAMPLE = 64  # one text in so many is looked at for frequent contexts
BATCH = 1_000_000  # tokens scored at a time
PLACE_BYTES = 8 << 20  # text counted by one task; for corpora of many terabytes 256 << 20, on larger executors
KEPT = 512 << 20
OPEN = 256  # shards that a worker holds open
U64 = np.uint64


class _Hashes(dict):
    """Word -> hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 1)
        return h


def hashed(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after another, each closed by END; the number of tokens of each."""
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        flat += [hashes[w] for w in words]
        flat.append(END)
        sizes[i] = len(words) + 1
    return np.array(flat, U64), sizes


def with_context(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token, START for a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (u * U64(0x9E3779B97F4A7C15)) ^ (w + U64(0x7F4A7C15F39CC060))
    h = (h ^ (h >> U64(32))) * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(29))


def place_of(u: np.ndarray, w: np.ndarray, frequent: np.ndarray, places: int) -> np.ndarray:
    key = np.where(np.isin(u, frequent), pair_hash(u, w), u) if len(frequent) else u
    return ((key >> U64(20)) % U64(places)).astype(np.int64)


def summed(keys: list[np.ndarray], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows sorted by the keys (the first is the major one), equal ones added up."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, [v.astype(np.int64) for v in values]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order].astype(np.int64), at) for v in values]


def packed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each; 255 stands for those whose places and values are listed."""
    big = np.flatnonzero(c >= 255)
    return np.minimum(c, 255).astype("u1"), big.astype("<u4"), c[big].astype("<u8")


def unpacked(low: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[at] = value
    return out


COUNTS = ("u1", "<u4", "<u8")


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(blob, kind, n, at + 8))
        at += 8 + size
    return out


PAIR = ("<u8", *COUNTS)  # the arrays of a shard of pairs: hashes, and counts in a byte each with the list of larger ones
WORD = ("<u8", *COUNTS * 6)  # and of a shard of words: hashes, and each of WORD_SUMS


def mapped_file(path: str) -> memoryview:
    """A file in memory that keeps no descriptor open, where Python allows it."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return memoryview(b"")
        try:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
        except TypeError:  # before Python 3.13
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Store:
    """Shards in a folder of the shared store: each one file, that begins with a table of where its arrays do."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def write(self, name: str, arrays: list[np.ndarray]) -> None:
        """Written aside, then moved: a repeated task leaves the same file. Arrays begin at multiples of eight bytes."""
        self.fs.create_dir(self.root, recursive=True)
        aside = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        begin, table = 16 * len(arrays), []
        for array in arrays:
            table += [begin, array.nbytes]
            begin += -(-array.nbytes // 8) * 8
        with self.fs.open_output_stream(aside) as f:
            f.write(np.array(table, "<u8").tobytes())
            for array in arrays:
                f.write(np.ascontiguousarray(array).tobytes())
                f.write(bytes(-array.nbytes % 8))
        self.fs.move(aside, f"{self.root}/{name}")

    @property
    def mapped(self) -> bool:
        return isinstance(self.fs, pafs.LocalFileSystem)

    def read(self, name: str, kinds: tuple[str, ...]) -> tuple[list[np.ndarray], int]:
        """The arrays of a shard, empty ones where nothing was dealt to its place; and the bytes that are held for them."""
        path = f"{self.root}/{name}"
        try:
            if self.mapped:
                raw, held = mapped_file(path), 0
            else:
                with self.fs.open_input_stream(path) as src:
                    raw = memoryview(src.read())
                held = len(raw)
        except FileNotFoundError:
            return [np.empty(0, kind) for kind in kinds], 0
        table = np.frombuffer(raw, "<u8", 2 * len(kinds)).tolist()
        return [np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, begin) for kind, begin, size in zip(kinds, table[::2], table[1::2])], held


@dataclass
class Model:
    uri: str
    places: int
    frequent: np.ndarray
    tokens: int  # N
    types: int  # V
    before: int  # k, the number of different bigrams
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float  # g0


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of items counted 1, 2, 3 and 4 times; 0.5, 1, 1.5 where a small corpus leaves one open."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < i else i / 2 for i, d in enumerate(found, 1))  # type: ignore[return-value]


def frequent_contexts(train: DataFrame, places: int) -> np.ndarray:
    """Words with over 1 / (2 * places) of a sample's tokens: 2 * places at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Hashes()
        for pdf in batches:
            tokens, _ = hashed(list(pdf["text"]), own)
            names, n = np.unique(tokens, return_counts=True)
            top = n * (4 * places) > len(tokens)
            yield pd.DataFrame({"h": names[top].view(np.int64), "n": n[top], "all": 0})
            yield pd.DataFrame({"h": np.zeros(1, np.int64), "n": 0, "all": [len(tokens)]})

    sample = train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    sums = sample.mapInPandas(run, "h long, n long, all long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    got = sums.orderBy(F.desc(F.col("n") + F.col("all"))).limit(2 * places + 1).collect()
    total = sum(r["all"] for r in got)
    return np.array(sorted(r["h"] for r in got if r["n"] * 2 * places > total), np.int64).view(U64)


# of a word: how often it stands, after how many different words, and of the pairs that it begins: how many were seen
# once, twice, more often, and all together
WORD_SUMS = ("n", "k", "1", "2", "3", "t")


def _counting(places: int, frequent: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kept, words, n, texts = _Hashes(), [], [], 0, 0

        def send() -> Iterator[pd.DataFrame]:
            (u, w), (c,) = summed([np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])], np.concatenate([k[2] for k in kept]))
            (x,), (m,) = summed([np.concatenate([k[0] for k in words])], np.concatenate([k[1] for k in words]))
            at_pair, at_word = place_of(u, w, frequent, places), ((x >> U64(20)) % U64(places)).astype(np.int64)
            by_pair, by_word = np.argsort(at_pair, kind="stable"), np.argsort(at_word, kind="stable")
            cut_pair, cut_word = np.searchsorted(at_pair[by_pair], np.arange(places + 1)), np.searchsorted(at_word[by_word], np.arange(places + 1))
            for p in range(places):
                i, j = by_pair[cut_pair[p] : cut_pair[p + 1]], by_word[cut_word[p] : cut_word[p + 1]]
                if len(i) or len(j):
                    head = np.flatnonzero(np.concatenate([[True], u[i][1:] != u[i][:-1]])) if len(i) else np.empty(0, np.int64)
                    runs = np.diff(np.concatenate([head, [len(i)]])) if len(i) else head
                    yield pd.DataFrame({"place": [p], "blob": [pack(u[i][head], runs.astype("<u4"), w[i], *packed(c[i]), x[j], *packed(m[j]))]})

        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                tokens, sizes = hashed(list(pdf["text"].iloc[a : a + 1000]), own)
                (u, w), (c,) = summed([with_context(tokens, sizes), tokens], np.ones(len(tokens), np.int64))
                kept.append((u, w, c))
                words.append(np.unique(tokens, return_counts=True))
                n += len(u)
                if n >= HELD:
                    yield from send()
                    kept, words, n = [], [], 0
        if kept:
            yield from send()

    return run


def _pairs_done(uri: str, places: int):
    """All bigrams of a place -> their shard; sums for their contexts and words, by word place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = int(pdf["place"].iloc[0])
        us, ws, cs, xs, ms = [], [], [], [], []
        for blob in pdf["blob"]:
            head, runs, w, *more = unpack(blob, "<u8", "<u4", "<u8", *COUNTS, "<u8", *COUNTS)
            us.append(np.repeat(head, runs))
            ws.append(w)
            cs.append(unpacked(*more[:3]))
            xs.append(more[3])
            ms.append(unpacked(*more[4:]))
        (u, w), (c,) = summed([np.concatenate(us), np.concatenate(ws)], np.concatenate(cs))
        h = pair_hash(u, w)
        order = np.argsort(h)
        Store(uri).write(f"pair-{place}", [h[order], *packed(c[order])])
        counts = np.bincount(np.minimum(c, 5), minlength=6)
        x, m = np.concatenate(xs), np.concatenate(ms)
        zero, zx, one = np.zeros(len(u), np.int64), np.zeros(len(x), np.int64), np.ones(len(u), np.int64)
        zw = np.zeros(len(w), np.int64)
        # name, count, different words before, and of those behind how many were seen once, twice, more
        (name,), sums = summed(
            [np.concatenate([x, w, u])],
            np.concatenate([m, zw, zero]),
            np.concatenate([zx, one, zero]),
            np.concatenate([zx, zw, c == 1]),
            np.concatenate([zx, zw, c == 2]),
            np.concatenate([zx, zw, c > 2]),
            np.concatenate([zx, zw, c]),
        )
        at = ((name >> U64(20)) % U64(places)).astype(np.int64)
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(places + 1))
        rows = [(p, pack(name[i], *(a for s in sums for a in packed(s[i]))), None) for p in range(places) if len(i := by[cuts[p] : cuts[p + 1]])]
        rows.append((place, None, [int(v) for v in counts[1:5]]))
        return pd.DataFrame(rows, columns=["place", "blob", "pair_counts"])

    return run


def _words_done(uri: str):
    """All sums of a word place -> its shard; the sums that the driver needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = int(pdf["place"].iloc[0])
        parts = [unpack(b, "<u8", *COUNTS * 6) for b in pdf["blob"] if b is not None]
        names = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, U64)
        (name,), sums = summed([names], *(np.concatenate([unpacked(*p[i : i + 3]) for p in parts]) if parts else np.empty(0, np.int64) for i in range(1, 19, 3)))
        count, before, *_ = sums
        Store(uri).write(f"word-{place}", [name, *(a for c in sums for a in packed(c))])
        of_words = np.bincount(np.minimum(before, 5), minlength=6)[1:5]
        of_pairs = np.sum([x for x in pdf["pair_counts"] if x is not None] or [[0] * 4], axis=0)
        more_k = int((before > 2).sum())
        return pd.DataFrame({"tokens": [int(count.sum())], "types": [int((count > 0).sum())], "before": [int(before.sum())], "more": [more_k], "pair_counts": [[int(v) for v in of_pairs]], "word_counts": [[int(v) for v in of_words]]})

    return run


def train(docs: DataFrame, place_bytes: int = PLACE_BYTES) -> Model | None:
    """Counts all texts of docs (doc_id, text; a null text is empty). None for an empty table."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    places = max(-(-size // place_bytes), spark.sparkContext.defaultParallelism)
    uri = new_folder(spark, "kneser-ney")
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    train_rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    frequent = frequent_contexts(train_rows, places)
    counted = train_rows.select("text").mapInPandas(_counting(places, frequent), "place long, blob binary").repartition(places, "place")
    pairs = counted.groupBy("place").applyInPandas(_pairs_done(uri, places), "place long, blob binary, pair_counts array<long>").repartition(places, "place")
    words = pairs.groupBy("place").applyInPandas(_words_done(uri), "tokens long, types long, before long, more long, pair_counts array<long>, word_counts array<long>")
    sums = [F.sum(c).alias(c) for c in ("tokens", "types", "before", "more")] + [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("pair_counts", "word_counts") for i in range(4)]
    r = words.agg(*sums).first()
    if not r["tokens"]:
        return None
    of_pairs, of_words = discounts([r[f"pair_counts{i}"] for i in range(4)]), discounts([r[f"word_counts{i}"] for i in range(4)])
    rest = (of_words[0] * r["word_counts0"] + of_words[1] * r["word_counts1"] + of_words[2] * r["more"]) / r["before"]
    return Model(uri, places, frequent, r["tokens"], r["types"], r["before"], of_pairs, of_words, rest)


class Scorer:
    """Looks probabilities up in the shards, of which it holds `OPEN` at most; of a store that cannot be mapped also no more than `KEPT` bytes."""

    def __init__(self, model: Model):
        self.model, self.store = model, Store(model.uri)
        self.open: OrderedDict[str, tuple[list[np.ndarray], int]] = OrderedDict()
        self.bytes = 0

    def _shard(self, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Those used last stay open; one that goes is unmapped, as nothing else refers to it."""
        if name not in self.open:
            self.open[name] = self.store.read(name, kinds)
            self.bytes += self.open[name][1]
            while len(self.open) > 1 and (self.bytes > KEPT or len(self.open) > OPEN):
                self.bytes -= self.open.popitem(last=False)[1][1]
        self.open.move_to_end(name)
        return self.open[name][0]

    @staticmethod
    def _counts(low: np.ndarray, places: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = low[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = values[np.searchsorted(places, at[big])]
        return out

    def _find(self, what: str, place: np.ndarray, keys: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """The counts at the keys, 0 where there is none. keys are searched in order, place by place, so a shard is opened once."""
        out = [np.zeros(len(keys), np.int64) for _ in range(len(kinds) // 3)]
        order = np.lexsort((keys, place))
        some, first = np.unique(place[order], return_index=True)
        for p, a, b in zip(some.tolist(), first.tolist(), [*first.tolist()[1:], len(order)]):
            mine = order[a:b]
            names, *counts = self._shard(f"{what}-{p}", kinds)
            if len(names):
                at = np.minimum(np.searchsorted(names, keys[mine]), len(names) - 1)
                hit = names[at] == keys[mine]
                for i, o in enumerate(out):
                    o[mine[hit]] = self._counts(*counts[3 * i : 3 * i + 3], at[hit])
        return out

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score, the model's log10 probability."""
        m = self.model
        names, at = np.unique(np.concatenate([tokens, [U64(START)]]), return_inverse=True)
        count, before, once, twice, more, total = self._find("word", ((names >> U64(20)) % U64(m.places)).astype(np.int64), names, WORD)
        d, e = np.array((0.0, *m.pair_discounts)), np.array((0.0, *m.word_discounts))
        low = np.maximum(before - e[np.minimum(before, 3)], 0) / m.before + m.word_rest / (m.types + 1)
        rest = np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(total, 1), 1.0)
        w = at[:-1]
        u = with_context(w.astype(U64), sizes).astype(np.int64)
        u[np.cumsum(sizes) - sizes] = at[-1]
        pairs, where = np.unique(u * len(names) + w, return_inverse=True)
        pu, pw = names[pairs // len(names)], names[pairs % len(names)]
        (c,) = self._find("pair", place_of(pu, pw, m.frequent, m.places), pair_hash(pu, pw), PAIR)
        iu, iw = pairs // len(names), pairs % len(names)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[iu], 1) + rest[iu] * low[iw]
        base = np.log10((count + 1) / (m.tokens + m.types + 1))
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat((count > 0)[w].astype(np.int64), starts), np.add.reduceat(base[w], starts), np.add.reduceat(np.log10(p)[where], starts)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs.

    A null or empty text has one token, its end. Without a model (nothing to learn from) known is 0
    and the scores are null. Repeated rows stay.
    """

    def make():
        own, scorer = _Hashes(), model and Scorer(model)

        def run(texts: list[str | None]):
            cuts, room = [0], 0
            for i, t in enumerate(texts):
                room += len(t or "") // 5 + 1
                if room > BATCH:
                    cuts, room = [*cuts, i + 1], 0
            all_sizes, found = [], []
            for a, b in zip(cuts, [*cuts[1:], len(texts)]):
                if a < b:
                    tokens, sizes = hashed(texts[a:b], own)
                    all_sizes.append(sizes)
                    found.append(scorer.score(tokens, sizes) if scorer else ())
            sizes = np.concatenate(all_sizes) if all_sizes else np.empty(0, np.int64)
            if not scorer:
                return sizes, np.zeros(len(sizes), np.int64), [None] * len(sizes), [None] * len(sizes)
            return sizes, *(np.concatenate(c) for c in zip(*found))

        return run

    scored = each_text(make, "n_tokens long, n_known long, base_score double, score double")
    out = docs.select("doc_id", scored(F.col("text").cast("string")).alias("_r"))
    perplexity = F.pow(F.lit(10.0), -F.col("_r.score") / F.col("_r.n_tokens"))
    train_tokens = F.lit(model.tokens if model else 0).cast("long")
    return out.select("doc_id", "_r.n_tokens", "_r.n_known", train_tokens.alias("train_tokens"), "_r.base_score", "_r.score", perplexity.alias("perplexity"))
