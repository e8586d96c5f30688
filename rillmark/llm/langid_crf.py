"""Language of each word by a linear-chain conditional random field, and of a text by its words.

Features of a word: its affixes (first and last two and three letters), its letter trigrams, and
membership in each language's lexicon of frequent words. Neighbouring labels are scored by a
learned transition matrix, so a switch of language inside a text costs, but may happen. Marginals
come from forward-backward; a text's language is the one with the largest mean marginal.

Fitting uses a sample of rows: of each language the `ROWS_PER_LANG` different ones with the smallest
hashes of id and text, whole. Their texts are cut into sequences of `SEQUENCE` words, every second of
which has another sequence behind it, mostly of another text, so that the transitions see switches.
Labelling covers whole texts of all rows; its memory is bounded by `TOKENS`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import each_text

ROWS_PER_LANG = 64
SEQUENCE = 60
LEXICON = 80
EPOCHS = 200  # at most
TOLERANCE = 1e-4  # the fit ends when an epoch changes the mean log-likelihood of a word by less
SAMPLE_BYTES = 64 << 20  # text that the driver gets, for all languages together
TOKENS = 400_000
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str, lexicon: dict[str, list[str]]) -> list[str]:
    """Trigrams with the word's ends marked (the outer ones are the two-letter affixes), three-letter affixes, and lexicons."""
    s = f"^{word}$"
    out = [s[i : i + 3] for i in range(len(s) - 2)] or [s]
    if len(word) > 2:
        out += (s[:4], s[-4:])
    return out + lexicon.get(word, [])


@dataclass
class Crf:
    langs: list[str]
    lexicon: dict[str, list[str]]  # word -> the lexicons that list it, as features
    index: dict[str, int]
    weights: np.ndarray  # features x languages
    start: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Summed feature weights of each word."""
        get, flat, sizes = self.index.get, [], []
        for w in words:
            own = [k for k in map(get, features(w, self.lexicon)) if k is not None]
            own.append(0)  # the bias
            flat += own
            sizes.append(len(own))
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.weights[flat], starts, axis=0).astype(np.float32)


def marginals(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences that are stored one after another in emit.

    Returns each position's label marginals, the summed pair marginals, and the log-likelihood's
    normaliser. lengths must be in descending order and positive.
    """
    n, k = len(lengths), emit.shape[1]
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    top = emit.max(axis=1, keepdims=True)
    pot = np.exp(emit - top)
    move = np.exp(moves).astype(pot.dtype)
    alpha, scale = np.empty_like(pot), np.empty(len(pot), pot.dtype)
    alive = [int(x) for x in np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")]  # sequences longer than t
    for t, m in enumerate(alive):
        here = at[:m] + t
        a = pot[here] * (np.exp(start).astype(pot.dtype) if t == 0 else alpha[here - 1] @ move)
        z = a.sum(axis=1)
        alpha[here], scale[here] = a / z[:, None], z
    beta = np.ones((n, k), pot.dtype)
    out = np.empty_like(pot)
    pairs = np.zeros((k, k))
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        here = at[:m] + t
        longer = alive[t + 1] if t + 1 < len(alive) else 0
        if longer:
            nxt = at[:longer] + t + 1
            inner = pot[nxt] * beta[:longer] / scale[nxt][:, None]
            pairs += move * (alpha[at[:longer] + t].T @ inner)
            beta[:longer] = inner @ move.T
        b = alpha[here] * beta[:m]
        out[here] = b / b.sum(axis=1, keepdims=True)
    return out, pairs, float(np.log(scale).sum() + top.sum())


def fit(sample: list[tuple[str, list[str]]]) -> Crf | None:
    """sample: (language, words), in any order. Gradient ascent (Adagrad) on the regularised likelihood."""
    sample = [s for s in sample if s[1]]
    langs = sorted({x for x, _ in sample})
    if not langs:
        return None
    counts = {x: Counter() for x in langs}
    for x, ws in sample:
        counts[x].update(ws)
    lexicon: dict[str, list[str]] = {}
    for x in langs:
        for w, c in sorted(counts[x].items(), key=lambda e: (-e[1], e[0]))[:LEXICON]:
            if c > 1:
                lexicon.setdefault(w, []).append("=" + x)
    parts = sorted((xxhash.xxh64_intdigest(" ".join(ws[a : a + SEQUENCE])), x, ws[a : a + SEQUENCE]) for x, ws in sample for a in range(0, len(ws), SEQUENCE))
    seen = Counter(f for _, _, ws in parts for w in set(ws) for f in features(w, lexicon))
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c > 1), 1)}
    code = {x: i for i, x in enumerate(langs)}
    seqs = [[(w, code[x]) for w in ws] for _, x, ws in parts]
    seqs = [s + seqs[(i + 1) % len(seqs)] if i % 2 else s for i, s in enumerate(seqs)]
    seqs.sort(key=len, reverse=True)
    lengths = np.array([len(s) for s in seqs])
    names = sorted({w for s in seqs for w, _ in s})
    word_at = {w: i for i, w in enumerate(names)}
    rows, cols = [], []
    for i, w in enumerate(names):
        own = [0, *(index[f] for f in features(w, lexicon) if f in index)]
        rows += [i] * len(own)
        cols += own
    rows, cols = np.array(rows), np.array(cols)
    row_starts = np.concatenate([[0], np.cumsum(np.bincount(rows))[:-1]])
    ids = np.array([word_at[w] for s in seqs for w, _ in s])
    gold = np.array([y for s in seqs for _, y in s])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    k = len(langs)
    onehot = np.eye(k)[gold]
    inner = np.ones(len(gold), bool)
    inner[first] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    weights, start, moves = np.zeros((len(index) + 1, k)), np.zeros(k), np.zeros((k, k))
    squares = [np.full(x.shape, 1e-8) for x in (weights, start, moves)]
    order = np.argsort(cols, kind="stable")
    col_names, col_starts = np.unique(cols[order], return_index=True)
    before = -np.inf
    for _ in range(EPOCHS):
        per_word = np.add.reduceat(weights[cols], row_starts, axis=0)
        emit = per_word[ids]
        post, pairs, norm = marginals(emit, lengths, start, moves)
        likelihood = (emit[np.arange(len(gold)), gold].sum() + start[gold[first]].sum() + (moves * gold_pairs).sum() - norm) / len(gold)
        if abs(likelihood - before) < TOLERANCE:
            break
        before = likelihood
        gap = onehot - post
        by_word = np.zeros((len(names), k))
        np.add.at(by_word, ids, gap)
        slope = np.zeros_like(weights)
        slope[col_names] = np.add.reduceat(by_word[rows[order]], col_starts, axis=0)
        for x, g, s in zip((weights, start, moves), (slope - 0.01 * weights, gap[first].sum(axis=0), gold_pairs - pairs - 0.01 * moves), squares):
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    return Crf(langs, lexicon, index, weights.astype(np.float32), start, moves)


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, sample_bytes: int = SAMPLE_BYTES) -> Crf | None:
    """docs: doc_id, text, lang. None if no row has a language and a letter.

    Equal rows count once, whatever their number; null and repeated ids are ids as any other. The driver gets rows_per_lang whole texts
    for each language at most, and of those as many as have sample_bytes together, shared equally by the languages; one text
    of a language at least.
    """
    rows = docs.filter("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("key", F.lit("")), "text"))
    # each row's hash once, whatever its number; then each task sends on only its own smallest hashes of a language
    order = Window.partitionBy("lang").orderBy("h")
    once = rows.select("lang", "h", F.octet_length("text").cast("long").alias("size")).groupBy("lang", "h").agg(F.max("size").alias("size"))
    least = once.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= rows_per_lang)
    langs = F.count_if(F.col("at") == 1).over(Window.partitionBy(F.lit(0)))
    share = least.select("lang", "h", "at", "size", F.sum("size").over(order).alias("bytes"), langs.alias("langs"))
    chosen = share.filter((F.col("at") == 1) | (F.col("bytes") * F.col("langs") <= sample_bytes)).select("lang", "h")
    found = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    return fit([(r["lang"], words_of(r["text"])) for r in found.collect()])


class Labeller:
    """Applies a model to texts; a word's emissions are kept while the cache has room."""

    def __init__(self, model: Crf):
        self.model, self.cache, self.rows = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        new = list(dict.fromkeys(w for w in words if w not in cache))
        if len(cache) + len(new) > CACHE:
            cache.clear()
            self.rows = self.rows[:0]
            new = list(dict.fromkeys(words))
        cache.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, self.model.emissions(new)])
        return np.array([cache[w] for w in words], np.int64)

    def posteriors(self, seqs: list[list[str]]) -> list[np.ndarray]:
        """Label marginals of each word of each sequence; none may be empty."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        lengths = np.array([len(seqs[i]) for i in order])
        emit = self.rows_of([w for i in order for w in seqs[i]])
        post, _, _ = marginals(emit, lengths, self.model.start, self.model.moves)
        parts = np.split(post, np.cumsum(lengths)[:-1])
        out: list[np.ndarray] = [np.empty(0)] * len(seqs)
        for i, p in zip(order, parts):
            out[i] = p
        return out

    def rows_of(self, words: list[str]) -> np.ndarray:
        ids = self._ids(words)
        return self.rows[ids]


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """Texts with letters, in groups of about TOKENS words."""
    group, n = [], 0
    for i, text in enumerate(texts):
        if ws := words_of(text):
            group.append((i, ws))
            n += len(ws)
            if n >= TOKENS:
                yield group
                group, n = [], 0
    if group:
        yield group


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score, n_switches for each row of docs (text only is read).

    A null text or one without a letter is `und` with score 0, as all are where nothing could be
    learned. Equal marginals: the language that comes first by name. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's bound

    def make():
        own = shared.value and Labeller(shared.value)

        def run(texts: list[str | None]):
            lang, score, switches = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for group in _groups(texts) if own else ():
                for (i, _), p in zip(group, own.posteriors([ws for _, ws in group])):
                    mean = p.mean(axis=0, dtype=np.float64)
                    best = int(mean.argmax())
                    lang[i], score[i] = own.model.langs[best], min(1.0, float(mean[best]))
                    labels = p.argmax(axis=1)
                    switches[i] = int((labels[1:] != labels[:-1]).sum())
            return lang, score, switches

        return run

    label = each_text(make, "lang_pred string, score double, n_switches long")
    return docs.select("doc_id", label(F.col("text").cast("string")).alias("_r")).select("doc_id", "_r.*")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """One row for each run of words with the same label: doc_id, run, lang, first_word, n_words, score. None for a text without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = Labeller(shared.value)

        def run(texts: list[str | None]):
            out: list[list[dict]] = [[] for _ in texts]
            for group in _groups(texts):
                for (i, _), p in zip(group, own.posteriors([ws for _, ws in group])):
                    labels = p.argmax(axis=1)
                    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
                    out[i] = [{"run": r, "lang": own.model.langs[labels[a]], "first_word": a, "n_words": b - a, "score": float(p[a:b, labels[a]].mean())} for r, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            return (out,)

        return run

    label = each_text(make, "runs array<struct<run: long, lang: string, first_word: long, n_words: long, score: double>>")
    return docs.select("doc_id", label(F.col("text").cast("string")).alias("_r")).select("doc_id", F.inline("_r.runs"))
