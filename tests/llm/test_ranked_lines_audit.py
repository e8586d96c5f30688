"""Search, line dedup and filter audit against plain versions of what they promise."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillmark.llm import filter_audit, line_dedup, max_sketch

SCHEMA = "doc_id long, text string, source string, item long, n long, rank int, t1 long, h1 long, part string, mask int"
WORDS = "the river of stone and light was in a quiet valley where old mills turned by day for grain ünïc Straße İ".split()


def prose(n: int, start: int = 0) -> str:
    out, x = [], start * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 15] + ("" if x >> 20 & 3 else str(x >> 8 & 63)))
    return " ".join(out)


def frame(spark, rows, parts=3):
    """doc_id, text, source; the other columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5, "p", 6) for i, t, s in rows], SCHEMA).repartition(parts)


TEXTS = [None, "", " \t\n", "one", "The RIVER, the river; the-river", prose(60), prose(60), prose(400, 3), prose(3000, 5), "x" * 3000, "\n".join(["Shared line"] * 3), "été İ K"]
ROWS = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)] + [(None, prose(60), None), (5, prose(60), "a"), (5, prose(60), "b"), (900, prose(30, 9), "a"), (2**53 + 1, prose(60), "a"), (2**53 + 2, prose(60), "b")]


# 11 ----------------------------------------------------------------------------------------------


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_search(rows, items, k):
    docs = [(i, words(t)) for i, t, *_ in rows]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(len(w) for _, w in docs)
    tfs = [(i, len(w), Counter(w)) for i, w in docs]
    df = Counter(t for _, _, c in tfs for t in c)
    out = []
    for item, text in items:
        asked = Counter(words(text))
        scored = []
        for i, size, c in tfs:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "quiet river valley"), (2, None), (3, "..."), (4, "STRASSE Ünïc İ river river river"), (5, prose(200, 3)), (5, "mills"), (None, "light stone"), (7, "nowhere"), (8, "été x")]


@pytest.mark.parametrize("k,width,block,docs,round_", [(10, 4096, (1000, 200_000), 256, 16), (3, 8, (2, 10), 5, 1), (2, 1, (1, 1), 1, 2)])
def test_search_against_plain_version(spark, monkeypatch, k, width, block, docs, round_):
    monkeypatch.setattr(max_sketch, "DOCS", docs)
    monkeypatch.setattr(max_sketch, "ROUND", round_)
    rows = ROWS + [(1000 + i, prose(20 + i % 50, i), "a") for i in range(200)] + [(3000 - i, prose(40, 77), "a") for i in range(60)]
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, item long, terms long")
    got = max_sketch.search(frame(spark, rows), items, k, width, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, ITEMS, k)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = frame(spark, [])
    assert max_sketch.search(none, items).count() == 0
    assert max_sketch.search(frame(spark, [(1, None, "a"), (2, " ", "a")]), items).count() == 0
    assert max_sketch.search(frame(spark, ROWS), items.limit(0)).count() == 0


def test_bounds_hold_and_stop_the_scoring():
    """A sketch's bound is never under the exact score, and most pairs are never scored."""
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(-(2**62), 2**62, 5000)
    docs = [np.unique(rng.choice(vocabulary, 100)) for _ in range(2000)]
    counts = [rng.integers(1, 6, len(d)) for d in docs]
    n = np.array([c.sum() for c in counts])
    names = np.sort(vocabulary)
    items = [np.unique(rng.integers(0, 5000, 12)) for _ in range(20)]
    sizes = np.array([len(i) for i in items])
    q = max_sketch.Queries(names, np.arange(20), np.cumsum(sizes) - sizes, np.concatenate(items), rng.integers(1, 9000, sizes.sum()), 2000, int(n.sum()))
    table, best, scored = q.table(1024), max_sketch.Best(20, 10), 0
    for a in range(0, 2000, 250):
        part = slice(a, a + 250)
        scored += max_sketch.rank_block(q, table, best, np.arange(2000)[part], np.zeros(250, bool), n[part], np.concatenate(docs[part]), np.concatenate(counts[part]), np.array([len(d) for d in docs[part]]))
    want = []
    for j in range(20):
        weights = dict(zip(names[items[j]].tolist(), q.weights[q.starts[j] :].tolist()))
        all_ = [(-sum(weights.get(t, 0) * int(x) for t, x in zip(d.tolist(), max_sketch.impacts(c, np.full(len(c), n[i]), 2000, int(n.sum())))), i) for i, (d, c) in enumerate(zip(docs, counts))]
        want.append([(-s, i) for s, i in sorted(all_)[:10]])
    assert [list(zip(s.tolist(), i.tolist())) for s, i in zip(best.score, best.id)] == want
    assert scored < 20 * 2000 / 4


# 12 ----------------------------------------------------------------------------------------------


def plain_dedup(rows, min_docs, least=1):
    def key(line):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return low if len(low) >= least else None

    lines = [(t or "").split("\n") for _, t, *_ in rows]
    in_docs = Counter(k for own in lines for k in {key(x) for x in own} if k is not None)
    out = []
    for (i, *_), own in zip(rows, lines):
        kept = [x for x in own if in_docs[key(x)] < min_docs or key(x) is None]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rows = list(ROWS)
    for i in range(120):
        own = [f"line {i % 30}", f" Line {i % 30}\t", "", "MENU | home \x0b", f"only {i}", "é" * (i % 3), "\x1c x"]
        rows.append((i % 100, "\n".join(own[i % 4 :] + own[: i % 2]), "a"))
    rows += [(500 + i, "copied\ntext\n of two lines", "b") for i in range(40)]
    return rows


@pytest.mark.parametrize("min_docs,least,batches,fanout", [(10, 1, 4, 2), (4, 1, 5, 3), (5, 2, 1, 2), (1, 1, 3, 2)])
def test_line_dedup_against_plain_version(spark, min_docs, least, batches, fanout):
    rows = line_rows()
    got = line_dedup.dedup(frame(spark, rows, 7), min_docs, least, batches, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == plain_dedup(rows, min_docs, least)


def test_line_dedup_by_shuffles_alone(spark, monkeypatch):
    """No table is small enough for a broadcast."""
    monkeypatch.setattr(line_dedup, "if_small", lambda df: df)
    rows = line_rows()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, line_dedup.dedup(frame(spark, rows, 7)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == plain_dedup(rows, 10)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup(frame(spark, [])).count() == 0
    got = line_dedup.dedup(frame(spark, [(1, None, "a"), (2, "", "a")])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_runs_are_levelled_and_settled_lines_are_not_added_again(spark):
    """Batches of one corpus in any number give the same counts; a line known to be common is in no later run."""
    runs = line_dedup.Runs(spark, min_docs=3, fanout=2)
    try:
        for b in range(5):
            rows = [(1, 1)] * 4 + [(2, b)] + [(3, 3)]
            runs.add(spark.createDataFrame(rows, "h1 long, h2 long"))
            assert [len(level) for level in runs.levels] == [int(x) for x in reversed(f"{b + 1:b}")]
        last = {(r["h1"], r["h2"]): r["n"] for r in runs.runs[0].collect()}
        assert last == {(2, 4): 1}  # (1, 1) was common in the first batch, (3, 3) once four batches were compacted
        assert sorted(map(tuple, runs.common().collect())) == [(1, 1), (3, 3)]
        assert len(runs.runs) == 2
        plan = runs._merged(runs.runs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # runs have their buckets
    finally:
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


# 13 ----------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[at] == 1 and i is not None} for at in (0, 1))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((s or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        found, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                failing = sum(d[1][f] for d in own)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                found.append((part, order, step, len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


LABELS = [(5, 1, 0), (5, 0, 1), (7, 1, 1), (8, None, 1), (None, 1, 1), (900, 1, None), (10**9, 1, 1)]


@pytest.mark.parametrize("hot", [1, 400])
def test_filter_audit_against_plain_version(spark, hot):
    long = " ".join(f"word{i}" for i in range(300))
    rows = ROWS + [(100 + i, long + (" A#" if i % 3 else " BBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBB"), "abc"[i % 3]) for i in range(20)] + [(2000 + i, "a b c d " * 80, None) for i in range(hot)]
    labels = spark.createDataFrame([(i, q, x, "p", 1) for i, q, x in LABELS], "doc_id long, quality int, toxic int, part string, mask int")
    got = filter_audit.audit(frame(spark, rows), labels)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, LABELS)


def test_filter_audit_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(frame(spark, ROWS), labels).collect())) == plain_audit(ROWS, [])


def test_removal_steps_are_the_first_failing_filter():
    steps = filter_audit.removal_steps(4)
    for mask in range(16):
        for o, order in enumerate(itertools.permutations(range(4))):
            want = next((i for i, f in enumerate(order, 1) if mask >> f & 1), 5)
            assert steps[mask, o] == want


def test_filter_audit_keeps_parts_apart_in_a_batch(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    rows = [(i, "w " * (i % 7 * 60), f"s{i % 11}") for i in range(150)]
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(150)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows), labels)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, [(i, i % 2, i % 3) for i in range(150)])


def test_line_digests_of_the_query(spark):
    from rillmark.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    want = {i: (n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in plain_dedup(list(docs.items()), 10)}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op12_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(defaultdict(int, got)) == len(docs)
