"""The subpackage's queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, html_blocks, kneser_ney, langid_crf, licenses, line_dedup, max_sketch, quality, secrets, shards, simhash
from .common import id_bucket, spread, table


def rank_file() -> str:
    import public_tokenizers

    return os.environ.get("BPE_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = id_bucket(F.col("doc_id"), 3) == 1
    model = langid_crf.train(docs.filter(~held).select("doc_id", "text", "lang"))
    out = langid_crf.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_switches")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    held = id_bucket(F.col("doc_id"), 7) == 2
    model = kneser_ney.train(docs.filter(~held))
    out = kneser_ney.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir, "doc_id", "text"), rank_file(), pattern(), output="digests")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir, "doc_id", "text"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.matches(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), k=10)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(documents(spark, sf_dir, "doc_id", "text"), min_docs=10, least=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_langid, op2_simhash, op3_kneser_ney, op4_bpe, op5_secrets, op6_shards, op7_html, op8_decontaminate, op9_quality, op10_licenses, op11_search, op12_line_dedup, op13_filter_audit)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality_sql() -> str:
    stop = ", ".join(map(_quoted, quality.STOP_WORDS))
    rules = " AND ".join(f"{m} {sign} {limit}" for m, least, most, _ in quality.RULES for sign, limit in ((">=", least), ("<=", most)) if limit is not None)

    def per_mille(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN {part} * 1000 // {whole} ELSE 0 END"

    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM t
), g AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1
), c AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
    len(list_filter(w, lambda x: suffix(x, '!')))::BIGINT AS n_shout
  FROM w LEFT JOIN c USING (r)
), p AS (
  SELECT *, {per_mille("word_chars", "n_words")} AS mean_word_pm, {per_mille("n_symbols", "n_words")} AS symbols_pm,
    {per_mille("n_shout", "n_words")} AS shout_pm, {per_mille("n_stop_words", "n_words")} AS stop_words_pm,
    {per_mille("n_dup_lines", "n_lines")} AS dup_lines_pm, {per_mille("n_repeat_words", "n_words")} AS repeat_words_pm
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {rules} AS kept
FROM p"""


def _licenses_sql() -> str:
    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), {_quoted(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
        for p, other in licenses.EQUIVALENT:
            out = f"regexp_replace({out}, {_quoted(p)}, {_quoted(other)}, 'g')"
        return f"trim(regexp_replace({out}, {_quoted(licenses.OTHER)}, ' ', 'g'))"

    known, digests = (", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows) for rows in (licenses.KNOWN, licenses.KNOWN_DIGESTS))
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256({form("text")}) AS digest, license FROM (VALUES {known}) AS k(license, text)
    UNION ALL SELECT digest, license FROM (VALUES {digests}) AS k(license, digest)
  ) GROUP BY 1
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, {form("coalesce(text, '')")} AS f, row_number() OVER () AS r FROM documents
), l AS (
  SELECT r, {form("x")} AS f FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
), h AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM l JOIN known ON l.f <> '' AND sha256(l.f) = digest GROUP BY r
)
SELECT doc_id, CASE WHEN f <> '' THEN sha256(f) END AS text_digest, license, coalesce(line_licenses, '') AS line_licenses
FROM d LEFT JOIN known ON f <> '' AND sha256(f) = digest LEFT JOIN h USING (r)"""


def _words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _decontaminate_sql() -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents
), b AS (
  SELECT item_id, {_words("text")} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def _search_sql() -> str:
    return f"""
WITH d AS (
  SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents) WHERE len(w) > 0
), s AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d
), tf AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM d) GROUP BY ALL
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY 1
), q AS (
  SELECT i, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({_words("text")}) AS t FROM benchmark) GROUP BY ALL
), x AS (
  SELECT i, item_id, r, doc_id, sum(c * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN df USING (t) JOIN tf USING (t), s GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10"""


def _line_dedup_sql() -> str:
    blanks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), x AS (
  SELECT r, i, l[i] AS line, translate(trim(l[i], {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d)
), c AS (
  SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
), o AS (
  SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY i) AS kept FROM x WHERE k NOT IN (SELECT k FROM c) GROUP BY r
)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n_kept, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (r)"""


def _filter_audit_sql() -> str:
    # an order is five letters; place is a letter's step in it
    at = "least(" + ", ".join(f"CASE WHEN {f} THEN instr(filter_order, '{f}') ELSE 6 END" for f in filter_audit.FILTERS) + ")"
    fails = "CASE substr(filter_order, step, 1) " + " ".join(f"WHEN '{f}' THEN {f}" for f in filter_audit.FILTERS) + " END"
    several = " + ".join(f"{f}::INT" for f in filter_audit.FILTERS)
    letters = ", ".join(f"('{f}')" for f in filter_audit.FILTERS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), m AS (
  SELECT part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C,
    regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM d
), c AS (
  SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), f(l) AS (
  VALUES {letters}
), o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), x AS (
  SELECT part, filter_order, step, n, good, toxic, {at} AS gone, {fails} AS fails, {several} AS fs FROM c, o, (SELECT unnest(range(1, 6))::INT AS step)
), y AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND fs = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM y"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_decontaminate": _decontaminate_sql(),
        "op9_quality": _quality_sql(),
        "op10_licenses": _licenses_sql(),
        "op11_search": _search_sql(),
        "op12_line_dedup": _line_dedup_sql(),
        "op13_filter_audit": _filter_audit_sql(),
    }
