"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Words are runs of characters other than the six ASCII white-space ones, lines are parts between
line feeds. All measures are columns of one select; a rule of `RULES` names a measure and the
range that it must lie in. No user function runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# fixed values: frequent short words of four languages
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des du et un une que en dans pour qui par sur au est pas avec "
    "el los las y en que un una por con del se para al lo como su no"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))

# measure, least, most (None: open), what it stands against. Ratios are in thousandths of a whole.
RULES: tuple[tuple[str, int | None, int | None, str], ...] = (
    ("n_words", 10, None, "fragments"),
    ("repeat_words_pm", None, 200, "text that repeats itself"),
    ("mean_word_pm", 2_000, 12_000, "word lists of codes, or single letters"),
    ("symbols_pm", None, 100, "symbols in over a tenth of the words"),
    ("shout_pm", None, 300, "words that end in an exclamation mark"),
    ("stop_words_pm", 20, None, "lists without function words"),
    ("dup_lines_pm", None, 300, "lines repeated"),
)


def _per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and all measures. Null text: no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_t"))
    base = base.select(*keep, "_t", F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    starts = F.when(F.size("_w") >= 5, F.sequence(F.lit(0), F.size("_w") - 5)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(5)]))
    base = base.select(*keep, "_t", "_w", lines.alias("_l"), hashes.alias("_h"))
    # only texts with a repeated hash are looked at closely: sort the windows, take those equal to a neighbour
    windows = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", F.slice("_w", i + 1, 5)).alias("s"), i.alias("i"))))
    base = base.select(*keep, "_t", "_w", "_l", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), windows).alias("_s"))
    n = F.size("_s")
    twin = F.filter(
        "_s",
        lambda x, i: ((i > 0) & (F.get("_s", i - 1)["s"] == x["s"])) | ((i < n - 1) & (F.get("_s", i + 1)["s"] == x["s"])),
    )
    places = F.array_sort(F.transform(twin, lambda x: x["i"]))
    base = base.select(*keep, "_t", "_w", "_l", places.alias("_p"))
    # each place adds five words, or as many as lie before the next place
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_p", i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x
    )
    # always 0; a filter on a measure is not moved through a projection that depends on the row's place,
    # or the optimiser would write all of the expressions above out again in the filter
    nothing = F.when(F.monotonically_increasing_id() < 0, F.lit(1)).otherwise(F.lit(0))
    n_words, n_lines = (F.size("_w") + nothing).cast("long"), F.size("_l").cast("long")
    base = base.select(
        *keep,
        n_words.alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w: w.endswith("!"))).cast("long").alias("n_shout"),
    )
    return base.select(
        "*",
        _per_mille(F.col("word_chars"), F.col("n_words")).alias("mean_word_pm"),
        _per_mille(F.col("n_symbols"), F.col("n_words")).alias("symbols_pm"),
        _per_mille(F.col("n_shout"), F.col("n_words")).alias("shout_pm"),
        _per_mille(F.col("n_stop_words"), F.col("n_words")).alias("stop_words_pm"),
        _per_mille(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines_pm"),
        _per_mille(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_words_pm"),
    )


def compiled(rules=RULES) -> Column:
    """The rule table as one Boolean column."""
    out = F.lit(True)
    for measure, least, most, _ in rules:
        if least is not None:
            out = out & (F.col(measure) >= least)
        if most is not None:
            out = out & (F.col(measure) <= most)
    return out


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of docs; no shuffle. Repeated rows stay."""
    out = measures(docs, "doc_id").withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that pass. The columns stay as they are."""
    row = docs.select(whole_row(docs).alias("_row"), F.col("text").cast("string").alias("text"))
    return measures(row, "_row").filter(~F.expr(BASE_FAILED) & compiled(rules)).select("_row.*")
