"""Row-level errors: strict operators add to a column, and one split at the end makes the dead letters.

`_errors` holds the messages of a row, `_record` the row as it came in, `_raw_content` what a decoder could not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS, RECORD, RAW = CHANNEL = ("_errors", "_record", "_raw_content")


def _record(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[f"`{c}`" for c in columns])) if columns else F.lit("{}")


def opened(df: DataFrame, without: str | None = None) -> DataFrame:
    """Keep each row's original as JSON and give it an empty list of errors. without: a column that the originals leave out."""
    if ERRORS in df.columns:
        return df
    return df.withColumns({RECORD: _record([c for c in df.columns if c != without]), ERRORS: F.array().cast("array<string>")})


def recorded(df: DataFrame) -> DataFrame:
    """Take rows without errors, as they are now, for the originals."""
    now = _record([c for c in df.columns if c not in CHANNEL])
    return df.withColumn(RECORD, F.when(F.size(ERRORS) == 0, now).otherwise(F.col(RECORD)))


def fault(df: DataFrame, when: Column, message: Column | str) -> DataFrame:
    """Add a message to the rows for which `when` holds; where no channel is open, such a row ends the job."""
    text = F.lit(message) if isinstance(message, str) else message
    if ERRORS in df.columns:
        return df.withColumn(ERRORS, F.when(when, F.array_append(ERRORS, text)).otherwise(F.col(ERRORS)))
    return df.filter(F.when(when, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def split_dlq(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors and without the channel, rows with errors)."""
    bad = F.size(ERRORS) > 0
    return df.filter(~bad).drop(*CHANNEL), df.filter(bad)


def dlq_envelope(bad: DataFrame, stage: str, pipeline: str, run_id: str, raw: Column | None = None) -> DataFrame:
    """The fixed columns of a dead letter; raw is the decoder's unless given."""
    raw = F.col(RAW) if raw is None and RAW in bad.columns else raw
    return bad.select(
        F.element_at(ERRORS, 1).alias("_error"),
        F.lit(stage).alias("_stage"),
        F.lit(pipeline).alias("_pipeline"),
        F.lit(run_id).alias("_run_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("_timestamp"),
        F.col(RECORD).alias("record"),
        (F.regexp_replace(F.base64(raw), "\\s", "") if raw is not None else F.lit(None).cast("string")).alias("raw"),
    )
