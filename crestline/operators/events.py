"""Normalisation and validation of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.text import collapse, identity, is_blank, lower, micros, normalized_length, trim_space

REASONS = ("empty_event_id", "empty_query", "invalid_utf8", "query_too_long", "no_identifier", "future_time", "stale_event")


def normalize(events: DataFrame) -> DataFrame:
    """query normalised, user and session trimmed, event_id as it is; ``identity`` and ``ts_us`` added."""
    # a step for each column that the next one uses more than once: Spark does not merge such projections
    out = events.withColumns({"event_id": F.coalesce("event_id", F.lit("")), "query": lower(F.col("query")), "user_id": trim_space(F.col("user_id")), "session_id": trim_space(F.col("session_id"))})
    out = out.withColumns({"query": trim_space(F.col("query")), "ts_us": micros(F.col("timestamp"))})
    return out.withColumns({"query": collapse(F.col("query")), "identity": identity(F.col("user_id"), F.col("session_id"))})


def reject_reason(now_us: Column, max_age_us: int = 300_000_000, max_chars: int = 256) -> Column:
    """The first of REASONS that holds for an event as it came, else null. A missing timestamp is stale.

    The tests are those of the normalised event, put so that no text is normalised for them: white space decides
    blanks, and only a text that is too long as it came can be too long afterwards.
    """
    query, ts = F.coalesce("query", F.lit("")), micros(F.col("timestamp"))
    tests = (
        F.coalesce("event_id", F.lit("")) == "",
        is_blank(query),
        ~F.is_valid_utf8(query),
        (F.length(query) > max_chars) & (normalized_length(query) > max_chars),
        is_blank(F.col("user_id")) & is_blank(F.col("session_id")),
        ts > now_us,
        ts.isNull() | (now_us - ts > max_age_us),
    )
    out = F
    for test, reason in zip(tests, REASONS, strict=True):
        out = out.when(test, reason)
    return out


def with_reject_reason(events: DataFrame, now_us: Column | int, max_age_us: int = 300_000_000, max_chars: int = 256) -> DataFrame:
    """Normalised events with ``reject_reason``: one projection, no shuffle."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return normalize(events.withColumn("reject_reason", reject_reason(now, max_age_us, max_chars)))
