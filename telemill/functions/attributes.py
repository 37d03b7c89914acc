"""Columns read from a log event: its family, attributes and time.

Attributes are text until a question is asked of them. A stored table may
carry the asked-for keys as columns of their own (``attr_<key>``), its event
family and its date; these functions use such a column where it is there, so
that the scan prunes files and never reads the whole map.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.fixed_values import (
    APPROVING_DECISIONS,
    EVENT_FAMILIES,
    REJECTING_DECISIONS,
    TRUE_TEXTS,
    UNKNOWN,
)
from telemill.functions import sql_text
from telemill.functions.numbers import real_number, whole_number


def attribute(logs: DataFrame, key: str) -> Column:
    """Text of one attribute, NULL when the event does not have it.

    The attributes are a map or, in tables kept elsewhere, JSON text.
    """
    promoted = f"attr_{key}"
    if promoted in logs.columns:
        return F.col(promoted)
    if isinstance(logs.schema["attributes"].dataType, T.StringType):
        return F.get_json_object("attributes", f"$.{key}")
    return F.col("attributes").getItem(key)


def event_family(column: str = "event_name") -> Column:
    """Family of the event name in a column, NULL when it has none. No name has two."""
    return F.expr(
        sql_text.first_match(
            (f"{sql_text.name(column)} LIKE {sql_text.literal(pattern)}", sql_text.literal(family))
            for family, pattern in EVENT_FAMILIES.items()
        )
    )


def is_family(logs: DataFrame, family: str) -> Column:
    """Whether the event belongs to a family; a partition filter on stored tables."""
    if "event_family" in logs.columns:
        return F.col("event_family") == family
    return F.col("event_name").like(EVENT_FAMILIES[family])


def utc_literal(moment: datetime) -> Column:
    """A fixed instant; a moment without a zone is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment.isoformat(sep=" ", timespec="microseconds")).cast("timestamp")


def since_filter(table: DataFrame, since: datetime | None) -> DataFrame:
    """Rows at or after ``since``; all rows when it is None. There is no upper bound."""
    if since is None:
        return table
    start = utc_literal(since)
    if "event_date" in table.columns:
        table = table.filter(F.col("event_date") >= start.cast("date"))
    return table.filter(F.col("timestamp") >= start)


def tool_name(logs: DataFrame) -> Column:
    return F.coalesce(attribute(logs, "tool_name"), F.lit(UNKNOWN))


def duration_ms(logs: DataFrame) -> Column:
    """Integer duration; missing and unreadable text count as 0."""
    return F.coalesce(whole_number(attribute(logs, "duration_ms")), F.lit(0).cast("bigint"))


def bad_duration(logs: DataFrame) -> Column:
    """Whether a duration is there but cannot be read."""
    text = attribute(logs, "duration_ms")
    return text.isNotNull() & whole_number(text).isNull()


def success(logs: DataFrame) -> Column:
    """True for the texts that mean it; anything else, and nothing, is false."""
    return F.coalesce(attribute(logs, "success").isin(*TRUE_TEXTS), F.lit(False))


def said_unsuccessful(logs: DataFrame) -> Column:
    """Whether the event itself says it failed; NULL, so no match, when it is silent."""
    return ~attribute(logs, "success").isin(*TRUE_TEXTS)


def latency_text(logs: DataFrame) -> Column:
    """The first latency an API event names."""
    return F.coalesce(attribute(logs, "latency_ms"), attribute(logs, "duration_ms"))


def latency_ms(logs: DataFrame) -> Column:
    """Latency as a double; missing and unreadable text count as 0."""
    return F.coalesce(real_number(latency_text(logs)), F.lit(0.0))


def bad_latency(logs: DataFrame) -> Column:
    text = latency_text(logs)
    return text.isNotNull() & real_number(text).isNull()


def is_approval(decision: Column) -> Column:
    return decision.isin(*APPROVING_DECISIONS)


def is_rejection(decision: Column) -> Column:
    return decision.isin(*REJECTING_DECISIONS)
