"""OTLP/JSON export requests, one per row, flattened to log events and metric points.

A request counts whole or not at all: one wrong type or one missing field
anywhere sends the payload to the quarantine frame.

The document is read with plain columns, which is fast but takes ``5`` for
``"5"`` where text must stand, and null for an absent list. Payloads whose text
may hold one of these (next to none) are read a second time with VARIANT
leaves, which keep the JSON type, to decide whether they are valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.fixed_values import (
    COST_METRIC,
    EVENT_NAME_KEY,
    SESSION_METRIC_PREFIX,
    SESSION_METRICS,
    TOKEN_METRIC,
    TOKEN_TYPE_KEY,
    UNKNOWN,
)
from telemill.functions import sql_text
from telemill.functions.names import metric_base_name
from telemill.functions.numbers import plain_double, saturating_bigint, unsigned_as_bigint
from telemill.session import prepare_session

_LOG_LISTS = ("resourceLogs", "scopeLogs", "logRecords")
_METRIC_LISTS = ("resourceMetrics", "scopeMetrics", "metrics")


def _document(lists: tuple[str, str, str], entry: str) -> str:
    """Type of a request with entries three lists deep."""
    outer, inner, leaf = lists
    return f"struct<{outer}:array<struct<{inner}:array<struct<{leaf}:array<{entry}>>>>>>"


# Whole numbers come as JSON numbers or as text, so they are read as text.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_RECORD = f"struct<timeUnixNano:string,body:struct<stringValue:string>,attributes:{_ATTRIBUTES}>"
_POINTS = f"struct<dataPoints:array<struct<asInt:string,asDouble:double,attributes:{_ATTRIBUTES}>>>"
_LOGS = _document(_LOG_LISTS, _RECORD)
_METRICS = _document(_METRIC_LISTS, f"struct<name:string,sum:{_POINTS},gauge:{_POINTS}>")

# The same with VARIANT where text or a list must stand.
_TYPED_LIST = "array<struct<key:variant,value:struct<stringValue:variant>>>"
_TYPED_POINTS = "struct<dataPoints:array<struct<attributes:variant>>>"
_TYPED_LOGS = _document(
    _LOG_LISTS, "struct<body:struct<stringValue:variant>,attributes:variant>"
)
_TYPED_METRICS = _document(
    _METRIC_LISTS, f"struct<name:variant,sum:{_TYPED_POINTS},gauge:{_TYPED_POINTS}>"
)

# Text that must be JSON text but may be something else, or a list given as null.
_SUSPECT = r"""\"(?:key|name|stringValue)\"\s*:\s*[^\"\sn]|\"attributes\"\s*:\s*null"""

_CORRUPT = "_corrupt"


def _from_json(wrapped: str, document: str) -> str:
    # JSON as the standard has it; Spark would read some more.
    options = f"""map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false',
      'columnNameOfCorruptRecord', '{_CORRUPT}')"""
    schema = f"struct<requests:array<{document}>,{_CORRUPT}:string>"
    return f"from_json({wrapped}, '{schema}', {options})"


def _parse(payloads: DataFrame, payload: str, document: str) -> DataFrame:
    """Add the parsed document as ``doc`` and whether the payload is one document as ``parsed``.

    The payload is read as the only element of an array: text behind the first
    document, which the parser would otherwise skip, then breaks the array. An
    empty payload is an empty request.
    """
    column = sql_text.name(payload)
    wrapped = F.concat(F.lit('{"requests":['), F.col(payload), F.lit("]}"))
    return (
        payloads.withColumn("_wrapped", wrapped)
        .withColumn("_json", F.expr(_from_json("_wrapped", document)))
        .withColumns(
            {
                "doc": F.expr("get(_json.requests, 0)"),
                "parsed": F.expr(f"_json.{_CORRUPT} IS NULL AND size(_json.requests) = 1"),
                "empty": F.expr(f"{column} = ''"),
                "suspect": F.col(payload).rlike(_SUSPECT),
            }
        )
        .drop("_json")
    )


def _right_types(document: str, right: str) -> str:
    """Whether a suspect payload has the right JSON types after all."""
    return f"(NOT suspect OR exists({_from_json('_wrapped', document)}.requests, doc -> {right}))"


def _is_text(leaf: str) -> str:
    return f"coalesce(schema_of_variant({leaf}) = 'STRING', false)"


def _absent_or_text(leaf: str) -> str:
    return f"coalesce(schema_of_variant({leaf}) IN ('STRING', 'VOID'), true)"


def _text_attributes(bag: str) -> str:
    """Whether a VARIANT is absent or a list of attributes with text where it must be."""
    return f"""({bag} IS NULL OR coalesce(
      forall(try_variant_get({bag}, '$', '{_TYPED_LIST}'), a ->
        {_is_text('a.key')} AND {_absent_or_text('a.value.stringValue')}), false))"""


def _signed(text: str) -> str:
    """Value of a whole number, NULL if the text is not one."""
    return f"if({text} RLIKE '^[+-]?[0-9]+\\\\z', try_cast({text} AS BIGINT), NULL)"


def _unsigned_wrapped(text: str) -> str:
    """Value of an unsigned 64-bit number; from 2^63 up it wraps to negative."""
    large = f"try_cast({text} AS DECIMAL(38, 0))"
    return f"""if({text} RLIKE '^[+]?[0-9]+\\\\z', coalesce(try_cast({text} AS BIGINT),
      if({large} < 18446744073709551616BD,
        CAST({large} - 18446744073709551616BD AS BIGINT), NULL)), NULL)"""


def _absent_or_signed(text: str) -> str:
    return f"({text} IS NULL OR {_signed(text)} IS NOT NULL)"


def _absent_or_finite(number: str) -> str:
    return f"({number} IS NULL OR abs({number}) < double('infinity'))"


def _complete_attributes(bag: str) -> str:
    """Whether an attribute list is absent or has a key and a readable value everywhere."""
    return f"""({bag} IS NULL OR forall({bag}, a ->
      a.key IS NOT NULL AND a.value IS NOT NULL AND {_absent_or_signed('a.value.intValue')}
      AND {_absent_or_finite('a.value.doubleValue')}))"""


def _first_text(attributes: str, key: str) -> str:
    """Text of the first attribute with a key; NULL if that one is not text."""
    wanted = sql_text.literal(key)
    return f"get(filter({attributes}, a -> a.key = {wanted}), 0).value.stringValue"


def _attribute_map(attributes: str) -> str:
    """Attributes with a usable value as a map of texts; the last of a repeated key wins."""
    number = plain_double("CAST(a.value.doubleValue AS STRING)")
    text = f"""coalesce(a.value.stringValue,
      CAST({_signed('a.value.intValue')} AS STRING),
      if(a.value.doubleValue IS NULL, NULL, {number}),
      CAST(a.value.boolValue AS STRING))"""
    pairs = f"transform(coalesce({attributes}, array()), a -> struct(a.key AS key, {text} AS value))"
    return f"map_from_entries(filter({pairs}, e -> e.value IS NOT NULL))"


def _unnest(lists: tuple[str, str, str]) -> str:
    """All entries of a request, through its resources and scopes."""
    outer, inner, leaf = lists
    return f"flatten(flatten(transform(doc.{outer}, r -> transform(r.{inner}, s -> s.{leaf}))))"


def _everywhere(lists: tuple[str, str, str], condition: str) -> str:
    """Whether the lists are all there and every entry ``x`` fulfils the condition."""
    outer, inner, leaf = lists
    return f"""coalesce(forall(doc.{outer}, r -> coalesce(forall(r.{inner}, s ->
      coalesce(forall(s.{leaf}, x -> x IS NOT NULL AND {condition}), false)), false)), false)"""


def _with_validity(parsed: DataFrame, complete: str, right_types: str) -> DataFrame:
    valid = f"empty OR (parsed AND {complete} AND {right_types})"
    return parsed.withColumn("valid", F.coalesce(F.expr(valid), F.lit(False)))


def _log_requests(payloads: DataFrame, payload: str) -> DataFrame:
    """Add the log records of each payload and whether it is valid."""
    complete = f"""(x.timeUnixNano IS NULL OR {_unsigned_wrapped('x.timeUnixNano')} IS NOT NULL)
      AND {_complete_attributes('x.attributes')}"""
    text = f"{_absent_or_text('x.body.stringValue')} AND {_text_attributes('x.attributes')}"
    return _with_validity(
        _parse(payloads, payload, _LOGS).withColumn("records", F.expr(_unnest(_LOG_LISTS))),
        _everywhere(_LOG_LISTS, complete),
        _right_types(_TYPED_LOGS, _everywhere(_LOG_LISTS, text)),
    )


def _metric_requests(payloads: DataFrame, payload: str) -> DataFrame:
    """Add the data points of each payload, with their metric's name, and whether it is valid."""

    def in_points(source: str, condition: str) -> str:
        return f"""(x.{source} IS NULL OR coalesce(forall(x.{source}.dataPoints, p ->
          {condition}), false))"""

    def in_both(condition: str) -> str:
        return f"{in_points('sum', condition)} AND {in_points('gauge', condition)}"

    point = f"""p IS NOT NULL AND {_absent_or_signed('p.asInt')} AND {_absent_or_finite('p.asDouble')}
      AND {_complete_attributes('p.attributes')}"""
    complete = f"x.name IS NOT NULL AND {in_both(point)}"
    text = f"{_is_text('x.name')} AND {in_both(_text_attributes('p.attributes'))}"
    # A sum is taken even if it is empty and a gauge stands beside it.
    points = f"""flatten(transform({_unnest(_METRIC_LISTS)}, m -> transform(
      coalesce(if(m.sum IS NULL, m.gauge.dataPoints, m.sum.dataPoints), array()),
      p -> struct(m.name AS name, p.asInt AS as_int, p.asDouble AS as_double,
        p.attributes AS attributes))))"""
    return _with_validity(
        _parse(payloads, payload, _METRICS).withColumn("records", F.expr(points)),
        _everywhere(_METRIC_LISTS, complete),
        _right_types(_TYPED_METRICS, _everywhere(_METRIC_LISTS, text)),
    )


def _rows(requests: DataFrame, payload: str, ingest_ts: str) -> DataFrame:
    """One row per record of valid payloads and one row, without record, per bad payload.

    A row's id is a hash of payload and place: equal on every run, with no
    numbering across tasks. It only breaks ties between equal times. The text
    is hashed before the unnesting, and goes through it for bad payloads only,
    or each record would carry a copy of its whole request.

    No filter may sink below the unnesting, where it would parse every payload
    once more: rows are told apart by having a record, not by ``valid``, and
    the unnested list is an expression, since Spark infers a filter on a column.
    """
    payload_column = F.col(payload)
    records = F.expr("CASE WHEN valid THEN records ELSE array(NULL) END")
    return (
        requests.select(
            F.xxhash64(payload_column).alias("request_key"),
            F.when(~F.col("valid"), payload_column).alias("payload"),
            F.col(ingest_ts).alias("ingest_ts"),
            "valid",
            "records",
        )
        .select("request_key", "payload", "ingest_ts", F.posexplode(records).alias("place", "record"))
        .withColumns(
            {"id": F.xxhash64("request_key", "place"), "valid": F.col("record").isNotNull()}
        )
    )


PROFILES = ("json", "proto")


def _check_profile(profile: str) -> None:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")


def log_rows(
    payloads: DataFrame,
    payload: str = "payload",
    ingest_ts: str = "ingest_ts",
    profile: str = "json",
) -> DataFrame:
    """Log events and bad payloads in one frame, told apart by ``valid``.

    A record without time gets its arrival time; in the ``proto`` profile, for
    payloads that were protobuf once, a time of 0 means the same.
    """
    _check_profile(profile)
    prepare_session(payloads.sparkSession)
    rows = _rows(_log_requests(payloads, payload), payload, ingest_ts)
    nanos = _unsigned_wrapped("record.timeUnixNano")
    rows = rows.withColumn("nanos", F.expr(f"nullif({nanos}, 0)" if profile == "proto" else nanos))
    # Whole microseconds downwards, also before 1970.
    moment = F.expr("timestamp_micros(nanos DIV 1000 - if(nanos % 1000 < 0, 1, 0))")
    return rows.select(
        "id",
        F.coalesce(moment, F.col("ingest_ts")).alias("timestamp"),
        F.expr(_first_text("record.attributes", EVENT_NAME_KEY)).alias("event_name"),
        F.col("record.body.stringValue").alias("body"),
        F.expr(_attribute_map("record.attributes")).alias("attributes"),
        "valid",
        "payload",
    )


def metric_rows(
    payloads: DataFrame, payload: str = "payload", ingest_ts: str = "ingest_ts"
) -> DataFrame:
    """Metric points and bad payloads in one frame; points carry their arrival time."""
    prepare_session(payloads.sparkSession)
    rows = _rows(_metric_requests(payloads, payload), payload, ingest_ts)
    return rows.select(
        "id",
        F.col("ingest_ts").alias("timestamp"),
        "record.name",
        F.expr(_signed("record.as_int")).alias("as_int"),
        "record.as_double",
        F.expr(_first_text("record.attributes", TOKEN_TYPE_KEY)).alias("type"),
        "valid",
        "payload",
    )


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = rows.filter("valid").drop("valid", "payload")
    return good, rows.filter("NOT valid").select("timestamp", "payload")


def parse_logs(
    payloads: DataFrame,
    payload: str = "payload",
    ingest_ts: str = "ingest_ts",
    profile: str = "json",
) -> tuple[DataFrame, DataFrame]:
    """Log events, and the payloads that could not be read."""
    return _split(log_rows(payloads, payload, ingest_ts, profile))


def parse_metrics(
    payloads: DataFrame, payload: str = "payload", ingest_ts: str = "ingest_ts"
) -> tuple[DataFrame, DataFrame]:
    """Metric points, and the payloads that could not be read."""
    return _split(metric_rows(payloads, payload, ingest_ts))


def routed_points(points: DataFrame, profile: str = "json") -> DataFrame:
    """Points with the table they belong to and that table's columns; others are dropped.

    The ``json`` profile reads tokens and session values from whole numbers
    only and cost from doubles only, and knows the session metrics by name.
    The ``proto`` profile takes either kind of number and any other metric
    with the agent's prefix.
    """
    _check_profile(profile)
    name, as_int, as_double = F.col("name"), F.col("as_int"), F.col("as_double")
    if profile == "json":
        is_session = name.isin(*SESSION_METRICS)
        count = value = as_int
        cost = as_double
    else:
        is_session = name.startswith(SESSION_METRIC_PREFIX) & ~name.isin(TOKEN_METRIC, COST_METRIC)
        count = F.coalesce(as_int, unsigned_as_bigint(as_double))
        value = F.coalesce(as_int, saturating_bigint(as_double))
        cost = F.coalesce(as_double, as_int.cast("double"))
    table = (
        F.when(name == TOKEN_METRIC, "token_usage")
        .when(name == COST_METRIC, "cost_usage")
        .when(is_session, "session_metrics")
    )
    if "valid" in points.columns:  # bad payloads travel along to their own table
        table = F.when(F.col("valid"), table).otherwise("bad_metric_payloads")
    none = F.lit(0).cast("bigint")
    return (
        points.withColumn("table", table)
        .filter(F.col("table").isNotNull())
        .select(
            *[c for c in ("id", "timestamp", "payload") if c in points.columns],
            "table",
            F.coalesce("type", F.lit(UNKNOWN)).alias("token_type"),
            F.coalesce(count, none).alias("count"),
            F.coalesce(cost, F.lit(0.0)).alias("cost_usd"),
            metric_base_name(name).alias("metric_name"),
            F.coalesce(value, none).alias("value"),
        )
    )


def route_metrics(
    points: DataFrame, profile: str = "json"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Token, cost and session rows of the points."""
    routed = routed_points(points, profile)

    def rows(table: str, *columns: str) -> DataFrame:
        return routed.filter(F.col("table") == table).select("id", "timestamp", *columns)

    return (
        rows("token_usage", "token_type", "count"),
        rows("cost_usage", "cost_usd"),
        rows("session_metrics", "metric_name", "value"),
    )
