"""API calls, latency and errors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, TOP_MODELS, Agent
from telemill.functions import attributes as A
from telemill.functions.names import with_model_names
from telemill.operators.partials import api_partials


def api_requests(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """API requests with model and latency."""
    requests = A.since_filter(logs, since).filter(A.is_family(logs, "api_request"))
    return requests.select(
        "id",
        "timestamp",
        A.attribute(requests, "model").alias("model"),
        A.latency_ms(requests).alias("latency_ms"),
        A.bad_latency(requests).alias("bad_latency"),
    )


def api_by_model(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Calls and mean latency per model; calls naming no model are a group of their own."""
    return (
        api_requests(logs, since)
        .groupBy("model")
        .agg(
            F.count("*").alias("calls"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.count_if(F.col("bad_latency")).alias("bad_latency_count"),
        )
    )


def calls_per_model(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Calls of each named model."""
    return api_by_model(logs, since).filter(F.col("model").isNotNull()).select("model", "calls")


def api_totals(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Calls, errors and mean latency in one pass: one row, 0 without events."""
    request = A.is_family(logs, "api_request")
    error = A.is_family(logs, "api_error")
    events = A.since_filter(logs, since).filter(request | error)
    return events.agg(
        F.count_if(request).alias("total_calls"),
        F.count_if(error).alias("total_errors"),
        F.coalesce(F.avg(F.when(request, A.latency_ms(events))), F.lit(0.0)).alias("avg_latency_ms"),
    )


def model_report(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Calls, errors, latency and first call per model, as partials that every API report is made of."""
    request = A.is_family(logs, "api_request")
    return api_partials(
        A.since_filter(logs, since), None, F.min(F.when(request, F.col("timestamp"))).alias("first_seen")
    )


def top_models(
    logs: DataFrame,
    since: datetime | None = None,
    n: int = TOP_MODELS,
    agents: Sequence[Agent] = AGENTS,
) -> DataFrame:
    """The models called most, with their short names."""
    return most_called(calls_per_model(logs, since), n, agents)


def most_called(models: DataFrame, n: int = TOP_MODELS, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """The first rows of a report of models by calls, with their short names."""
    first = models.select("model", "calls").orderBy(F.desc("calls"), F.asc("model")).limit(n)
    return with_model_names(first, agents).select("model", "short_model", "calls")


def usage_by_short_model(
    logs: DataFrame, since: datetime | None = None, agents: Sequence[Agent] = AGENTS
) -> DataFrame:
    """Calls and mean latency per short model name."""
    named = with_model_names(
        api_by_model(logs, since).filter(F.col("model").isNotNull()), agents
    )
    return named.groupBy("short_model", "agent").agg(
        F.count("*").alias("models"),
        F.sum("calls").alias("calls"),
        (F.sum(F.col("avg_latency_ms") * F.col("calls")) / F.sum("calls")).alias("avg_latency_ms"),
    )
