"""Tokens, cost and session productivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, SESSION_COLUMNS, TOKEN_CLASSES, Agent
from telemill.functions import rates
from telemill.functions.attributes import since_filter
from telemill.sources.agents import token_type_dim


def tokens_by_type(tokens: DataFrame, since: datetime | None = None) -> DataFrame:
    """Tokens per type as the agents name it."""
    return since_filter(tokens, since).groupBy("token_type").agg(F.sum("count").alias("tokens"))


def tokens_by_class(
    tokens: DataFrame, since: datetime | None = None, agents: Sequence[Agent] = AGENTS
) -> DataFrame:
    """Tokens per class; types of no class are left out."""
    dim = token_type_dim(tokens.sparkSession, agents)
    return (
        tokens_by_type(tokens, since)
        .join(dim, "token_type")
        .groupBy("token_class")
        .agg(F.sum("tokens").alias("tokens"))
    )


def unmatched_tokens(
    tokens: DataFrame, since: datetime | None = None, agents: Sequence[Agent] = AGENTS
) -> DataFrame:
    """Tokens of the types that belong to no class."""
    dim = token_type_dim(tokens.sparkSession, agents)
    return tokens_by_type(tokens, since).join(dim, "token_type", "left_anti")


def token_totals(
    tokens: DataFrame,
    costs: DataFrame,
    since: datetime | None = None,
    agents: Sequence[Agent] = AGENTS,
) -> DataFrame:
    """Tokens of each class, cost, and cache reuse: one row, also without data.

    Both tables go through one aggregation by token type (cost has none)
    before the small join with the classes.
    """
    token_rows = since_filter(tokens, since).select(
        "token_type", "count", F.lit(None).cast("double").alias("cost_usd")
    )
    cost_rows = since_filter(costs, since).select(
        F.lit(None).cast("string").alias("token_type"),
        F.lit(None).cast("bigint").alias("count"),
        "cost_usd",
    )
    sums = (
        token_rows.unionByName(cost_rows)
        .groupBy("token_type")
        .agg(F.sum("count").alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
        .join(token_type_dim(tokens.sparkSession, agents), "token_type", "left")
    )

    def of_class(name: str):
        tokens_of_class = F.sum(F.when(F.col("token_class") == name, F.col("tokens")))
        return F.coalesce(tokens_of_class, F.lit(0)).alias(f"{name}_tokens")

    totals = sums.agg(
        *[of_class(name) for name in TOKEN_CLASSES],
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )
    total = sum((F.col(f"{name}_tokens") for name in TOKEN_CLASSES), F.lit(0))
    return totals.withColumns(
        {
            "total_tokens": total,
            "cache_reuse_rate": rates.cache_reuse_rate(
                F.col("cache_read_tokens"), F.col("input_tokens")
            ),
        }
    ).withColumn("cache_reuse_band", rates.cache_reuse_band(F.col("cache_reuse_rate")))


def classified_totals(tokens: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Tokens of each class and in all: one row, of one aggregation, so that a stream can make it."""
    classed = tokens.join(token_type_dim(tokens.sparkSession, agents), "token_type", "left")

    def of_class(*names: str):
        wanted = F.col("token_class").isin(*names)
        return F.coalesce(F.sum(F.when(wanted, F.col("count"))), F.lit(0))

    return classed.agg(
        *[of_class(name).alias(f"{name}_tokens") for name in TOKEN_CLASSES],
        of_class(*TOKEN_CLASSES).alias("total_tokens"),
    )


def cost_total(costs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Cost in all, 0 without rows."""
    return since_filter(costs, since).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd")
    )


def session_by_name(metrics: DataFrame, since: datetime | None = None) -> DataFrame:
    """Signed sum per session metric."""
    return since_filter(metrics, since).groupBy("metric_name").agg(F.sum("value").alias("total"))


def session_metrics(
    metrics: DataFrame,
    since: datetime | None = None,
    extra_names: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Lines of code, commits and active seconds: one row, 0 where nothing was sent.

    Each column takes the sum of the first of its names that is present.
    ``extra_names`` adds names, such as ``{"commit_count": ["commit"]}``.
    """
    by_name = session_by_name(metrics, since)

    def report_column(column: str, known: Sequence[str]):
        accepted = (*known, *(extra_names or {}).get(column, ()))
        sums = [F.max(F.when(F.col("metric_name") == name, F.col("total"))) for name in accepted]
        return F.coalesce(*sums, F.lit(0)).alias(column)

    return by_name.agg(*[report_column(column, known) for column, known in SESSION_COLUMNS.items()])


def session_totals(metrics: DataFrame) -> DataFrame:
    """The row of ``session_metrics`` over all rows, of one aggregation, so that a stream can make it."""

    def sum_of(name: str):
        return F.sum(F.when(F.col("metric_name") == name, F.col("value")))

    return metrics.agg(
        *[F.coalesce(*map(sum_of, known), F.lit(0)).alias(column) for column, known in SESSION_COLUMNS.items()]
    )


def productivity(session: DataFrame) -> DataFrame:
    """Lines changed per active hour, NULL without active time."""
    hours = F.col("active_time_secs") / 3600.0
    return session.withColumn(
        "lines_per_hour",
        F.when(F.col("active_time_secs") != 0, F.abs("lines_of_code") / hours),
    )
