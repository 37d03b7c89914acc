"""Percentages and health bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.fixed_values import APPROVAL_BANDS, CACHE_REUSE_BANDS, SUCCESS_BANDS


def percent(part: Column, whole: Column, when_none: float) -> Column:
    """``100 * part / whole``, or ``when_none`` if there is nothing to divide by."""
    return F.when(whole == 0, F.lit(when_none)).otherwise(part.cast("double") / whole * 100.0)


def approval_rate(approved: Column, rejected: Column) -> Column:
    return percent(approved, approved + rejected, 100.0)


def success_rate(succeeded: Column, calls: Column) -> Column:
    return percent(succeeded, calls, 100.0)


def cache_reuse_rate(cache_read: Column, fresh_input: Column) -> Column:
    return percent(cache_read, fresh_input + cache_read, 0.0)


def _band(good: Column, warn: Column) -> Column:
    return F.when(good, F.lit("good")).when(warn, F.lit("warn")).otherwise(F.lit("bad"))


def approval_band(rate: Column) -> Column:
    warn, good = APPROVAL_BANDS
    return _band(rate >= good, rate >= warn)


def success_band(rate: Column) -> Column:
    warn, good = SUCCESS_BANDS
    return _band(rate > good, rate > warn)


def cache_reuse_band(rate: Column) -> Column:
    warn, good = CACHE_REUSE_BANDS
    return _band(rate > good, rate > warn)


def error_band(errors: Column) -> Column:
    return F.when(errors > 0, F.lit("bad")).otherwise(F.lit("good"))
