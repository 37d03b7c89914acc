"""Reading numbers out of attribute text, and printing them as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column) -> Column:
    """Integer value of a text, NULL when it is not one."""
    return text.try_cast("bigint")


def real_number(text: Column) -> Column:
    """Double value of a text, NULL when it is not one.

    Java also reads a type letter behind the digits (``1.5f``); telemetry
    does not, so those count as bad text, as do digits that no double holds
    (``1e400``).
    """
    number = text.try_cast("double")
    too_large = text.rlike("[0-9]") & (F.abs(number) == float("inf"))
    return F.when(~text.rlike(r"[0-9.]\s*[dDfF]\s*$") & ~too_large, number)


def plain_double(text: str) -> str:
    """SQL for a double's text without exponent and point zero: 3.0 -> 3, 1.0E-7 -> 0.0000001.

    ``text`` is the expression of the double cast to string. Digits stay as
    they are; only the point moves.
    """
    sign = f"if(startswith({text}, '-'), '-', '')"
    mantissa = f"regexp_extract({text}, '^-?([0-9]+[.][0-9]+)', 1)"
    digits = f"regexp_replace(regexp_replace({mantissa}, '[.]', ''), '(?<=[0-9])0+$', '')"
    exponent = f"CAST(substring_index({text}, 'E', -1) AS INT)"
    small = f"concat('0.', repeat('0', -{exponent} - 1), {digits})"
    # The mantissa has one digit before the point, so the number has exponent + 1.
    large = f"""if(length({digits}) <= {exponent} + 1,
      rpad({digits}, {exponent} + 1, '0'),
      concat(left({digits}, {exponent} + 1), '.', substring({digits}, {exponent} + 2)))"""
    return f"""CASE WHEN NOT contains({text}, 'E') THEN regexp_replace({text}, '[.]0$', '')
      WHEN {exponent} < 0 THEN concat({sign}, {small}) ELSE concat({sign}, {large}) END"""


def saturating_bigint(number: Column) -> Column:
    """Double truncated to a signed 64-bit integer, clamped at the ends, NaN as 0."""
    return (
        F.when(F.isnan(number), F.lit(0).cast("bigint"))
        .when(number >= F.lit(2.0**63), F.lit(2**63 - 1))
        .when(number < F.lit(-(2.0**63)), F.expr("-9223372036854775807L - 1L"))
        .otherwise(number.try_cast("bigint"))
    )


def unsigned_as_bigint(number: Column) -> Column:
    """Double clamped to an unsigned 64-bit integer, then kept in signed storage.

    Negative and NaN become 0; values from 2^63 up wrap, as signed storage
    of an unsigned count does.
    """
    return (
        F.when(F.isnan(number) | (number <= 0), F.lit(0).cast("bigint"))
        .when(number >= F.lit(2.0**64), F.lit(-1).cast("bigint"))
        .when(number >= F.lit(2.0**63), (number - F.lit(2.0**64)).try_cast("bigint"))
        .otherwise(number.try_cast("bigint"))
    )
