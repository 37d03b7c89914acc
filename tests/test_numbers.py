from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import numbers

PLAIN = [
    (0.0, "0"),
    (-0.0, "-0"),
    (3.0, "3"),
    (-2.5, "-2.5"),
    (0.1, "0.1"),
    (0.001, "0.001"),
    (0.0001, "0.0001"),
    (1e-7, "0.0000001"),
    (-1.25e-9, "-0.00000000125"),
    (12345678.0, "12345678"),
    (12345678.5, "12345678.5"),
    (1.5e10, "15000000000"),
    (-123456789.125, "-123456789.125"),
    (1e21, "1000000000000000000000"),
    (1.2345e22, "12345000000000000000000"),
]


def test_plain_double(spark):
    frame = spark.createDataFrame([(value,) for value, _ in PLAIN], "v double")
    text = F.expr(numbers.plain_double("cast(v as string)"))
    found = [row[0] for row in frame.select(text).collect()]
    assert found == [shown for _, shown in PLAIN]


def test_numbers_in_text(spark):
    texts = ["50", " 7 ", "-3", "abc", "12.7", "1e3", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = [r[0] for r in frame.select(numbers.whole_number(F.col("t"))).collect()]
    assert whole == [50, 7, -3, None, None, None, None, None]
    real = [r[0] for r in frame.select(numbers.real_number(F.col("t"))).collect()]
    assert real == [50.0, 7.0, -3.0, None, 12.7, 1000.0, None, None]
    suffixed = spark.createDataFrame([("1.5f",), ("2d",), ("3D ",)], "t string")
    assert [r[0] for r in suffixed.select(numbers.real_number(F.col("t"))).collect()] == [None] * 3


def test_doubles_into_counters(spark):
    values = [2.9, -2.9, float("nan"), 1e30, -1e30, 2.0**63]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    signed = [r[0] for r in frame.select(numbers.saturating_bigint(F.col("v"))).collect()]
    top, bottom = 2**63 - 1, -(2**63)
    assert signed == [2, -2, 0, top, bottom, top]
    unsigned = [r[0] for r in frame.select(numbers.unsigned_as_bigint(F.col("v"))).collect()]
    assert unsigned == [2, 0, 0, -1, 0, bottom]
