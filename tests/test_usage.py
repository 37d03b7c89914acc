from __future__ import annotations

import pytest

from telemill.operators import usage
from tests.helpers import at, by, table


def tokens(spark, *rows):
    return table(spark, "token_usage", *rows)


def costs(spark, *rows):
    return table(spark, "cost_usage", *rows)


def sessions(spark, *rows):
    return table(spark, "session_metrics", *rows)


def test_token_totals(spark):
    row = usage.token_totals(
        tokens(spark, ("input", 1000), ("output", 500), ("cacheRead", 2000), ("cacheCreation", 100)),
        costs(spark, (0.05,), (0.03,)),
    ).first()
    assert (row.input_tokens, row.output_tokens) == (1000, 500)
    assert (row.cache_read_tokens, row.cache_write_tokens) == (2000, 100)
    assert row.total_tokens == 3600
    assert row.total_cost_usd == pytest.approx(0.08)


def test_aliases_add_up_and_unknown_types_are_left_out(spark):
    frame = tokens(
        spark,
        ("input", 1),
        ("prompt", 2),
        ("prompt_tokens", 4),
        ("input_tokens", 8),
        ("thought", 100),
        ("tool", 200),
        ("Input", 400),
    )
    row = usage.token_totals(frame, costs(spark)).first()
    assert (row.input_tokens, row.total_tokens) == (15, 15)
    assert {t: r.tokens for t, r in by(usage.unmatched_tokens(frame), "token_type").items()} == {
        "thought": 100,
        "tool": 200,
        "Input": 400,
    }
    assert by(usage.tokens_by_class(frame), "token_class")["input"].tokens == 15


def test_cache_reuse(spark):
    row = usage.token_totals(
        tokens(spark, ("input", 1000), ("cacheRead", 4000)), costs(spark)
    ).first()
    assert (row.cache_reuse_rate, row.cache_reuse_band) == (80.0, "warn")


def test_no_rows_give_zeros(spark):
    row = usage.token_totals(tokens(spark), costs(spark)).first()
    assert (row.input_tokens, row.total_tokens, row.total_cost_usd) == (0, 0, 0.0)
    assert (row.cache_reuse_rate, row.cache_reuse_band) == (0.0, "bad")
    assert usage.cost_total(costs(spark)).first().total_cost_usd == 0.0
    row = usage.session_metrics(sessions(spark)).first()
    assert (row.lines_of_code, row.commit_count, row.active_time_secs) == (0, 0, 0)


def test_time_range(spark):
    frame = tokens(spark, ("input", 1), ("input", 2), ("input", 4))
    money = costs(spark, (1.0,), (2.0,), (4.0,))
    row = usage.token_totals(frame, money, since=at(1)).first()
    assert (row.input_tokens, row.total_cost_usd) == (6, 6.0)
    assert usage.cost_total(money, since=at(2)).first().total_cost_usd == 4.0


def test_session_sums(spark):
    frame = sessions(
        spark,
        ("lines_of_code", 150),
        ("lines_of_code", -30),
        ("commits", 2),
        ("commits", 1),
        ("active_time", 3600),
        ("pull_request", 9),
    )
    row = usage.session_metrics(frame).first()
    assert (row.lines_of_code, row.commit_count, row.active_time_secs) == (120, 3, 3600)


def test_first_known_name_wins(spark):
    frame = sessions(spark, ("loc", 5), ("lines_of_code", 7), ("commit", 3))
    row = usage.session_metrics(frame).first()
    assert (row.lines_of_code, row.commit_count) == (7, 0)
    row = usage.session_metrics(frame, extra_names={"commit_count": ["commit"]}).first()
    assert row.commit_count == 3
    assert usage.session_metrics(sessions(spark, ("loc", 5))).first().lines_of_code == 5


def test_productivity(spark):
    frame = sessions(spark, ("lines_of_code", -150), ("active_time", 7200))
    assert usage.productivity(usage.session_metrics(frame)).first().lines_per_hour == 75.0
    idle = usage.productivity(usage.session_metrics(sessions(spark))).first()
    assert idle.lines_per_hour is None
