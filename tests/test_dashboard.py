from __future__ import annotations

import pytest

from telemill import schema
from telemill.operators import api, tools, usage
from telemill.plans import fixture
from telemill.plans.dashboard import dashboard
from telemill.plans.registry import Telemetry
from telemill.sources import tables
from tests.helpers import START

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    base = fixture.base_events(spark, SF)
    for name, build in fixture.TABLES.items():
        rows = build(base).select(*schema.TABLES[name].fieldNames())
        tables.append(rows, root, name, "one")
    return root


@pytest.mark.parametrize("range_name", ["all_time", "last_week"])
def test_reports_of_a_range(spark, root, range_name):
    t = Telemetry(spark, SF)
    since = None if range_name == "all_time" else fixture.AS_OF.replace(day=24)
    shown = dashboard(spark, root, fixture.AS_OF, range_name)
    metrics = tools.tool_metrics(t.calls(range_name))
    columns = metrics.columns
    assert shown["tools"].select(*columns).exceptAll(metrics).count() == 0
    calls = [row.call_count for row in shown["tools"].collect()]
    assert calls == sorted(calls, reverse=True)
    assert shown["tool_totals"].first().total_calls == sum(calls)
    session = usage.productivity(usage.session_metrics(t.session_metrics, since))
    assert shown["session"].first() == session.first()
    tokens, expected = shown["tokens"].first(), usage.token_totals(t.token_usage, t.cost_usage, since).first()
    assert tokens.total_tokens == expected.total_tokens
    assert tokens.total_cost_usd == pytest.approx(expected.total_cost_usd)
    assert shown["api"].first() == api.api_totals(t.log_events, since).first()
    assert shown["models"].count() == 3
    assert shown["agents"].count() == 4


def test_last_error_only_for_tools_with_errors_in_the_range(spark, root):
    rows = dashboard(spark, root, fixture.AS_OF, "last_week")["last_errors"].collect()
    assert rows and all((row.last_error is None) or row.error_count > 0 for row in rows)


def test_without_tables(spark, tmp_path):
    shown = dashboard(spark, str(tmp_path / "none"), START, "last_hour")
    assert shown["tools"].count() == 0
    assert shown["tokens"].first().total_tokens == 0
    assert shown["session"].first().lines_per_hour is None
    assert shown["api"].first().total_calls == 0
    assert shown["agents"].count() == 0
