"""SQL text for long CASE chains: one parsed expression instead of a call per part."""

from __future__ import annotations

from collections.abc import Iterable


def literal(value: str | int | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def first_match(cases: Iterable[tuple[str, str]]) -> str:
    """CASE giving the result of the first condition that holds, NULL if none does."""
    whens = " ".join(f"WHEN {condition} THEN {result}" for condition, result in cases)
    return f"CASE {whens} END" if whens else "CAST(NULL AS STRING)"
