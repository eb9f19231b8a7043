"""Helpers for analyses written as SQL expressions (``selectExpr``): a wide
aggregate of hundreds of expressions is then one call, parsed in the JVM,
instead of thousands of Python-side Column constructions."""

from __future__ import annotations


def ident(name: str) -> str:
    """Backtick-quoted column name."""
    return "`" + name.replace("`", "``") + "`"


def string(text: str) -> str:
    """Single-quoted SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stack(rows: list[list[str]], names: list[str]) -> str:
    """``stack(n, ...) AS (names)``: one output row per inner list."""
    body = ", ".join(", ".join(r) for r in rows)
    return f"stack({len(rows)}, {body}) AS ({', '.join(names)})"
