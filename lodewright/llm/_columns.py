"""Keeps a table's other columns out of the way of an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the used ones renamed to what no operator uses, and the way back to its columns."""
    names = [c if c in used else f"other column {i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*(f"`{c}`" for c in names)).toDF(*docs.columns)
