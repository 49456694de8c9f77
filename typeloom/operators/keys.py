"""The key of entries. Offsets count within one binary, and a table may hold several: source_id stands beside every offset
and name in joins, groups and windows, wherever the table has it."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keyed(rows: DataFrame, *columns: str) -> list[str]:
    """source_id, if rows have it, and the columns."""
    return [*(["source_id"] if "source_id" in rows.columns else []), *columns]
