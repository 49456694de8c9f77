"""Predicates over entries by tag and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .keys import keyed


def is_named_type() -> Column:
    return F.col("tag").isin(S.NAMED_TERMINAL) & F.col("name").isNotNull()


def is_forward_declarable() -> Column:
    return F.col("tag").isin(S.FORWARD_DECLARABLE) & F.col("name").isNotNull()


def is_type_qualifier() -> Column:
    return F.col("tag").isin(S.QUALIFIERS)


def is_primitive() -> Column:
    return F.coalesce((F.col("tag") == S.BASE) & F.col("name").isin(S.PRIMITIVES), F.lit(False))


def is_searchable() -> Column:
    return F.col("tag").isin(S.SEARCHABLE)


def requires_resolution() -> Column:
    return is_forward_declarable()


def is_simple(byte_size: Column, members: Column) -> Column:
    return (byte_size <= 64) & (members <= 10)


def looked_up(key: Column, table: dict[str, str], default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def category(key: Column) -> Column:
    return looked_up(key, S.CATEGORY, F.lit("other"))


def readable(key: Column) -> Column:
    return looked_up(key, S.READABLE, key)


def tags_of(categories: dict[str, list[str]], key: str) -> list[str]:
    """The tags of a category or legacy type name; none if it is not known."""
    return sorted(categories.get(key, []))


def is_namespace() -> Column:
    """P8."""
    return F.col("tag") == S.NAMESPACE


def type_name_at(offsets: DataFrame, dies: DataFrame) -> DataFrame:
    """offsets(die_offset, ..) with type_name, the name of a named type's entry (P5), null of any other or missing one."""
    by = [c for c in keyed(dies, "die_offset") if c in offsets.columns]
    return offsets.join(dies.where(is_named_type()).select(*by, F.col("name").alias("type_name")), by, "left")


def cache_key(tag: Column) -> Column:
    """The key under which a kind of entry is kept: the tag itself."""
    return tag


def classified(dies: DataFrame) -> DataFrame:
    """die_offset with each predicate's value."""
    return dies.select(
        *keyed(dies, "die_offset"),
        is_named_type().alias("named"),
        is_forward_declarable().alias("declarable"),
        is_type_qualifier().alias("qualifier"),
        is_primitive().alias("primitive"),
        is_searchable().alias("searchable"),
        F.when(is_named_type(), F.col("name")).alias("type_name"),
        category(F.col("tag")).alias("category"),
        readable(F.col("tag")).alias("readable"),
    )


def resolvable(offsets: DataFrame, dies: DataFrame) -> DataFrame:
    """The rows of offsets(die_offset, ..) whose entry exists and needs resolution."""
    by = [c for c in keyed(dies, "die_offset") if c in offsets.columns]
    return offsets.join(dies.where(requires_resolution()).select(*by), by, "left_semi")


def outer_names(rows: DataFrame, column: str = "name") -> DataFrame:
    """Without the names that stand for unnamed types."""
    return rows.where(~F.col(column).isin(S.INTERNAL_NAMES))
