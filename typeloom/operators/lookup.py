"""Entries by offset, unit, parent and reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import keyed

#: Widest unit (bytes) that falls into so many cells of the grid by which offsets meet units.
GRID = 1 << 16


def by_offset(offsets: DataFrame, dies: DataFrame) -> DataFrame:
    """offsets(die_offset, ..) with their entries; missing ones drop out."""
    return offsets.join(dies, [c for c in keyed(dies, "die_offset") if c in offsets.columns])


def units_of(offsets: DataFrame, units: DataFrame, grid: int = GRID) -> DataFrame:
    """offsets(die_offset, ..) with the unit cu_offset <= offset < cu_end that holds them.

    An interval join as an equi-join: a unit is listed in each grid cell that it touches, an offset in its own, so
    both sides are dealt by cell and no pair of all offsets and units is formed."""
    by = [c for c in keyed(units) if c in offsets.columns]
    cells = units.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("cu_offset") / grid), F.floor((F.col("cu_end") - 1) / grid))))
    met = offsets.withColumn("_cell", F.floor(F.col("die_offset") / grid)).join(cells.select(*by, "_cell", "cu_offset", "cu_end"), [*by, "_cell"])
    return met.where((F.col("die_offset") >= F.col("cu_offset")) & (F.col("die_offset") < F.col("cu_end"))).drop("_cell", "cu_end")


def children(dies: DataFrame, parents: DataFrame) -> DataFrame:
    """All entries whose parent is in parents(die_offset), with their place among their siblings' offsets."""
    by = [c for c in keyed(dies) if c in parents.columns]
    return dies.join(parents.select(*by, F.col("die_offset").alias("parent_offset")).distinct(), [*by, "parent_offset"], "left_semi")


def dereferenced(dies: DataFrame, edge: str = "type_ref") -> DataFrame:
    """die_offset, target, target_tag, target_name along one kind of reference. Entries without it take no part in the
    join; a target that a third of all entries refer to is met by AQE's splitting of skewed partitions."""
    target = dies.select(*keyed(dies), F.col("die_offset").alias("target"), F.col("tag").alias("target_tag"), F.col("name").alias("target_name"))
    return dies.where(F.col(edge).isNotNull()).select(*keyed(dies, "die_offset"), F.col(edge).alias("target")).join(target, keyed(dies, "target")).select(*keyed(dies, "die_offset"), "target", "target_tag", "target_name")


def parents(dies: DataFrame) -> DataFrame:
    """die_offset, parent_offset, parent_tag, parent_name."""
    up = dies.select(*keyed(dies), F.col("die_offset").alias("parent_offset"), F.col("tag").alias("parent_tag"), F.col("name").alias("parent_name"))
    return dies.where("parent_offset is not null").select(*keyed(dies, "die_offset", "parent_offset")).join(up, keyed(dies, "parent_offset")).select(*keyed(dies, "die_offset"), "parent_offset", "parent_tag", "parent_name")


def declaration_files(dies: DataFrame, files: DataFrame) -> DataFrame:
    """die_offset, decl_file of each entry with a file index; null where the unit's table has no such entry."""
    by = [c for c in keyed(files, "cu_offset") if c in dies.columns]
    keys = files.select(*by, F.col("file_idx").alias("decl_file_idx"), F.col("file_name").alias("decl_file"))
    return dies.where("decl_file_idx is not null").select(*keyed(dies, "die_offset", "cu_offset", "decl_file_idx")).join(keys, [*by, "decl_file_idx"], "left").select(*keyed(dies, "die_offset"), "decl_file")
