"""The index from names to definitions, its checks and statistics, set at a time over all units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .keys import keyed


def symbol_index(dies: DataFrame, tags: list[str] = S.SEARCHABLE) -> DataFrame:
    """C4: symbol, die_offset, cu_offset, tag of the best entry of each name (of each binary): complete ones (with a size or
    children) before declarations, then the first by unit and offset. The least combines in the map tasks, so a name that a
    third of all entries share is one row of each task."""
    return ranked(dies, tags).select(*keyed(dies, "symbol"), "b.die_offset", "b.cu_offset", "b.tag")


def ranked(dies: DataFrame, tags: list[str] = S.SEARCHABLE) -> DataFrame:
    """symbol, b: the best entry of each name with what it is compared by (partial, cu_offset, die_offset, tag)."""
    complete = F.coalesce(F.col("byte_size") > 0, F.lit(False)) | F.coalesce(F.col("has_children"), F.lit(False))
    rows = dies.where(F.col("tag").isin(tags) & F.col("name").isNotNull())
    return rows.groupBy(*keyed(dies), F.col("name").alias("symbol")).agg(F.min(F.struct((~complete).alias("partial"), F.col("cu_offset"), F.col("die_offset"), F.col("tag"))).alias("b"))


def definitions(dies: DataFrame) -> DataFrame:
    """The definition of each name among definable entries."""
    return symbol_index(dies, S.DEFINABLE)


def find(symbols: DataFrame, index: DataFrame) -> DataFrame:
    """symbols(symbol, ..) with what the index has of them, null where it has nothing. A symbol that is
    asked for without a source_id is found in each binary that has it."""
    return symbols.join(index, [c for c in keyed(index, "symbol") if c in symbols.columns], "left")


def targeted_search(symbols: DataFrame, dies: DataFrame) -> DataFrame:
    """Symbol, die_offset of the first entry by name (in each binary), the hinted unit of symbols(symbol, hint)
    before others."""
    rows = dies.where(F.col("tag").isin(S.SEARCHABLE)).select(*keyed(dies), F.col("name").alias("symbol"), "cu_offset", "die_offset")
    met = symbols.join(rows, [c for c in keyed(dies, "symbol") if c in symbols.columns])
    first = F.struct((~F.coalesce(F.col("cu_offset") == F.col("hint"), F.lit(False))).alias("other"), "cu_offset", "die_offset")
    return met.groupBy(*keyed(met, "symbol")).agg(F.min(first).alias("b")).select(*keyed(met, "symbol"), F.col("b.die_offset").alias("die_offset"))


def discovered(dies: DataFrame) -> DataFrame:
    """C4: cu_offset, n: how many named searchable entries each unit has."""
    return dies.where(F.col("tag").isin(S.SEARCHABLE) & F.col("name").isNotNull()).groupBy(*keyed(dies, "cu_offset")).agg(F.count("*").alias("n"))


def first_writer(pairs: DataFrame) -> DataFrame:
    """Symbol, die_offset of pairs(symbol, die_offset, seq): the first stays."""
    return pairs.groupBy(*keyed(pairs, "symbol")).agg(F.min_by("die_offset", F.struct("seq", "die_offset")).alias("die_offset"))


def last_writer(pairs: DataFrame) -> DataFrame:
    """Symbol, cu_offset of pairs(symbol, cu_offset, seq): the last stays."""
    return pairs.groupBy(*keyed(pairs, "symbol")).agg(F.max_by("cu_offset", F.struct("seq", "cu_offset")).alias("cu_offset"))


def unit_symbols(index: DataFrame) -> DataFrame:
    """cu_offset, symbol: the index by unit, a projection and no second truth."""
    return index.select(*keyed(index, "cu_offset", "symbol")).distinct()


def mismatched(index: DataFrame, by_unit: DataFrame) -> DataFrame:
    """cu_offset, symbol, side of pairs in only one of the two maps; a sound index has none."""
    by = [c for c in keyed(index, "cu_offset", "symbol") if c in by_unit.columns]
    a, b = index.select(*by).distinct(), by_unit.select(*by).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("index")).unionByName(b.exceptAll(a).withColumn("side", F.lit("units")))


def checked(index: DataFrame, by_unit: DataFrame) -> DataFrame:
    """The index, or ValueError where the two maps differ."""
    if not mismatched(index, by_unit).isEmpty():
        raise ValueError("Cache file is corrupted: symbols and units do not match")
    return index


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows in only one of two indexes; nothing has to be written if there are none."""
    return new.exceptAll(old).unionByName(old.exceptAll(new))


def statistics(index: DataFrame) -> DataFrame:
    """Symbols, units (of each binary)."""
    return index.groupBy(*keyed(index)).agg(F.count("*").alias("symbols"), F.countDistinct("cu_offset").alias("units"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """C11: the share of hits in percent with one decimal, 0.0% without any."""
    total = hits + misses
    return F.format_string("%.1f%%", F.when(total > 0, hits * 100.0 / total).otherwise(F.lit(0.0)))


def content_key(binaries: DataFrame) -> DataFrame:
    """Path, source_id of Spark's binaryFile rows: the first 16 hexadecimal digits of SHA-256 of the first 64 KiB."""
    return binaries.select("path", F.substring(F.sha2(F.substring("content", 1, 65536), 256), 1, 16).alias("source_id"))


def numbered(symbols: DataFrame) -> DataFrame:
    """rank 1 is the first mention of each symbol of symbols(symbol, pos)."""
    return symbols.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("pos")))
