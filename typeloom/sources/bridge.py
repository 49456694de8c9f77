"""A deterministic projection of the star-schema tables onto the table of entries, so that every operator runs on them.

The SQL text is plain enough for other engines to run it too. Offsets of each kind have their own range of 10^9.

There are two binaries, whose offsets and names are the same but whose definitions differ: `star` has all kinds, `moon` none
of the orders and of the nations' bases, its classes are larger, and its members have other names and offsets. So whatever
takes one binary's entry for the other's is seen."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DIES
from .store import store

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
G = 1_000_000_000

#: Kind: (offset, parent, tag, name, byte_size, type_ref, loc, const_value, upper_bound, count_attr, flags, source).
#: flags: v virtual, e external, d declaration, a artificial.
KINDS = [
    (f"1*{G}+r_regionkey", None, "namespace", "r_name", "0", None, None, None, None, None, "", "region"),
    (f"2*{G}+n_nationkey", f"1*{G}+n_regionkey", "class_type", "n_name", "8", None, None, None, None, None, "", "nation"),
    (f"2*{G}+500000000+s_suppkey", None, "class_type", "s_name", "0", None, None, None, None, None, "d", "supplier WHERE s_suppkey % 3 = 0"),
    (f"3*{G}+s_suppkey", None, "class_type", "s_name", "16", None, None, None, None, None, "", "supplier"),
    (f"4*{G}+c_custkey", None, "class_type", "c_name", "24", None, None, None, None, None, "", "customer"),
    (f"5*{G}+p_partkey", None, "CASE WHEN p_size < 10 THEN 'DW_TAG_base_type' WHEN p_size < 20 THEN 'DW_TAG_enumeration_type' ELSE 'DW_TAG_structure_type' END", "p_name", "p_size", None, None, None, None, None, "", "part"),
    (f"6*{G}+o_orderkey", None, "structure_type", "concat('Order_', cast(o_orderkey as varchar(20)))", "128", None, None, None, None, None, "", "orders"),
    (f"7*{G}+c_custkey", None, "pointer_type", None, "8", f"8*{G}+c_custkey", None, None, None, None, "", "customer"),
    (f"8*{G}+c_custkey", None, "const_type", None, None, f"CASE WHEN c_custkey % 3 = 0 THEN 9*{G}+c_custkey ELSE 4*{G}+c_custkey END", None, None, None, None, "", "customer"),
    (f"9*{G}+c_custkey", None, "typedef", "concat('td_', cast(c_custkey as varchar(20)))", None, f"CASE WHEN c_custkey % 5 = 4 THEN 9*{G}+c_custkey-1 ELSE 4*{G}+c_custkey END", None, None, None, None, "", "customer"),
    (f"10*{G}+p_partkey", None, "array_type", None, None, f"5*{G}+p_partkey", None, None, None, None, "", "part WHERE p_partkey % 3 = 0"),
    (f"11*{G}+p_partkey*2", f"10*{G}+p_partkey", "subrange_type", None, None, None, None, None, "p_size % 7", None, "", "part WHERE p_partkey % 3 = 0"),
    (f"11*{G}+p_partkey*2+1", f"10*{G}+p_partkey", "subrange_type", None, None, None, None, None, None, "p_size % 5", "", "part WHERE p_partkey % 6 = 0"),
    (f"13*{G}+p_partkey*3", f"5*{G}+p_partkey", "enumerator", "'Low'", None, None, None, "p_size", None, None, "", "part WHERE p_size BETWEEN 10 AND 19"),
    (f"13*{G}+p_partkey*3+1", f"5*{G}+p_partkey", "enumerator", "'High'", None, None, None, "p_size * 2", None, None, "", "part WHERE p_size BETWEEN 10 AND 19"),
    (f"14*{G}+s_suppkey", f"3*{G}+s_suppkey", "inheritance", None, None, f"2*{G}+s_nationkey", "0", None, None, None, "", "supplier"),
    (f"15*{G}+c_custkey", f"4*{G}+c_custkey", "inheritance", None, None, f"2*{G}+c_nationkey", "0", None, None, None, "", "customer"),
    (f"16*{G}+n_nationkey", f"2*{G}+n_nationkey", "inheritance", None, None, f"2*{G}+n_nationkey-5", "0", None, None, None, "", "nation WHERE n_nationkey >= 5"),
    (f"17*{G}+s_suppkey*3", f"3*{G}+s_suppkey", "subprogram", "s_name", None, None, None, None, None, None, "e", "supplier"),
    (f"17*{G}+s_suppkey*3+1", f"3*{G}+s_suppkey", "subprogram", "concat('~', s_name)", None, None, None, None, None, None, "ev", "supplier"),
    (f"17*{G}+s_suppkey*3+2", f"3*{G}+s_suppkey", "subprogram", "'find'", None, f"7*{G}+s_suppkey", None, None, None, None, "ev", "supplier"),
    (f"18*{G}+s_suppkey*2", f"17*{G}+s_suppkey*3+2", "formal_parameter", "'this'", None, f"3*{G}+s_suppkey", None, None, None, None, "a", "supplier"),
    (f"18*{G}+s_suppkey*2+1", f"17*{G}+s_suppkey*3+2", "formal_parameter", "'key'", None, f"9*{G}+s_suppkey", None, None, None, None, "", "supplier"),
    (f"20*{G}+o_orderkey*8", f"6*{G}+o_orderkey", "member", "'customer'", None, f"7*{G}+o_custkey", "0", None, None, None, "", "orders"),
    (f"20*{G}+k*8+n", f"6*{G}+k", "member", "concat('line', cast(n as varchar(20)))", None, f"CASE n % 4 WHEN 0 THEN 3*{G}+s WHEN 1 THEN 5*{G}+p WHEN 2 THEN 7*{G}+s ELSE CASE WHEN p % 3 = 0 THEN 10*{G}+p ELSE 5*{G}+p END END", "n * 16 + cast(q as bigint) % 5", None, None, None, "", "items"),
    (f"21*{G}+s_suppkey", f"3*{G}+s_suppkey", "member", "'nation'", None, f"2*{G}+s_nationkey", "8", None, None, None, "", "supplier"),
    (f"22*{G}+c_custkey", f"4*{G}+c_custkey", "member", "'home'", None, f"2*{G}+c_nationkey", "8", None, None, None, "", "customer"),
    (f"22*{G}+500000000+c_custkey", f"4*{G}+c_custkey", "member", "'LIMIT'", None, f"9*{G}+c_custkey", None, "c_nationkey", None, None, "ed", "customer"),
    (f"23*{G}+n_nationkey", f"2*{G}+n_nationkey", "member", "'next'", None, f"2*{G}+(n_nationkey+5)%25", "0", None, None, None, "", "nation"),
    # every other nation: a nested structure whose members are not in order, a named union, an unnamed one with a structure, and parameters of a template
    (f"24*{G}+n_nationkey*8", f"2*{G}+n_nationkey", "structure_type", "'Geo'", "16", None, None, None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"24*{G}+n_nationkey*8+1", f"24*{G}+n_nationkey*8", "member", "'east'", None, f"4*{G}+n_nationkey+1", "8", None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"24*{G}+n_nationkey*8+2", f"24*{G}+n_nationkey*8", "member", "'north'", None, f"3*{G}+n_nationkey % 5+1", "0", None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"25*{G}+n_nationkey*8", f"2*{G}+n_nationkey", "union_type", None, "8", None, None, None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"25*{G}+n_nationkey*8+1", f"25*{G}+n_nationkey*8", "member", "'code'", None, f"4*{G}+n_nationkey+1", "0", None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"25*{G}+n_nationkey*8+2", f"25*{G}+n_nationkey*8", "structure_type", None, "8", None, None, None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"25*{G}+n_nationkey*8+3", f"25*{G}+n_nationkey*8+2", "member", "'low'", None, f"4*{G}+n_nationkey+1", "0", None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"25*{G}+n_nationkey*8+4", f"2*{G}+n_nationkey", "union_type", "'Value'", "8", None, None, None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"25*{G}+n_nationkey*8+5", f"25*{G}+n_nationkey*8+4", "member", "'raw'", None, f"4*{G}+n_nationkey+1", "0", None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"26*{G}+n_nationkey", f"2*{G}+n_nationkey", "member", None, None, f"25*{G}+n_nationkey*8", "16", None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"27*{G}+n_nationkey*2", f"2*{G}+n_nationkey", "template_type_param", "'T'", None, f"4*{G}+n_nationkey+1", None, None, None, None, "", "nation WHERE n_nationkey % 2 = 0"),
    (f"27*{G}+n_nationkey*2+1", f"2*{G}+n_nationkey", "template_value_param", "'N'", None, None, None, "n_regionkey", None, None, "", "nation WHERE n_nationkey % 2 = 0"),
]


def selected(kind: tuple) -> str:
    offset, parent, tag, name, size, ref, loc, const, upper, count, flags, source = kind
    n = lambda x: f"cast({x} as bigint)" if x else "cast(null as bigint)"
    tag = tag if tag.startswith("CASE") else f"'DW_TAG_{tag}'"
    name = name or "cast(null as varchar(200))"
    columns = [n(offset), n(parent), tag, name, n(size), n(ref), n(loc), n(const), n(upper), n(count), *("true" if f in flags else "false" for f in "veda")]
    return "SELECT " + ", ".join(f"{c} AS {a}" for c, a in zip(columns, ["die_offset", "parent_offset", "tag", "name", "byte_size", "type_ref", "loc", "const_value", "upper_bound", "count_attr", "has_virtuality", "is_external", "is_declaration", "is_artificial"])) + f" FROM {source}"


#: (l_orderkey, l_linenumber) repeats, so a member is made of the least values of its pair.
ITEMS = "SELECT l_orderkey AS k, cast(l_linenumber as bigint) AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"
#: A unit is 500 orders with their members, or another kind's whole range.
UNIT = f"""CASE WHEN die_offset >= 6*cast({G} as bigint) AND die_offset < 7*cast({G} as bigint) THEN 6*cast({G} as bigint) + cast(floor((die_offset - 6*cast({G} as bigint)) / 500.0) as bigint) * 500
 WHEN die_offset >= 20*cast({G} as bigint) AND die_offset < 21*cast({G} as bigint) THEN 6*cast({G} as bigint) + cast(floor((die_offset - 20*cast({G} as bigint)) / 4000.0) as bigint) * 500
 ELSE cast(floor(die_offset / {G}.0) as bigint) * cast({G} as bigint) END"""
#: What moon leaves out, and how its rows differ.
MOON = {"name": "CASE WHEN tag = 'DW_TAG_member' AND name IS NOT NULL THEN concat('m_', name) ELSE name END", "byte_size": "CASE WHEN tag = 'DW_TAG_class_type' THEN byte_size + 8 ELSE byte_size END", "loc": "loc + 8"}
LEFT_OUT = " OR ".join(f"die_offset >= {k}*cast({G} as bigint) AND die_offset < {k + 1}*cast({G} as bigint)" for k in (6, 16, 20))
COLUMNS = ["die_offset", "parent_offset", "tag", "name", "byte_size", "type_ref", "loc", "const_value", "upper_bound", "count_attr", "has_virtuality", "is_external", "is_declaration", "is_artificial"]
SOURCES = ("star", "moon")
#: WITH-clause definitions: items and rows (src 0 or 1, offsets within a binary).
ROWS = f"items AS ({ITEMS}), raw_dies AS (\n" + "\nUNION ALL\n".join(selected(k).replace(f"*{G}", f"*cast({G} as bigint)") for k in KINDS) + f"""
), placed AS (SELECT *, {UNIT} AS cu_offset FROM raw_dies),
rows AS (SELECT cast(0 as bigint) AS src, {", ".join(COLUMNS)}, cu_offset FROM placed
UNION ALL SELECT cast(1 as bigint) AS src, {", ".join(f"{MOON.get(c, c)} AS {c}" for c in COLUMNS)}, cu_offset FROM placed WHERE NOT ({LEFT_OUT}))"""
#: For SQL, an entry of binary k has the number offset + k * NODE, so that one number is a key.
NODE = 1 << 40
SQL = f"{ROWS}, dies AS MATERIALIZED (SELECT src, " + ", ".join(f"{c} + src * {NODE} AS {c}" if c in ("die_offset", "parent_offset", "type_ref", "cu_offset") else c for c in [*COLUMNS, "cu_offset"]) + " FROM rows)"


#: The projected table of each application, folder and state of its tables.
LOADED: dict[tuple, str] = {}


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """When each table was last changed, and its size."""
    out = []
    for t in TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out += [files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()]
    return tuple(out)


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """projected(), written once for each application, folder and state of its tables, as the entries of binaries are; written
    again if the result is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir))
    try:
        if key in LOADED:
            return spark.read.parquet(LOADED[key])
    except AnalysisException:
        pass
    rows = projected(spark, sf_dir)
    LOADED[key] = rows.inputFiles()[0].rpartition("/")[0]
    return rows


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of entries, with the columns of schema.DIES that the projection can fill and nulls in the rest; written once,
    as a reader of binaries would, so that operators scan a table and not the projection. An entry's rows of both binaries come
    from one scan (rows, in the SQL, reads all kinds twice)."""
    sql = ROWS.partition(",\nrows AS (")[0]
    for t in TABLES:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", sql)
    placed = spark.sql(f"WITH {sql} SELECT * FROM placed")
    rows = placed.select("*", F.explode(F.expr(f"CASE WHEN NOT ({LEFT_OUT}) THEN array(0, 1) ELSE array(0) END")).alias("src"))
    rows = rows.select("src", "cu_offset", *[F.expr(f"CASE WHEN src = 1 THEN {MOON[c]} ELSE {c} END").alias(c) if c in MOON else c for c in COLUMNS])
    own = {
        "source_id": F.when(F.col("src") == 0, SOURCES[0]).otherwise(SOURCES[1]),
        "platform": F.lit("unknown"),
        "member_loc": F.when(F.col("loc").isNotNull(), F.struct(F.col("loc").alias("int_value"), F.lit(None).cast("array<bigint>").alias("expr"))),
        "has_children": F.lit(None).cast("boolean"),
    }
    fields = T.StructType.fromDDL(DIES).fields
    out = rows.select(*[(own.get(f.name) if f.name in own else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return store(spark, out, "entries")


def units(dies: DataFrame) -> DataFrame:
    """The compile units of the projected entries."""
    rows = dies.groupBy("source_id", "cu_offset").agg(F.lit(4).alias("version"), F.lit(8).alias("addr_size"), F.first("platform").alias("platform"))
    end = F.col("cu_offset") + F.when((F.col("cu_offset") >= 6 * G) & (F.col("cu_offset") < 7 * G), 500).otherwise(G)
    return rows.select("source_id", "cu_offset", end.alias("cu_end"), "version", "addr_size", "platform")
