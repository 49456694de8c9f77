"""The registered queries over the projected tables, each with SQL that says the same.

Q and O are filled side by side: a query and its SQL stand together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import values as V
from ..operators import chains, classify, closure, index, layout, lookup, records, render
from ..sources.bridge import NODE, SOURCES, SQL, bridge, units
from ..sources.elf import dwarf_version, platform_of
from ..sources.store import store
from . import headers

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}  # noqa: E741
NAMED = ", ".join(f"'{t}'" for t in S.NAMED_TERMINAL)
DECLARABLE = ", ".join(f"'{t}'" for t in S.FORWARD_DECLARABLE)
QUALIFIER = ", ".join(f"'{t}'" for t in S.QUALIFIERS)
SEARCHABLE = ", ".join(f"'{t}'" for t in S.SEARCHABLE)
#: Names and terminals of type entries, in SQL: chains by recursion, one row for each step.
INDEX_SQL = f"idx AS (SELECT src, name AS symbol, die_offset, cu_offset, tag FROM (SELECT *, row_number() OVER (PARTITION BY src, name ORDER BY CASE WHEN coalesce(byte_size, 0) > 0 THEN 0 ELSE 1 END, cu_offset, die_offset) AS rn FROM dies WHERE tag IN ({SEARCHABLE}) AND name IS NOT NULL) WHERE rn = 1)"
STEPS_SQL = f"""term AS (
  SELECT die_offset AS node, die_offset AS cur, 0 AS depth FROM dies WHERE tag IN ({NAMED}, {QUALIFIER}, 'DW_TAG_typedef', 'DW_TAG_array_type')
  UNION ALL
  SELECT t.node, d.type_ref, t.depth + 1 FROM term t JOIN dies d ON d.die_offset = t.cur
  WHERE t.depth < 19 AND d.type_ref IS NOT NULL AND d.tag IN ({QUALIFIER}, 'DW_TAG_typedef', 'DW_TAG_array_type')
), terminal AS (
  SELECT t.node AS die_offset, max(CASE WHEN d.tag IN ({DECLARABLE}) OR (d.tag IN ({NAMED}) AND d.name IS NOT NULL) THEN t.cur END) AS terminal
  FROM term t JOIN dies d ON d.die_offset = t.cur GROUP BY t.node
)"""
NAMES_SQL = f"""brackets AS (
  SELECT a.die_offset, '[' || coalesce(string_agg(CASE WHEN d > 0 THEN cast(d AS varchar) ELSE '' END, '][' ORDER BY seq), '') || ']' AS b
  FROM dies a LEFT JOIN (SELECT parent_offset, die_offset AS seq, coalesce(count_attr, upper_bound + 1, 0) AS d FROM dies WHERE tag = 'DW_TAG_subrange_type') r ON r.parent_offset = a.die_offset
  WHERE a.tag = 'DW_TAG_array_type' GROUP BY a.die_offset
), walk AS (
  SELECT die_offset AS node, die_offset AS cur, 0 AS depth, '' AS pre, '' AS post FROM dies WHERE tag IN ({NAMED}, {QUALIFIER}, 'DW_TAG_typedef', 'DW_TAG_array_type')
  UNION ALL
  SELECT w.node, d.type_ref, w.depth + 1, w.pre || CASE WHEN d.tag = 'DW_TAG_const_type' THEN 'const ' ELSE '' END,
    CASE d.tag WHEN 'DW_TAG_pointer_type' THEN '*' WHEN 'DW_TAG_array_type' THEN b.b ELSE '' END || w.post
  FROM walk w JOIN dies d ON d.die_offset = w.cur LEFT JOIN brackets b ON b.die_offset = d.die_offset
  WHERE w.depth < 19 AND d.name IS NULL AND d.type_ref IS NOT NULL AND d.tag IN ('DW_TAG_pointer_type', 'DW_TAG_const_type', 'DW_TAG_array_type')
), names AS (
  SELECT w.node AS die_offset, w.pre || coalesce(d.name, replace(d.tag, 'DW_TAG_', '')) || w.post AS type_name FROM walk w JOIN dies d ON d.die_offset = w.cur
  WHERE d.name IS NOT NULL OR d.tag NOT IN ('DW_TAG_pointer_type', 'DW_TAG_const_type', 'DW_TAG_array_type')
)"""


def query(sql: str, key: str | None = "die_offset", nodes: tuple[str, ...] = ()):
    """Register a query under its function's name with its SQL, which may use dies. key: the column that tells the binary,
    a number of an entry or src; nodes: further numbers of entries. The result has source_id and offsets instead."""

    def put(f):
        Q[f.__name__] = f
        O[f.__name__] = by_source(f"WITH RECURSIVE {SQL}{', ' if sql.lstrip().split(' ')[0] != 'SELECT' else ' '}{sql}", key, nodes)
        return f

    return put


def by_source(sql: str, key: str | None, nodes: tuple[str, ...]) -> str:
    if key is None:
        return sql
    offsets = [*([key] if key != "src" else []), *nodes]
    new = f" REPLACE ({', '.join(f'{c} % {NODE} AS {c}' for c in offsets)})" if offsets else ""
    return f"SELECT CASE WHEN {key} >= {1 if key == 'src' else NODE} THEN 'moon' ELSE 'star' END AS source_id, *{' EXCLUDE (src)' if key == 'src' else ''}{new} FROM ({sql})"


def plain(sql: str):
    def put(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return put


#: The graph of each projected table: its folder, and a folder that shows whether its tables are still there.
GRAPHS: dict[str, tuple[headers.Graph, str]] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> headers.Graph:
    """The graph of the projected entries, with types, records and typed parts: worked out once for each projected table and
    read by all queries that need it, again if its tables are gone."""
    dies = bridge(spark, sf_dir)
    at = dies.inputFiles()[0].rpartition("/")[0]
    try:
        if at in GRAPHS:
            graph, parts = GRAPHS[at]
            spark.read.parquet(parts)
            return graph
    except AnalysisException:
        pass
    graph = headers.Graph(dies)
    GRAPHS[at] = graph, graph.parts.inputFiles()[0].rpartition("/")[0]
    return graph


#: Entries up to which the shared graph of all is taken.
SMALL = 3_000_000


def text_of(array, f) -> DataFrame:
    return F.array_join(F.transform(array, f), ";")


@query("SELECT tag, count(*) AS n, cast(sum(coalesce(byte_size, 0)) AS bigint) AS bytes FROM dies GROUP BY tag", key=None)
def die_scan_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.coalesce("byte_size", F.lit(0))).cast("bigint").alias("bytes"))


@query(f"{INDEX_SQL} SELECT symbol, die_offset, cu_offset, tag FROM idx", nodes=("cu_offset",))
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.symbol_index(bridge(spark, sf_dir))


@query("SELECT name AS symbol, die_offset, cu_offset, tag FROM (SELECT *, row_number() OVER (PARTITION BY src, name ORDER BY CASE WHEN coalesce(byte_size, 0) > 0 THEN 0 ELSE 1 END, cu_offset, die_offset) AS rn FROM dies WHERE tag IN (" + ", ".join(f"'{t}'" for t in S.DEFINABLE) + ") AND name IS NOT NULL) WHERE rn = 1", nodes=("cu_offset",))
def pick_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.definitions(bridge(spark, sf_dir))


@query("SELECT m.die_offset, m.type_ref AS target, d.tag AS target_tag, d.name AS target_name FROM dies m JOIN dies d ON d.die_offset = m.type_ref", nodes=("target",))
def die_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dereferenced(bridge(spark, sf_dir))


@query(f"""u AS (SELECT cu_offset, cu_offset + CASE WHEN cu_offset % {NODE} >= 6000000000 AND cu_offset % {NODE} < 7000000000 THEN 500 ELSE 1000000000 END AS cu_end FROM dies GROUP BY cu_offset)
SELECT o.type_ref AS die_offset, u.cu_offset, count(*) AS n FROM dies o JOIN u ON o.type_ref >= u.cu_offset AND o.type_ref < u.cu_end GROUP BY o.type_ref, u.cu_offset""", nodes=("cu_offset",))
def cu_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    # referenced offsets are counted first, so a hot one is one row of the interval join
    offsets = dies.where("type_ref is not null").groupBy("source_id", F.col("type_ref").alias("die_offset")).agg(F.count("*").alias("n"))
    return lookup.units_of(offsets, units(dies), grid=1 << 28).select("source_id", "die_offset", "cu_offset", "n")


@query("SELECT c.parent_offset, p.tag AS parent_tag, count(*) AS n, string_agg(cast(c.die_offset % " + str(NODE) + " AS varchar), ',' ORDER BY c.die_offset) AS children FROM dies c JOIN dies p ON p.die_offset = c.parent_offset GROUP BY c.parent_offset, p.tag", key="parent_offset")
def children_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    kids = lookup.children(dies, dies).groupBy("source_id", "parent_offset").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("die_offset")), lambda x: x.cast("string")), ",").alias("children"))
    return kids.join(dies.select("source_id", F.col("die_offset").alias("parent_offset"), F.col("tag").alias("parent_tag")), ["source_id", "parent_offset"]).select("source_id", "parent_offset", "parent_tag", "n", "children")


@query(f"""SELECT n.die_offset, n.name, '#ifndef ' || g || chr(10) || '#define ' || g || chr(10) || chr(10) || '#include <cstdint>' || chr(10) || chr(10)
|| '// Generated from DWARF debug information using pyelftools' || chr(10) || '// Target namespace: ' || n.name || chr(10) || chr(10) || '// DWARF Debug Information:' || chr(10)
|| '// - DIE Offset: ' || printf('0x%08x', n.die_offset % {NODE}) || chr(10) || '// - Source CU: ' || printf('0x%08x', n.cu_offset % {NODE}) || chr(10) || chr(10)
|| '// Namespace: ' || n.name || chr(10) || '// Contains ' || cast(count(c.name) AS varchar) || ' type(s)' || chr(10) || chr(10) || 'namespace ' || n.name || ' {{' || chr(10) || chr(10)
|| '// Forward declarations' || chr(10) || string_agg('class ' || c.name || ';', chr(10) ORDER BY c.name) || chr(10) || chr(10)
|| '// To generate full headers for these classes, use:' || chr(10) || string_agg('//   --generate ' || n.name || '::' || c.name, chr(10) ORDER BY c.name) || chr(10) || chr(10)
|| '}}  // namespace ' || n.name || chr(10) || chr(10) || '#endif // ' || g || chr(10) AS header
FROM (SELECT *, upper(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g')) || '_NAMESPACE_H' AS g FROM dies WHERE tag = 'DW_TAG_namespace') n
JOIN dies c ON c.parent_offset = n.die_offset AND c.tag = 'DW_TAG_class_type' GROUP BY n.die_offset, n.cu_offset, n.name, g""")
def namespace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.namespace_children(bridge(spark, sf_dir)).select("source_id", "die_offset", "name", render.namespace_header().alias("header"))


CATEGORY_SQL = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CATEGORY.items()) + " ELSE 'other' END"
READABLE_SQL = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.READABLE.items()) + " ELSE tag END"


@query(f"""SELECT die_offset, tag IN ({NAMED}) AND name IS NOT NULL AS named, tag IN ({DECLARABLE}) AND name IS NOT NULL AS declarable, tag IN ({QUALIFIER}) AS qualifier,
coalesce(tag = 'DW_TAG_base_type' AND name IN ({", ".join(f"'{p}'" for p in S.PRIMITIVES)}), false) AS primitive, tag IN ({SEARCHABLE}) AS searchable,
CASE WHEN tag IN ({NAMED}) THEN name END AS type_name, {CATEGORY_SQL} AS category, {READABLE_SQL} AS readable FROM dies""")
def classify_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(bridge(spark, sf_dir))


@query(f"{STEPS_SQL} SELECT d.die_offset, t.terminal FROM dies d LEFT JOIN terminal t ON t.die_offset = d.type_ref WHERE d.type_ref IS NOT NULL", nodes=("terminal",))
def terminal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.terminal_offsets(bridge(spark, sf_dir))


@query(f"{NAMES_SQL} SELECT die_offset, type_name FROM names")
def type_name_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.type_names(bridge(spark, sf_dir))


BASES_SQL = f"""{INDEX_SQL}, base AS (SELECT i.parent_offset AS class_offset, i.die_offset AS seq, b.name AS base FROM dies i JOIN dies b ON b.die_offset = i.type_ref WHERE i.tag = 'DW_TAG_inheritance' AND b.name IS NOT NULL),
first_base AS (SELECT i.src, i.symbol, arg_min(b.base, b.seq) AS base FROM idx i JOIN base b ON b.class_offset = i.die_offset WHERE i.tag IN ({DECLARABLE}) GROUP BY i.src, i.symbol),
up AS (SELECT src, symbol, base AS ancestor, 1 AS depth FROM first_base UNION ALL SELECT u.src, u.symbol, f.base, u.depth + 1 FROM up u JOIN first_base f ON f.src = u.src AND f.symbol = u.ancestor WHERE u.depth < 64)"""


@query(f"{BASES_SQL} SELECT src, symbol, string_agg(ancestor, ' -> ' ORDER BY depth DESC) AS chain, cast(count(*) AS bigint) AS length FROM up GROUP BY src, symbol", key="src")
def inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    rows = chains.inheritance(dies, index.symbol_index(dies)).groupBy("source_id", "symbol")
    by_depth = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))), lambda x: x["ancestor"])
    return rows.agg(F.array_join(by_depth, " -> ").alias("chain"), F.count("*").alias("length"))


PARTS_SQL = f"""{STEPS_SQL}, parts AS (
  SELECT m.parent_offset AS owner, t.terminal FROM dies m LEFT JOIN terminal t ON t.die_offset = m.type_ref WHERE m.tag IN ('DW_TAG_member', 'DW_TAG_subprogram')
  UNION ALL
  SELECT s.parent_offset, t.terminal FROM dies p JOIN dies s ON s.die_offset = p.parent_offset LEFT JOIN terminal t ON t.die_offset = p.type_ref WHERE p.tag = 'DW_TAG_formal_parameter'
), deps AS (SELECT DISTINCT owner, terminal AS dependency FROM parts WHERE terminal IS NOT NULL)"""


def parts_of(dies: DataFrame) -> DataFrame:
    """owner, terminal of members, results and parameters, without building whole records."""
    ends = chains.terminal_offsets(dies.where(F.col("tag").isin(S.MEMBER, S.SUBPROGRAM, S.PARAMETER, S.SUBRANGE, *chains.TYPES)))
    key = ["source_id", "die_offset"]
    direct = dies.where(F.col("tag").isin(S.MEMBER, S.SUBPROGRAM)).select(*key, F.col("parent_offset").alias("owner"))
    up = dies.where(F.col("tag") == S.SUBPROGRAM).select("source_id", F.col("die_offset").alias("parent_offset"), F.col("parent_offset").alias("owner"))
    params = dies.where(F.col("tag") == S.PARAMETER).select(*key, "parent_offset").join(up, ["source_id", "parent_offset"]).select(*key, "owner")
    return direct.unionByName(params).join(ends, key).select("source_id", "owner", "terminal")


@query(f"{PARTS_SQL} SELECT owner, dependency FROM deps", key="owner", nodes=("dependency",))
def extract_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.dependencies(parts_of(bridge(spark, sf_dir)))


@query(f"""{PARTS_SQL}, {INDEX_SQL}, edges AS (SELECT DISTINCT d.owner AS src, i.die_offset AS dst FROM deps d JOIN dies t ON t.die_offset = d.dependency AND t.tag IN ({DECLARABLE}) AND t.name IS NOT NULL JOIN idx i ON i.src = t.src AND i.symbol = t.name AND i.tag NOT IN ('DW_TAG_enumeration_type', 'DW_TAG_typedef')),
roots AS (SELECT die_offset AS root FROM idx WHERE tag IN ({DECLARABLE})),
reach AS (SELECT r.root, e.dst AS node, 0 AS depth FROM roots r JOIN edges e ON e.src = r.root UNION SELECT x.root, e.dst, x.depth + 1 FROM reach x JOIN edges e ON e.src = x.node WHERE x.depth < 9)
SELECT root, node, cast(min(depth) AS integer) AS depth FROM reach WHERE node <> root GROUP BY root, node""", key="root", nodes=("node",))
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    idx = index.symbol_index(dies)
    edges = closure.definition_edges(closure.dependencies(parts_of(dies)), dies, idx)
    roots = idx.where(F.col("tag").isin(S.FORWARD_DECLARABLE)).select("source_id", F.col("die_offset").alias("root"), F.col("die_offset").alias("node"))
    return closure.closure(roots, edges)


@query(f"""{STEPS_SQL}, {NAMES_SQL}, members AS (
  SELECT m.parent_offset, string_agg(m.name || ':' || n.type_name || '@' || coalesce(cast(m.loc AS varchar), '-') || '>' || coalesce(cast(t.terminal % {NODE} AS varchar), '-') || CASE WHEN m.is_external AND m.is_declaration THEN '=' || coalesce(cast(m.const_value AS varchar), '-') ELSE '' END, ';' ORDER BY m.die_offset) AS members
  FROM dies m JOIN names n ON n.die_offset = m.type_ref LEFT JOIN terminal t ON t.die_offset = m.type_ref WHERE m.tag = 'DW_TAG_member' AND m.name IS NOT NULL GROUP BY m.parent_offset
), methods AS (
  SELECT m.parent_offset, string_agg(coalesce(n.type_name, 'void') || ' ' || m.name || '/' || cast(coalesce(p.k, 0) AS varchar) || CASE WHEN m.has_virtuality THEN ' virtual' ELSE '' END || CASE WHEN m.name = c.name THEN ' ctor' WHEN m.name LIKE '~%' THEN ' dtor' ELSE '' END, ';' ORDER BY m.die_offset) AS methods
  FROM dies m JOIN dies c ON c.die_offset = m.parent_offset LEFT JOIN names n ON n.die_offset = m.type_ref LEFT JOIN (SELECT parent_offset, count(*) AS k FROM dies WHERE tag = 'DW_TAG_formal_parameter' GROUP BY parent_offset) p ON p.parent_offset = m.die_offset
  WHERE m.tag = 'DW_TAG_subprogram' GROUP BY m.parent_offset
), based AS (SELECT i.parent_offset, string_agg(b.name, ';' ORDER BY i.die_offset) AS bases FROM dies i JOIN dies b ON b.die_offset = i.type_ref WHERE i.tag = 'DW_TAG_inheritance' GROUP BY i.parent_offset)
SELECT d.die_offset, coalesce(d.name, 'unknown_class') AS name, coalesce(d.byte_size, 0) AS byte_size, coalesce(b.bases, '') AS bases, coalesce(m.members, '') AS members, coalesce(f.methods, '') AS methods
FROM dies d LEFT JOIN members m ON m.parent_offset = d.die_offset LEFT JOIN methods f ON f.parent_offset = d.die_offset LEFT JOIN based b ON b.parent_offset = d.die_offset
WHERE d.tag IN ({SEARCHABLE}) AND d.tag <> 'DW_TAG_namespace'""")
def class_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: x.cast("string")
    rows = graph_of(spark, sf_dir).records
    member = lambda m: F.concat(m["name"], F.lit(":"), m["type_name"], F.lit("@"), F.coalesce(s(m["offset"]), F.lit("-")), F.lit(">"), F.coalesce(s(m["type_offset"]), F.lit("-")), F.when(m["is_static"], F.concat(F.lit("="), F.coalesce(s(m["const_value"]), F.lit("-")))).otherwise(""))
    method = lambda m: F.concat(m["return_type"], F.lit(" "), m["name"], F.lit("/"), s(F.size(m["parameters"])), F.when(m["is_virtual"], " virtual").otherwise(""), F.when(m["is_constructor"], " ctor").when(m["is_destructor"], " dtor").otherwise(""))
    return rows.select("source_id", "die_offset", "name", "byte_size", F.array_join("base_classes", ";").alias("bases"), text_of("members", member).alias("members"), text_of("methods", method).alias("methods"))


@plain("SELECT event_id, CASE WHEN cast(json_extract(props, '$.k') AS bigint) % 3 = 0 THEN cast(json_extract(props, '$.k') AS bigint) WHEN cast(json_extract(props, '$.k') AS bigint) % 3 = 1 THEN cast(json_extract(props, '$.k') AS bigint) * 2 END AS member_offset FROM events")
def member_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location is k as an integer, [plus_uconst, 2k], or another operation, by k modulo 3."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    loc = F.struct(F.when(k % 3 == 0, k).alias("int_value"), F.when(k % 3 == 1, F.array(F.lit(35).cast("bigint"), k * 2)).when(k % 3 == 2, F.array(F.lit(99).cast("bigint"), k)).alias("expr"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", V.location_offset(loc).alias("member_offset"))


TEXTS_SQL = """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'const u32' WHEN 1 THEN p_brand || '*' WHEN 2 THEN 'const int[' || cast(p_size AS varchar) || ']' WHEN 3 THEN 'double[2][3]' WHEN 4 THEN 'char[]' WHEN 5 THEN 'const volatile f32 &' WHEN 6 THEN 'u16' ELSE p_name END AS t FROM part"""


def type_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 8
    t = F.when(kind == 0, "const u32").when(kind == 1, F.concat("p_brand", F.lit("*"))).when(kind == 2, F.concat(F.lit("const int["), F.col("p_size").cast("string"), F.lit("]"))).when(kind == 3, "double[2][3]").when(kind == 4, "char[]").when(kind == 5, "const volatile f32 &").when(kind == 6, "u16").otherwise(F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", t.alias("t"))


@plain(f"SELECT p_partkey, t AS type_name, cast(CASE WHEN t LIKE '%*' OR t LIKE '%&' THEN 8 WHEN t LIKE 'const int[%' THEN 4 * cast(regexp_extract(t, '[0-9]+') AS bigint) WHEN t = 'double[2][3]' THEN 16 WHEN t = 'char[]' THEN 8 WHEN t = 'const u32' THEN 4 WHEN t = 'u16' THEN 2 ELSE 8 END AS bigint) AS member_size FROM ({TEXTS_SQL})")
def member_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_texts(spark, sf_dir).select("p_partkey", F.col("t").alias("type_name"), V.member_size(F.col("t")).alias("member_size"))


@plain(f"SELECT p_partkey, trim(split_part(regexp_replace(regexp_replace(t, '^((const|volatile) +)+', ''), '( *(&&|&|[*]))+ *$', ''), '[', 1)) AS base_type FROM ({TEXTS_SQL})")
def extract_base_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_texts(spark, sf_dir).select("p_partkey", V.base_text(F.col("t")).alias("base_type"))


LAYOUT_SQL = f"""{NAMES_SQL}, laid AS (
  SELECT m.parent_offset AS class_offset, c.byte_size, m.die_offset AS seq, m.name, m.loc AS off,
    8 * coalesce(try_cast(regexp_extract(n.type_name, '\\[([^\\]]*)\\]', 1) AS bigint), 1) AS size
  FROM dies m JOIN names n ON n.die_offset = m.type_ref JOIN dies c ON c.die_offset = m.parent_offset WHERE m.tag = 'DW_TAG_member' AND m.loc IS NOT NULL AND m.name IS NOT NULL
), prev AS (
  SELECT *, off + size AS stop, lag(off + size) OVER (PARTITION BY class_offset ORDER BY off, seq) AS before, lag(name) OVER (PARTITION BY class_offset ORDER BY off, seq) AS after FROM laid
), ends AS (
  SELECT class_offset, sum(greatest(off - before, 0)) AS inside, sum(size) AS natural, arg_max(stop, (off, seq)) AS stop, arg_max(name, (off, seq)) AS last FROM prev GROUP BY class_offset
)"""


def bridge_layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    graph = graph_of(spark, sf_dir)
    dies = graph.dies
    classes = dies.where(F.col("tag").isin(S.FORWARD_DECLARABLE)).select("source_id", F.col("die_offset").alias("class_offset"), F.coalesce("byte_size", F.lit(0)).alias("byte_size"))
    rows = records.members(dies, graph.types).select("source_id", F.col("parent_offset").alias("class_offset"), F.col("die_offset").alias("seq"), "name", "type_name", "offset")
    return rows, classes


PACK_SQL = f"""{LAYOUT_SQL}, padded AS (
  SELECT d.die_offset AS class_offset, coalesce(d.byte_size, 0) AS actual_size, CASE WHEN e.natural IS NULL THEN 0 ELSE coalesce(e.inside, 0) + greatest(coalesce(d.byte_size, 0) - e.stop, 0) END AS total_padding, coalesce(e.natural, 0) AS natural_size
  FROM dies d LEFT JOIN ends e ON e.class_offset = d.die_offset WHERE d.tag IN ({DECLARABLE})
), packed AS (SELECT class_offset, cast(CASE WHEN total_padding = 0 THEN 1 WHEN total_padding <= actual_size * 0.1 THEN 4 ELSE 8 END AS bigint) AS suggested_packing, cast(total_padding AS bigint) AS total_padding, cast(natural_size AS bigint) AS natural_size, actual_size FROM padded)"""


@query(f"{PACK_SQL} SELECT * FROM packed", key="class_offset")
def packing_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.packing(*bridge_layout(spark, sf_dir))


@query(f"{PACK_SQL} SELECT class_offset, CASE suggested_packing WHEN 1 THEN '#pragma pack(push, 1)' WHEN 4 THEN '#pragma pack(push, 4)' END AS pragma FROM packed", key="class_offset")
def pragma_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.packing(*bridge_layout(spark, sf_dir)).select("source_id", "class_offset", layout.pragma(F.col("suggested_packing")).alias("pragma"))


@query(f"""{LAYOUT_SQL} SELECT class_offset, coalesce(after, 'start') AS after_member, cast(coalesce(before, 0) AS bigint) AS "offset", cast(off - coalesce(before, 0) AS bigint) AS size FROM prev WHERE off > coalesce(before, 0)
UNION ALL SELECT e.class_offset, e.last, cast(e.stop AS bigint), cast(d.byte_size - e.stop AS bigint) FROM ends e JOIN dies d ON d.die_offset = e.class_offset WHERE d.byte_size > e.stop""", key="class_offset")
def member_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classes = bridge_layout(spark, sf_dir)
    return layout.gaps(rows, classes).select("source_id", "class_offset", "after_member", F.col("offset").cast("bigint").alias("offset"), F.col("size").cast("bigint").alias("size"))


DEFS_SQL = """defs AS (SELECT d.src, d.name, t.name AS underlying FROM dies d JOIN dies t ON t.die_offset = d.type_ref WHERE d.tag = 'DW_TAG_typedef'),
chain AS (SELECT src, name, underlying AS cur, 1 AS depth FROM defs UNION ALL SELECT c.src, c.name, d.underlying, c.depth + 1 FROM chain c JOIN defs d ON d.src = c.src AND d.name = c.cur WHERE c.depth < 20),
ends AS (SELECT src, name, arg_max(cur, depth) AS resolved FROM chain GROUP BY src, name)"""


@query(f"{DEFS_SQL} SELECT * FROM ends", key="src")
def typedef_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.typedef_chains(chains.typedefs(bridge(spark, sf_dir)))


TYPED_SQL = """typed AS (SELECT m.src, m.parent_offset AS owner, m.type_ref FROM dies m WHERE m.tag IN ('DW_TAG_member', 'DW_TAG_subprogram') AND m.type_ref IS NOT NULL UNION ALL SELECT s.src, s.parent_offset, p.type_ref FROM dies p JOIN dies s ON s.die_offset = p.parent_offset WHERE p.tag = 'DW_TAG_formal_parameter')"""
FINAL_SQL = f"""final AS (SELECT d.src, d.name, t.name AS target FROM (SELECT src, name, die_offset FROM dies WHERE tag = 'DW_TAG_typedef') d JOIN terminal x ON x.die_offset = d.die_offset JOIN dies t ON t.die_offset = x.terminal),
{TYPED_SQL},
used AS (SELECT DISTINCT t.owner, f.name, f.target FROM typed t JOIN names n ON n.die_offset = t.type_ref JOIN final f ON f.src = t.src AND f.name = regexp_replace(regexp_replace(n.type_name, '^(const )+', ''), '[*]+$', ''))"""


@query(f"{STEPS_SQL}, {NAMES_SQL}, {FINAL_SQL} SELECT owner, name, target FROM used", key="owner")
def used_typedefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    return chains.used_typedefs(graph.parts.select("source_id", "owner", "type_name"), graph.finals)


FORWARD_SQL = f"""declared AS (
  SELECT DISTINCT t.owner, regexp_replace(regexp_replace(n.type_name, '^const ', ''), '[*&]+$', '') AS name FROM typed t JOIN names n ON n.die_offset = t.type_ref JOIN terminal x ON x.die_offset = t.type_ref JOIN dies e ON e.die_offset = x.terminal AND e.tag IN ({DECLARABLE}) AND e.name IS NOT NULL
  WHERE n.type_name NOT LIKE '%[%'
), forward AS (SELECT owner, name FROM declared d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.owner = d.owner AND u.name = d.name))"""


@query(f"{STEPS_SQL}, {NAMES_SQL}, {FINAL_SQL}, {FORWARD_SQL} SELECT owner, name FROM forward", key="owner")
def forward_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    return headers.extras(graph, graph.records.select("source_id", F.col("die_offset").alias("owner")))[1]


@query(f"""{BASES_SQL}, owned AS (SELECT i.src, i.symbol AS root, t.name FROM idx i JOIN dies m ON m.parent_offset = i.die_offset AND m.tag = 'DW_TAG_member' JOIN dies t ON t.die_offset = m.type_ref WHERE t.tag IN ({DECLARABLE}))
SELECT DISTINCT src, root, name FROM owned o WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.src = o.src AND up.symbol = o.root AND up.ancestor = o.name)""", key="src")
def hierarchy_minus_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    idx = index.symbol_index(dies)
    edge = lookup.dereferenced(dies.where(F.col("tag").isin(S.MEMBER, *S.FORWARD_DECLARABLE))).where(F.col("target_tag").isin(S.FORWARD_DECLARABLE))
    owned = dies.where(F.col("tag") == S.MEMBER).select("source_id", "die_offset", "parent_offset").join(edge, ["source_id", "die_offset"]).join(idx.select("source_id", F.col("die_offset").alias("parent_offset"), F.col("symbol").alias("root")), ["source_id", "parent_offset"]).select("source_id", "root", F.col("target_name").alias("name"))
    chain = chains.inheritance(dies, idx).select("source_id", F.col("symbol").alias("root"), F.col("ancestor").alias("name"))
    return closure.only_dependencies(owned, chain)


@query("""r AS (SELECT parent_offset, die_offset, coalesce(count_attr, upper_bound + 1, 0) AS d FROM dies WHERE tag = 'DW_TAG_subrange_type')
SELECT a.die_offset, '[' || coalesce(string_agg(CASE WHEN d > 0 THEN cast(d AS varchar) ELSE '' END, '][' ORDER BY r.die_offset), '') || ']' AS brackets, cast(coalesce(round(product(CASE WHEN d > 0 THEN d END)), 0) AS bigint) AS total FROM dies a LEFT JOIN r ON r.parent_offset = a.die_offset WHERE a.tag = 'DW_TAG_array_type' GROUP BY a.die_offset""")
def array_type_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.array_texts(bridge(spark, sf_dir)).select("source_id", "die_offset", "brackets", "total")


@query("""SELECT e.die_offset, '    // Enum ' || e.name || ' (' || cast(e.byte_size AS varchar) || ' bytes)' || chr(10) || '    enum class ' || e.name || chr(10) || '    {' || chr(10)
|| string_agg('        ' || v.name || ' = ' || cast(v.const_value AS varchar), ',' || chr(10) ORDER BY v.die_offset) || chr(10) || '    };' || chr(10) AS text
FROM dies e JOIN dies v ON v.parent_offset = e.die_offset AND v.tag = 'DW_TAG_enumerator' WHERE e.tag = 'DW_TAG_enumeration_type' GROUP BY e.die_offset, e.name, e.byte_size""")
def enum_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.struct("name", "byte_size", "enumerators")
    return records.enums(bridge(spark, sf_dir)).select("source_id", "die_offset", F.element_at(F.transform(F.array(e), lambda x: F.array_join(render.enum_lines(x, True), "\n")), 1).alias("text"))


@plain("""SELECT page_id, CASE WHEN s = '' THEN 'unnamed' ELSE s END || '.h' AS file_name FROM (
SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(replace(url, '::', '__'), '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 200), '_+$', '') AS s FROM pages)""")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", V.header_name(F.col("url")).alias("file_name"))


def classes_text_sql() -> str:
    """Each class as text, in SQL: what the projection can contain."""
    nl = "|| chr(10) ||"
    return f"""{STEPS_SQL}, {NAMES_SQL}, {FINAL_SQL}, {FORWARD_SQL}, {INDEX_SQL}, laid AS (
  SELECT m.parent_offset AS class_offset, m.die_offset AS seq, m.loc AS off, 8 * coalesce(try_cast(regexp_extract(n.type_name, '\\[([^\\]]*)\\]', 1) AS bigint), 1) AS size
  FROM dies m JOIN names n ON n.die_offset = m.type_ref WHERE m.tag = 'DW_TAG_member' AND m.loc IS NOT NULL AND m.name IS NOT NULL
), prev AS (SELECT *, off + size AS stop, lag(off + size) OVER (PARTITION BY class_offset ORDER BY off, seq) AS before FROM laid),
ends AS (SELECT class_offset, sum(greatest(off - before, 0)) AS inside, sum(size) AS natural, arg_max(stop, (off, seq)) AS stop FROM prev GROUP BY class_offset),
padded AS (SELECT i.src, i.symbol, i.die_offset, coalesce(d.byte_size, 0) AS byte_size, i.cu_offset, CASE WHEN e.natural IS NULL THEN 0 ELSE coalesce(e.inside, 0) + greatest(coalesce(d.byte_size, 0) - e.stop, 0) END AS pad FROM idx i JOIN dies d ON d.die_offset = i.die_offset LEFT JOIN ends e ON e.class_offset = i.die_offset WHERE i.tag <> 'DW_TAG_namespace'),
packed AS (SELECT *, '// - Suggested Packing: ' || CASE WHEN pad = 0 THEN '1' WHEN pad <= byte_size * 0.1 THEN '4' ELSE '8' END || ' bytes' || CASE WHEN pad > 0 THEN chr(10) || '// - Total Padding: ' || cast(cast(pad AS bigint) AS varchar) || ' bytes' ELSE '' END AS packing FROM padded),
based AS (SELECT i.parent_offset, string_agg(b.name, ', ' ORDER BY i.die_offset) AS bases, string_agg(b.name, ' -> ' ORDER BY i.die_offset) AS arrow, string_agg(b.name, ', public ' ORDER BY i.die_offset) AS pub FROM dies i JOIN dies b ON b.die_offset = i.type_ref WHERE i.tag = 'DW_TAG_inheritance' GROUP BY i.parent_offset),
params AS (SELECT p.parent_offset, string_agg(n.type_name || ' ' || p.name, ', ' ORDER BY p.die_offset) AS args FROM dies p JOIN names n ON n.die_offset = p.type_ref WHERE p.tag = 'DW_TAG_formal_parameter' AND NOT p.is_artificial GROUP BY p.parent_offset),
methods AS (SELECT m.parent_offset, m.has_virtuality AS v, 'public:' || chr(10) || string_agg('    ' || CASE WHEN m.name = c.name THEN m.name || '(' || coalesce(p.args, '') || ');' WHEN m.name LIKE '~%' THEN CASE WHEN m.has_virtuality THEN 'virtual ' ELSE '' END || m.name || '();' ELSE CASE WHEN m.has_virtuality THEN 'virtual ' ELSE '' END || coalesce(n.type_name, 'void') || ' ' || m.name || '(' || coalesce(p.args, '') || ');' END, chr(10) ORDER BY CASE WHEN m.name = c.name THEN 0 WHEN m.name LIKE '~%' THEN 1 ELSE 2 END, m.die_offset) || chr(10) AS t
  FROM dies m JOIN dies c ON c.die_offset = m.parent_offset LEFT JOIN names n ON n.die_offset = m.type_ref LEFT JOIN params p ON p.parent_offset = m.die_offset WHERE m.tag = 'DW_TAG_subprogram' GROUP BY m.parent_offset, m.has_virtuality),
lines AS (SELECT m.parent_offset, m.is_external AND m.is_declaration AS st, string_agg('    ' || CASE WHEN m.is_external AND m.is_declaration THEN 'static ' || CASE WHEN m.const_value IS NOT NULL AND n.type_name NOT LIKE 'const %' THEN 'const ' ELSE '' END || n.type_name || ' ' || m.name || coalesce(' = ' || cast(m.const_value AS varchar), '')
   WHEN n.type_name LIKE '%_[%]' THEN regexp_extract(n.type_name, '^(.+?)(\\[.+\\])$', 1) || CASE WHEN regexp_extract(n.type_name, '^(.+?)(\\[.+\\])$', 2) = '' THEN n.type_name ELSE '' END || ' ' || m.name || regexp_extract(n.type_name, '^(.+?)(\\[.+\\])$', 2) ELSE n.type_name || ' ' || m.name END || ';' || CASE WHEN m.is_external AND m.is_declaration OR m.loc IS NULL THEN '' ELSE '  // offset: ' || printf('0x%x', m.loc) END, chr(10) ORDER BY m.die_offset) || chr(10) AS t
  FROM dies m JOIN names n ON n.die_offset = m.type_ref WHERE m.tag = 'DW_TAG_member' AND m.name IS NOT NULL GROUP BY m.parent_offset, m.is_external AND m.is_declaration),
  inner_lines AS (SELECT m.parent_offset, string_agg('        ' || n.type_name || ' ' || m.name || ';  // offset ' || cast(m.loc AS varchar), chr(10) ORDER BY m.loc, m.die_offset) AS by_place, string_agg('        ' || n.type_name || ' ' || m.name || ';  // offset ' || cast(m.loc AS varchar), chr(10) ORDER BY m.die_offset) AS in_order, string_agg('            ' || n.type_name || ' ' || m.name || ';  // offset ' || cast(m.loc AS varchar), chr(10) ORDER BY m.die_offset) AS deeper
    FROM dies m JOIN names n ON n.die_offset = m.type_ref WHERE m.tag = 'DW_TAG_member' AND m.name IS NOT NULL GROUP BY m.parent_offset),
  nested AS (SELECT s.parent_offset, 'public:' || chr(10) || string_agg('    // Struct ' || s.name || ' (' || cast(s.byte_size AS varchar) || ' bytes)' || chr(10) || '    struct ' || s.name || chr(10) || '    {{' || chr(10) || l.by_place || chr(10) || '    }};' || chr(10), chr(10) ORDER BY s.die_offset) || chr(10) AS t
    FROM dies s JOIN inner_lines l ON l.parent_offset = s.die_offset WHERE s.tag = 'DW_TAG_structure_type' AND s.name IS NOT NULL AND s.parent_offset IS NOT NULL GROUP BY s.parent_offset),
  within AS (SELECT s.parent_offset, string_agg('        struct' || chr(10) || '        {{' || chr(10) || l.deeper || chr(10) || '        }};' || chr(10), '' ORDER BY s.die_offset) AS t FROM dies s JOIN inner_lines l ON l.parent_offset = s.die_offset WHERE s.tag = 'DW_TAG_structure_type' AND s.name IS NULL GROUP BY s.parent_offset),
  unions AS (SELECT u.parent_offset, 'public:' || chr(10) || string_agg('    // Union ' || coalesce(u.name, '') || ' (' || cast(u.byte_size AS varchar) || ' bytes)' || chr(10) || '    union' || coalesce(' ' || u.name, '') || chr(10) || '    {{' || chr(10) || coalesce(w.t, '') || l.in_order || chr(10) || '    }};' || chr(10), chr(10) ORDER BY coalesce(m.die_offset, u.die_offset)) || chr(10) AS t
    FROM dies u JOIN inner_lines l ON l.parent_offset = u.die_offset LEFT JOIN within w ON w.parent_offset = u.die_offset LEFT JOIN dies m ON m.tag = 'DW_TAG_member' AND m.name IS NULL AND m.type_ref = u.die_offset WHERE u.tag = 'DW_TAG_union_type' GROUP BY u.parent_offset),
body AS (SELECT k.src, k.symbol, k.die_offset, k.cu_offset, k.byte_size, k.packing, b.arrow,
  '// ' || k.symbol || ' - DWARF Information:' {nl} '// - Size: ' || cast(k.byte_size AS varchar) || ' bytes' {nl} '// - DIE Offset: ' || printf('0x%08x', k.die_offset % {NODE}) {nl} k.packing || chr(10) || coalesce('// - Inherits from: ' || b.bases || chr(10), '')
  || 'class ' || k.symbol || coalesce(' : public ' || b.pub, '') {nl} '{{' || chr(10) || coalesce(z.t, '') || coalesce(x.t, '') || coalesce(v.t, '') || coalesce(w.t, '') || CASE WHEN i.t IS NULL AND s.t IS NULL THEN '' ELSE 'public:' || chr(10) END || coalesce(i.t, '') || coalesce(chr(10) || '    // Static members' || chr(10) || s.t, '') || '}};' AS text
  FROM packed k LEFT JOIN based b ON b.parent_offset = k.die_offset LEFT JOIN methods v ON v.parent_offset = k.die_offset AND v.v LEFT JOIN methods w ON w.parent_offset = k.die_offset AND NOT w.v LEFT JOIN nested z ON z.parent_offset = k.die_offset LEFT JOIN unions x ON x.parent_offset = k.die_offset LEFT JOIN lines i ON i.parent_offset = k.die_offset AND NOT i.st LEFT JOIN lines s ON s.parent_offset = k.die_offset AND s.st)"""


HEADER_SQL = f"""SELECT b.src, b.symbol, 'ok' AS status, '#ifndef ' || g || '_H' || chr(10) || '#define ' || g || '_H' || chr(10) || chr(10) || '#include <cstdint>' || chr(10) || chr(10)
|| coalesce('// Type definitions from DWARF' || chr(10) || u.t || chr(10) || chr(10), '') || '// Generated from DWARF debug information using pyelftools' || chr(10) || '// Target symbol: ' || b.symbol || chr(10) || chr(10) || '// DWARF Debug Information:' || chr(10) || '// - Size: ' || cast(b.byte_size AS varchar) || ' bytes' || chr(10) || '// - DIE Offset: ' || printf('0x%08x', b.die_offset % {NODE}) || chr(10) || '// - Source CU: ' || printf('0x%08x', b.cu_offset % {NODE}) || chr(10) || b.packing || chr(10)
|| coalesce('// - Direct Inheritance: ' || b.arrow || ' -> ' || b.symbol || chr(10), '') || chr(10) || coalesce(chr(10) || '// Forward declarations' || chr(10) || f.t || chr(10), '') || chr(10) || b.text || chr(10) || chr(10) || '#endif // ' || g || '_H' AS header
FROM (SELECT *, upper(regexp_replace(regexp_replace(regexp_replace(symbol, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS g FROM body) b
LEFT JOIN (SELECT owner, string_agg('typedef ' || target || ' ' || name || ';', chr(10) ORDER BY name) AS t FROM used GROUP BY owner) u ON u.owner = b.die_offset
LEFT JOIN (SELECT owner, string_agg('class ' || name || ';', chr(10) ORDER BY name) AS t FROM forward GROUP BY owner) f ON f.owner = b.die_offset"""


@query(f"{classes_text_sql()} {HEADER_SQL}", key="src")
def header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-definition headers of every symbol that is no namespace."""
    graph = graph_of(spark, sf_dir)
    return headers.single_headers(graph, graph.index.where(F.col("tag") != S.NAMESPACE).select("source_id", "symbol"))


#: The hierarchies of classes: their chains, what these reach in ten steps through members of any depth, and the header.
HIERARCHY_SQL = f"""{classes_text_sql()}, {BASES_SQL.removeprefix(INDEX_SQL + ", ")},
held AS (
  SELECT m.parent_offset AS owner, m.type_ref FROM dies m WHERE m.tag = 'DW_TAG_subprogram' OR (m.tag = 'DW_TAG_member' AND m.name IS NOT NULL)
  UNION ALL SELECT s.parent_offset, p.type_ref FROM dies p JOIN dies s ON s.die_offset = p.parent_offset WHERE p.tag = 'DW_TAG_formal_parameter'
  UNION ALL SELECT s.parent_offset, m.type_ref FROM dies m JOIN dies s ON s.die_offset = m.parent_offset WHERE m.tag = 'DW_TAG_member' AND m.name IS NOT NULL AND s.tag IN ('DW_TAG_structure_type', 'DW_TAG_union_type') AND s.parent_offset IS NOT NULL
  UNION ALL SELECT u.parent_offset, m.type_ref FROM dies m JOIN dies s ON s.die_offset = m.parent_offset JOIN dies u ON u.die_offset = s.parent_offset WHERE m.tag = 'DW_TAG_member' AND s.tag = 'DW_TAG_structure_type' AND u.tag = 'DW_TAG_union_type'
), links AS (SELECT DISTINCT h.owner AS a, i.die_offset AS b FROM held h JOIN terminal t ON t.die_offset = h.type_ref JOIN dies d ON d.die_offset = t.terminal AND d.tag IN ({DECLARABLE}) AND d.name IS NOT NULL JOIN idx i ON i.src = d.src AND i.symbol = d.name AND i.tag NOT IN ('DW_TAG_enumeration_type', 'DW_TAG_typedef')),
roots AS (SELECT src, symbol AS root FROM idx WHERE tag = 'DW_TAG_class_type'),
named AS (SELECT src, root, root AS name, 0 AS depth FROM roots UNION ALL SELECT u.src, u.symbol, u.ancestor, u.depth FROM up u JOIN roots r ON r.src = u.src AND r.root = u.symbol),
chained AS (SELECT n.src, n.root, n.name, n.depth, i.die_offset FROM named n JOIN idx i ON i.src = n.src AND i.symbol = n.name),
reach AS (SELECT src, root, die_offset AS node, -1 AS depth FROM chained UNION SELECT x.src, x.root, l.b, x.depth + 1 FROM reach x JOIN links l ON l.a = x.node WHERE x.depth < 9),
beside AS (SELECT r.src, r.root, i.symbol AS name, min(r.depth) AS depth, min(r.node) AS die_offset FROM reach r JOIN idx i ON i.die_offset = r.node WHERE r.depth >= 0 AND NOT EXISTS (SELECT 1 FROM chained c WHERE c.src = r.src AND c.root = r.root AND c.name = i.symbol) GROUP BY r.src, r.root, i.symbol),
defined AS (SELECT *, false AS other FROM chained UNION ALL SELECT *, true FROM beside),
merged AS (SELECT d.src, d.root, u.name, arg_max(u.target, u.owner) AS target FROM defined d JOIN used u ON u.owner = d.die_offset GROUP BY d.src, d.root, u.name),
undefined AS (SELECT DISTINCT d.src, d.root, f.name FROM defined d JOIN forward f ON f.owner = d.die_offset
  WHERE NOT EXISTS (SELECT 1 FROM defined e WHERE e.src = d.src AND e.root = d.root AND e.name = f.name) AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.src = d.src AND m.root = d.root AND m.name = f.name)),
whole AS (SELECT d.src, d.root, string_agg(CASE WHEN NOT other THEN d.name END, ' -> ' ORDER BY d.depth DESC) AS chain, count(CASE WHEN NOT other THEN 1 END) AS long,
  string_agg(CASE WHEN NOT other THEN chr(10) || b.text END, chr(10) ORDER BY d.depth DESC) AS above, string_agg(CASE WHEN other THEN chr(10) || b.text END, chr(10) ORDER BY d.name) AS besides FROM defined d JOIN body b ON b.die_offset = d.die_offset GROUP BY d.src, d.root)
SELECT w.src, w.root AS symbol, 'ok' AS status, '#ifndef ' || g || chr(10) || '#define ' || g || chr(10) || chr(10) || '#include <cstdint>' || chr(10) || chr(10) || coalesce('// Type definitions from DWARF' || chr(10) || t.t || chr(10) || chr(10), '')
|| '// Generated complete inheritance hierarchy for: ' || w.root || chr(10) || chr(10) || '// Target Class: ' || w.root || chr(10) || '// - Size: ' || cast(b.byte_size AS varchar) || ' bytes' || chr(10) || '// - DIE Offset: ' || printf('0x%08x', b.die_offset % {NODE}) || chr(10) || split_part(b.packing, chr(10), 1) || chr(10)
|| CASE WHEN w.long > 1 THEN '// - Full Inheritance Chain: ' || w.chain || chr(10) ELSE '' END || coalesce(chr(10) || '// Forward declarations' || chr(10) || f.t || chr(10), '') || chr(10) || '// ========== Inheritance Hierarchy ==========' || chr(10) || w.above
|| coalesce(chr(10) || chr(10) || '// ========== Dependency Classes ==========' || chr(10) || w.besides, '') || chr(10) || chr(10) || '#endif // ' || g AS header
FROM (SELECT *, upper(regexp_replace(regexp_replace(regexp_replace(root, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) || '_HIERARCHY_H' AS g FROM whole) w
JOIN body b ON b.src = w.src AND b.symbol = w.root
LEFT JOIN (SELECT src, root, string_agg('typedef ' || target || ' ' || name || ';', chr(10) ORDER BY name) AS t FROM merged GROUP BY src, root) t ON t.src = w.src AND t.root = w.root
LEFT JOIN (SELECT src, root, string_agg('class ' || name || ';', chr(10) ORDER BY name) AS t FROM undefined GROUP BY src, root) f ON f.src = w.src AND f.root = w.root"""


@query(HIERARCHY_SQL, key="src")
def hierarchy_header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-hierarchy headers of every class (suppliers, customers and nations; what is no class is no root). Of a large
    table, records are made of what the classes reach only."""
    dies = bridge(spark, sf_dir)
    small = dies.count() <= SMALL
    symbols = graph_of(spark, sf_dir).index if small else store(spark, index.symbol_index(dies), "index")
    asked = symbols.where(F.col("tag") == S.CLASS).select("source_id", "symbol")
    return headers.hierarchy_headers(graph_of(spark, sf_dir) if small else headers.reached_graph(dies, asked, symbol_index=symbols), asked)


@query("SELECT o.die_offset, d.tag, d.name, d.cu_offset FROM (SELECT DISTINCT type_ref AS die_offset FROM dies WHERE type_ref IS NOT NULL UNION SELECT die_offset + 7 FROM dies) o JOIN dies d ON d.die_offset = o.die_offset", nodes=("cu_offset",))
def die_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries at offsets of which many hold nothing."""
    dies = bridge(spark, sf_dir)
    offsets = dies.where("type_ref is not null").select("source_id", F.col("type_ref").alias("die_offset")).union(dies.select("source_id", F.col("die_offset") + 7)).distinct()
    return lookup.by_offset(offsets, dies).select("source_id", "die_offset", "tag", "name", "cu_offset")


@query("SELECT c.die_offset, c.parent_offset, p.tag AS parent_tag, p.name AS parent_name FROM dies c JOIN dies p ON p.die_offset = c.parent_offset", nodes=("parent_offset",))
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.parents(bridge(spark, sf_dir))


@query(f"SELECT die_offset, CASE WHEN die_offset % {NODE} % 5 BETWEEN 1 AND 3 THEN 'unit' || cast(cu_offset % {NODE} AS varchar) || '_' || cast(die_offset % {NODE} % 5 AS varchar) || '.h' END AS decl_file FROM dies")
def declaration_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit has files 1 to 3, and entries name files 0 to 4."""
    dies = bridge(spark, sf_dir)
    files = units(dies).withColumn("file_idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("file_name", F.format_string("unit%d_%d.h", "cu_offset", "file_idx"))
    return lookup.declaration_files(dies.withColumn("decl_file_idx", (F.col("die_offset") % 5).cast("int")), files)


@query("SELECT src, min(cu_offset) AS first_unit, count(DISTINCT cu_offset) AS n, 4 AS version FROM dies GROUP BY src", key="src", nodes=("first_unit",))
def compile_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(bridge(spark, sf_dir))
    return rows.groupBy("source_id").agg(F.min("cu_offset").alias("first_unit"), F.count("*").alias("n")).join(dwarf_version(rows), "source_id")


@query(f"""SELECT src, symbol, die_offset FROM (SELECT d.src, s.s_name AS symbol, d.die_offset, row_number() OVER (PARTITION BY d.src, s.s_name ORDER BY CASE WHEN d.cu_offset % {NODE} = CASE WHEN s.s_suppkey % 2 = 0 THEN 3000000000 ELSE 2000000000 END THEN 0 ELSE 1 END, d.cu_offset, d.die_offset) AS rn
FROM supplier s JOIN dies d ON d.name = s.s_name AND d.tag IN ({SEARCHABLE})) WHERE rn = 1""", key="src", nodes=("die_offset",))
def targeted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, of which every third is declared in another unit first, searched with a hint that is right for half."""
    hint = F.when(F.col("s_suppkey") % 2 == 0, 3_000_000_000).otherwise(2_000_000_000).cast("bigint")
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("symbol"), hint.alias("hint"))
    return index.targeted_search(asked, bridge(spark, sf_dir))


@query(f"SELECT src, name AS symbol, arg_min(die_offset, (die_offset % {NODE} % 7, die_offset)) AS die_offset, arg_max(cu_offset, (die_offset % {NODE} % 7, cu_offset)) AS cu_offset FROM dies WHERE name IS NOT NULL GROUP BY src, name", key="src", nodes=("die_offset", "cu_offset"))
def symbol_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first writer's offset and the last writer's unit of each name, in an order that is not that of offsets."""
    rows = bridge(spark, sf_dir).where("name is not null").select("source_id", F.col("name").alias("symbol"), "die_offset", "cu_offset", (F.col("die_offset") % 7).alias("seq"))
    return index.first_writer(rows).join(index.last_writer(rows), ["source_id", "symbol"])


@query(f"{INDEX_SQL} SELECT DISTINCT cu_offset, symbol FROM idx", key="cu_offset")
def unit_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.unit_symbols(index.symbol_index(bridge(spark, sf_dir)))


@query(f"SELECT m.die_offset, m.type_ref, CASE WHEN d.tag IN ({NAMED}) THEN d.name END AS type_name, coalesce(d.tag IN ({DECLARABLE}) AND d.name IS NOT NULL, false) AS resolvable, coalesce(d.tag = 'DW_TAG_namespace', false) AS is_namespace FROM dies m LEFT JOIN dies d ON d.die_offset = m.type_ref WHERE m.type_ref IS NOT NULL", nodes=("type_ref",))
def resolvable_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reference: the named type at it, and whether that needs resolution."""
    dies = bridge(spark, sf_dir)
    at = ["source_id", "die_offset"]
    asked = dies.where("type_ref is not null").select("source_id", F.col("type_ref").alias("die_offset")).distinct()
    good = classify.resolvable(asked, dies).withColumn("resolvable", F.lit(True))
    spaces = dies.where(classify.is_namespace()).select(*at).withColumn("is_namespace", F.lit(True))
    found = classify.type_name_at(asked, dies).join(good, at, "left").join(spaces, at, "left").withColumnRenamed("die_offset", "type_ref")
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return dies.where("type_ref is not null").select(*at, "type_ref").join(found, ["source_id", "type_ref"]).select(*at, "type_ref", "type_name", false("resolvable"), false("is_namespace"))


@query(f"SELECT c.die_offset, coalesce(c.byte_size, 0) <= 64 AND count(m.die_offset) <= 10 AS simple FROM dies c LEFT JOIN dies m ON m.parent_offset = c.die_offset AND m.tag = 'DW_TAG_member' AND m.name IS NOT NULL WHERE c.tag IN ({SEARCHABLE}) AND c.tag <> 'DW_TAG_namespace' GROUP BY c.die_offset, c.byte_size")
def simple_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_of(spark, sf_dir).records
    return rows.select("source_id", "die_offset", classify.is_simple(F.col("byte_size"), F.size("members")).alias("simple"))


@query("""SELECT c.die_offset, coalesce(string_agg(CASE WHEN p.tag = 'DW_TAG_template_type_param' THEN p.name || '=' || t.name END, ';' ORDER BY p.die_offset), '') AS types, coalesce(string_agg(CASE WHEN p.tag = 'DW_TAG_template_value_param' THEN p.name || ':void=' || cast(p.const_value AS varchar) END, ';' ORDER BY p.die_offset), '') AS vals
FROM dies c JOIN dies p ON p.parent_offset = c.die_offset AND p.tag IN ('DW_TAG_template_type_param', 'DW_TAG_template_value_param') LEFT JOIN dies t ON t.die_offset = p.type_ref GROUP BY c.die_offset""")
def template_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_of(spark, sf_dir).records.where(F.size("template_type_params") + F.size("template_value_params") > 0)
    return rows.select("source_id", "die_offset", text_of("template_type_params", lambda p: F.concat(p["name"], F.lit("="), p["default_type"])).alias("types"), text_of("template_value_params", lambda p: F.concat(p["name"], F.lit(":"), p["type_name"], F.lit("="), p["default_value"])).alias("vals"))


PRIMITIVE_SQL = ", ".join(f"'{x}'" for x in S.PRIMITIVE_TYPEDEFS)
MORE_SQL = ", ".join(f"'{x}'" for x in S.MORE_PRIMITIVES)
ASKED_SQL = "asked AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'td_' || cast(c_custkey AS varchar) WHEN 1 THEN 'u32' WHEN 2 THEN 'wchar_t' ELSE c_name END AS name FROM customer)"


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typedefs, a primitive name, one that stands for itself in full hierarchies only, and names of classes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.col("c_custkey") % 4
    return c.select(F.when(kind == 0, F.concat(F.lit("td_"), F.col("c_custkey").cast("string"))).when(kind == 1, "u32").when(kind == 2, "wchar_t").otherwise(F.col("c_name")).alias("name")).distinct()


@query(f"{DEFS_SQL}, {ASKED_SQL}, srcs AS (SELECT DISTINCT src FROM dies) SELECT s.src, a.name, CASE WHEN a.name IN ({PRIMITIVE_SQL}) THEN a.name ELSE d.underlying END AS underlying, a.name IN ({PRIMITIVE_SQL}, {MORE_SQL}) AS own FROM asked a CROSS JOIN srcs s LEFT JOIN defs d ON d.src = s.src AND d.name = a.name WHERE a.name IN ({PRIMITIVE_SQL}) OR d.name IS NOT NULL", key="src")
def find_typedef(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    names = asked_names(spark, sf_dir).withColumn("source_id", F.explode(F.array(*map(F.lit, SOURCES))))
    return chains.found_typedefs(names, chains.typedefs(dies)).select("source_id", "name", "underlying", F.col("name").isin(chains.primitive_names(True)).alias("own"))


@query(f"{DEFS_SQL}, {NAMES_SQL} SELECT DISTINCT m.parent_offset AS owner, e.resolved FROM dies m JOIN names n ON n.die_offset = m.type_ref JOIN ends e ON e.src = m.src AND e.name = n.type_name WHERE m.tag = 'DW_TAG_member'", key="owner")
def member_typedefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.member_typedefs(bridge(spark, sf_dir))


@query(f"{STEPS_SQL}, {INDEX_SQL}, {ASKED_SQL} SELECT i.src, a.name, t.name AS base FROM asked a JOIN idx i ON i.symbol = a.name JOIN terminal x ON x.die_offset = i.die_offset JOIN dies t ON t.die_offset = x.terminal", key="src")
def base_type_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    return chains.base_type_of(asked_names(spark, sf_dir), index.symbol_index(dies), dies)


@query(f"""{DEFS_SQL}, {NAMES_SQL}, {TYPED_SQL}, base AS (SELECT DISTINCT t.src, t.owner, regexp_replace(regexp_replace(n.type_name, '^const ', ''), '[*]+$', '') AS name FROM typed t JOIN names n ON n.die_offset = t.type_ref),
direct AS (SELECT b.src, b.owner, b.name, d.underlying AS target FROM base b JOIN defs d ON d.src = b.src AND d.name = b.name),
more AS (SELECT DISTINCT d.src, d.owner, d.target AS name FROM direct d JOIN defs e ON e.src = d.src AND e.name = d.target WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.owner = d.owner AND x.name = d.target))
SELECT owner, name, target FROM direct UNION ALL SELECT m.owner, m.name, e.resolved FROM more m JOIN ends e ON e.src = m.src AND e.name = m.name""", key="owner")
def used_typedefs_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    parts = graph.parts.where(F.col("part").isin("member", "result", "parameter")).select("source_id", "owner", "type_name")
    return chains.used_typedefs_legacy(parts, chains.typedefs(graph.dies, graph.types.names))


@plain("SELECT s_suppkey, '#ifndef ' || upper(s_name) || 'X_H' || chr(10) || '#define ' || upper(s_name) || 'X_H' || chr(10) || chr(10) || '// Class ''' || s_name || 'x'' not found in DWARF information' || chr(10) || '// Generated from DWARF debug information using pyelftools' || chr(10) || chr(10) || '#endif // ' || upper(s_name) || 'X_H' || chr(10) AS header FROM supplier")
def missing_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of symbols that no binary has."""
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat("s_name", F.lit("x")).alias("symbol"))
    found = index.find(asked, index.symbol_index(bridge(spark, sf_dir))).where("die_offset is null")
    return found.select("s_suppkey", render.missing_header(F.col("symbol")).alias("header"))


@plain("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey % 2 = 1 THEN 'ps3' WHEN s_suppkey % 3 = 1 AND s_nationkey % 2 = 0 THEN 'ps4' ELSE 'unknown' END AS platform FROM supplier")
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = F.when(F.col("s_suppkey") % 3 == 0, "EM_PPC64").when(F.col("s_suppkey") % 3 == 1, "EM_X86_64").otherwise("EM_ARM")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", platform_of(machine, F.col("s_nationkey") % 2 == 0).alias("platform"))


@query(f"{INDEX_SQL}, units AS (SELECT cu_offset, name AS symbol FROM dies WHERE tag IN ({SEARCHABLE}) AND name IS NOT NULL), a AS (SELECT DISTINCT cu_offset, symbol FROM idx), b AS (SELECT DISTINCT cu_offset, symbol FROM units) SELECT cu_offset, symbol, 'index' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT cu_offset, symbol, 'units' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", key="cu_offset")
def cache_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    dies = bridge(spark, sf_dir)
    by_unit = dies.where(F.col("tag").isin(S.SEARCHABLE) & F.col("name").isNotNull()).select("source_id", "cu_offset", F.col("name").alias("symbol"))
    return index.mismatched(index.symbol_index(dies), by_unit)


@query(f"{INDEX_SQL} SELECT src, count(*) AS symbols, count(DISTINCT cu_offset) AS units FROM idx GROUP BY src", key="src")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(index.symbol_index(bridge(spark, sf_dir)))


@query(f"SELECT cu_offset, count(*) AS n FROM dies WHERE tag IN ({SEARCHABLE}) AND name IS NOT NULL GROUP BY cu_offset", key="cu_offset")
def discover_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.discovered(bridge(spark, sf_dir))


@query(f"{INDEX_SQL}, asked AS (SELECT DISTINCT trim(x) AS symbol FROM (SELECT unnest(string_split(s_name || ', ' || cast(s_suppkey AS varchar) || ',', ',')) AS x FROM supplier) WHERE trim(x) <> '') SELECT CASE WHEN i.symbol IS NULL THEN 'not_found' ELSE 'ok' END AS status, count(*) AS n FROM asked a LEFT JOIN idx i ON i.symbol = a.symbol GROUP BY 1", key=None)
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.explode(V.symbol_list(F.concat("s_name", F.lit(", "), F.col("s_suppkey").cast("string"), F.lit(",")))).alias("symbol")).distinct()
    found = index.find(asked, index.symbol_index(bridge(spark, sf_dir)))
    return headers.summary(found.select(F.when(F.col("die_offset").isNull(), "not_found").otherwise("ok").alias("status")))
