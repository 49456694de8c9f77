"""Operators over small hand-written graphs of entries."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom import schema as S
from typeloom.functions.values import file_stem
from typeloom.operators import chains, closure, index, layout, lookup, records, render
from typeloom.plans import headers

def dies(spark, *rows):
    """Rows of dicts; the offset's order is the order of the rows unless given."""
    fields = T.StructType.fromDDL(S.DIES).fields
    full = [tuple({"source_id": "t", "cu_offset": 0}.get(f.name) if f.name not in r else r[f.name] for f in fields) for r in rows]
    return spark.createDataFrame(full, T.StructType(fields))


def die(offset, tag, name=None, parent=None, **more):
    return {"die_offset": offset, "tag": f"DW_TAG_{tag}", "name": name, "parent_offset": parent, **more}


@pytest.fixture(scope="module")
def widget(spark):
    return dies(
        spark,
        die(1, "base_type", "int", byte_size=4), die(2, "typedef", "u32", type_ref=3), die(3, "base_type", "unsigned int", byte_size=4),
        die(4, "class_type", "Base", byte_size=8), die(5, "class_type", "Gadget", byte_size=16),
        die(6, "pointer_type", type_ref=7), die(7, "const_type", type_ref=8), die(8, "typedef", "GadgetT", type_ref=5),
        die(9, "pointer_type"), die(10, "array_type", type_ref=1), die(11, "subrange_type", parent=10, upper_bound=127), die(12, "subrange_type", parent=10, count_attr=2),
        die(20, "class_type", "ns::Widget", byte_size=32, decl_line=7, decl_file="w.h"),
        die(21, "inheritance", parent=20, type_ref=4),
        die(22, "member", "count", 20, type_ref=2, member_loc=(8, None)),
        die(23, "member", "owner", 20, type_ref=6, member_loc=(None, [35, 16])),
        die(24, "member", "VERSION", 20, type_ref=2, is_external=True, is_declaration=True, const_value=3),
        die(25, "member", None, 20, type_ref=26, member_loc=(24, None)),
        die(26, "union_type", None, 20, byte_size=8), die(27, "member", "bits", 26, type_ref=1, member_loc=(0, None)),
        die(28, "enumeration_type", "Mode", 20, byte_size=4), die(29, "enumerator", "Off", 28, const_value=0), die(30, "enumerator", "On", 28, const_value=1),
        die(31, "subprogram", "ns::Widget", 20), die(32, "formal_parameter", "this", 31, type_ref=9, is_artificial=True), die(33, "formal_parameter", None, 31, type_ref=2),
        die(34, "subprogram", "size", 20, type_ref=2, has_virtuality=True),
        die(35, "structure_type", "Pair", 20, byte_size=8), die(36, "member", "b", 35, type_ref=1, member_loc=(4, None)), die(37, "member", "a", 35, type_ref=1, member_loc=(0, None)),
        die(38, "member", "grid", 20, type_ref=10),
    )


def pairs(frame, a, b):
    return {r[a]: r[b] for r in frame.collect()}


def test_N2_type_names(widget):
    names = pairs(chains.type_names(widget), "die_offset", "type_name")
    assert names[6] == "const GadgetT*" and names[9] == "void*" and names[10] == "int[128][2]" and names[26] == "union_type" and names[2] == "u32"


def test_J8_terminal(widget):
    ends = pairs(chains.terminal_types(widget), "die_offset", "terminal")
    assert ends[6] == 5 and ends[2] == 3 and ends[9] is None and ends[10] == 1 and ends[20] == 20


def test_J8_circle_and_length(spark):
    ring = [die(1, "pointer_type", type_ref=2), die(2, "pointer_type", type_ref=1)]
    line = [die(k, "pointer_type", type_ref=k + 1) for k in range(100, 125)] + [die(125, "base_type", "int")]
    ends = pairs(chains.terminal_types(dies(spark, *ring, *line)), "die_offset", "terminal")
    assert ends[1] is None and ends[2] is None
    assert ends[106] == 125 and ends[105] is None  # 20 entries at most


def test_N5_typedef_circle(spark):
    defs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "int")], "name string, underlying string")
    assert pairs(chains.typedef_chains(defs), "name", "resolved") == {"a": "a", "b": "b", "c": "int", "d": "int"}


def test_R1_record(widget):
    r = records.class_records(widget).where("die_offset = 20").collect()[0]
    assert [m["name"] for m in r["members"]] == ["count", "owner", "VERSION", "grid"]
    assert r["members"][1]["offset"] == 16 and r["members"][1]["type_offset"] == 5 and r["members"][2]["is_static"]
    assert r["base_classes"] == ["Base"] and [u["name"] for u in r["unions"]] == [""] and r["unions"][0]["members"][0]["name"] == "bits"
    assert [(m["name"], m["is_constructor"], [p["name"] for p in m["parameters"]]) for m in r["methods"]] == [("ns::Widget", True, ["__artificial__", "param"]), ("size", False, [])]
    assert [(v["name"], v["value"]) for v in r["enums"][0]["enumerators"]] == [("Off", 0), ("On", 1)]


HEADER = """#ifndef NS_WIDGET_H
#define NS_WIDGET_H

#include <cstdint>

// Type definitions from DWARF
typedef unsigned int u32;

// Generated from DWARF debug information using pyelftools
// Target symbol: ns::Widget

// DWARF Debug Information:
// - Size: 32 bytes
// - DIE Offset: 0x00000014
// - Source CU: 0x00000000
// - Suggested Packing: 8 bytes
// - Total Padding: 12 bytes
// - Declaration: w.h
// - Line: 7
// - Direct Inheritance: Base -> ns::Widget


// ns::Widget - DWARF Information:
// - Size: 32 bytes
// - DIE Offset: 0x00000014
// - Suggested Packing: 8 bytes
// - Total Padding: 12 bytes
// - Declaration: w.h
//   Line: 7
// - Inherits from: Base
class ns::Widget : public Base
{
public:
    // Enum Mode (4 bytes)
    enum class Mode
    {
        Off = 0,
        On = 1
    };

public:
    // Struct Pair (8 bytes)
    struct Pair
    {
        int a;  // offset 0
        int b;  // offset 4
    };

public:
    // Union  (8 bytes)
    union
    {
        int bits;  // offset 0
    };

public:
    virtual u32 size();
public:
    ns::Widget(u32 param);
public:
    u32 count;  // offset: 0x8
    const GadgetT* owner;  // offset: 0x10
    int grid[128][2];

    // Static members
    static const u32 VERSION = 3;
};

#endif // NS_WIDGET_H"""


def test_T1_golden_header(spark, widget):
    graph = headers.Graph(widget)
    asked = spark.createDataFrame([("ns::Widget",), ("nowhere",)], "symbol string")
    got = {r["symbol"]: (r["status"], r["header"]) for r in headers.generate(graph, asked).collect()}
    want = HEADER.replace("typedef unsigned int u32;", "typedef Gadget GadgetT;\ntypedef unsigned int u32;")
    assert got["ns::Widget"][1] == want
    assert got["nowhere"] == ("not_found", "#ifndef NOWHERE_H\n#define NOWHERE_H\n\n// Class 'nowhere' not found in DWARF information\n// Generated from DWARF debug information using pyelftools\n\n#endif // NOWHERE_H\n")


def test_T2_hierarchy(spark, widget):
    graph = headers.Graph(widget)
    text = headers.generate(graph, spark.createDataFrame([("ns::Widget",)], "symbol string"), full_hierarchy=True).collect()[0]["header"]
    assert "// - Full Inheritance Chain: Base -> ns::Widget" in text
    assert text.index("class Base") < text.index("class ns::Widget") < text.index("Dependency Classes") < text.index("class Gadget")


def test_W2_W3_layout(spark):
    rows = [(1, 0, "c", "char", 0), (1, 1, "i", "int", 16), (2, 0, "p", "char*", 0), (2, 1, "i", "int", 8), (2, 2, "c", "char", 12), (2, 3, "d", "double", 16), (4, 0, "c", "char", 4)]
    frame = spark.createDataFrame(rows, "class_offset bigint, seq bigint, name string, type_name string, offset bigint")
    classes = spark.createDataFrame([(1, 32), (2, 24), (3, 40), (4, 5)], "class_offset bigint, byte_size bigint")
    got = {r[0]: tuple(r)[1:] for r in layout.packing(frame, classes).collect()}
    assert got == {1: (8, 27, 5, 32), 2: (8, 3, 21, 24), 3: (1, 0, 0, 40), 4: (1, 0, 1, 5)}
    assert {tuple(r) for r in layout.gaps(frame, classes).collect()} == {(1, "c", 1, 15), (1, "i", 20, 12), (2, "c", 13, 3), (4, "start", 0, 4)}


def test_Q4_definition_before_declaration(spark):
    frame = dies(spark, die(1, "class_type", "A", is_declaration=True), die(9, "class_type", "A", byte_size=4, cu_offset=8), die(3, "class_type", "B"))
    assert pairs(index.symbol_index(frame), "symbol", "die_offset") == {"A": 9, "B": 3}


def test_J3_units(spark):
    units = spark.createDataFrame([(0, 100), (100, 5000), (5000, 5001)], "cu_offset bigint, cu_end bigint")
    offsets = spark.createDataFrame([(0,), (99,), (100,), (4999,), (5000,), (5001,)], "die_offset bigint")
    assert pairs(lookup.units_of(offsets, units, grid=64), "die_offset", "cu_offset") == {0: 0, 99: 0, 100: 100, 4999: 100, 5000: 5000}


def test_J15_closure_against_plain_search(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    frame = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    roots = spark.createDataFrame([(r, r) for r in range(30)], "root bigint, node bigint")
    want = set()
    for r in range(30):
        seen, now = {r}, {r}
        for depth in range(4):
            now = {b for a, b in edges if a in now} - seen
            seen |= now
            want |= {(r, n, depth) for n in now}
    assert {tuple(x) for x in closure.closure(roots, frame, deepest=4).collect()} == want


def test_C8_integrity(spark):
    a = spark.createDataFrame([("A", 1, 0), ("B", 2, 0)], S.SYMBOL_INDEX)
    assert index.checked(a, index.unit_symbols(a)).count() == 2
    with pytest.raises(ValueError, match="corrupted"):
        index.checked(a, index.unit_symbols(a).where("symbol = 'A'"))


def test_C11_hit_rate(spark):
    out = spark.createDataFrame([(1, 2), (0, 0)], "h int, m int").select(index.hit_rate(F.col("h"), F.col("m")).alias("r")).collect()
    assert [r["r"] for r in out] == ["33.3%", "0.0%"]


def test_K2_index_is_written_once(spark, tmp_path):
    a = spark.createDataFrame([("A", 1, 0)], S.SYMBOL_INDEX)
    at = f"file://{tmp_path}/index"
    assert headers.load_index(spark, at).count() == 0
    assert headers.save_index(a, at) and not headers.save_index(a, at)
    assert headers.load_index(spark, at).count() == 1


@pytest.fixture(scope="module")
def two(spark):
    """Two binaries with the same offsets: class A {int x} and class B {float y} at 2, and both have a class Same."""
    of = lambda source, kind, size, cls, member: [
        die(1, "base_type", kind, byte_size=size, source_id=source), die(2, "class_type", cls, byte_size=size, source_id=source), die(3, "member", member, 2, type_ref=1, member_loc=(0, None), source_id=source),
        die(4, "class_type", "Same", byte_size=size * 2, source_id=source), die(5, "inheritance", parent=4, type_ref=2, source_id=source), die(6, "pointer_type", type_ref=2, source_id=source), die(7, "member", "p", 4, type_ref=6, member_loc=(0, None), source_id=source),
        die(8, "typedef", "word", type_ref=1, source_id=source), die(9, "member", "w", 4, type_ref=8, member_loc=(8, None), source_id=source),
    ]
    return dies(spark, *of("one", "int", 4, "A", "x"), *of("two", "float", 8, "B", "y"))


def test_two_binaries_headers(spark, two):
    graph = headers.Graph(two)
    asked = spark.createDataFrame([("A",), ("B",), ("Same",), ("C",)], "symbol string")
    got = {(r["source_id"], r["symbol"]): r["header"] for r in headers.generate(graph, asked).collect()}
    assert set(got) == {("one", "A"), ("two", "B"), ("one", "Same"), ("two", "Same"), (None, "C")}
    assert got["one", "A"].count("int x;  // offset: 0x0") == 1 and "float" not in got["one", "A"] and "class B" not in got["one", "A"]
    assert got["two", "B"].count("float y;  // offset: 0x0") == 1
    assert "class Same : public A" in got["one", "Same"] and "A* p;" in got["one", "Same"] and "typedef int word;" in got["one", "Same"] and "class A;" in got["one", "Same"]
    assert "class Same : public B" in got["two", "Same"] and "B* p;" in got["two", "Same"] and "typedef float word;" in got["two", "Same"] and "- Size: 16 bytes" in got["two", "Same"]
    whole = {(r["source_id"], r["symbol"]): r["header"] for r in headers.generate(graph, asked, full_hierarchy=True).collect()}
    assert set(whole) == set(got) and "// - Full Inheritance Chain: A -> Same" in whole["one", "Same"] and "B -> Same" in whole["two", "Same"]
    # asked for by source
    one = headers.generate(graph, spark.createDataFrame([("two", "Same"), ("two", "A")], "source_id string, symbol string")).collect()
    assert {(r["source_id"], r["symbol"], r["status"]) for r in one} == {("two", "Same", "ok"), ("two", "A", "not_found")}


def test_two_binaries_lookups(spark, two):
    assert {(r["source_id"], r["symbol"]): r["die_offset"] for r in index.symbol_index(two).collect()} == {(s, n): o for s, c, k in (("one", "A", "int"), ("two", "B", "float")) for n, o in ((k, 1), (c, 2), ("Same", 4), ("word", 8))}
    assert {(r["source_id"], r["die_offset"], r["target_name"]) for r in lookup.dereferenced(two).collect()} >= {("one", 3, "int"), ("two", 3, "float"), ("one", 6, "A"), ("two", 6, "B")}
    assert lookup.dereferenced(two).count() == 12 and lookup.children(two, two).count() == 8 and lookup.parents(two).count() == 8
    assert {(r["source_id"], r["symbol"], r["ancestor"]) for r in chains.inheritance(two, index.symbol_index(two)).collect()} == {("one", "Same", "A"), ("two", "Same", "B")}


def test_J11_long_chains_and_circles(spark):
    """A chain of 200 classes is whole, a circle is cut where it closes."""
    line = [x for k in range(200) for x in (die(1000 + k, "class_type", f"c{k}", byte_size=8), die(3000 + k, "inheritance", parent=1000 + k, type_ref=1001 + k))][:-1]
    ring = [x for k in range(5) for x in (die(5000 + k, "class_type", f"r{k}", byte_size=8), die(6000 + k, "inheritance", parent=5000 + k, type_ref=5000 + (k + 1) % 5))]
    tail = [die(7000, "class_type", "t", byte_size=8), die(7001, "inheritance", parent=7000, type_ref=5002)]
    frame = dies(spark, *line, *ring, *tail)
    got = {}
    for r in chains.inheritance(frame, index.symbol_index(frame)).collect():
        got.setdefault(r["symbol"], {})[r["depth"]] = r["ancestor"]
    assert got["c0"] == {k: f"c{k}" for k in range(1, 200)} and got["c198"] == {1: "c199"}
    assert got["r3"] == {1: "r4", 2: "r0", 3: "r1", 4: "r2"} and got["t"] == {1: "r2", 2: "r3", 3: "r4", 4: "r0", 5: "r1"}


def test_K1_files_of_like_names(spark, tmp_path):
    rows = [("a::b", "ok", "1"), ("a__b", "ok", "2"), ("A::B", "ok", "3")]
    headers.export_files(spark.createDataFrame(rows, "symbol string, status string, header string"), str(tmp_path), "ps4")
    assert sorted(p.read_text() for p in (tmp_path / "ps4").iterdir()) == ["1", "2", "3"]


def test_reached_graph(spark, widget, monkeypatch):
    """hierarchies from what their symbols reach equal those from the whole graph, and what they do not reach is in no record."""
    from typeloom.operators import slices

    more = dies(
        spark,
        # nothing refers to Far; Near is reached by a base's typedef and a text; a union stands where an unnamed member is
        die(50, "structure_type", "Far", byte_size=8), die(51, "member", "w", 50, type_ref=20, member_loc=(0, None)),
        die(60, "class_type", "Near", byte_size=8), die(61, "member", "u", 60, type_ref=2, member_loc=(0, None)), die(62, "typedef", "NearT", type_ref=60),
        die(63, "class_type", "Root", byte_size=24), die(64, "inheritance", parent=63, type_ref=62), die(65, "member", "g", 63, type_ref=6, member_loc=(8, None)),
        die(66, "member", None, 63, type_ref=68, member_loc=(16, None)),
        die(67, "structure_type", "Holder", byte_size=8), die(68, "union_type", None, 67, byte_size=8), die(69, "member", "v", 68, type_ref=1, member_loc=(0, None)),
        die(70, "class_type", "Gadget", byte_size=0), die(71, "typedef", "GadgetT", type_ref=1),
    )
    table = widget.unionByName(more)
    asked = spark.createDataFrame([("Root",), ("ns::Widget",), ("none",)], "symbol string")
    rows = lambda graph: sorted(map(str, headers.hierarchy_headers(graph, asked).select("source_id", "symbol", "status", "header").collect()))
    want = rows(headers.Graph(table))
    monkeypatch.setattr(slices, "LARGEST_SHARE", 1.0)
    part = headers.reached_graph(table, asked)
    assert rows(part) == want and len(want) == 3
    names = {r["name"] for r in part.records.select("name").collect()}
    assert "Far" not in names and {"Root", "Near", "Gadget", "ns::Widget"} <= names
    monkeypatch.setattr(slices, "LARGEST_SHARE", 0.0)
    assert slices.needed(table, index.symbol_index(table), asked) is None


def test_no_case_mapping_of_constants(spark, widget):
    """no lower() or upper() over a constant, which the driver folds by loading ICU's tables (3 GB of garbage at once); the
    texts are as with them."""
    types = records.Types(widget)
    plan = lambda frame: frame._jdf.queryExecution().analyzed().toString()
    assert "lower(" not in plan(records.members(widget, types))
    stems = spark.createDataFrame([("ns::Ünit<a-b>",), ("",), ("x_é9.z",)], "name string").select(file_stem(F.col("name")).alias("s"), render.capitals(file_stem(F.col("name"))).alias("up"))
    assert "upper(" not in plan(stems)
    assert all(r["up"] == r["s"].upper() for r in stems.collect())
    named = dies(spark, die(1, "class_type", "My_UNIon", byte_size=8), die(2, "class_type", "Other", byte_size=8), die(3, "class_type", "Holder", byte_size=16), die(4, "member", None, 3, type_ref=1), die(5, "member", None, 3, type_ref=2))
    assert [r["die_offset"] for r in records.members(named, records.Types(named)).collect()] == [4]


def test_rounds_are_one_scan(spark):
    """what a closure's and a chain's rounds wrote is read by one scan."""
    scans = lambda frame: frame._jdf.queryExecution().analyzed().toString().count("Relation")
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "src bigint, dst bigint")
    far = closure.closure(spark.createDataFrame([(0, 0)], "root bigint, node bigint"), edges)
    assert scans(far) == 1 and sorted((r["node"], r["depth"]) for r in far.collect()) == [(k, k - 1) for k in range(1, 7)]
    line = spark.createDataFrame([(k, k + 1 if k < 9 else None, "<", ">") for k in range(10)], "node bigint, next bigint, prefix string, suffix string")
    ends = chains.followed(line)
    assert scans(ends) <= 2 and {(r["node"], r["last"], r["prefix"], r["suffix"]) for r in ends.collect()} == {(k, 9, "<" * (10 - k), ">" * (10 - k)) for k in range(10)}
