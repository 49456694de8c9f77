"""Truth tables of the scalar functions."""

from pyspark.sql import functions as F

from typeloom.functions import values as V


def column(spark, rows, kind, f):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}")
    return [r["y"] for r in frame.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_V1_location(spark):
    rows = [(0, None), (-4, None), (None, [35, 8]), (None, [4]), (None, [35]), (None, []), (None, [99, 4]), None]
    out = column(spark, rows, "struct<int_value:bigint,expr:array<bigint>>", V.location_offset)
    assert out == [0, -4, 8, 4, 35, None, None, None]


def test_W1_member_size(spark):
    rows = ["char", "bool", "int", "float", "double", "long", "Foo*", "Foo &", "char[10]", "int[5]", "double[3]", "Foo", "int[abc]", "char[]", "type[", "const int", "char*[4]", "int[2][3]"]
    assert column(spark, rows, "string", V.member_size) == [1, 1, 4, 4, 8, 8, 8, 8, 10, 20, 24, 8, 8, 8, 8, 4, 32, 8]


def test_N8_base_text(spark):
    rows = ["const int*", "const T&", "A::B*", "V<int>*", "const volatile u8 **", "T[3][4]", "int"]
    assert column(spark, rows, "string", V.base_text) == ["int", "T", "A::B", "V<int>", "u8", "T", "int"]


def test_N17_legacy(spark):
    assert column(spark, ["const int*", "const T&", "A"], "string", V.base_text_legacy) == ["int", "T", "A"]


def test_V2_V3_names(spark):
    rows = ["ns::Widget<int>", "", "::", "a  b", "x" * 250, "_a_", None]
    assert column(spark, rows, "string", V.file_stem) == ["ns_Widget_int", "unnamed", "unnamed", "a_b", "x" * 200, "a", "unnamed"]
    assert column(spark, ["a b"], "string", lambda c: V.header_name(c, "v2")) == ["a_b_v2.h"]


def test_V4_hex(spark):
    assert column(spark, [26], "bigint", V.hex8) == ["0x0000001a"]
    assert column(spark, [26, None], "bigint", V.hexed) == ["0x1a", None]


def test_S8_symbol_list(spark):
    assert column(spark, [" A, B ,,C10,1"], "string", V.symbol_list) == [["A", "B", "C10", "1"]]
