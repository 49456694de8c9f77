"""Readers over texts and a tiny binary written here."""

import struct

import pytest
from pyspark.sql import functions as F

from typeloom.operators import chains
from typeloom.sources import binary, dumptext, elf

VERBOSE = """0x00000000: Compile Unit: length = 0x00000050, format = DWARF32, version = 0x0004, abbr_offset = 0x0000, addr_size = 0x08 (next unit at 0x00000054)

0x0000000b: DW_TAG_compile_unit [1] *
              DW_AT_name [DW_FORM_strp]\t( .debug_str[0x00000035] = "a.cpp")

0x0000001e:   DW_TAG_class_type [2] * (0x0000000b)
                DW_AT_name [DW_FORM_strp]\t( .debug_str[0x0000007c] = "Box")
                DW_AT_byte_size [DW_FORM_data1]\t(0x10)

0x00000025:     DW_TAG_member [3]   (0x0000001e)
                  DW_AT_name [DW_FORM_strp]\t( .debug_str[0x00000080] = "size")
                  DW_AT_type [DW_FORM_ref4]\t(cu + 0x0030 => {0x00000030} "int")
                  DW_AT_data_member_location [DW_FORM_data1]\t(0x08)

0x0000002b:     NULL

0x00000030:   DW_TAG_base_type [4]   (0x0000000b)
                DW_AT_name [DW_FORM_strp]\t( .debug_str[0x00000089] = "int")
                DW_AT_byte_size [DW_FORM_data1]\t(0x04)
"""
TERSE = """0x0000001e:   DW_TAG_class_type
                DW_AT_name\t("Box")
                DW_AT_byte_size\t(0x10)

0x00000025:     DW_TAG_member
                  DW_AT_name\t("size")
                  DW_AT_type\t(0x00000030 "int")
                  DW_AT_external\t(true)
                  DW_AT_declaration\t(true)
"""
OTHER = """< 1><0x0000001e GOFF=0x0000011e>    DW_TAG_class_type <abbrev 53 ABGOFF = 0x0000049c count = 0x00000005>
                                      DW_AT_name                  Box
                                      DW_AT_byte_size             16
< 2><0x00000025 GOFF=0x00000125>      DW_TAG_member <abbrev 47 ABGOFF = 0x00000446 count = 0x00000005>
                                        DW_AT_name                  size
                                        DW_AT_type                  <0x00000030 GOFF=0x00000130> Refers to: int
                                        DW_AT_data_member_location  8
"""


def test_S12_dumps(spark, tmp_path):
    for name, text in (("a", VERBOSE), ("b", TERSE), ("c", OTHER)):
        (tmp_path / f"{name}.txt").write_text(text)
    rows = {(r["source_id"][-5], r["die_offset"]): r for r in dumptext.read_dump(spark, f"file://{tmp_path}").collect()}
    assert sorted(rows) == [("a", 11), ("a", 30), ("a", 37), ("a", 48), ("b", 30), ("b", 37), ("c", 0x11E), ("c", 0x125)]
    a, b, c = rows["a", 37], rows["b", 37], rows["c", 0x125]
    assert (a["name"], a["parent_offset"], a["type_ref"], a["member_loc"]["int_value"]) == ("size", 30, 48, 8) and rows["a", 30]["byte_size"] == 16 and rows["a", 30]["has_children"]
    assert (b["name"], b["parent_offset"], b["type_ref"], b["is_external"]) == ("size", 30, 48, True)
    assert (c["name"], c["parent_offset"], c["type_ref"], c["cu_offset"], c["member_loc"]["int_value"]) == ("size", 0x11E, 0x130, 0x100, 8)


def elf_file(little: bool, machine: int, wide: bool = True) -> bytes:
    """A file with one unit: a class Box {int size @8} of DWARF 4, and a section of an unknown type."""
    e = "<" if little else ">"
    abbrev = bytes([1, 0x11, 1, 0, 0, 2, 0x02, 1, 0x03, 0x08, 0x0B, 0x0B, 0, 0, 3, 0x0D, 0, 0x03, 0x0E, 0x49, 0x13, 0x38, 0x0A, 0, 0, 4, 0x24, 0, 0x03, 0x08, 0x0B, 0x0B, 0, 0, 0])
    # offsets in the unit: 11 compile unit, 12 class, 18 member, 30 end of children, 31 int
    body = bytes([1, 2]) + b"Box\0" + bytes([16, 3]) + struct.pack(e + "I", 0) + struct.pack(e + "I", 31) + bytes([2, 0x23, 8, 0, 4]) + b"int\0" + bytes([4, 0])
    head = struct.pack(e + "HIB", 4, 0, 8)
    info = struct.pack(e + "I", len(head) + len(body)) + head + body
    parts = {".debug_info": info, ".debug_abbrev": abbrev, ".debug_str": b"size\0", ".odd": b"?"}
    names = b"\0" + b"".join(n.encode() + b"\0" for n in [*parts, ".shstrtab"])
    blobs, at, table = [], 64 if wide else 52, [(0, 0, 0, 0)]
    for n, data in [*parts.items(), (".shstrtab", names)]:
        table.append((names.index(n.encode() + b"\0"), 0x61000001 if n == ".odd" else 1, at, len(data)))
        blobs.append(data)
        at += len(data)
    word = "Q" if wide else "I"
    rows = b"".join(struct.pack(f"{e}II{word}{word}{word}{word}II{word}{word}", n, kind, 0, 0, o, s, 99, 0, 1, 0) for n, kind, o, s in table)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if little else 2, 1]) + bytes(9)
    header = ident + struct.pack(f"{e}HHI{word}{word}{word}IHHHHHH", 2, machine, 1, 0, 0, at, 0, 64, 0, 0, 64 if wide else 40, len(table), len(table) - 1)
    return header + b"".join(blobs) + rows


@pytest.mark.parametrize(("little", "machine", "wide", "platform"), [(True, 62, True, "ps4"), (False, 21, True, "ps3"), (True, 62, False, "ps4"), (True, 40, True, "unknown")])
def test_S1_binary(spark, tmp_path, little, machine, wide, platform):
    (tmp_path / "x.elf").write_bytes(elf_file(little, machine, wide))
    binary.register(spark)
    for frame in (spark.read.format("dwarf").load(str(tmp_path / "x.elf")), binary.read_binaries(spark, f"file://{tmp_path}/x.elf")):
        rows = {r["name"]: r for r in frame.collect()}
        assert rows["size"]["parent_offset"] == rows["Box"]["die_offset"] == 12 and rows["size"]["type_ref"] == rows["int"]["die_offset"] == 31
        assert rows["size"]["member_loc"]["expr"] == [35, 8] and rows["Box"]["byte_size"] == 16 and rows["Box"]["platform"] == platform
        assert {r["type_name"] for r in chains.resolved_names(frame.where("tag = 'DW_TAG_member'"), chains.type_names(frame)).collect()} == {"int"}
    assert [r["platform"] for r in elf.headers(spark, f"file://{tmp_path}/x.elf").collect()] == [platform]


def test_S1_without_dwarf():
    import io

    with pytest.raises(ValueError, match="DWARF"):
        binary.Binary(io.BytesIO(elf_file(True, 62).replace(b".debug_info", b".xxxxx_info")), "x")
    with pytest.raises(ValueError, match="ELF"):
        binary.Binary(io.BytesIO(b"nothing"), "x")


def many_units(n: int, name: bytes, size: int) -> bytes:
    """A file with n units, each a class `name` of `size` bytes {int x} declared in its second file, and line programs."""
    e = "<"
    abbrev = bytes([1, 0x11, 1, 0x10, 0x17, 0, 0, 2, 0x02, 1, 0x03, 0x08, 0x0B, 0x0B, 0x3A, 0x0B, 0, 0, 3, 0x0D, 0, 0x03, 0x08, 0x49, 0x13, 0x38, 0x0B, 0, 0, 4, 0x24, 0, 0x03, 0x08, 0x0B, 0x0B, 0, 0, 0])
    info = lines = b""
    for k in range(n):
        head = struct.pack("<IHIBBBBB", 0, 2, 0, 1, 1, 0xFB, 14, 10)[4:] + bytes([0, 1, 1, 1, 1, 0, 0, 0, 1])
        head += b"inc\0\0" + b"".join(f"{name.decode()}{k}_{j}.h".encode() + b"\0\0\0\0" for j in (1, 2)) + b"\0"
        at, lines = len(lines), lines + struct.pack("<I", len(head)) + head
        parts = bytes([1]) + struct.pack("<I", at) + bytes([2]) + name + str(k).encode() + b"\0" + bytes([size, 2])
        kind = 11 + len(parts) + 1 + 2 + 4 + 1 + 1
        parts += bytes([3]) + b"x\0" + struct.pack("<I", kind) + bytes([0, 0]) + bytes([4]) + b"int\0" + bytes([4, 0])
        body = struct.pack("<HIB", 4, 0, 8) + parts
        info += struct.pack("<I", len(body)) + body
    sections = {".debug_info": info, ".debug_abbrev": abbrev, ".debug_line": lines}
    names = b"\0" + b"".join(x.encode() + b"\0" for x in [*sections, ".shstrtab"])
    blobs, at, table = [], 64, [(0, 0, 0, 0)]
    for x, data in [*sections.items(), (".shstrtab", names)]:
        table.append((names.index(x.encode() + b"\0"), 1, at, len(data)))
        blobs.append(data)
        at += len(data)
    rows = b"".join(struct.pack(f"{e}IIQQQQIIQQ", a, kind, 0, 0, o, z, 0, 0, 1, 0) for a, kind, o, z in table)
    return b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack(f"{e}HHIQQQIHHHHHH", 2, 62, 1, 0, 0, at, 0, 64, 0, 0, 64, len(table), len(table) - 1) + b"".join(blobs) + rows


def test_S2_J7_batches_units_and_files(spark, tmp_path):
    """Two binaries with the same offsets, in several batches each; declaration files reach the headers."""
    from typeloom.plans import headers

    (tmp_path / "a.elf").write_bytes(many_units(7, b"Box", 4))
    (tmp_path / "b.elf").write_bytes(many_units(7, b"Bin", 8))
    binary.register(spark)
    read = lambda table: spark.read.format("dwarf").option("table", table).option("batch_bytes", 100).load(f"{tmp_path}/*.elf")
    assert read("entries").rdd.getNumPartitions() > 2
    for table in binary.TABLES:
        assert sorted(map(str, read(table).collect())) == sorted(map(str, binary.read_binaries(spark, f"file://{tmp_path}/*.elf", table).collect()))
    rows = read("units").collect()
    assert len(rows) == 14 and len({r["source_id"] for r in rows}) == 2 and {r["version"] for r in rows} == {4} and all(r["cu_end"] > r["cu_offset"] for r in rows)
    assert [r["version"] for r in elf.dwarf_version(read("units")).collect()] == [4, 4] and {r["e_machine"] for r in read("headers").collect()} == {"EM_X86_64"}
    dies = read("entries")
    assert dies.where("tag = 'DW_TAG_class_type'").count() == 14 and dies.select("die_offset").distinct().count() == dies.count() // 2
    graph = headers.Graph(dies, read("files"))
    out = {r["symbol"]: r["header"] for r in headers.generate(graph, spark.createDataFrame([("Box3",), ("Bin3",)], "symbol string")).collect()}
    assert "// - Declaration: Box3_2.h" in out["Box3"] and "// - Size: 4 bytes" in out["Box3"] and "int x;  // offset: 0x0" in out["Box3"]
    assert "// - Declaration: Bin3_2.h" in out["Bin3"] and "// - Size: 8 bytes" in out["Bin3"]


def test_S9_S10_S11(spark, tmp_path, monkeypatch):
    (tmp_path / "s.txt").write_text("# list\n A \n\nB\n")
    assert [r["symbol"] for r in elf.symbols_from_file(spark, f"file://{tmp_path}/s.txt").collect()] == ["A", "B"]
    monkeypatch.setenv("OUTPUT_DIR", "there")
    assert elf.options(elf_file=str(tmp_path / "s.txt"), verbose="yes") == {"elf_file": str(tmp_path / "s.txt"), "output_dir": "there", "verbose": True}
    with pytest.raises(FileNotFoundError):
        elf.options(elf_file="/nowhere")
    assert elf.dwarf_options({"A": 1, "B": 2}, {"DWARF_A": "2.5"}) == {"A": 2.5, "B": 2}


def test_streaming_index(spark, tmp_path):
    from typeloom.schema import DIES
    from typeloom.streaming.indexing import index_arrivals, latest

    (tmp_path / "x.elf").write_bytes(elf_file(True, 62))
    binary.register(spark)
    for k in range(2):
        spark.read.format("dwarf").load(str(tmp_path / "x.elf")).where(F.lit(True)).to(spark.createDataFrame([], DIES).schema).write.mode("append").parquet(f"{tmp_path}/in")
        index_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert {r["symbol"]: r["die_offset"] for r in latest(spark, f"{tmp_path}/out").collect()} == {"Box": 12, "int": 31}


def test_streaming_prefers_definitions(spark, tmp_path):
    """A declaration that arrives first gives way to the definition, and that to no later declaration."""
    from typeloom import schema as S
    from typeloom.streaming.indexing import index_arrivals, latest

    full = spark.createDataFrame([], S.DIES).schema
    row = lambda offset, size: tuple({"source_id": "s", "tag": "DW_TAG_class_type", "name": "A", "cu_offset": 0, "die_offset": offset, "byte_size": size}.get(f.name) for f in full)
    for offset, size in ((3, None), (9, 8), (1, None)):
        spark.createDataFrame([row(offset, size)], full).write.mode("append").parquet(f"{tmp_path}/in")
        index_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert [r["die_offset"] for r in latest(spark, f"{tmp_path}/out").collect()] == [9]


def test_O2_command_line(spark, tmp_path, capsys):
    """Headers of found symbols, a placeholder for a missing one, files apart by platform, the exit code."""
    from typeloom import __main__ as cli

    (tmp_path / "a.elf").write_bytes(many_units(3, b"Box", 4))
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "a.elf"), "-o", str(out), "--generate", "Box1, Nothing", "--verbose"], spark) == 0
    assert "class Box1" in (out / "ps4" / "Box1.h").read_text() and "not found" in (out / "unknown" / "Nothing.h").read_text()
    said = capsys.readouterr().out
    assert "Total symbols: 2" in said and "ok: 1" in said and "not_found: 1" in said and "entries" in said
    (tmp_path / "s.txt").write_text("# one\nBox2\n\n")
    assert cli.main([str(tmp_path / "a.elf"), "-o", str(out), "--symbols-file", str(tmp_path / "s.txt"), "--full-hierarchy"], spark) == 0
    assert "Inheritance Hierarchy" in (out / "ps4" / "Box2.h").read_text()
    assert cli.main([str(tmp_path / "a.elf"), "-o", str(out)], spark) == 1
    assert cli.main([str(tmp_path / "a.elf"), "--generate", "A", "--symbols-file", str(tmp_path / "s.txt")], spark) == 1
    assert cli.main([str(tmp_path / "none.elf"), "--generate", "A"], spark) == 1


def test_O9_progress(spark, tmp_path):
    from typeloom.plans.progress import observed

    (tmp_path / "a.elf").write_bytes(many_units(3, b"Box", 4))
    binary.register(spark)
    rows, counts = observed(spark.read.format("dwarf").load(str(tmp_path / "a.elf")), "read")
    assert rows.count() == counts()["entries"] == 12 and counts()["units"] == 3
