"""ELF files with DWARF 2 to 4, as a data source of entries, units, file tables and headers.

After register(spark), `spark.read.format("dwarf").load(path)` reads entries; option("table", ..) takes `units`, `files` or
`headers` instead, option("batch_bytes", ..) the size of a partition. A file is looked at once to list its units (their headers only); a partition is a batch of units, of
which it reads its own bytes, beside the abbreviations and strings. Paths are files or folders that all executors see, or
addresses that pyarrow's file systems open (hdfs://, s3://, gs://). read_binaries() reads from any other store by Spark's
binaryFile reader, one task a file, up to the 2 GB that a value may have. Only the sections that are needed are looked at, by
name, so unknown section types and broken links of other sections do no harm. 64-bit DWARF is not read.
"""

from __future__ import annotations

import glob
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import COMPILE_UNITS, DIES, ELF_HEADERS, LINE_FILES

# fixed values: numbers of DWARF 2 to 4 with the names that operators know
TAGS = {
    0x01: "array_type", 0x02: "class_type", 0x04: "enumeration_type", 0x05: "formal_parameter", 0x08: "imported_declaration", 0x0B: "lexical_block", 0x0D: "member", 0x0F: "pointer_type",
    0x10: "reference_type", 0x11: "compile_unit", 0x13: "structure_type", 0x15: "subroutine_type", 0x16: "typedef", 0x17: "union_type", 0x18: "unspecified_parameters", 0x1C: "inheritance",
    0x1D: "inlined_subroutine", 0x1F: "ptr_to_member_type", 0x21: "subrange_type", 0x24: "base_type", 0x26: "const_type", 0x28: "enumerator", 0x2E: "subprogram", 0x2F: "template_type_param",
    0x30: "template_value_param", 0x34: "variable", 0x35: "volatile_type", 0x37: "restrict_type", 0x39: "namespace", 0x3A: "imported_module", 0x3B: "unspecified_type", 0x42: "rvalue_reference_type",
}
ATTRIBUTES = {
    0x03: "name", 0x0B: "byte_size", 0x0C: "bit_offset", 0x0D: "bit_size", 0x10: "stmt_list", 0x18: "import_ref", 0x1C: "const_value", 0x1D: "containing_type_ref", 0x1E: "default_value", 0x22: "lower_bound",
    0x2F: "upper_bound", 0x32: "accessibility", 0x34: "is_artificial", 0x37: "count_attr", 0x38: "member_loc", 0x3A: "decl_file_idx", 0x3B: "decl_line", 0x3C: "is_declaration", 0x3E: "encoding", 0x3F: "is_external",
    0x47: "specification_ref", 0x49: "type_ref", 0x4C: "has_virtuality", 0x4D: "vtable_loc", 0x88: "alignment",
}
FIXED = {0x05: 2, 0x06: 4, 0x07: 8, 0x0B: 1, 0x0C: 1, 0x11: 1, 0x12: 2, 0x13: 4, 0x14: 8, 0x17: 4, 0x20: 8}
CODES = {"accessibility": {1: "DW_ACCESS_public", 2: "DW_ACCESS_protected", 3: "DW_ACCESS_private"}, "encoding": {1: "DW_ATE_address", 2: "DW_ATE_boolean", 4: "DW_ATE_float", 5: "DW_ATE_signed", 6: "DW_ATE_signed_char", 7: "DW_ATE_unsigned", 8: "DW_ATE_unsigned_char", 16: "DW_ATE_UTF"}}
#: Bytes of units in a partition, about, and rows of an Arrow batch.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4_096
TABLES = {"entries": DIES, "units": COMPILE_UNITS, "files": LINE_FILES, "headers": ELF_HEADERS}
# fixed values: ELF machine numbers with their names
MACHINES = {20: "EM_PPC", 21: "EM_PPC64", 3: "EM_386", 40: "EM_ARM", 62: "EM_X86_64", 183: "EM_AARCH64"}


class Bytes:
    """A cursor over bytes of one byte order."""

    def __init__(self, data: bytes, order: str, at: int = 0):
        self.data, self.order, self.at = data, order, at

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def unsigned(self, n: int) -> int:
        return int.from_bytes(self.take(n), self.order)

    def leb(self, signed: bool = False) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out - (1 << shift) if signed and b & 64 else out

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        raw, self.at = self.data[self.at : end], end + 1
        return raw.decode("utf-8", "replace")


def opened(path: str) -> BinaryIO:
    """A file to read and seek in."""
    if "://" in path or path.startswith("file:"):
        local = path.removeprefix("file://").removeprefix("file:")
        if path.startswith("file:"):
            return open(local, "rb")
        from pyarrow.fs import FileSystem

        files, at = FileSystem.from_uri(path)
        return files.open_input_file(at)
    return open(path, "rb")


def layout(f: BinaryIO) -> tuple[str, int, dict[str, tuple[int, int]]]:
    """The byte order, machine number, and offset and length of the debug sections of an ELF file; ValueError of others."""
    head = f.read(64)
    if head[:4] != b"\x7fELF":
        raise ValueError("not an ELF file")
    wide, order = head[4] == 2, "little" if head[5] == 1 else "big"
    e = "<" if order == "little" else ">"
    machine = struct.unpack_from(e + "H", head, 18)[0]
    start = struct.unpack_from(e + ("Q" if wide else "I"), head, 40 if wide else 32)[0]
    size, n, names = struct.unpack_from(e + "HHH", head, 58 if wide else 46)
    f.seek(start)
    rows, found = f.read(size * n), []
    for at in range(0, size * n, size or 1):
        name = struct.unpack_from(e + "I", rows, at)[0]
        found.append((name, *struct.unpack_from(e + ("QQ" if wide else "II"), rows, at + (24 if wide else 16))))
    if names >= n:
        return order, machine, {}
    f.seek(found[names][1])
    labels = f.read(found[names][2])
    named = ((labels[at : labels.find(b"\0", at)].decode("ascii", "replace"), offset, length) for at, offset, length in found)
    return order, machine, {label: (offset, length) for label, offset, length in named if label.startswith(".debug_")}


def section(f: BinaryIO, found: dict[str, tuple[int, int]], name: str) -> bytes:
    if name not in found:
        return b""
    f.seek(found[name][0])
    return f.read(found[name][1])


def info_of(found: dict[str, tuple[int, int]]) -> tuple[int, int]:
    if ".debug_info" not in found:
        raise ValueError("no DWARF information")
    return found[".debug_info"]


def units(f: BinaryIO, order: str, info: tuple[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """offset, end, version, abbreviations' offset, address size of each unit; only the units' headers are read."""
    at, (start, size) = 0, info
    while at + 11 <= size:
        f.seek(start + at)
        b = Bytes(f.read(11), order)
        length = b.unsigned(4)
        if length >= 0xFFFFFFF0:
            raise ValueError("64-bit DWARF")
        yield at, at + 4 + length, b.unsigned(2), b.unsigned(4), b.unsigned(1)
        at += 4 + length


def abbreviations(order: str, data: bytes, at: int) -> dict[int, tuple[int, bool, list[tuple[int, int]]]]:
    b, out = Bytes(data, order, at), {}
    while code := b.leb():
        tag, kids, pairs = b.leb(), b.unsigned(1) == 1, []
        while (pair := (b.leb(), b.leb())) != (0, 0):
            pairs.append(pair)
        out[code] = (tag, kids, pairs)
    return out


def value(b: Bytes, form: int, unit: int, address: int, version: int, strings: bytes):
    """The value of a form, references as offsets into the section."""
    if form == 0x16:
        form = b.leb()
    if form == 0x01:
        return b.unsigned(address)
    if form in FIXED:
        n = b.unsigned(FIXED[form])
        return n + unit if form in (0x11, 0x12, 0x13, 0x14) else n != 0 if form == 0x0C else n
    if form == 0x08:
        return b.text()
    if form == 0x0E:
        return Bytes(strings, b.order, b.unsigned(4)).text()
    if form in (0x03, 0x04, 0x0A, 0x09, 0x18):
        return b.take({0x03: lambda: b.unsigned(2), 0x04: lambda: b.unsigned(4), 0x0A: lambda: b.unsigned(1)}.get(form, b.leb)())
    if form == 0x0D:
        return b.leb(True)
    if form == 0x0F:
        return b.leb()
    if form == 0x10:
        return b.unsigned(address if version == 2 else 4)
    if form == 0x15:
        return b.leb() + unit
    if form == 0x19:
        return True
    raise ValueError(f"form {form:#x}")


def expression(raw: bytes, order: str) -> list[int]:
    """An operation and its operand, where it has one."""
    b = Bytes(raw, order)
    out = []
    while b.at < len(raw):
        out.append(b.unsigned(1))
        if out[-1] in (0x10, 0x23) and b.at < len(raw):
            out.append(b.leb())
    return out


def tidy(name: str, x, order: str):
    """A value as its column holds it."""
    if name in CODES:
        return CODES[name].get(x)
    if name in ("is_external", "is_declaration", "is_artificial", "has_virtuality"):
        return x is not None
    if name == "member_loc":
        return {"int_value": None, "expr": expression(x, order)} if isinstance(x, bytes) else {"int_value": x, "expr": None}
    if name == "vtable_loc":
        return expression(x, order) if isinstance(x, bytes) else [x]
    if name == "const_value":
        return int.from_bytes(x, order, signed=True) if isinstance(x, bytes) and 0 < len(x) <= 8 else 0 if isinstance(x, bytes) else x if isinstance(x, int) and x < 1 << 63 else None
    if name == "default_value":
        return str(x)
    if name == "name":
        return x if isinstance(x, str) else None
    return x if isinstance(x, int) and not isinstance(x, bool) and x < 1 << 63 else None


class Binary:
    """An open file with what its units share."""

    def __init__(self, f: BinaryIO, source: str):
        self.f, self.source = f, source
        f.seek(0)
        self.order, self.machine, self.found = layout(f)
        self.info = info_of(self.found)
        self.platform = {(21, "big"): "ps3", (62, "little"): "ps4"}.get((self.machine, self.order), "unknown")
        self.abbrev, self.strings = section(f, self.found, ".debug_abbrev"), section(f, self.found, ".debug_str")
        self.known: dict[int, dict] = {}

    def table(self, at: int) -> dict[int, tuple[int, bool, list[tuple[int, int]]]]:
        if at not in self.known:
            self.known[at] = abbreviations(self.order, self.abbrev, at)
        return self.known[at]

    def raw(self, first: int, end: int) -> bytes:
        self.f.seek(self.info[0] + first)
        return self.f.read(end - first)

    def entries(self, batch: list[tuple[int, int, int, int, int]]) -> Iterator[tuple]:
        """Rows of schema.DIES of units that follow each other."""
        if not batch:
            return
        shift, data = batch[0][0], self.raw(batch[0][0], batch[-1][1])
        for unit, end, version, abbrev, address in batch:
            table = self.table(abbrev)
            b, parents = Bytes(data, self.order, unit + 11 - shift), []
            while b.at < end - shift:
                offset = b.at + shift
                code = b.leb()
                if not code:
                    if parents:
                        parents.pop()
                    continue
                tag, kids, pairs = table[code]
                row = {"source_id": self.source, "platform": self.platform, "cu_offset": unit, "die_offset": offset, "parent_offset": parents[-1] if parents else None, "depth": len(parents), "tag": "DW_TAG_" + TAGS.get(tag, f"{tag:#x}"), "has_children": kids, "is_external": False, "is_declaration": False, "is_artificial": False, "has_virtuality": False}
                rest = {}
                for attribute, form in pairs:
                    x = value(b, form, unit, address, version, self.strings)
                    if attribute in ATTRIBUTES and ATTRIBUTES[attribute] in NAMES:
                        row[ATTRIBUTES[attribute]] = tidy(ATTRIBUTES[attribute], x, self.order)
                    else:
                        rest[f"{attribute:#x}"] = x.hex() if isinstance(x, bytes) else str(x)
                row["attrs"] = list(rest.items())
                yield tuple(row.get(n) for n in NAMES)
                if kids:
                    parents.append(offset)

    def unit_rows(self, batch: list[tuple[int, int, int, int, int]]) -> Iterator[tuple]:
        """Rows of schema.COMPILE_UNITS."""
        for unit, end, version, _, address in batch:
            yield self.source, unit, end, version, address, self.platform

    def file_rows(self, batch: list[tuple[int, int, int, int, int]]) -> Iterator[tuple]:
        """Rows of schema.LINE_FILES: the files of each unit's line program, numbered from 1."""
        lines = section(self.f, self.found, ".debug_line")
        for unit, end, version, abbrev, address in batch:
            b = Bytes(self.raw(unit, min(end, unit + 65_536)), self.order, 11)
            code = b.leb()
            at = None
            for attribute, form in self.table(abbrev)[code][2] if code else []:
                x = value(b, form, unit, address, version, self.strings)
                if attribute == 0x10:
                    at = x
            for k, name in enumerate(file_names(lines, self.order, at), 1):
                yield self.source, unit, k, name

    def header_rows(self) -> Iterator[tuple]:
        """A row of schema.ELF_HEADERS."""
        yield self.source, MACHINES.get(self.machine, f"EM_{self.machine}"), self.order == "little", True


def file_names(lines: bytes, order: str, at: int | None) -> list[str]:
    """The file names in the header of a line program of version 2 to 4; none of other versions and broken ones."""
    if not isinstance(at, int) or at + 10 > len(lines):
        return []
    try:
        b = Bytes(lines, order, at)
        b.unsigned(4)
        version = b.unsigned(2)
        if not 2 <= version <= 4:
            return []
        b.take(4 + 1 + (version >= 4) + 3)
        b.take(b.unsigned(1) - 1)
        while b.text():
            pass
        out = []
        while name := b.text():
            b.leb(), b.leb(), b.leb()
            out.append(name)
        return out
    except (IndexError, ValueError):
        return []


def key_of(head: bytes) -> str:
    """C12."""
    return hashlib.sha256(head[:65536]).hexdigest()[:16]


#: Arrow's types of the schemas' types; the workers that read have no session to ask.
ARROW = {
    "STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "BOOLEAN": pa.bool_(), "ARRAY<BIGINT>": pa.list_(pa.int64()), "MAP<STRING,STRING>": pa.map_(pa.string(), pa.string()),
    "STRUCT<int_value:BIGINT, expr:ARRAY<BIGINT>>": pa.struct([("int_value", pa.int64()), ("expr", pa.list_(pa.int64()))]),
}


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = "|".join(sorted(map(re.escape, ARROW), key=len, reverse=True))
    return pa.schema([(name, ARROW[kind]) for name, kind in re.findall(rf"(\w+) ({kinds})(?:,|$)", ddl)])


NAMES = arrow_schema(DIES).names


def arrow(rows: Iterator[tuple], table: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    schema, held = arrow_schema(TABLES[table]), []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


class Batch(InputPartition):
    def __init__(self, path: str, source: str, units: list[tuple[int, int, int, int, int]]):
        self.path, self.source, self.units = path, source, units


def listed(path: str) -> list[str]:
    """The files of a folder, a pattern or an address."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow.fs import FileSelector, FileSystem, FileType

        files, at = FileSystem.from_uri(path)
        if files.get_file_info(at).type != FileType.Directory:
            return [path]
        root = path[: path.index(at)] if at in path else path.partition("://")[0] + "://"
        return sorted(root + x.path for x in files.get_file_info(FileSelector(at)) if x.type == FileType.File)
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]


class DwarfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.files, self.bytes = options.get("table", "entries"), listed(options["path"]), int(options.get("batch_bytes", BATCH_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            with opened(path) as f:
                source = key_of(f.read(65536))
                f.seek(0)
                order, _, found = layout(f)
                held: list[tuple[int, int, int, int, int]] = []
                first = len(out)
                for unit in units(f, order, info_of(found)):
                    held.append(unit)
                    if unit[1] - held[0][0] >= self.bytes:
                        out.append(Batch(path, source, held))
                        held = []
                if held or len(out) == first:
                    out.append(Batch(path, source, held))
                if self.table == "headers":
                    out[first:] = [Batch(path, source, [])]
        return out

    def read(self, batch: Batch) -> Iterator[pa.RecordBatch]:
        with opened(batch.path) as f:
            own = Binary(f, batch.source)
            rows = {"entries": lambda: own.entries(batch.units), "units": lambda: own.unit_rows(batch.units), "files": lambda: own.file_rows(batch.units), "headers": own.header_rows}[self.table]()
            yield from arrow(rows, self.table)


class DwarfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dwarf"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "entries")]

    def reader(self, schema) -> DataSourceReader:
        return DwarfReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DwarfSource)


def read_binaries(spark: SparkSession, path: str, table: str = "entries") -> DataFrame:
    """A table of all ELF files at path, in any store that Spark reads."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(0)[k].as_buffer().to_pybytes()
                own = Binary(io.BytesIO(data), key_of(data))
                every = list(units(own.f, own.order, own.info))
                rows = {"entries": lambda: (r for u in every for r in own.entries([u])), "units": lambda: own.unit_rows(every), "files": lambda: own.file_rows(every), "headers": own.header_rows}[table]()
                yield from arrow(rows, table)

    return spark.read.format("binaryFile").load(path).select(F.col("content")).mapInArrow(run, TABLES[table])
