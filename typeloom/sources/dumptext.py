"""Entries out of dump texts, in two dialects of one printer (with forms and parents, or terse) and one of another.

A block of text is an entry; its attributes are read by regular expressions, its parent is printed or is the last entry
one level up, which a window by level finds. All of it runs as DataFrame expressions, one file's levels in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DIES

NUMBER = r"(0x[0-9a-fA-F]+|-?\d+)"
#: Column and attribute of texts, numbers, references and flags.
NUMBERS = {"byte_size": "byte_size", "alignment": "alignment", "decl_line": "decl_line", "const_value": "const_value", "upper_bound": "upper_bound", "lower_bound": "lower_bound", "count_attr": "count", "bit_size": "bit_size", "bit_offset": "bit_offset"}
REFERENCES = {"type_ref": "type", "containing_type_ref": "containing_type", "specification_ref": "specification", "import_ref": "import"}
FLAGS = {"has_virtuality": "virtuality", "is_external": "external", "is_declaration": "declaration", "is_artificial": "artificial"}


def number(text: Column) -> Column:
    """A decimal or 0x number; null of anything else."""
    digits = F.regexp_replace(text, "^0x", "")
    return F.when(text.startswith("0x"), F.conv(digits, 16, 10).cast("bigint")).when(text.rlike(r"^-?\d+$"), text.cast("bigint"))


def cut(block: Column, pattern: str) -> Column:
    out = F.regexp_extract(block, pattern, 1)
    return F.when(out != "", out)


def columns(block: Column, other: bool) -> dict[str, Column]:
    """The columns of a block; other: of the second printer."""
    at = (lambda a: rf"DW_AT_{a}[ \t]+") if other else (lambda a: rf"DW_AT_{a}(?: \[[^\]]*\])?[ \t]+\(")
    text = (lambda a: cut(block, rf"(?m){at(a)}(?:0x[0-9a-f]+ )?(.+?)[ \t]*$")) if other else (lambda a: cut(block, rf'{at(a)}[^"\n]*"(.*)"\)'))
    ref = lambda a: number(cut(block, at(a) + (r"<0x[0-9a-fA-F]+ GOFF=(0x[0-9a-fA-F]+)>" if other else r"(?:cu \+ 0x[0-9a-fA-F]+ => \{)?(0x[0-9a-fA-F]+)")))
    place = number(cut(block, at("data_member_location") + NUMBER + (r"[ \t]*(?:\n|$)" if other else r"\)")))
    uconst = number(cut(block, r"DW_AT_data_member_location[^\n]*DW_OP_plus_uconst,? " + NUMBER))
    out = {k: number(cut(block, at(a) + NUMBER)) for k, a in NUMBERS.items()}
    out |= {k: ref(a) for k, a in REFERENCES.items()}
    out |= {k: block.contains(f"DW_AT_{a}") for k, a in FLAGS.items()}
    out |= {
        "name": text("name"),
        "decl_file": text("decl_file"),
        "encoding": cut(block, r"DW_AT_encoding[^\n]*(DW_ATE_\w+)"),
        "accessibility": cut(block, r"DW_AT_accessibility[^\n]*(DW_ACCESS_\w+)"),
        "default_value": text("default_value") if other else cut(block, at("default_value") + r"(.*)\)"),
        "member_loc": F.when(uconst.isNotNull(), F.struct(F.lit(None).cast("bigint").alias("int_value"), F.array(F.lit(35).cast("bigint"), uconst).alias("expr"))).when(place.isNotNull(), F.struct(place.alias("int_value"), F.lit(None).cast("array<bigint>").alias("expr"))),
    }
    return out


def finished(rows: DataFrame) -> DataFrame:
    """rows(source_id, cu_offset, die_offset, level, printed_parent, tag, block, other) as the table of entries."""
    # each entry stands in its own level as a possible parent and in the one above as a child that looks back
    seen = rows.select("source_id", F.col("level").alias("l"), "die_offset", F.col("die_offset").alias("p")).unionByName(rows.select("source_id", (F.col("level") - 1).alias("l"), "die_offset", F.lit(None).cast("bigint").alias("p")))
    up = seen.withColumn("up", F.last("p", ignorenulls=True).over(Window.partitionBy("source_id", "l").orderBy("die_offset"))).where("p is null").select("source_id", "die_offset", "up")
    rows = rows.join(up, ["source_id", "die_offset"], "left").withColumn("parent_offset", F.coalesce("printed_parent", "up"))
    with_kids = rows.select("source_id", F.col("parent_offset").alias("die_offset")).where("die_offset is not null").distinct().withColumn("kids", F.lit(True))
    rows = rows.join(with_kids, ["source_id", "die_offset"], "left")
    a, b = columns(F.col("block"), False), columns(F.col("block"), True)
    own = {k: F.when(F.col("other"), b[k]).otherwise(a[k]) for k in a} | {"depth": F.col("level"), "has_children": F.coalesce("kids", F.lit(False)), "platform": F.lit("unknown")}
    out = []
    for f in T.StructType.fromDDL(DIES).fields:
        value = own[f.name] if f.name in own else F.col(f.name) if f.name in rows.columns else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all dump texts at path, of either printer."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), F.regexp_replace("value", "\r", "").alias("t"))
    whole = whole.withColumn("other", F.col("t").rlike(r"(?m)^< *\d+><0x"))
    blocks = whole.select("source_id", "other", F.explode(F.split("t", r"(?m)^(?=< *\d+><0x)|\n\n+")).alias("block"))
    head = F.col("block")
    local, goff = number(cut(head, r"^< *\d+><(0x[0-9a-fA-F]+)")), number(cut(head, r"^< *\d+><0x[0-9a-fA-F]+ GOFF=(0x[0-9a-fA-F]+)>"))
    second = blocks.where("other").select("source_id", "other", "block", F.coalesce(goff, local).alias("die_offset"), F.when(goff.isNotNull(), goff - local).otherwise(0).alias("cu_offset"), cut(head, r"^< *(\d+)>").cast("int").alias("level"), F.lit(None).cast("bigint").alias("printed_parent"), cut(head, r"^[^\n]*?(DW_TAG_\w+)").alias("tag"))
    start = number(cut(head, r"^\s*(0x[0-9a-fA-F]+):"))
    first = blocks.where("not other").select("source_id", "other", "block", start.alias("die_offset"), F.when(head.rlike(r"^\s*0x[0-9a-fA-F]+: Compile Unit:"), start).alias("unit"), F.floor((F.length(cut(head, r"^\s*0x[0-9a-fA-F]+:( +)")) - 1) / 2).cast("int").alias("level"), number(cut(head, r"^[^\n]*\((0x[0-9a-fA-F]+)\)[ \t]*(?:\n|$)")).alias("printed_parent"), cut(head, r"^\s*0x[0-9a-fA-F]+: +(DW_TAG_\w+)").alias("tag"))
    first = first.where("die_offset is not null").withColumn("cu_offset", F.coalesce(F.last("unit", ignorenulls=True).over(Window.partitionBy("source_id").orderBy("die_offset", F.col("unit").isNull())), F.lit(0)))
    return finished(first.drop("unit").unionByName(second).where("tag is not null and die_offset is not null"))
