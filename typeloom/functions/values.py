"""Values out of types, locations and names, as column expressions (code-generated, no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SIZES

OP_PLUS_UCONST = 0x23


def location_offset(loc: Column) -> Column:
    """V1: a member's offset of struct(int_value, expr): an integer is itself, [plus_uconst, n, ..] is n, [n] is n, else null."""
    expr = loc["expr"]
    return F.coalesce(loc["int_value"], F.when((F.size(expr) >= 2) & (expr[0] == OP_PLUS_UCONST), expr[1]).when(F.size(expr) == 1, expr[0]))


def file_stem(name: Column, fill: str = "_") -> Column:
    """V2: a name as a file name: scopes to two fillers, brackets and other signs to one, runs collapsed, ends stripped, 200 at most."""
    out = F.regexp_replace(F.replace(name, F.lit("::"), F.lit(fill * 2)), r"[^A-Za-z0-9_.\-]", fill)
    out = F.regexp_replace(F.regexp_replace(out, f"{fill}{{2,}}" if fill else "^$", fill), f"^{fill}+|{fill}+$", "")
    out = F.regexp_replace(F.substring(out, 1, 200), f"{fill}+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "unnamed").otherwise(out)


def header_name(name: Column, suffix: str = "") -> Column:
    """V3."""
    return F.concat(file_stem(name), F.lit(f"_{suffix}" if suffix else ""), F.lit(".h"))


def hex8(x: Column) -> Column:
    """V4: 0x and at least eight digits; null of null."""
    return F.when(x.isNotNull(), F.format_string("0x%08x", x))


def hexed(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("0x%x", x))


def base_text(text: Column) -> Column:
    """A type text without leading const and volatile, trailing pointers and references, and dimensions."""
    out = F.regexp_replace(F.trim(text), r"^(?:(?:const|volatile) +)+", "")
    out = F.regexp_replace(out, r"(?: *(?:&&|&|\*))+ *$", "")
    return F.trim(F.when(out.contains("[") & out.contains("]"), F.substring_index(out, "[", 1)).otherwise(out))


def base_text_legacy(text: Column) -> Column:
    """As N8, with one const and no volatile."""
    out = F.regexp_replace(F.regexp_replace(F.trim(text), r"^const +", ""), r"(?: *(?:&|\*))+ *$", "")
    return F.trim(F.when(out.contains("["), F.substring_index(out, "[", 1)).otherwise(out))


def member_size(text: Column) -> Column:
    """The estimated size of a member of a type text; 8 where nothing better is known."""
    table = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])
    known = lambda t: F.coalesce(F.try_element_at(table, t), F.lit(8))
    clean = F.trim(F.replace(text, F.lit("const "), F.lit("")))
    dim = F.regexp_extract(clean, r"\[([^\]]*)\]", 1)
    count = F.when(F.trim(dim).rlike(r"^[+-]?\d+$"), F.trim(dim).try_cast("bigint"))
    base = F.trim(F.substring_index(clean, "[", 1))
    of_base = F.when(base.rlike(r"[*&]$"), F.lit(8)).otherwise(known(base))
    out = F.when(clean.rlike(r"[*&]$"), F.lit(8)).when(clean.contains("[") & clean.contains("]"), F.coalesce(count * of_base, F.lit(8))).otherwise(known(clean))
    return out.cast("bigint")


def symbol_list(text: Column) -> Column:
    """The names of a comma-separated list, trimmed, without empty ones, in order."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def member_text(type_name: Column, name: Column, is_static: Column, is_const: Column, const_value: Column) -> Column:
    """T5: a member's declaration; dimensions move behind the name, static members show their value."""
    plain, dims = F.regexp_extract(type_name, r"^(.+?)(\[.+\])$", 1), F.regexp_extract(type_name, r"^(.+?)(\[.+\])$", 2)
    lead = F.when(is_static, F.lit("static ")).otherwise("")
    constant = lambda t: F.when(is_static & is_const & ~t.startswith("const "), F.concat(F.lit("const "), t)).otherwise(t)
    tail = F.when(is_static & const_value.isNotNull(), F.concat(F.lit(" = "), const_value.cast("string"))).otherwise("")
    return F.when(F.coalesce(name, F.lit("")) == "", type_name).when(dims != "", F.concat(lead, constant(plain), F.lit(" "), name, dims)).otherwise(F.concat(lead, constant(type_name), F.lit(" "), name, tail))
