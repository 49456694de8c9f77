"""Chains along type references, typedefs and bases.

A chain has one successor at each step, so it is followed by pointer doubling: after k rounds of a self-join each entry
knows where it is 2^k steps on, and what text it gathered on the way. Five joins cover the 20 entries that a type chain may
have; nothing is followed entry by entry, and the joins run over distinct type entries, not over members. Walks over the
same entries share their rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.values import base_text, base_text_legacy
from ..sources.store import store, together
from .keys import keyed

LONGEST = 20


def followed(edges: DataFrame, most: int = LONGEST) -> DataFrame:
    """node, last, steps, prefix, suffix of edges(node, next, prefix, suffix); next is null at an end. last is null where
    the end is more than most - 1 steps away or the chain runs in a circle. Columns source_id and walk keep chains apart.
    A round writes only the nodes that have not ended; what has ended stays where it was written."""
    spark = edges.sparkSession
    by = [c for c in ("source_id", "walk") if c in edges.columns]
    rows = edges.select(*by, "node", F.col("next").alias("cur"), F.when(F.col("next").isNull(), F.col("node")).alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("steps"), "prefix", "suffix")
    tables, reach = [store(spark, rows, "chains")], 1
    ended, live = tables[0].where("cur is null"), tables[0].where("cur is not null")
    while reach < most and not live.isEmpty():
        ahead = ended.unionByName(live).select(*by, F.col("node").alias("cur"), F.col("cur").alias("_cur"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("prefix").alias("_p"), F.col("suffix").alias("_s"))
        moved = live.join(ahead, [*by, "cur"], "left").select(
            *by,
            "node",
            F.col("_cur").alias("cur"),
            F.col("_last").alias("last"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.concat("prefix", F.coalesce("_p", F.lit(""))).alias("prefix"),
            F.concat(F.coalesce("_s", F.lit("")), "suffix").alias("suffix"),
        )
        tables, reach = [*tables, store(spark, moved, "chains")], reach * 2
        ended, live = together(tables).where("cur is null"), tables[-1].where("cur is not null")
    return ended.unionByName(live).select(*by, "node", F.when(F.col("steps") < most, F.col("last")).alias("last"), "steps", "prefix", "suffix")


#: Entries that chains run over.
TYPES = [*S.NAMED_TERMINAL, *S.QUALIFIERS, S.TYPEDEF, S.ARRAY, S.SUBROUTINE, S.PTR_TO_MEMBER]
#: The three walks: to a terminal (J8), through the parts of a name (N2), and through typedefs too.
TERMINAL, NAME, FINAL = "terminal", "name", "final"


def terminal_ends() -> Column:
    tag = F.col("tag")
    return tag.isin(S.FORWARD_DECLARABLE) | (tag.isin(S.NAMED_TERMINAL) & F.col("name").isNotNull())


def wraps() -> Column:
    """Entries that add to the name of what they refer to."""
    return F.col("tag").isin([S.POINTER, S.REFERENCE, S.RVALUE, S.CONST, S.ARRAY]) & F.col("name").isNull()


def passes() -> Column:
    """Entries that final texts see through."""
    return F.col("tag").isin([S.TYPEDEF, S.POINTER, S.REFERENCE, S.CONST, S.VOLATILE, S.PTR_TO_MEMBER, S.SUBROUTINE])


def walked(dies: DataFrame, walks: tuple[str, ...] = (TERMINAL, NAME, FINAL)) -> DataFrame:
    """walk, node, last, prefix, suffix (and source_id): several walks over the same entries in the same rounds.

    terminal: a named type ends; qualifiers, typedefs, arrays and subroutines pass on; unnamed classes end; a pointer to
    member prefers its class; others lead nowhere. name: pointers, references and arrays add behind, const in front, and a
    name ends. final: typedefs are seen through, a pointer to member stands for its class, a subroutine for its result."""
    tag = F.col("tag")
    types = dies.where(tag.isin(TYPES))
    types = types.join(array_texts(dies).select(*keyed(dies, "die_offset", "brackets")), keyed(dies, "die_offset"), "left")
    owner = F.coalesce("containing_type_ref", "type_ref")
    onward = tag.isin([*S.QUALIFIERS, S.TYPEDEF, S.ARRAY, S.SUBROUTINE])
    nothing = F.lit("")
    of = {
        TERMINAL: (F.when(terminal_ends(), None).when(onward, F.col("type_ref")).when(tag == S.PTR_TO_MEMBER, owner), nothing, nothing),
        NAME: (
            F.when(wraps(), F.col("type_ref")),
            F.when(wraps() & (tag == S.CONST), F.lit("const ")).otherwise(""),
            F.when(~wraps(), "").when(tag == S.POINTER, "*").when(tag == S.REFERENCE, "&").when(tag == S.RVALUE, "&&").when(tag == S.ARRAY, F.col("brackets")).otherwise(""),
        ),
        FINAL: (
            F.when(tag == S.PTR_TO_MEMBER, owner).when(passes(), F.col("type_ref")),
            F.when(tag == S.CONST, "const ").when(tag == S.VOLATILE, "volatile ").otherwise(""),
            F.when(tag == S.POINTER, "*").when(tag == S.REFERENCE, "&").otherwise(""),
        ),
    }
    steps = F.array(*[F.struct(F.lit(w).alias("walk"), of[w][0].alias("next"), of[w][1].alias("prefix"), of[w][2].alias("suffix")) for w in walks])
    edges = types.select(*keyed(dies), F.col("die_offset").alias("node"), F.explode(steps).alias("s")).select(*keyed(dies, "node"), "s.walk", "s.next", "s.prefix", "s.suffix")
    return followed(edges).select(*keyed(dies, "walk", "node", "last", "prefix", "suffix"))


def one_walk(dies: DataFrame, walks: DataFrame | None, walk: str) -> DataFrame:
    return (walked(dies, (walk,)) if walks is None else walks).where(F.col("walk") == walk).drop("walk")


def terminal_types(dies: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """die_offset, terminal: where each type entry's chain ends, null for dead ends, circles and chains too long."""
    types = dies.where(F.col("tag").isin(TYPES))
    last = one_walk(dies, walks, TERMINAL)
    good = types.where(terminal_ends()).select(*keyed(dies), F.col("die_offset").alias("last"))
    reached = last.join(good, keyed(dies, "last"), "left_semi").select(*keyed(dies), F.col("node").alias("die_offset"), F.col("last").alias("terminal"))
    return types.select(*keyed(dies, "die_offset")).join(reached, keyed(dies, "die_offset"), "left")


def terminal_offsets(dies: DataFrame) -> DataFrame:
    """die_offset, terminal of each entry with a type: the terminal of what it refers to."""
    ends = terminal_types(dies).withColumnRenamed("die_offset", "type_ref")
    return dies.where("type_ref is not null").select(*keyed(dies, "die_offset", "type_ref")).join(ends, keyed(dies, "type_ref"), "left").select(*keyed(dies, "die_offset", "terminal"))


def array_texts(dies: DataFrame) -> DataFrame:
    """die_offset, dims, total, brackets of each array: a dimension is its count, or its bounds' span, or 0; brackets are
    empty for 0 and [] without any dimension; total is the product of the positive ones, 0 without any."""
    size = F.coalesce("count_attr", F.col("upper_bound") - F.coalesce("lower_bound", F.lit(0)) + 1, F.lit(0))
    ranges = dies.where(F.col("tag") == S.SUBRANGE).groupBy(*keyed(dies), F.col("parent_offset").alias("die_offset")).agg(F.array_sort(F.collect_list(F.struct("die_offset", size.alias("d")))).alias("r"))
    arrays = dies.where(F.col("tag") == S.ARRAY).select(*keyed(dies, "die_offset")).join(ranges, keyed(dies, "die_offset"), "left")
    dims = F.coalesce(F.transform("r", lambda x: x["d"]), F.array().cast("array<bigint>"))
    text = F.concat(F.lit("["), F.array_join(F.transform("dims", lambda x: F.when(x > 0, x.cast("string")).otherwise("")), "]["), F.lit("]"))
    positive = F.filter("dims", lambda x: x > 0)
    total = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(1).cast("bigint"), lambda a, x: a * x)).otherwise(F.lit(0).cast("bigint"))
    return arrays.select(*keyed(dies, "die_offset"), dims.alias("dims")).select(*keyed(dies, "die_offset"), "dims", total.alias("total"), text.alias("brackets"))


def type_names(dies: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """die_offset, type_name of each type entry. A name ends the chain (so typedef names are kept); pointers, references
    and arrays add behind, const in front; other unnamed entries give their tag's word, what is unknown is void behind
    a pointer and unknown_type else."""
    leaf = F.when(F.col("name").isNotNull(), F.col("name")).when(wraps(), F.lit("void")).otherwise(F.regexp_replace("tag", "^DW_TAG_", ""))
    return texts_of(dies, one_walk(dies, walks, NAME), leaf, "type_name")


def texts_of(dies: DataFrame, walk: DataFrame, leaf: Column, alias: str) -> DataFrame:
    """die_offset, alias: what a walk gathered around the leaf text of its last entry."""
    leaves = dies.where(F.col("tag").isin(TYPES)).select(*keyed(dies), F.col("die_offset").alias("last"), leaf.alias("leaf"))
    return walk.join(leaves, keyed(dies, "last"), "left").select(*keyed(dies), F.col("node").alias("die_offset"), F.concat("prefix", F.coalesce("leaf", F.lit("unknown_type")), "suffix").alias(alias))


def resolved_names(dies: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """die_offset, type_name of each entry: void without a type, unknown_type where nothing is found. Entries
    without a type take no part in the join, so that null is no hot key."""
    names = (type_names(dies) if names is None else names).withColumnRenamed("die_offset", "type_ref")
    rows = dies.select(*keyed(dies, "die_offset", "type_ref"))
    typed = rows.where("type_ref is not null").join(names, keyed(dies, "type_ref"), "left").select(*keyed(dies, "die_offset"), F.coalesce("type_name", F.lit("unknown_type")).alias("type_name"))
    return typed.unionByName(rows.where("type_ref is null").select(*keyed(dies, "die_offset"), F.lit("void").alias("type_name")))


def typedefs(dies: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Name, underlying of every typedef name, the last entry's where there are several."""
    rows = dies.where((F.col("tag") == S.TYPEDEF) & F.col("name").isNotNull()).select(*keyed(dies, "name", "die_offset"))
    of = resolved_names(dies.where(F.col("tag") == S.TYPEDEF), type_names(dies) if names is None else names)
    return rows.join(of, keyed(dies, "die_offset")).groupBy(*keyed(dies, "name")).agg(F.max_by("type_name", "die_offset").alias("underlying"))


def primitive_names(full_hierarchy: bool = False) -> list[str]:
    """Names that stand for themselves; for full hierarchies some more."""
    return [*S.PRIMITIVE_TYPEDEFS, *(S.MORE_PRIMITIVES if full_hierarchy else [])]


def found_typedefs(names: DataFrame, defs: DataFrame, primitives: list[str] = S.PRIMITIVE_TYPEDEFS) -> DataFrame:
    """names(name, ..) with underlying: primitive names map to themselves, others to what defs(name, underlying) say; the
    rest drop out."""
    own = names.where(F.col("name").isin(primitives)).withColumn("underlying", F.col("name"))
    return own.unionByName(names.where(~F.col("name").isin(primitives)).join(defs, [c for c in keyed(defs, "name") if c in names.columns]).select(own.columns))


def typedef_chains(defs: DataFrame, primitives: list[str] | None = None) -> DataFrame:
    """Name, resolved of typedefs(name, underlying): the first name that is no typedef; a circle gives the name
    itself. primitives end a chain."""
    by = keyed(defs)
    known = defs.select(*by, F.col("name").alias("underlying"), F.lit(True).alias("more"))
    if primitives:
        known = known.where(~F.col("underlying").isin(primitives))
    edges = defs.join(known, [*by, "underlying"], "left").select(*by, F.col("name").alias("node"), F.when(F.col("more"), F.col("underlying")).alias("next"), F.lit("").alias("prefix"), F.lit("").alias("suffix"))
    last = followed(edges).join(defs.select(*by, F.col("name").alias("last"), "underlying"), [*by, "last"], "left")
    return last.select(*by, F.col("node").alias("name"), F.coalesce("underlying", "node").alias("resolved"))


def member_typedefs(dies: DataFrame, full_hierarchy: bool = False) -> DataFrame:
    """Owner, resolved: the distinct resolved chains of an entry's direct members whose type text is a typedef or a
    primitive name."""
    names = type_names(dies)
    defs, prims = typedefs(dies, names), primitive_names(full_hierarchy)
    members = dies.where((F.col("tag") == S.MEMBER) & F.col("parent_offset").isNotNull())
    texts = members.select(*keyed(dies, "die_offset"), F.col("parent_offset").alias("owner")).join(resolved_names(members, names), keyed(dies, "die_offset"))
    found = found_typedefs(texts.select(*keyed(dies, "owner"), F.col("type_name").alias("name")).distinct(), defs, prims)
    ends = typedef_chains(defs, prims)
    return found.join(ends, keyed(dies, "name"), "left").select(*keyed(dies, "owner"), F.when(F.col("name").isin(prims), F.col("name")).otherwise(F.coalesce("resolved", "underlying")).alias("resolved")).distinct()


def base_type_of(names: DataFrame, index: DataFrame, dies: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """names(name, ..) with base: the final text (N6) of the entry that the index has for exactly this name; names that
    it does not have drop out."""
    texts = final_of_types(dies, walks)
    at = index.select(*keyed(index), F.col("symbol").alias("name"), "die_offset")
    return names.join(at, [c for c in keyed(index, "name") if c in names.columns]).join(texts, keyed(index, "die_offset")).select(*dict.fromkeys([*keyed(index), *names.columns]), F.col("target").alias("base"))


def final_of_types(dies: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """die_offset, target of every type entry: its text with typedefs seen through; pointers, references, const and
    volatile stay; a pointer to member stands for its class, a subroutine for its result or void; unnamed types, enumerations,
    arrays and others are unknown_type."""
    plain = F.col("tag").isin([S.BASE, *S.FORWARD_DECLARABLE]) & F.col("name").isNotNull()
    leaf = F.when(plain, F.col("name")).when(passes(), F.lit("void")).otherwise("unknown_type")
    return texts_of(dies, one_walk(dies, walks, FINAL), leaf, "target")


def final_texts(dies: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Name, target of every typedef name, the first entry's where there are several."""
    rows = dies.where((F.col("tag") == S.TYPEDEF) & F.col("name").isNotNull()).select(*keyed(dies, "name", "die_offset"))
    rows = rows.join(final_of_types(dies, walks), keyed(dies, "die_offset"))
    return rows.groupBy(*keyed(dies, "name")).agg(F.min_by("target", "die_offset").alias("target"))


# fixed values: names never listed as typedefs, and targets that say nothing
NOT_TYPEDEFS = ["void", "int", "char", "float", "double", "bool", "unsigned", "signed", "short", "long", "unknown_type", "class_type", "structure_type", "union_type", "subroutine_type"]
NO_TARGETS = ["unknown_type", "class_type", "structure_type", "union_type", "pointer_type", "subroutine_type", "ptr_to_member_type"]


def used_typedefs(texts: DataFrame, finals: DataFrame) -> DataFrame:
    """Owner, name, target: the typedefs that the type texts(owner, type_name) of each owner use."""
    by = keyed(texts)
    used = texts.select(*by, "owner", base_text(F.col("type_name")).alias("name")).where(~F.col("name").isin(NOT_TYPEDEFS) & ~F.col("name").rlike(r"[*&\[]")).distinct()
    return used.join(finals, [*by, "name"]).where((F.col("target") != F.col("name")) & ~F.col("target").isin(NO_TARGETS)).select(*by, "owner", "name", "target")


def used_typedefs_legacy(texts: DataFrame, defs: DataFrame, primitives: list[str] = S.PRIMITIVE_TYPEDEFS) -> DataFrame:
    """Owner, name, target as N9 without its exclusions, by the older cleaning of texts (N17); the targets' own typedefs are
    added once, resolved to their ends."""
    by = keyed(texts)
    used = texts.select(*by, "owner", base_text_legacy(F.col("type_name")).alias("name")).distinct()
    found = store(texts.sparkSession, found_typedefs(used, defs, primitives).withColumnRenamed("underlying", "target"), "typedefs")
    more = found.select(*by, "owner", base_text_legacy(F.col("target")).alias("name")).distinct().join(found.select(*by, "owner", "name"), [*by, "owner", "name"], "left_anti")
    more = more.join(defs.select(*by, "name"), [*by, "name"], "left_semi").join(typedef_chains(defs, primitives), [*by, "name"])
    return found.unionByName(more.select(*by, "owner", "name", F.col("resolved").alias("target")).select(found.columns))


def bases(dies: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """class_offset, seq, base: the named bases of each class in order; bases without a known name are left out."""
    rows = dies.where(F.col("tag") == S.INHERITANCE)
    named = rows.select(*keyed(dies), F.col("parent_offset").alias("class_offset"), F.col("die_offset").alias("seq"))
    named = named.join(resolved_names(rows, type_names(dies) if names is None else names).withColumnRenamed("die_offset", "seq"), keyed(dies, "seq"))
    return named.where(F.col("type_name") != "unknown_type").select(*keyed(dies, "class_offset", "seq"), F.col("type_name").alias("base"))


def first_bases(base_rows: DataFrame) -> DataFrame:
    """class_offset, base: each class's first base."""
    return base_rows.groupBy(*keyed(base_rows, "class_offset")).agg(F.min_by("base", "seq").alias("base"))


def inheritance(dies: DataFrame, index: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Symbol, ancestor, depth of every class of the index: its first base, that base's first base and so on by
    name, each once; the last name is kept even if it has no definition. The ranges of known ancestors double in each round,
    until no chain goes on; what lies behind the first name that comes back is cut, so circles end too."""
    by = keyed(index)
    first = index.where(F.col("tag").isin(S.FORWARD_DECLARABLE)).select(*by, F.col("die_offset").alias("class_offset"), "symbol").join(first_bases(bases(dies, names)), [*by, "class_offset"]).select(*by, "symbol", F.col("base").alias("ancestor"))
    spark = dies.sparkSession
    rows, reach = store(spark, first.where("symbol <> ancestor").withColumn("depth", F.lit(1)), "bases"), 1
    before = Window.partitionBy(*by, "symbol").orderBy("depth")
    again = F.row_number().over(Window.partitionBy(*by, "symbol", "ancestor").orderBy("depth")) > 1
    while not rows.where(F.col("depth") == reach).isEmpty():
        far = rows.where(F.col("depth") == reach).select(*by, "symbol", F.col("ancestor").alias("_a"))
        more = far.join(rows.select(*by, F.col("symbol").alias("_a"), "ancestor", (F.col("depth") + reach).alias("depth")), [*by, "_a"]).select(*by, "symbol", "ancestor", "depth")
        every = rows.unionByName(more).withColumn("_again", (again | (F.col("ancestor") == F.col("symbol"))).cast("int"))
        every = every.withColumn("_again", F.max("_again").over(before)).where("_again = 0").drop("_again")
        rows, reach = store(spark, every, "bases"), reach * 2
    return rows
