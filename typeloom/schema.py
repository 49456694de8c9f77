"""The native tables' schemas, and the tag sets that operators test."""

from __future__ import annotations

DIES = """source_id STRING, platform STRING, cu_offset BIGINT, die_offset BIGINT, parent_offset BIGINT, depth INT, tag STRING,
has_children BOOLEAN, name STRING, byte_size BIGINT, alignment BIGINT, type_ref BIGINT, containing_type_ref BIGINT,
specification_ref BIGINT, import_ref BIGINT, decl_file_idx INT, decl_file STRING, decl_line INT,
member_loc STRUCT<int_value:BIGINT, expr:ARRAY<BIGINT>>, const_value BIGINT, default_value STRING,
upper_bound BIGINT, lower_bound BIGINT, count_attr BIGINT, bit_size INT, bit_offset INT, encoding STRING,
accessibility STRING, has_virtuality BOOLEAN, vtable_loc ARRAY<BIGINT>,
is_external BOOLEAN, is_declaration BOOLEAN, is_artificial BOOLEAN, attrs MAP<STRING,STRING>"""
COMPILE_UNITS = "source_id STRING, cu_offset BIGINT, cu_end BIGINT, version INT, addr_size INT, platform STRING"
LINE_FILES = "source_id STRING, cu_offset BIGINT, file_idx INT, file_name STRING"
ELF_HEADERS = "source_id STRING, e_machine STRING, little_endian BOOLEAN, has_dwarf BOOLEAN"
SYMBOL_INDEX = "symbol STRING, die_offset BIGINT, cu_offset BIGINT"

# fixed values: DWARF tag names of each role
CLASS, STRUCT, UNION = "DW_TAG_class_type", "DW_TAG_structure_type", "DW_TAG_union_type"
ENUM, BASE, NAMESPACE = "DW_TAG_enumeration_type", "DW_TAG_base_type", "DW_TAG_namespace"
TYPEDEF, ARRAY, SUBRANGE = "DW_TAG_typedef", "DW_TAG_array_type", "DW_TAG_subrange_type"
POINTER, REFERENCE, RVALUE = "DW_TAG_pointer_type", "DW_TAG_reference_type", "DW_TAG_rvalue_reference_type"
CONST, VOLATILE, RESTRICT = "DW_TAG_const_type", "DW_TAG_volatile_type", "DW_TAG_restrict_type"
PTR_TO_MEMBER, SUBROUTINE = "DW_TAG_ptr_to_member_type", "DW_TAG_subroutine_type"
MEMBER, SUBPROGRAM, PARAMETER = "DW_TAG_member", "DW_TAG_subprogram", "DW_TAG_formal_parameter"
INHERITANCE, ENUMERATOR = "DW_TAG_inheritance", "DW_TAG_enumerator"
TEMPLATE_TYPE, TEMPLATE_VALUE = "DW_TAG_template_type_param", "DW_TAG_template_value_param"
FORWARD_DECLARABLE = [CLASS, STRUCT, UNION]
NAMED_TERMINAL = [CLASS, STRUCT, UNION, ENUM, BASE, NAMESPACE]
QUALIFIERS = [POINTER, REFERENCE, RVALUE, CONST, VOLATILE, RESTRICT]
SEARCHABLE = [CLASS, STRUCT, UNION, TYPEDEF, BASE, ENUM, NAMESPACE, ARRAY]
DEFINABLE = [CLASS, STRUCT, UNION, ENUM, TYPEDEF, ARRAY]
CATEGORY = {CLASS: "class_like", STRUCT: "class_like", UNION: "class_like", TYPEDEF: "type_def", BASE: "base_type", ENUM: "enum_type", NAMESPACE: "namespace", ARRAY: "array_type"}
READABLE = {CLASS: "class", STRUCT: "struct", UNION: "union", TYPEDEF: "typedef", BASE: "base_type", ENUM: "enum", NAMESPACE: "namespace", ARRAY: "array"}
LEGACY = {"class": [CLASS, STRUCT], "struct": [STRUCT], "union": [UNION], "typedef": [TYPEDEF], "base_type": [BASE], "enum": [ENUM], "namespace": [NAMESPACE], "primitive_type": [TYPEDEF, BASE]}
INTERNAL_NAMES = ["class_type", "structure_type", "union_type", "unknown_type", "subroutine_type"]
# fixed values: primitive type names
PRIMITIVES = [
    "void", "bool", "char", "signed char", "unsigned char", "short", "unsigned short", "int", "unsigned int", "long", "unsigned long",
    "long long", "unsigned long long", "float", "double", "long double", "wchar_t", "char16_t", "char32_t",
    "size_t", "ptrdiff_t", "intptr_t", "uintptr_t",
    "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t",
    "__int8_t", "__int16_t", "__int32_t", "__int64_t", "__uint8_t", "__uint16_t", "__uint32_t", "__uint64_t",
    "int_fast8_t", "int_fast16_t", "int_fast32_t", "int_fast64_t", "uint_fast8_t", "uint_fast16_t", "uint_fast32_t", "uint_fast64_t",
    "int_least8_t", "int_least16_t", "int_least32_t", "int_least64_t", "uint_least8_t", "uint_least16_t", "uint_least32_t", "uint_least64_t",
]
# fixed values: typedef names that stand for themselves, and those that do in full hierarchies too
PRIMITIVE_TYPEDEFS = [
    "u8", "u16", "u32", "u64", "s8", "s16", "s32", "s64", "f32", "f64", "size_t", "ssize_t",
    "uint_fast8_t", "int_fast8_t", "uint_fast16_t", "int_fast16_t", "uint_fast32_t", "int_fast32_t", "uint_fast64_t", "int_fast64_t",
    "uint8_t", "int8_t", "uint16_t", "int16_t", "uint32_t", "int32_t", "uint64_t", "int64_t", "uintptr_t", "intptr_t",
    "__uint64_t", "__int64_t", "__uint32_t", "__int32_t", "__uint16_t", "__int16_t", "__uint8_t", "__int8_t",
]
MORE_PRIMITIVES = ["ptrdiff_t", "wchar_t", "char16_t", "char32_t", "long long", "unsigned long long", "long double", "bool", "char", "wchar", "std::size_t", "std::ptrdiff_t"]
# fixed values: estimated sizes of member types
SIZES = {
    "bool": 1, "char": 1, "u8": 1, "s8": 1, "uint8_t": 1, "int8_t": 1, "u16": 2, "s16": 2, "short": 2, "uint16_t": 2, "int16_t": 2,
    "u32": 4, "s32": 4, "int": 4, "float": 4, "f32": 4, "uint32_t": 4, "int32_t": 4,
    "u64": 8, "s64": 8, "long": 8, "double": 8, "f64": 8, "size_t": 8, "uint64_t": 8, "int64_t": 8, "void*": 8, "ptr": 8,
}
# fixed values: names that need no forward declaration
NOT_DECLARED = ["int", "char", "float", "double", "void", "bool", "unknown_type", "unsigned", "signed", "short", "long", "u8", "u16", "u32", "u64", "s8", "s16", "s32", "s64", "f32", "f64"]
