"""What an ELF file's header says, symbol lists and options."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: ELF machine numbers of the two known platforms
MACHINES = {21: "EM_PPC64", 62: "EM_X86_64"}


def platform_of(machine: Column, little_endian: Column) -> Column:
    """S6."""
    known = F.when((machine == "EM_PPC64") & ~little_endian, "ps3").when((machine == "EM_X86_64") & little_endian, "ps4")
    return known.otherwise("unknown")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, e_machine, little_endian, platform of every file below path; others than ELF files are unknown."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 20).alias("h"))
    byte = lambda at: F.conv(F.hex(F.substring("h", at, 1)), 16, 10).cast("int")
    elf = F.hex(F.substring("h", 1, 4)) == "7F454C46"
    little = byte(6) == 1
    number = F.when(little, byte(19) + byte(20) * 256).otherwise(byte(19) * 256 + byte(20))
    machine = None
    for n, name in MACHINES.items():
        machine = F.when(number == n, name) if machine is None else machine.when(number == n, name)
    rows = files.select("path", F.when(elf, machine.otherwise("other")).alias("e_machine"), F.when(elf, little).alias("little_endian"))
    return rows.withColumn("platform", F.coalesce(platform_of(F.col("e_machine"), F.col("little_endian")), F.lit("unknown")))


def dwarf_version(units: DataFrame) -> DataFrame:
    """source_id, version of its first unit."""
    return units.groupBy("source_id").agg(F.min_by("version", "cu_offset").alias("version"))


def symbols_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Symbol: one name a line, trimmed, without blank lines and comments; a missing file is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("symbol"))
    return lines.where((F.col("symbol") != "") & ~F.col("symbol").startswith("#"))


# fixed values: options with their environment names
OPTIONS = {"elf_file": ("ELF_FILE_PATH", ""), "output_dir": ("OUTPUT_DIR", "output"), "verbose": ("VERBOSE", "false")}


def options(**given) -> dict:
    """Options from the environment, overridden by those given; the file has to exist and be one."""
    out = {k: given[k] if given.get(k) is not None else os.environ.get(env, default) for k, (env, default) in OPTIONS.items()}
    out["verbose"] = coerced(str(out["verbose"])) is True
    if out["elf_file"] and not os.path.exists(out["elf_file"]):
        raise FileNotFoundError(f"ELF file not found: {out['elf_file']}")
    if out["elf_file"] and not os.path.isfile(out["elf_file"]):
        raise ValueError(f"not a file: {out['elf_file']}")
    return out


def coerced(value: str) -> bool | int | float | str:
    """A text as what it looks like."""
    if value.lower() in ("true", "yes", "on"):
        return True
    if value.lower() in ("false", "no", "off"):
        return False
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def dwarf_options(defaults: dict, environ: dict | None = None) -> dict:
    """Defaults overridden by DWARF_<KEY> variables."""
    environ = os.environ if environ is None else environ
    return {k: coerced(environ[f"DWARF_{k}"]) if f"DWARF_{k}" in environ else v for k, v in defaults.items()}
