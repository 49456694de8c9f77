"""O1, O2: headers of symbols of ELF files from the command line: `python -m typeloom file.elf --generate A,B -o out`."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import symbol_list
from .operators.keys import keyed
from .plans.headers import Graph, export_files, generate, summary
from .plans.progress import observed, timed
from .sources import binary, elf
from .sources.store import clean, store


def arguments(given: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="typeloom", description="C++ headers out of the debug information of ELF files.")
    p.add_argument("elf_file", nargs="?", help="file, folder or pattern (or ELF_FILE_PATH)")
    p.add_argument("-o", "--output", help="output folder (or OUTPUT_DIR; default: output)")
    p.add_argument("-v", "--verbose", action="store_true", default=None, help="debug log")
    p.add_argument("--generate", metavar="SYMBOL", help="symbols, separated by commas")
    p.add_argument("--symbols-file", metavar="FILE", help="a file with one symbol on a line")
    p.add_argument("--full-hierarchy", action="store_true", help="with all bases and dependencies")
    p.add_argument("--no-metadata", action="store_true", help="without comments on sizes and offsets")
    return p.parse_args(given)


def asked(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """symbol: what --generate or --symbols-file ask for; ValueError without either or with both."""
    if bool(args.generate) == bool(args.symbols_file):
        raise ValueError("give either --generate or --symbols-file")
    if args.symbols_file:
        rows = elf.symbols_from_file(spark, args.symbols_file)
    else:
        rows = spark.range(1).select(F.explode(symbol_list(F.lit(args.generate))).alias("symbol"))
    return rows.select("symbol").distinct()


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0, or 1 where nothing could be done. A symbol that is not found gets a placeholder, which is no failure."""
    args = arguments(given)
    try:
        options = elf.options(elf_file=args.elf_file, output_dir=args.output, verbose="true" if args.verbose else None)
        if not options["elf_file"]:
            raise ValueError("no ELF file given")
    except (OSError, ValueError) as e:
        print(f"Configuration error: {e}", file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.DEBUG if options["verbose"] else logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    own = spark is None
    spark = spark or SparkSession.builder.appName("typeloom").getOrCreate()
    try:
        symbols = store(spark, asked(spark, args), "symbols")
        total = symbols.count()
        if not total:
            raise ValueError("no symbols given")
        binary.register(spark)
        rows, read = observed(spark.read.format("dwarf").load(options["elf_file"]), "read")
        with timed("reading"):
            dies = store(spark, rows, "entries")
        files = store(spark, spark.read.format("dwarf").option("table", "files").load(options["elf_file"]), "files")
        with timed("headers"):
            headers = store(spark, generate(Graph(dies, files), symbols, args.full_hierarchy, args.no_metadata), "headers")
        platforms = dies.groupBy("source_id").agg(F.first("platform").alias("platform"))
        placed = headers.join(platforms, keyed(headers), "left").withColumn("platform", F.coalesce("platform", F.lit("unknown")))
        for row in placed.select("platform").distinct().collect():
            export_files(placed.where(F.col("platform") == row["platform"]), options["output_dir"], row["platform"])
        counts = read()
        print(f"Read {counts['entries']} entries of {counts['units']} units\nTotal symbols: {total}")
        for row in summary(headers).orderBy("status").collect():
            print(f"{row['status']}: {row['n']}")
        return 0
    except (OSError, ValueError, PySparkException) as e:
        print(f"Failed: {e}", file=sys.stderr)
        return 1
    finally:
        clean(spark)
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
