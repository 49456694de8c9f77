"""Counts of entries and units as a plan runs, and times of steps."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("typeloom")


def observed(dies: DataFrame, name: str) -> tuple[DataFrame, Callable[[], dict]]:
    """The entries, and a function that gives how many of them and of units (their first entries) the first action on them read.
    Counted beside the action, without a pass of its own."""
    seen = Observation(name)
    return dies.observe(seen, F.count(F.lit(1)).alias("entries"), F.count_if(F.col("tag") == "DW_TAG_compile_unit").alias("units")), lambda: seen.get


@contextmanager
def timed(step: str) -> Iterator[None]:
    """Log how long a step took, at level DEBUG."""
    began = time.time()
    try:
        yield
    finally:
        log.debug("%s: %.2f s", step, time.time() - began)
