"""Helpers that the operators of this subpackage share.

Every operator picks its columns by name at its first step and works on
internal names from there on, so further columns of the input (whatever their
names) neither clash nor travel through its shuffles unless it says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from patchlens.sources.shared import cut, discard, fresh_path, shared_folder  # noqa: F401  for the operators

#: White space of the word definition, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(pieces, lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, from the split's size alone: only its first and last piece can be empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    n = F.size(pieces)
    first, last = F.element_at(pieces, 1) == "", F.element_at(pieces, -1) == ""
    return (n - F.when(n == 1, first.cast("int")).otherwise(first.cast("int") + last.cast("int"))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces whose column number `text` has about `most` bytes (a longer text is a piece of its own), so that what is made of a piece stays small."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, end - start)
            start = end


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Arrow batches of at most `most` bytes in this session, from now on.

    The default of 64 MB is held several times over, beside the heap, by every
    task that feeds a Python worker. A result that is computed later is planned
    with the session's setting of that time, so it can't be set back here; a
    smaller one stays as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not re.fullmatch(r"[0-9]+b?", now) or not 0 < int(now.rstrip("b")) <= most:
        spark.conf.set(name, str(most))
