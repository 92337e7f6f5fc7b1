"""Frame helpers shared by the operators: Arrow columns, bounded batches, settled frames."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from crewledger.session import use_checkpoints

# A Python worker holds the words of this much text at once, or one text if that is longer.
SLICE_BYTES = 4 << 20
# Spark hands a worker Arrow batches of about this size, or of one row if that is larger.
BATCH_BYTES = 8 << 20
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [PACKAGE_ROOT, known]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


# What workers keep from one slice to the next.
KEPT: list = []


def kept_for_task(make: Callable) -> Callable:
    """`make` with its results kept until the task ends."""
    found = lru_cache(maxsize=4)(make)
    KEPT.append(found)
    return found


def task_end() -> None:
    """Drop what the task kept and give free memory back: Spark keeps idle workers for other tasks."""
    for held in KEPT:
        held.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` followed by `task_end`, also where it fails or is not read to its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            task_end()

    return tidied


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `size` bytes of text, or one row."""
    lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if row > start and held + length > size:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


def add_columns(
    rows: DataFrame, text: str, fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """`rows` with further columns made from the text column, in bounded slices.

    `make` gets the texts of a slice and returns one array per field. Names of `fields` must be new.
    """
    reach_package(rows.sparkSession)
    names = rows.columns + [f.name for f in fields]
    schema = T.StructType(rows.schema.fields + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays(part.columns + make(part.column(text)), names=names)

    return rows.mapInArrow(tidy(run), schema)


def map_slices(
    rows: DataFrame, text: str, schema: T.StructType | str, make: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """What `make` returns for each bounded slice of rows."""
    reach_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return rows.mapInArrow(tidy(run), schema)


def settled(rows: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared checkpoint folder."""
    use_checkpoints(rows.sparkSession)
    return rows.checkpoint(eager=True)


def free_name(rows: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column has that name."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def segment_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
