"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.store import discard, fresh_dir, materialise, shared_dir

__all__ = ["crc_mod", "discard", "few_texts", "fresh_dir", "give_back", "kept", "lean", "materialise", "read", "shared_dir", "slices", "table", "texts"]

TEXTS = 1_000  # rows of texts that go to Python at once, for memory

_kept: list[Callable[[], bool]] = []
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not with every C library
    _trim = None


def kept(empty: Callable[[], bool]) -> None:
    """``empty`` drops a table that a worker keeps between tasks, and says whether there was one."""
    _kept.append(empty)


def give_back() -> None:
    """Memory that is free goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(call):
    """For what a worker runs over batches: tables that others keep in the worker go first, and what is free at the
    end goes back to the system. Else workers, idle ones too, hold the most that any stage before has taken."""

    @functools.wraps(call)
    def run(self, batches):
        if any([empty() for empty in _kept]):
            give_back()
        try:
            yield from call(self, batches)
        finally:
            give_back()

    return run


@contextlib.contextmanager
def few_texts(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to Python in batches of ``TEXTS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch as Python strings; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a step holds at once stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(data: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) for f in schema], schema=schema)


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null ids: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
