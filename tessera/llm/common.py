"""What the operators of this subpackage share: tables, checkpoints, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, ship

#: What a word is, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many bytes (estimated from its rows), else it is shuffled.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in one batch between the JVM and Python: at 10,000 (the default) a batch of long texts takes hundreds of MB.
BATCH_ROWS = 500


def _give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and others need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with batches small enough for long texts, and workers that keep nothing when a task ends."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: computed once, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """A checkpointed side of a join and its row count, with a broadcast hint only if its checked size allows it.

    row_bytes: bytes of a row as held in memory; a column where rows hold
    arrays or texts of any length, whose sizes are then summed.
    """
    done = cut(df)
    if isinstance(row_bytes, int):
        n = done.count()
        total = n * row_bytes
    else:
        n, total = done.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return (F.broadcast(done) if total <= limit else done), n


__all__ = ["BROADCAST_BYTES", "WORD", "arrow_map", "cut", "small_side", "table"]
