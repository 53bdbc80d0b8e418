"""Group-wise kernels over sorted Arrow streams, large groups dealt into pairs of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map
from tessera.operators.components import components


def chunked(rows: DataFrame, group: str, size: str, member: str, chunk: int, own: str | None = None) -> DataFrame:
    """Rows of groups, with the pair of chunks (ci <= cj) each takes part in.

    A group of more than chunk rows is dealt by hash into chunks; every pair of
    chunks becomes a group of its own, so no task ever holds a whole large
    group while every pair of its rows still meets. own names a column for the
    chunk that a row itself belongs to.
    """
    n = F.ceil(F.col(size) / chunk).cast("int")
    mine = F.when(n > 1, F.pmod(F.xxhash64(F.col(member), F.lit(7)), n).cast("int")).otherwise(F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least(F.col("_own"), j).alias("ci"), F.greatest(F.col("_own"), j).alias("cj")))
    dealt = rows.withColumns({"_n": n, "_own": mine}).withColumn("_pair", F.explode(pairs))
    return dealt.select(*rows.columns, F.col("_pair.ci").alias("ci"), F.col("_pair.cj").alias("cj"), *([F.col("_own").alias(own)] if own else []))


def by_group(rows: DataFrame, keys: list[str], kernel: Callable[[pa.RecordBatch], Iterator[tuple]], schema: str) -> DataFrame:
    """kernel over each group of rows; groups come one after another out of a sorted stream, several to a batch."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = _changes(batch, keys)
            if held and not _same(held[-1], batch, keys):
                yield from _emit(kernel(_joined(held)))
                held = []
            if len(cuts):
                held.append(batch.slice(0, cuts[0]))
                yield from _emit(kernel(_joined(held)))
                rest = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rest.extend(kernel(batch.slice(a, b - a)))
                yield from _emit(rest)
                held = [batch.slice(cuts[-1])]
            else:
                held.append(batch)
        if held:
            yield from _emit(kernel(_joined(held)))

    def _emit(found) -> Iterator[pa.RecordBatch]:
        found = list(found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in found], pa.int64()) for i in range(len(names))], names)

    return arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(batch.num_rows, bool)
    for key in keys:
        x = batch.column(key).to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, each tree as a star around its first row."""
    n = len(linked)
    todo = np.ones(n, bool)
    edges: list[tuple[int, int]] = []
    for root in range(n):
        if not todo[root]:
            continue
        reach = np.zeros(n, bool)
        reach[root] = True
        front = np.array([root])
        while len(front):
            new = linked[front].any(axis=0) & ~reach
            reach |= new
            front = np.flatnonzero(new)
        todo &= ~reach
        edges += [(root, int(x)) for x in np.flatnonzero(reach) if x != root]
    return edges


__all__ = ["by_group", "chunked", "components", "forest"]
