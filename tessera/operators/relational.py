"""Deduplication, joins, filters and samples with explicit ids and total tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows, counted first; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counts no further than that)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def attach_metadata(pieces: DataFrame, metadata: DataFrame, key: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(pieces with their first metadata row, pieces without one)."""
    first = keep_first(metadata, [key], order)
    return pieces.join(first, key), pieces.join(first.select(key), key, "left_anti")


def align(pieces: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Inner join that raises if a piece has no metadata."""
    missing = pieces.join(metadata.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no metadata for {[row[key] for row in missing]}")
    return pieces.join(metadata, key)


def left_join_suffixed(left: DataFrame, right: DataFrame, key: str, suffix: str = "_meta") -> DataFrame:
    """Left join; columns of the right side that the left has too get a suffix."""
    renamed = right.select(F.col(key).alias("_key"), *(F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key))
    return left.join(renamed, left[key] == F.col("_key"), "left").drop("_key")


def pending(items: DataFrame, done: DataFrame, key: str, finished: Column | None = None) -> DataFrame:
    """Items that no finished row of done covers."""
    ready = done if finished is None else done.where(finished)
    return items.join(ready.select(key).distinct(), key, "left_anti")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that depend on nothing but ids and seed (display samples)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), key).limit(n)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every group, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= n)


def label_boundaries(df: DataFrame, label: str, key: str) -> DataFrame:
    """Where each label's rows begin and end when rows are sorted by label and id: from pre-aggregated sizes."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"), F.min(key).alias("first_id"))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return sizes.select(label, "first_id", start.alias("start"), (start + F.col("n")).alias("end"))
