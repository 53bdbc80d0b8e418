"""Event sequences: pauses, transitions, intervals, pitch features, shingles.

Everything is keyed by an explicit id and an explicit order. Long form is
(id, pos, token); the array functions take one list per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAUSE = 128


def with_pauses(notes: DataFrame, key: str, order: Sequence[Column], start: Column, end: Column, token: Column, threshold: float, pause: int = PAUSE) -> DataFrame:
    """(key, pos, token): notes in start order, a pause before a note that begins more than threshold after the previous one's end.

    The previous note is the one before in that order, not the one that ends last.
    """
    own = Window.partitionBy(key).orderBy(*order)
    gaps = notes.select(key, F.row_number().over(own).alias("_at"), token.alias("_token"), (start - F.lag(end).over(own)).alias("_gap"))
    items = F.when(F.col("_gap") > threshold, F.array(F.lit(pause), F.col("_token"))).otherwise(F.array(F.col("_token")))
    long = gaps.select(key, "_at", F.posexplode(items).alias("_sub", "token"))
    return long.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_at", "_sub")).alias("pos"), "token")


def transitions(long: DataFrame, key: str, pos: str = "pos", token: str = "token") -> DataFrame:
    """(key, a, b, n): counts of consecutive pairs, the sparse form of a transition matrix."""
    own = Window.partitionBy(key).orderBy(pos)
    pairs = long.select(key, F.col(token).alias("a"), F.lead(token).over(own).alias("b")).where("b IS NOT NULL")
    return pairs.groupBy(key, "a", "b").agg(F.count("*").alias("n"))


def row_normalised(matrix: DataFrame, key: str) -> DataFrame:
    """Each row of a matrix divided by its sum; rows without counts have no cells."""
    return matrix.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key, "a")))


def log_row_normalised(matrix: DataFrame, key: str) -> DataFrame:
    return row_normalised(matrix, key).withColumn("p", F.log1p("p"))


def globally_normalised(matrix: DataFrame, key: str) -> DataFrame:
    """Each matrix divided by its sum."""
    return matrix.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def dense_matrix(matrix: DataFrame, key: str, size: int, value: str = "n") -> DataFrame:
    """(key, matrix): row-major size * size list, absent cells 0."""
    cells = matrix.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") * size + F.col("b")).alias("k"), F.col(value).cast("double").alias("v")))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("matrix"))


def without_pauses(tokens: Column, pause: int = PAUSE) -> Column:
    return F.filter(tokens, lambda p: p != pause)


def pitch_classes(tokens: Column, pause: int = PAUSE) -> Column:
    return F.transform(without_pauses(tokens, pause), lambda p: F.pmod(p, F.lit(12)))


def intervals(tokens: Column) -> Column:
    """First differences; fewer than two tokens have none."""
    n = F.size(tokens)
    return F.when(n >= 2, F.zip_with(F.slice(tokens, F.lit(2), n - 1), F.slice(tokens, F.lit(1), n - 1), lambda x, y: x - y)).otherwise(F.slice(tokens, 1, 0))


def _steps(long: DataFrame, key: str, pos: str, token: str, pause: int) -> DataFrame:
    """(key, x, y): consecutive pitches, pauses left out first."""
    own = Window.partitionBy(key).orderBy(pos)
    return long.where(F.col(token) != pause).select(key, F.col(token).alias("x"), F.lead(token).over(own).alias("y")).where("y IS NOT NULL")


def pitch_class_matrix(long: DataFrame, key: str, pos: str = "pos", token: str = "token", pause: int = PAUSE) -> DataFrame:
    """(key, a, b, n): counts of consecutive pitch classes, the sparse form of a 12 x 12 matrix."""
    return _steps(long, key, pos, token, pause).groupBy(key, F.pmod("x", F.lit(12)).alias("a"), F.pmod("y", F.lit(12)).alias("b")).agg(F.count("*").alias("n"))


def interval_histogram(long: DataFrame, key: str, most: int = 12, pos: str = "pos", token: str = "token", pause: int = PAUSE) -> DataFrame:
    """(key, interval, share): shares of the intervals between pitches, clipped to +-most; a key without an interval has none."""
    clipped = F.greatest(F.least(F.col("y") - F.col("x"), F.lit(most)), F.lit(-most))
    shares = _steps(long, key, pos, token, pause).groupBy(key, clipped.alias("interval")).agg(F.count("*").alias("n"))
    return shares.select(key, "interval", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def pitch_features(long: DataFrame, key: str, pos: str = "pos", token: str = "token", pause: int = PAUSE) -> DataFrame:
    """(key, feature, value): the non-zero ones of 169 features of (key, pos, token) rows.

    0 to 143: log(1 + share) of the row-normalised pitch class matrix;
    144 to 168: shares of the intervals, clipped to an octave. Two aggregations
    over one window; vectors(..., size=169) makes lists of them.
    """
    matrix = log_row_normalised(pitch_class_matrix(long, key, pos, token, pause), key)
    classes = matrix.select(key, (F.col("a") * 12 + F.col("b")).cast("int").alias("feature"), F.col("p").alias("value"))
    shares = interval_histogram(long, key, 12, pos, token, pause)
    return classes.unionByName(shares.select(key, (F.col("interval") + 156).cast("int").alias("feature"), F.col("share").alias("value")))


def feature_vectors(features: DataFrame, key: str, size: int = 169) -> DataFrame:
    """(key, v): lists of size features, absent ones 0."""
    cells = features.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def shingles(tokens: Column, q: int) -> Column:
    """All slices of q consecutive tokens; a shorter list has none."""
    starts = F.sequence(F.lit(0), F.size(tokens) - q)
    return F.when(F.size(tokens) >= q, F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(q)))).otherwise(F.slice(F.array(tokens), 1, 0))


def usable(df: DataFrame, tokens: str) -> DataFrame:
    """Rows whose sequence is not empty."""
    return df.where(F.size(tokens) > 0)


def without_nan(df: DataFrame, features: str) -> DataFrame:
    """Rows whose feature vector holds no NaN."""
    return df.where(~F.exists(features, lambda x: F.isnan(x)))
