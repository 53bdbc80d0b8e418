"""Standardising, principal components, outlier masks, pooling.

Vectors stay distributed; what comes to the driver is a d x d moment matrix,
or, where there are fewer rows than columns, an n x n Gram matrix, both under
a size guard: more than MOST_SIDE rows of more than MOST_SIDE columns raise.

Defined results: rows whose vector is null take no part and are not returned;
an empty table gives an empty result; a constant dimension is only centred.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairwise import dot_products
from tessera.session import cut_lineage

#: Largest side of a matrix that the driver factorises.
MOST_SIDE = 6000


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, x)."""
    return df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))


def vectors(long: DataFrame, key: str, value: str = "x", out: str = "v") -> DataFrame:
    """Back from (key, pos, value) to one list per key."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("x")))), lambda e: e["x"]).alias(out))


def standardised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, z): zero mean and unit population deviation per dimension; a constant dimension is only centred."""
    long = long_form(df, key, vector)
    moments = F.broadcast(long.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")))  # one row a dimension
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return long.join(moments, "pos").select(key, "pos", ((F.col("x") - F.col("mean")) / scale).alias("z"))


def l2_normalised(df: DataFrame, key: str, vector: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return df.select(key, F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("v"))


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # ddof 1


def _known(df: DataFrame, vector: str, *keep: Column) -> DataFrame:
    return df.select(*keep, F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")


def moments(df: DataFrame, vector: str) -> Moments:
    """Mean and covariance in one pass of partial sums, shifted by the first row for accuracy."""
    rows = _known(df, vector)
    first = rows.first()
    if first is None:
        return Moments(0, np.zeros(0), np.zeros((0, 0)))
    shift = np.array(first.v)
    d = len(shift)
    if d > MOST_SIDE:
        raise ValueError(f"{d} dimensions: their covariance is too large for one machine")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if len(batch):
                x = np.stack(batch.v.to_numpy()) - shift
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        if n:
            yield pd.DataFrame({"part": ["n", "s", "ss"], "x": [[float(n)], s.tolist(), ss.ravel().tolist()]})

    parts = rows.mapInPandas(partial, "part string, x array<double>")
    # summed by element before the driver sees it: one matrix comes back, however many tasks there were
    total = parts.select("part", F.posexplode("x").alias("at", "x")).groupBy("part", "at").agg(F.sum("x").alias("x")).toPandas()
    by = {name: group.sort_values("at").x.to_numpy() for name, group in total.groupby("part")}
    n, s, ss = int(by["n"][0]), by["s"], by["ss"].reshape(d, d)
    cov = (ss - np.outer(s, s) / n) / max(n - 1, 1)
    return Moments(n, shift + s / n, cov)


@dataclass
class Pca:
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray  # k x d, the largest absolute entry of each positive
    variance: np.ndarray
    ratio: np.ndarray  # of all dimensions

    def transform(self, df: DataFrame, key: str, vector: str, kind: str = "double") -> DataFrame:
        """(key, v): projections of the centred, scaled rows; one broadcast of k x d numbers."""
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.scale, self.components))

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mean, scale, components = shared.value
            for batch in batches:
                x = (np.stack(batch.v.to_numpy()) - mean) / scale if len(batch) else np.zeros((0, len(mean)))
                yield pd.DataFrame({"id": batch.id, "v": list(x @ components.T)})

        id_type = df.schema[key].dataType.simpleString()
        rows = _known(df, vector, F.col(key).alias("id"))
        return rows.mapInPandas(project, f"id {id_type}, v array<double>").select(F.col("id").alias(key), F.col("v").cast(f"array<{kind}>").alias("v"))


def _column_sums(rows: DataFrame, d: int, terms: int, add) -> np.ndarray:
    """terms x d sums over the rows' vectors; add gives a batch's share. Summed by element before the driver sees them."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((terms, d))
        for batch in batches:
            if len(batch):
                total += add(batch)
        yield pd.DataFrame({"x": [total.ravel().tolist()]})

    parts = rows.mapInPandas(partial, "x array<double>").select(F.posexplode("x").alias("at", "x"))
    found = parts.groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
    return found.x.to_numpy().reshape(terms, d)


def _gram_pca(df: DataFrame, vector: str, n: int, d: int, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
    """(mean, scale, variances, components of a number) of fewer rows than columns: the eigenvectors of the n x n Gram matrix give those of the columns."""
    rows = _known(df, vector)
    mean = _column_sums(rows, d, 1, lambda b: np.stack(b.v.to_numpy()).sum(axis=0)[None, :])[0] / n
    std = np.sqrt(_column_sums(rows, d, 1, lambda b: ((np.stack(b.v.to_numpy()) - mean) ** 2).sum(axis=0)[None, :])[0] / n) if scale else np.ones(d)
    std = np.where(std > 0, std, 1.0)
    shared = df.sparkSession.sparkContext.broadcast((mean, std))

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, s = shared.value
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": list((np.stack(batch.v.to_numpy()) - m) / s)})

    numbered = cut_lineage(rows.mapInPandas(centred, "v array<double>").withColumn("id", F.monotonically_increasing_id()))
    at = {r.id: i for i, r in enumerate(numbered.select("id").orderBy("id").collect())}  # n rows, under the guard
    gram = np.zeros((n, n))
    for part in dot_products(numbered, "id", "v").toLocalIterator():
        i, j = [at[x] for x in part.i], [at[x] for x in part.j]
        block = np.array(part.x).reshape(len(i), len(j))
        gram[np.ix_(i, j)] = block
        gram[np.ix_(j, i)] = block.T
    values, left = np.linalg.eigh(gram)
    values, left = np.maximum(values[::-1], 0), left[:, ::-1]

    def components(k: int) -> np.ndarray:
        weights = left[:, :k] / np.sqrt(np.where(values[:k] > 0, values[:k], 1))
        return _column_sums(numbered, d, k, lambda b: weights[[at[x] for x in b.id]].T @ np.stack(b.v.to_numpy()))

    return mean, std, values / max(n - 1, 1), components


def fit_pca(df: DataFrame, vector: str, k: int | None = None, target: float = 0.90, cap_mode: str = "replace", scale: bool = True) -> Pca:
    """Components that explain target of the variance; k replaces that number, or only caps it (cap_mode 'min')."""
    rows = _known(df, vector)
    first = rows.first()
    if first is None:
        return Pca(np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    n, d = rows.count(), len(first.v)
    if n < d and n <= MOST_SIDE:
        mean, std, values, components = _gram_pca(df, vector, n, d, scale)
    else:
        m = moments(df, vector)
        mean, std = m.mean, np.sqrt(np.diag(m.cov) * (m.n - 1) / max(m.n, 1)) if scale else np.ones(len(m.mean))
        std = np.where(std > 0, std, 1.0)
        values, columns = np.linalg.eigh(m.cov / np.outer(std, std))
        values, columns = np.maximum(values[::-1], 0), columns[:, ::-1]
        components = lambda count: columns[:, :count].T
    total = values.sum()
    ratio = values / total if total > 0 else np.zeros_like(values)
    enough = min(int(np.searchsorted(np.cumsum(ratio), target - 1e-12)) + 1, len(values))
    count = enough if k is None else k if cap_mode == "replace" else min(k, enough)
    count = max(1, min(count, len(values), max(n, 1)))
    chosen = components(count)
    signs = np.sign(chosen[np.arange(count), np.abs(chosen).argmax(axis=1)])
    return Pca(mean, std, chosen * np.where(signs == 0, 1, signs)[:, None], values[:count], ratio)


def chi2_quantile(p: float, df: int) -> float:
    """Chi-square quantile by bisection on the regularised lower incomplete gamma function."""
    lo, hi = 0.0, max(10.0, df + 20.0 * math.sqrt(2 * df) + 50)
    for _ in range(200):
        mid = (lo + hi) / 2
        if _lower_gamma(df / 2, mid / 2) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _lower_gamma(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * head
    # continued fraction of the upper part (modified Lentz)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1 - head * h


def mahalanobis(df: DataFrame, key: str, vector: str, alpha: float) -> DataFrame:
    """(key, d2, threshold, keep): squared Mahalanobis distance against the chi-square quantile 1 - alpha."""
    m = moments(df, vector)
    if not m.n:
        return df.limit(0).select(key, F.lit(0.0).alias("d2"), F.lit(0.0).alias("threshold"), F.lit(True).alias("keep"))
    limit = chi2_quantile(1 - alpha, len(m.mean))
    shared = df.sparkSession.sparkContext.broadcast((m.mean, np.linalg.pinv(m.cov)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, inverse = shared.value
        for batch in batches:
            x = np.stack(batch.v.to_numpy()) - mean if len(batch) else np.zeros((0, len(mean)))
            yield pd.DataFrame({"id": batch.id, "d2": np.einsum("ij,jk,ik->i", x, inverse, x)})

    id_type = df.schema[key].dataType.simpleString()
    rows = _known(df, vector, F.col(key).alias("id"))
    scored = rows.mapInPandas(score, f"id {id_type}, d2 double")
    return scored.select(F.col("id").alias(key), "d2", F.lit(limit).alias("threshold"), (F.col("d2") < limit).alias("keep"))


def iqr_mask(df: DataFrame, key: str, vector: str, factor: float = 1.5) -> DataFrame:
    """(key, keep): whether every dimension lies within factor interquartile ranges of the quartiles."""
    long = long_form(df, key, vector)
    q = lambda p: F.expr(f"percentile(x, {p})")
    bounds = F.broadcast(long.groupBy("pos").agg(q(0.25).alias("q1"), q(0.75).alias("q3")))
    width = (F.col("q3") - F.col("q1")) * factor
    return long.join(bounds, "pos").groupBy(key).agg(F.every((F.col("x") >= F.col("q1") - width) & (F.col("x") <= F.col("q3") + width)).alias("keep"))


def preprocess(df: DataFrame, key: str, vector: str, n_components: int | None = None, cap_mode: str = "replace", remove_outliers: bool = True, alpha: float = 0.001, kind: str = "double") -> DataFrame:
    """(key, v): standardised, projected, without outliers."""
    reduced = fit_pca(df, vector, n_components, cap_mode=cap_mode).transform(df, key, vector, kind)
    if not remove_outliers:
        return reduced
    keep = mahalanobis(reduced, key, "v", alpha).where("keep").select(key)
    return reduced.join(keep, key, "left_semi")


def outlier_counts(df: DataFrame, key: str, vector: str, alphas: tuple[float, ...] = (0.05, 0.01, 0.001), n_components: int = 30) -> DataFrame:
    """(alpha, removed, percent) after projection without scaling."""
    reduced = fit_pca(df, vector, n_components, cap_mode="min", target=1.0, scale=False).transform(df, key, vector)
    d2 = mahalanobis(reduced, key, "v", 0.5).select("d2")
    one = reduced.first()
    size = len(one.v) if one else 1
    limits = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(chi2_quantile(1 - a, size)).alias("limit")) for a in alphas))).alias("x")
    removed = F.sum(F.when(F.col("d2") < F.col("limit"), 0).otherwise(1))
    return d2.select("d2", limits).select("d2", "x.alpha", "x.limit").groupBy("alpha").agg(removed.cast("bigint").alias("removed"), F.round(100.0 * removed / F.count("*"), 6).alias("percent"))


def pooled(frames: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): mean, then sample deviation, of every dimension over a key's frames (rows)."""
    stats = long_form(frames, key, vector).groupBy(key, "pos").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("mean").alias("x")), F.struct(F.lit(1).alias("half"), F.col("std").alias("x")))).alias("e")
    long = stats.select(key, "pos", both).select(key, F.struct("e.half", "pos").alias("pos"), "e.x")
    return vectors(long, key)
