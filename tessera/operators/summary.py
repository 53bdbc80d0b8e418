"""Counts, lift, histograms and other summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import flatten_literal
from tessera.operators.relational import top_per_group


def column_summary(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """(cluster, column, value, n, cluster_size): how often each value occurs; list columns count their items."""
    size = df.groupBy(cluster).agg(F.count("*").alias("cluster_size"))
    items = [F.struct(F.lit(c).alias("column"), _items(df, c).alias("values")) for c in columns]
    long = df.select(cluster, F.explode(F.array(*items)).alias("x")).select(cluster, "x.column", F.explode("x.values").alias("value"))
    counts = long.groupBy(cluster, "column", "value").agg(F.count("*").alias("n"))
    return counts.join(size, cluster)


def _items(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("array"):
        return F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>"))
    if kind == "string":
        return flatten_literal(F.col(column))
    return F.when(F.col(column).isNotNull(), F.array(F.col(column).cast("string"))).otherwise(F.array().cast("array<string>"))


def summary_json(summary: DataFrame, cluster: str) -> DataFrame:
    """(cluster, column, counts): each column's counts as one JSON object, most frequent value first."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value")))
    counts = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["value"].alias("value"), (-e["m"]).alias("n"))))
    return summary.groupBy(cluster, "column").agg(F.to_json(counts).alias("counts"))


def lift(tags: DataFrame, cluster: str, tag: str, top_n: int) -> DataFrame:
    """P(tag | cluster) / P(tag), the top_n tags of each cluster; tags of one or two characters do not count."""
    kept = tags.where(F.length(tag) > 2)
    by_both = kept.groupBy(cluster, tag).agg(F.count("*").alias("n"))
    by_cluster = by_both.groupBy(cluster).agg(F.sum("n").alias("n_cluster"))
    by_tag = by_both.groupBy(tag).agg(F.sum("n").alias("n_tag"))
    total = by_tag.agg(F.sum("n_tag").alias("n_all"))
    joined = by_both.join(by_cluster, cluster).join(by_tag, tag).crossJoin(total)  # one row
    scored = joined.withColumn("lift", F.round((F.col("n") / F.col("n_cluster")) / (F.col("n_tag") / F.col("n_all")), 6))
    return top_per_group(scored.select(cluster, tag, "lift"), [cluster], [F.col("lift").desc(), F.col(tag)], top_n)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from minimum to maximum, the last closed on the right; bounds come from one aggregate row."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum, mean, population deviation, median and percentiles (linear interpolation)."""
    p = lambda q: F.expr(f"percentile(`{value}`, {q})")
    return df.groupBy(*groups).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"),
        F.round(p(0.5), 6).alias("median"), F.round(p(0.25), 6).alias("p25"), F.round(p(0.75), 6).alias("p75"), F.round(p(0.95), 6).alias("p95"),
    )


def global_distribution(summary: DataFrame, column: str, value: str, n: str, top_n: int) -> DataFrame:
    """Per column the top_n values over all clusters, by summing the clusters' counts."""
    whole = summary.groupBy(column, value).agg(F.sum(n).alias("total"))
    return top_per_group(whole, [column], [F.col("total").desc(), F.col(value)], top_n)


def year_distribution(summary: DataFrame, value: str, n: str) -> DataFrame:
    """Counts by year, values that are no whole number left out."""
    return summary.withColumn("year", F.col(value).try_cast("int")).where("year IS NOT NULL").groupBy("year").agg(F.sum(n).alias("total"))


def element_means(df: DataFrame, vector: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, pos, mean): element-wise mean of vectors, as rows."""
    return df.select(*groups, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(*groups, "pos").agg(F.avg("x").alias("mean"))


def release_year(epochs: Column) -> Column:
    """UTC year of the least non-zero epoch second of a list; null without one."""
    real = F.filter(epochs, lambda e: e.isNotNull() & (e != 0))
    return F.when(F.size(real) > 0, F.year(F.timestamp_seconds(F.array_min(real))))


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
