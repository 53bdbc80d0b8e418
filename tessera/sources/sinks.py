"""Writers: datasets with failure logs, JSON results, CSV with encoded lists, labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import pending


def dataset(df: DataFrame, failures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, and one line of text per failure beside it."""
    df.write.mode(mode).parquet(f"{path}/data")
    failures.select(F.concat_ws("\t", *failures.columns).alias("value")).write.mode(mode).text(f"{path}/failures")


def pieces(df: DataFrame, path: str, key: str, values: str, mode: str = "overwrite") -> None:
    """Non-empty arrays as Parquet and a summary CSV of (id, length)."""
    kept = df.where((F.size(values) > 0) & F.exists(values, lambda x: x != 0))
    kept.write.mode(mode).parquet(f"{path}/data")
    kept.select(key, F.size(values).alias("length")).write.mode(mode).csv(f"{path}/summary", header=True)


def results_json(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One row: {key: value} over all rows of a result that is small by nature (clusters, scores)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def csv_with_lists(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV whose list columns are JSON texts."""
    encoded(df).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def encoded(df: DataFrame) -> DataFrame:
    return df.select(*((F.to_json(f"`{f.name}`") if f.dataType.typeName() == "array" else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def labelled(df: DataFrame, labels: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    """The rows with their cluster number, joined by id."""
    df.join(labels.select(key, F.col("label").alias("cluster_number")), key).write.mode(mode).parquet(path)


def memo(df: DataFrame, path: str) -> DataFrame:
    """A result computed once and read again from Parquet afterwards."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def to_convert(items: DataFrame, written: DataFrame, key: str, size: str) -> DataFrame:
    """Items without a converted file of at least a byte."""
    return pending(items, written, key, F.col(size) > 0)
