"""Parquet, CSV, JSON and array file sources."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fix_json_list, metadata_text, path_stem, sequence_ratio, strip_outer_quotes
from tessera.operators.relational import keep_first

#: Metadata of pieces as written by the CSV sink.
METADATA_SCHEMA = "id string, name string, rating string, themes string, keywords string, involved_companies string, first_release_year string"
LISTS = ("themes", "keywords", "involved_companies")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_metadata(df: DataFrame) -> DataFrame:
    """df with the cleaned metadata text of its name and list columns."""
    return df.withColumn("metadata", metadata_text(F.col("name"), *(F.col(c) for c in LISTS if c in df.columns)))


def embeddings_dataset(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Embedding vectors with metadata; only the named columns are read, if any are named."""
    df = with_metadata(spark.read.parquet(path))
    return df.select(*columns) if columns else df


def matrices_dataset(spark: SparkSession, path: str, flat: bool = True) -> DataFrame:
    """Transition matrices with metadata; flat gives one row-major list per matrix."""
    df = with_metadata(spark.read.parquet(path))
    return df.withColumn("ctm", F.flatten("ctm")) if flat else df


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metadata table with trimmed lower-case column names."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def clean_games_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with parsed lists and numbers; what is no number becomes null."""
    return cleaned_games(spark.read.csv(path, header=True, schema=METADATA_SCHEMA, quote='"', escape='"', multiLine=True))


def cleaned_games(df: DataFrame) -> DataFrame:
    lists = {c: fix_json_list(F.col(c)) for c in LISTS}
    return df.withColumns({**lists, "id": F.col("id").try_cast("long"), "rating": F.col("rating").try_cast("double"), "first_release_year": F.col("first_release_year").try_cast("double").cast("int")})


def unquoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text, read with its quoting, without one more pair of outer quotes."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.select(*(strip_outer_quotes(F.col(f"`{c}`")).alias(c) for c in df.columns))


def builder_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata for a dataset build; whatever goes wrong is a FileNotFoundError that names the path."""
    try:
        return metadata_csv(spark, path)
    except Exception as e:
        raise FileNotFoundError(f"no readable metadata at {path}") from e


def array_files(spark: SparkSession, folder: str, suffix: str, kind: str = "double") -> tuple[DataFrame, DataFrame]:
    """((id, shape, values), (path, error)): *.npy files below a folder; id is the stem without the suffix, bad files are reported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    x = np.load(io.BytesIO(content), allow_pickle=False)
                    out.append((path, list(x.shape), x.ravel().astype(float).tolist(), None))
                except Exception as e:  # noqa: BLE001  every kind of broken file is a failure of that file alone
                    out.append((path, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "shape", "values", "error"])

    rows = files.mapInPandas(decode, "path string, shape array<int>, values array<double>, error string")
    stem = F.regexp_replace(path_stem(F.col("path")), f"{suffix}$", "")
    good = rows.where("error IS NULL").select(stem.alias("id"), "shape", F.col("values").cast(f"array<{kind}>").alias("values"))
    return good, rows.where("error IS NOT NULL").select("path", "error")


def feature_dataset(spark: SparkSession, folder: str, csv: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrices, metadata, failures)."""
    matrices, failures = array_files(spark, folder, "_traj", "int")
    return matrices, metadata_csv(spark, csv), failures


def term_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """((file, cluster, term), (path, error)) of a folder of {cluster: [terms]} JSON files; its own summary file is left out."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.where(~F.col("path").endswith("similarity_sums.json")).withColumn("m", F.from_json("value", "map<string,array<string>>"))
    terms = files.where("m IS NOT NULL").select(path_stem(F.col("path")).alias("file"), F.explode("m").alias("cluster", "terms")).select("file", "cluster", F.explode_outer("terms").alias("term"))
    return terms, files.where("m IS NULL").select("path", F.lit("no object of lists").alias("error"))


def closest_response(df: DataFrame, key: str, title: str, column: str) -> DataFrame:
    """(key, body, ratio): of a search's results (a JSON array of responses as text) the one whose name is most like the title, the first of equals.

    A result without a name counts as named ''; a title none of whose results
    shares a character with it, or that has none, has no row.
    """
    results = F.posexplode(F.coalesce(F.from_json(column, "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "result")
    rows = df.select(key, F.lower(F.regexp_replace(title, "_", " ")).alias("_title"), results)
    name = F.lower(F.coalesce(F.try_variant_get("result", "$.name", "string"), F.lit("")))
    scored = rows.withColumns({"ratio": sequence_ratio("_title", name), "body": F.to_json("result")}).where("ratio > 0")
    return keep_first(scored.select(key, "pos", "body", "ratio"), [key], [F.col("ratio").desc(), F.col("pos")]).drop("pos")


def flattened_response(df: DataFrame, column: str) -> DataFrame:
    """One metadata row out of a REST response: names of nested objects, distinct, in order; rating to one decimal, 0 without."""
    schema = "struct<id:long,name:string,rating:double,themes:array<struct<name:string>>,keywords:array<struct<name:string>>,involved_companies:array<struct<company:struct<name:string>>>,release_dates:array<struct<date:long>>>"
    r = df.withColumn("_r", F.from_json(column, schema))
    names = lambda c, f: F.array_distinct(F.coalesce(F.transform(c, f), F.array().cast("array<string>")))
    dates = F.filter(F.transform("_r.release_dates", lambda d: d["date"]), lambda d: d.isNotNull() & (d != 0))
    return r.select(
        F.col("_r.id").alias("id"), F.col("_r.name").alias("name"), F.round(F.coalesce("_r.rating", F.lit(0.0)), 1).alias("rating"),
        names(F.col("_r.themes"), lambda x: x["name"]).alias("themes"), names(F.col("_r.keywords"), lambda x: x["name"]).alias("keywords"),
        names(F.col("_r.involved_companies"), lambda x: x["company"]["name"]).alias("involved_companies"),
        F.year(F.timestamp_seconds(F.array_min(dates))).alias("first_release_year"),
    )


def inspect(df: DataFrame, vector: str | None = None, seed: int = 0) -> dict:
    """Row and column counts, five sampled rows, and the vector lengths seen."""
    sizes = [] if vector is None else [r[0] for r in df.select(F.size(vector)).distinct().limit(20).collect()]
    return {"rows": df.count(), "columns": df.columns, "sample": df.orderBy(F.rand(seed)).limit(5).collect(), "sizes": sorted(sizes)}


