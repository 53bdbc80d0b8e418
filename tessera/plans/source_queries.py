"""Queries over files in the formats of the sources: tables are written to the shared folder, then read back by a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import ensure_checkpoint_dir
from tessera.sources import tables as S
from tessera.sources.sinks import encoded
from tessera.sources.tables import table

_CLEAN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("rating"), F.split("p_name", " ").alias("themes"),
        F.array("p_type", F.lit('a "b", c')).alias("keywords"), F.array("p_brand").alias("involved_companies"), F.col("p_size").cast("string").alias("first_release_year"),
    )


@query(
    "source_metadata_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', ' || chr(10) || '"x"' AS name, CAST(p_size AS VARCHAR) AS size FROM part""",
)
def source_metadata_csv(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, commas and line ends inside cells; column names trimmed and lower-cased."""
    path = _folder(spark, "metadata")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias(" ID"), F.concat("p_name", F.lit(', \n"x"')).alias("Name "), F.col("p_size").alias("SIZE"))
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.metadata_csv(spark, path)


@query(
    "source_games_csv",
    "SELECT p_partkey AS id, p_name AS name, p_retailprice AS rating, string_split(p_name, ' ')[1] AS first_theme, 2 AS n_keywords, 'a \"b\", c' AS last_keyword, p_size AS first_release_year FROM part",
)
def source_games_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lists as JSON text in CSV cells."""
    path = _folder(spark, "games")
    encoded(_metadata(spark, d)).write.csv(path, header=True, quote='"', escape='"')
    g = S.clean_games_csv(spark, path)
    return g.select("id", "name", "rating", F.element_at("themes", 1).alias("first_theme"), F.size("keywords").alias("n_keywords"), F.element_at("keywords", -1).alias("last_keyword"), "first_release_year")


@query("source_unquoted_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', ' || p_type AS title FROM part")
def source_unquoted_csv(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold one more pair of quotes, and commas."""
    path = _folder(spark, "quoted")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = table(spark, d, "part").select(quoted(F.col("p_partkey").cast("string")).alias("id"), quoted(F.concat("p_name", F.lit(", "), "p_type")).alias("title"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return S.unquoted_csv(spark, path)


@query(
    "source_embeddings",
    f"""SELECT vec_id AS filename, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, {_CLEAN.format("'Vector No. ' || vec_id || ' Théme ' || label")} AS metadata FROM embeddings""",
)
def source_embeddings(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "embeddings")
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("filename"), F.concat(F.lit("Vector No. "), "vec_id").alias("name"), F.array(F.concat(F.lit("Théme "), "label")).alias("themes"), F.col("embedding").alias("ast"))
    rows.write.parquet(path)
    return S.embeddings_dataset(spark, path).select("filename", F.size("ast").alias("n"), F.round(F.col("ast")[0].cast("double"), 6).alias("first"), "metadata")


@query(
    "source_matrices",
    f"""WITH g AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_linenumber <= 3)
    SELECT l_orderkey AS id, 9 AS cells, CAST(sum(n) * 3 AS BIGINT) AS total, {_CLEAN.format("'Order ' || l_orderkey")} AS metadata FROM g GROUP BY l_orderkey""",
)
def source_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Square matrices, read flat."""
    path = _folder(spark, "matrices")
    li = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_linenumber").alias("n"))
    rows = li.select("id", F.concat(F.lit("Order "), "id").alias("name"), F.array_repeat(F.array(F.col("n"), F.lit(0), F.lit(0)), 3).alias("ctm"))
    rows.write.parquet(path)
    m = S.matrices_dataset(spark, path)
    return m.select("id", F.size("ctm").alias("cells"), F.aggregate("ctm", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), "metadata")


@query(
    "source_term_lists",
    "WITH t AS (SELECT DISTINCT n_regionkey, n_name FROM nation) SELECT CAST(n_regionkey AS VARCHAR) AS cluster, n_name AS term FROM t",
)
def source_term_lists(spark: SparkSession, d: str) -> DataFrame:
    """A folder of JSON objects of term lists by cluster, one object a file."""
    path = _folder(spark, "terms")
    named = [str(r[0]) for r in table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # one row a cluster
    lists = [F.array_sort(F.collect_set(F.when(F.col("n_regionkey") == int(k), F.col("n_name")))).alias(k) for k in named]
    table(spark, d, "nation").agg(*lists).coalesce(1).write.json(path)
    terms, _ = S.term_lists(spark, path)
    return terms.select("cluster", "term")


@query("title_search")
def title_search(spark: SparkSession, d: str) -> DataFrame:
    """Searches by title: of the ten names that came back the closest, flattened. The ratio has no SQL."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("_v1")).alias("title"), "p_brand", (F.col("p_partkey") % 10).alias("at"), "p_name", "p_type")
    others = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((F.col("p_partkey") * 100 + i).alias("id"), F.when(i == F.col("at"), F.col("p_name")).otherwise(F.concat("p_type", i.cast("string"))).alias("name")))
    found = S.closest_response(p.withColumn("body", F.to_json(others)), "p_partkey", "title", "body")
    return S.flattened_response(found.select("body"), "body").select("id", "name", "rating")
