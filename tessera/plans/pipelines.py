"""Whole paths: features to explained clusters, sweeps, neighbour-graph clustering, dataset builds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as E
from tessera.operators import graphs as G
from tessera.operators import relational as R
from tessera.operators import sequences as Q
from tessera.operators import summary as S
from tessera.operators import tfidf as X
from tessera.operators import validate as V
from tessera.operators.cluster import core as C
from tessera.operators.pairwise import nearest
from tessera.session import cut_lineage
from tessera.sources import midi, sinks, tables


@dataclass
class Report:
    """Labels of a clustering and what explains them."""

    labels: DataFrame  # key, label
    terms: DataFrame  # label, rank, term, score
    counts: DataFrame  # label, column, value, n, cluster_size


def explain(labelled: DataFrame, key: str, text: str, columns: Sequence[str], k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(terms, counts) of labelled rows."""
    return X.distinctive_terms(labelled.select(key, "label", text), key, text, "label", k=k), S.column_summary(labelled, "label", columns)


def evaluate(df: DataFrame, key: str, vector: str, text: str, columns: Sequence[str], k: int = 6, n_components: int = 30, cap_mode: str = "min", alpha: float = 0.001) -> Report:
    """Standardise, reduce, drop outliers, cluster with KMeans, explain by terms and counts."""
    reduced = cut_lineage(E.preprocess(df.select(key, vector), key, vector, n_components, cap_mode=cap_mode, alpha=alpha))
    labels = cut_lineage(C.canonical(C.run_clustering("kmeans", reduced, key, "v", k=k), key))
    terms, counts = explain(df.drop(vector).join(labels, key), key, text, columns)
    return Report(labels, terms, counts)


def tune(df: DataFrame, key: str, vector: str, ks: Iterable[int] = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25), n_components: int = 30, alpha: float = 0.01) -> DataFrame:
    """(k, silhouette, davies_bouldin): one feature frame for all k, reduced once."""
    reduced = cut_lineage(E.preprocess(df.select(key, vector), key, vector, n_components, cap_mode="min", alpha=alpha, kind="float"))
    return V.sweep(reduced, key, "v", lambda k: C.run_clustering("kmeans", reduced, key, "v", k=k), ks)


def graph_sweep(df: DataFrame, key: str, vector: str, ks: Iterable[int], neighbours: int = 15, metric: str = "kl") -> DataFrame:
    """(k, silhouette, davies_bouldin, modularity, dispersion) of spectral clusterings of one neighbour graph."""
    edges = cut_lineage(G.local_scaled(nearest(df, key, vector, metric, neighbours)))
    found, labels, ks = [], None, tuple(ks)
    for k, x in zip(ks, C.Spectral(max(ks), neighbours, metric).embeddings(df, key, vector, ks), strict=True):
        x = cut_lineage(x)
        labelled = cut_lineage(x.join(C.run_clustering("kmeans", x, key, "v", k=k), key))
        # few shuffles a k: each leaves the driver a thread for a minute
        davies, _, dispersion = V.spread_scores(labelled, "v", "label")
        found.append((k, V.silhouette(labelled, key, "v", "label").first()[0], davies, dispersion))
        own = labelled.select(F.col(key).alias("id"), F.lit(len(found)).alias("at"), "label")
        labels = own if labels is None else labels.unionByName(own)
    every = labels.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
    q = {r.pos: r.modularity for r in G.modularities(edges, every).collect()}
    rows = [(k, s, davies, q.get(at) or 0.0, dispersion) for at, (k, s, davies, dispersion) in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, modularity double, dispersion double")


def build_sequences(spark: SparkSession, folder: str, metadata_csv: str, out: str, most_files: int | None = None, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(pieces, failures): decode MIDI files, make sequences and transition counts, attach the first metadata row, write both.

    One bad file, or one without metadata, is a failure of that file alone.
    """
    notes, broken = midi.scan(spark, folder, most_files)
    long = midi.sequences(notes, threshold)
    lists = long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("note_sequence"))
    counts = Q.transitions(long, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "n"))).alias("ctm"))
    pieces = lists.join(counts, "id", "left").withColumnRenamed("id", "filename").withColumn("id", F.coalesce(F.regexp_extract("filename", r"^v?(\d+)", 1).try_cast("long"), F.lit(-1)))
    metadata = tables.cleaned_games(tables.builder_metadata(spark, metadata_csv))
    matched, missing = R.attach_metadata(pieces, metadata, "id", [F.col("name"), F.col("rating")])
    failures = broken.unionByName(missing.select(F.col("filename").alias("path"), F.lit("no metadata").alias("error")))
    sinks.dataset(matched, failures, out)
    return matched, failures
