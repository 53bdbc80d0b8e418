"""TF-IDF profiles of clusters, as relational plans.

Tokens are runs of two or more word characters of the cleaned text; stop words
go before n-grams are made; idf = ln((1 + n) / (1 + df)) + 1; a document's
weights are raw counts times idf, scaled to unit length. A term that a
document lacks counts as 0 in every mean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_text
from tessera.operators.relational import checked_broadcast, top_per_group
from tessera.session import cut_lineage, ship

#: Own list of common words; both queries and their oracles use it.
STOP_WORDS = (
    "about", "after", "all", "also", "and", "any", "are", "because", "been", "but", "can", "could", "did", "for", "from",
    "had", "has", "have", "her", "him", "his", "how", "into", "its", "may", "more", "most", "not", "one", "only", "other",
    "our", "out", "over", "she", "should", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these",
    "they", "this", "those", "was", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your", "an",
    "as", "at", "be", "by", "do", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we",
)


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    words = F.filter(F.split(F.coalesce(clean_text(text), F.lit("")), " "), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of low to high words, joined by spaces."""
    return F.concat(*(words if n == 1 else _ngrams(words, n) for n in range(low, high + 1)))


def _ngrams(words: Column, n: int) -> Column:
    """n-grams by zipping a list with itself shifted; a shorter list has none."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), count)
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(words, F.lit(k), count), lambda x, y: F.concat(x, F.lit(" "), y))
    return grams


def term_counts(docs: DataFrame, id_col: str, text: Column, ngram: tuple[int, int] = (1, 2), keep: Sequence[str] = (), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(id, keep, term, tf).

    The texts are dealt by id before they are taken apart: they are smaller
    than their n-grams, and counting then needs no shuffle of its own. The
    number is stated, since their size says little about the work they make.
    """
    dealt = docs.select(id_col, *keep, text.alias("_text")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    words = dealt.select(id_col, *keep, tokens(F.col("_text"), stop_words).alias("_words"))
    return words.select(id_col, *keep, F.explode(ngrams(F.col("_words"), *ngram)).alias("term")).groupBy(id_col, *keep, "term").agg(F.count("*").alias("tf"))


def weights(counts: DataFrame, id_col: str, sizes: DataFrame, scope: Sequence[str] = (), min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """counts with unit-length weights. sizes: (scope, n_docs), one row per scope; the fit is made inside each."""
    df = counts.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    df = df.join(F.broadcast(sizes), list(scope)) if scope else df.crossJoin(F.broadcast(sizes))
    most = F.greatest(F.lit(float(max_df)), F.lit(float(min_df)) / F.col("n_docs")) if max_df < 1 else F.lit(1.0)
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= most * F.col("n_docs")))
    idf = df.withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).select(*scope, "term", "idf")
    raw = counts.join(idf, [*scope, "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*scope, id_col)))
    return raw.withColumn("weight", F.col("raw") / norm)


def hashed_counts(docs: DataFrame, id_col: str, text: Column, ngram: tuple[int, int], cluster: str, stop_words: Sequence[str]) -> DataFrame:
    """(id, k, terms, tfs): one row for each id and cluster, with 64-bit hashes of its terms and their counts. Nothing but texts is shuffled."""
    ship(docs.sparkSession)
    dealt = docs.select(F.col(id_col).alias("id"), F.col(cluster).alias("k"), text.alias("text")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    words = dealt.select("id", "k", tokens(F.col("text"), stop_words).alias("words"))
    rows = words.select("id", "k", F.explode_outer(F.array(ngrams(F.col("words"), *ngram))).alias("grams")).select("id", "k", F.transform("grams", lambda g: F.xxhash64(g)).alias("terms")).groupBy("id", "k").agg(F.flatten(F.collect_list("terms")).alias("terms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(sizes)))]).astype(np.int32)
            tfs = np.diff(np.append(first, len(flat))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat[first]), pa.ListArray.from_arrays(ends, tfs)], ["id", "k", "terms", "tfs"])

    id_type, k_type = (rows.schema[c].dataType.simpleString() for c in ("id", "k"))
    return rows.mapInArrow(count, f"id {id_type}, k {k_type}, terms array<bigint>, tfs array<int>")


def _scored(counts: DataFrame, n_docs: int, sizes: DataFrame, min_df: int, max_df: float, scoring: str) -> DataFrame:
    """(k, h, score) of hashed counts. A term's idf is the same in all documents, so a cluster's sum of weights is idf times its sum of tf / norm."""
    most = max(float(max_df), min_df / max(n_docs, 1)) if max_df < 1 else 1.0
    kept = (F.col("df") >= min_df) & (F.col("df") <= F.lit(most) * n_docs)
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    each = counts.select("id", "k", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", "k", F.col("x.terms").alias("h"), F.col("x.tfs").alias("tf"))
    known = each.groupBy("h").agg(F.count("*").alias("df")).where(kept).select("h", idf.alias("idf"))
    norms = cut_lineage(each.join(known, "h").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0)))).alias("norm")))
    norms = checked_broadcast(norms.withColumnRenamed("id", "_id"), 2_000_000)
    share = counts.join(norms, F.col("id").eqNullSafe(F.col("_id"))).select("k", "norm", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    own = share.groupBy("k", F.col("x.terms").alias("h")).agg(F.sum(F.col("x.tfs") / F.col("norm")).alias("own"), F.count("*").alias("n"))
    every = Window.partitionBy("h")
    means = own.withColumns({"df": F.sum("n").over(every), "whole": F.sum("own").over(every)}).where(kept).join(F.broadcast(sizes), "k")
    score = idf * (F.col("own") / F.col("cluster_size") - (F.col("whole") / F.lit(n_docs) if scoring == "distinctiveness" else F.lit(0.0)))
    return means.select("k", "h", F.round(score, 6).alias("score"))


def distinctive_terms(docs: DataFrame, id_col: str, text_col: str, cluster: str, k: int = 20, ngram: tuple[int, int] = (1, 2), min_df: int = 1, max_df: float = 0.8, scoring: str = "distinctiveness") -> DataFrame:
    """(cluster, rank, term, score): cluster mean minus global mean of the weights, or the cluster mean alone.

    Terms are counted, weighted and ranked as 64-bit hashes; the texts of those
    that reach a rank up to k, ties included, are looked up at the end. Where
    stop words and bounds leave no term at all, the fit is made without them.
    """
    n_docs, sizes = docs.count(), docs.groupBy(F.col(cluster).alias("k")).agg(F.count("*").alias("cluster_size"))
    rank = F.rank().over(Window.partitionBy("k").orderBy(F.col("score").desc()))
    for words, least, most in ((STOP_WORDS, min_df, max_df), ((), 1, 1.0)):
        counts = cut_lineage(hashed_counts(docs, id_col, F.col(text_col), ngram, cluster, words))
        best = cut_lineage(_scored(counts, n_docs, sizes, least, most, scoring).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        if not best.isEmpty():
            break
    grams = docs.select(tokens(F.col(text_col), words).alias("words")).select(F.explode(ngrams(F.col("words"), *ngram)).alias("term"))
    wanted = checked_broadcast(best.select("h").distinct())
    texts = grams.withColumn("h", F.xxhash64("term")).join(wanted, "h", "left_semi").distinct()
    named = best.join(texts, "h").select(F.col("k").alias(cluster), "term", "score")
    return top_per_group(named, [cluster], [F.col("score").desc(), F.col("term")], k)


def terms_per_column(docs: DataFrame, id_col: str, columns: Sequence[str], cluster: str, k: int = 15, ngram: tuple[int, int] = (1, 2), min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(cluster, column, rank, term, score): fitted inside each cluster and column, ranked by the sum of weights."""
    texts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns))).alias("x")
    long = docs.select(id_col, cluster, texts).select(id_col, cluster, "x.column", "x.text")
    counts = term_counts(long, id_col, F.col("text"), ngram, keep=[cluster, "column"])
    sizes = long.groupBy(cluster, "column").agg(F.count("*").alias("n_docs"))
    weighted = weights(counts, id_col, sizes, scope=[cluster, "column"], min_df=min_df, max_df=max_df)
    summed = weighted.groupBy(cluster, "column", "term").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top_per_group(summed, [cluster, "column"], [F.col("score").desc(), F.col("term")], k)


def cloud_weights(docs: DataFrame, id_col: str, text_col: str, cluster: str) -> DataFrame:
    """(cluster, term, weight): idf from single documents, counts from a cluster's joined texts, unit length."""
    counts = term_counts(docs, id_col, F.col(text_col), (1, 1), keep=[cluster])
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs)).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    raw = counts.groupBy(cluster, "term").agg(F.sum("tf").alias("tf")).join(idf.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(cluster).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(F.broadcast(norms), cluster).select(cluster, "term", F.round(F.col("raw") / F.col("norm"), 6).alias("weight"))


def term_jaccard(terms: DataFrame, cluster: str, term: str) -> DataFrame:
    """(a, b, jaccard) for every pair a < b of clusters, from shared terms: two empty lists give 0."""
    sets = terms.where(F.col(term).isNotNull()).select(cluster, term).distinct()
    sizes = terms.groupBy(cluster).agg(F.countDistinct(term).alias("n"))
    x, y = sets.select(F.col(cluster).alias("a"), term), sets.select(F.col(cluster).alias("b"), term)
    shared = x.join(y, term).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    # pairs of clusters: a few dozen rows, not of documents
    pairs = sizes.select(F.col(cluster).alias("a"), F.col("n").alias("na")).join(sizes.select(F.col(cluster).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    both = F.coalesce("both", F.lit(0))
    jaccard = F.coalesce(F.try_divide(both.cast("double"), F.col("na") + F.col("nb") - both), F.lit(0.0))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", jaccard.alias("jaccard"))
