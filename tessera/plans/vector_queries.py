"""Sequence, distance, graph, feature, clustering and validation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import features as E
from tessera.operators import graphs as G
from tessera.operators import minhash as M
from tessera.operators import pairwise as P
from tessera.operators import sequences as Q
from tessera.operators import summary as S
from tessera.operators import validate as V
from tessera.operators.cluster import core as C
from tessera.plans import pipelines as L
from tessera.plans.registry import query
from tessera.session import cut_lineage
from tessera.sources.tables import table

#: Event types as tokens.
TOKENS = ("click", "error", "purchase", "signup", "view")
_TOKEN = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TOKENS)) + " END"
_SEQ = f"WITH q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, {_TOKEN} AS token FROM events)"
_CTM = _SEQ + ", p AS (SELECT user_id, token AS a, lead(token) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM q), m AS (SELECT user_id, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL)"


def _token() -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(TOKENS):
        out = F.when(F.col("event_type") == name, F.lit(i)).otherwise(out)
    return out


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", _token().alias("token"))
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("user_id", "pos", "token")


def _event_lists(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return e.select("user_id", F.transform("x", lambda s: s["token"]).alias("tokens"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("token"))
    return li.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "token")))


_ORDERS = "WITH q AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS pos FROM lineitem)"


@query(
    "pause_sequence",
    f"""WITH e AS (SELECT user_id, event_id, ts, {_TOKEN} AS token, epoch(ts) - lag(epoch(ts) + 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    x AS (SELECT user_id, ts, event_id, 1 AS sub, token FROM e UNION ALL SELECT user_id, ts, event_id, 0, 128 FROM e WHERE gap > 7200)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, sub) AS INTEGER) AS pos, token FROM x""",
)
def pause_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Events of a minute's length each; a pause of more than two hours becomes a token."""
    e = table(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return Q.with_pauses(e, "user_id", [F.col("ts"), F.col("event_id")], start, start + 60, _token(), 7200.0)


@query("transition_matrix", _CTM + " SELECT * FROM m")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return Q.transitions(_events(spark, d), "user_id")


@query("transition_rownorm", _CTM + " SELECT user_id, a, b, n, round(n / sum(n) OVER (PARTITION BY user_id, a), 6) AS p FROM m")
def transition_rownorm(spark: SparkSession, d: str) -> DataFrame:
    return Q.row_normalised(Q.transitions(_events(spark, d), "user_id"), "user_id").withColumn("p", F.round("p", 6))


@query("transition_lognorm", _CTM + " SELECT user_id, a, b, n, round(ln(1 + n / sum(n) OVER (PARTITION BY user_id, a)), 6) AS p FROM m")
def transition_lognorm(spark: SparkSession, d: str) -> DataFrame:
    return Q.log_row_normalised(Q.transitions(_events(spark, d), "user_id"), "user_id").withColumn("p", F.round("p", 6))


@query("transition_globalnorm", _CTM + " SELECT user_id, a, b, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS p FROM m")
def transition_globalnorm(spark: SparkSession, d: str) -> DataFrame:
    return Q.globally_normalised(Q.transitions(_events(spark, d), "user_id"), "user_id").withColumn("p", F.round("p", 6))


@query("transition_dense", _CTM + " SELECT user_id, a * 5 + b AS cell, CAST(n AS DOUBLE) AS n FROM m")
def transition_dense(spark: SparkSession, d: str) -> DataFrame:
    """Dense row-major matrices, their non-zero cells shown."""
    dense = Q.dense_matrix(Q.transitions(_events(spark, d), "user_id"), "user_id", len(TOKENS))
    return dense.select("user_id", F.posexplode("matrix").alias("cell", "n")).where("n > 0")


@query(
    "interval_hist",
    _ORDERS
    + """, r AS (SELECT l_orderkey, p - lag(p) OVER (PARTITION BY l_orderkey ORDER BY pos) AS step FROM q), s AS (SELECT l_orderkey, greatest(least(step, 12), -12) AS step FROM r WHERE step IS NOT NULL)
    SELECT l_orderkey, step AS "interval", round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 6) AS share FROM s GROUP BY l_orderkey, step""",
)
def interval_hist(spark: SparkSession, d: str) -> DataFrame:
    return Q.interval_histogram(_orders(spark, d), "l_orderkey").withColumn("share", F.round("share", 6))


@query(
    "pitch_class_matrix",
    _ORDERS + ", c AS (SELECT l_orderkey, p % 12 AS a, lead(p % 12) OVER (PARTITION BY l_orderkey ORDER BY pos) AS b FROM q) SELECT l_orderkey, a, b, count(*) AS n FROM c WHERE b IS NOT NULL GROUP BY ALL",
)
def pitch_class_matrix(spark: SparkSession, d: str) -> DataFrame:
    return Q.pitch_class_matrix(_orders(spark, d), "l_orderkey")


@query(
    "pitch_features",
    _ORDERS
    + """, c AS (SELECT l_orderkey, p % 12 AS a, lead(p % 12) OVER (PARTITION BY l_orderkey ORDER BY pos) AS b, lead(p) OVER (PARTITION BY l_orderkey ORDER BY pos) - p AS s FROM q),
    m AS (SELECT l_orderkey, a, b, count(*) AS n FROM c WHERE b IS NOT NULL GROUP BY ALL),
    h AS (SELECT l_orderkey, greatest(least(s, 12), -12) AS s, count(*) AS n FROM c WHERE s IS NOT NULL GROUP BY ALL)
    SELECT l_orderkey, a * 12 + b AS feature, round(ln(1 + n / sum(n) OVER (PARTITION BY l_orderkey, a)), 6) AS value FROM m
    UNION ALL SELECT l_orderkey, 144 + 12 + s, round(n / sum(n) OVER (PARTITION BY l_orderkey), 6) FROM h""",
)
def pitch_features(spark: SparkSession, d: str) -> DataFrame:
    """169 features a sequence, the non-zero ones shown."""
    return Q.pitch_features(_orders(spark, d), "l_orderkey").withColumn("value", F.round("value", 6))


_SHINGLES = _SEQ + ", s AS (SELECT user_id, (token * 131 + lead(token) OVER w) * 131 + lead(token, 2) OVER w AS item FROM q WINDOW w AS (PARTITION BY user_id ORDER BY pos))"


@query("shingles", _SHINGLES + " SELECT user_id, CAST(item AS BIGINT) AS item, count(*) AS n FROM s WHERE item IS NOT NULL GROUP BY ALL")
def shingles(spark: SparkSession, d: str) -> DataFrame:
    return M.sequence_shingles(_event_lists(spark, d), "user_id", F.col("tokens"), 3).groupBy("user_id", "item").agg(F.count("*").alias("n"))


_K = 100
_COEFFICIENTS = ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(M.coefficients(_K)))
_MINHASH = (
    _SHINGLES
    + f""", i AS (SELECT DISTINCT user_id, item FROM s WHERE item IS NOT NULL), c(slot, a, b) AS (VALUES {_COEFFICIENTS}),
    g AS (SELECT user_id, slot, CAST(min(((a * item + b) % 18446744073709551616::HUGEINT) % 4294967295) AS BIGINT) AS value FROM i, c GROUP BY user_id, slot
          UNION ALL SELECT user_id, slot, 0 FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM i)), c)"""
)


@query("minhash_sig", _MINHASH + " SELECT user_id, slot, value FROM g")
def minhash_sig(spark: SparkSession, d: str) -> DataFrame:
    return M.slots(_signatures(spark, d), "user_id")


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return M.list_signatures(_event_lists(spark, d), "user_id", M.shingle_items(F.col("tokens"), 3), _K, empty=True)


@query("minhash_sim", _MINHASH + f" SELECT x.user_id AS i, y.user_id AS j, round(count(*) / {_K}, 6) AS similarity FROM g x JOIN g y ON x.slot = y.slot AND x.value = y.value AND x.user_id < y.user_id GROUP BY ALL")
def minhash_sim(spark: SparkSession, d: str) -> DataFrame:
    return M.list_similarities(_signatures(spark, d), "user_id", _K, 1 / _K).withColumn("similarity", F.round("similarity", 6))


@query("minhash_near", _MINHASH + f" SELECT * FROM (SELECT x.user_id AS i, y.user_id AS j, round(count(*) / {_K}, 6) AS similarity FROM g x JOIN g y ON x.slot = y.slot AND x.value = y.value AND x.user_id < y.user_id GROUP BY ALL) WHERE similarity >= 0.5")
def minhash_near(spark: SparkSession, d: str) -> DataFrame:
    """Alike pairs by bands or, where too many meet there, by blocks; verified on all slots."""
    return M.similar_lists(_signatures(spark, d), "user_id", _K, 0.5).withColumn("similarity", F.round("similarity", 6))


@query(
    "minhash_variants",
    _SEQ
    + f""", t AS (SELECT user_id, list(token ORDER BY pos) AS x FROM q GROUP BY user_id), d AS (SELECT user_id, x, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS y FROM t),
    v AS (SELECT user_id, 'sequence' AS variant, 131 AS base, x AS z FROM d UNION ALL SELECT user_id, 'interval', 257, list_transform(y, lambda s: s + 128) FROM d
          UNION ALL SELECT user_id, 'interval class', 131, list_transform(y, lambda s: (s % 12 + 12) % 12) FROM d),
    i AS (SELECT DISTINCT user_id, variant, n, unnest(list_transform(range(1, len(z) - n + 2), lambda k: list_reduce(list_prepend(0::HUGEINT, z[k:k + n - 1]), lambda h, w: h * base + w))) AS item FROM v, (VALUES (3), (4), (5)) u(n)),
    c(slot, a, b) AS (VALUES {_COEFFICIENTS}),
    g AS (SELECT variant, n, user_id, slot, min(((a * item + b) % 18446744073709551616::HUGEINT) % 4294967295) AS value FROM i, c GROUP BY ALL)
    SELECT x.variant, CAST(x.n AS INTEGER) AS q, round(2 * count(*) / {_K}, 6) AS total FROM g x JOIN g y ON x.variant = y.variant AND x.n = y.n AND x.slot = y.slot AND x.value = y.value AND x.user_id < y.user_id GROUP BY ALL""",
)
def minhash_variants(spark: SparkSession, d: str) -> DataFrame:
    """Summed similarities of sequences, of their intervals and of the intervals' classes, by shingle length."""
    lists = cut_lineage(_event_lists(spark, d))
    steps = Q.intervals(F.col("tokens"))
    kinds = {"sequence": (F.col("tokens"), 131), "interval": (M.shifted_intervals(steps), 257), "interval class": (Q.pitch_classes(steps), 131)}
    own = [
        F.struct(F.lit(variant).alias("variant"), F.lit(n).alias("q"), M.shingle_items(values, n, base).alias("items"))
        for variant, (values, base) in kinds.items()
        for n in (3, 4, 5)
    ]
    each = lists.select("user_id", F.explode(F.array(*own)).alias("x"))
    sig = M.list_signatures(each, F.struct("x.variant", "x.q", "user_id"), F.col("x.items"), _K).select("key.*", "values")
    return M.totals(sig, "user_id", _K, ("variant", "q")).withColumn("total", F.round("total", 6))


@query("graph_layout")
def graph_layout(spark: SparkSession, d: str) -> DataFrame:
    """Places of the nodes in a drawing, by classical scaling of their distances; of each axis the sign is free, so squares are shown."""
    x = G.vector_layout(_embeddings(spark, d), "vec_id", "v")
    return x.select("id", *(F.round(F.col("v")[k] * F.col("v")[k], 6).alias(f"square_{k + 1}") for k in range(2)))


@query("minhash_total", _MINHASH + f" SELECT round(2 * count(*) / {_K}, 6) AS total FROM g x JOIN g y ON x.slot = y.slot AND x.value = y.value AND x.user_id < y.user_id")
def minhash_total(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the similarity matrix without its diagonal."""
    return M.totals(_signatures(spark, d), "user_id", _K).agg(F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 6).alias("total"))


@query(
    "interval_shingles",
    _SEQ
    + """, v AS (SELECT user_id, pos, token - lag(token) OVER (PARTITION BY user_id ORDER BY pos) + 128 AS x FROM q),
    s AS (SELECT user_id, x * 257 + lead(x) OVER (PARTITION BY user_id ORDER BY pos) AS item FROM v WHERE x IS NOT NULL)
    SELECT user_id, CAST(item AS BIGINT) AS item, count(*) AS n FROM s WHERE item IS NOT NULL GROUP BY ALL""",
)
def interval_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Shingles of intervals, shifted so that the encoding stays one to one."""
    x = _event_lists(spark, d)
    return M.sequence_shingles(x, "user_id", M.shifted_intervals(Q.intervals(F.col("tokens"))), 2, base=257).groupBy("user_id", "item").agg(F.count("*").alias("n"))


@query(
    "kl_pairs",
    _CTM
    + """, p2 AS (SELECT user_id, a * 5 + b AS c, n / sum(n) OVER (PARTITION BY user_id) AS p FROM m), u AS (SELECT DISTINCT user_id FROM m),
    f AS (SELECT u.user_id, g.c, greatest(coalesce(p2.p, 0), 1e-10) AS p FROM u CROSS JOIN range(25) g(c) LEFT JOIN p2 ON p2.user_id = u.user_id AND p2.c = g.c)
    SELECT x.user_id AS i, y.user_id AS j, round(0.5 * sum((x.p - y.p) * (ln(x.p) - ln(y.p))), 6) AS d FROM f x JOIN f y ON x.c = y.c AND x.user_id < y.user_id GROUP BY ALL""",
)
def kl_pairs(spark: SparkSession, d: str) -> DataFrame:
    cells = Q.globally_normalised(Q.transitions(_events(spark, d), "user_id"), "user_id")
    dense = Q.dense_matrix(cells, "user_id", len(TOKENS), "p")
    return P.pairs(dense, "user_id", "matrix", "kl").withColumn("d", F.round("d", 6) + 0.0)


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_PAIRS = _V + ", p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id)"
_NEAR = _V + ", p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS INTEGER) AS rank FROM p)"


@query("cosine_pairs", _V + " SELECT a.vec_id AS i, b.vec_id AS j, round(1 - list_cosine_similarity(a.x, b.x), 6) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.pairs(_embeddings(spark, d), "vec_id", "v", "cosine").withColumn("d", F.round("d", 6) + 0.0)


@query("cosine_topk", _V + " SELECT a.vec_id AS i, b.vec_id AS j, round(1 - list_cosine_similarity(a.x, b.x), 6) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id ORDER BY 3, 1, 2 LIMIT 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten closest pairs: every row's ten nearest are enough to find them."""
    near = P.nearest(_embeddings(spark, d), "vec_id", "v", "cosine", 10).where("src < dst")
    return near.select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.round("d", 6) + 0.0).alias("d")).orderBy("d", "i", "j").limit(10)


@query("frobenius_pairs", _PAIRS + " SELECT i, j, round(d, 6) AS d FROM p UNION ALL SELECT j, i, round(d, 6) FROM p")
def frobenius_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs."""
    return P.pairs(_embeddings(spark, d), "vec_id", "v", "frobenius", ordered=True).withColumn("d", F.round("d", 6))


@query("distances_within", _PAIRS + " SELECT i, j, round(d, 6) AS d FROM p WHERE d <= 1.15")
def distances_within(spark: SparkSession, d: str) -> DataFrame:
    return P.pairs(_embeddings(spark, d), "vec_id", "v", "euclidean", within=1.15).withColumn("d", F.round("d", 6))


@query(
    "outliers_to_mean",
    _V + ", m AS (SELECT list(a ORDER BY pos) AS c FROM (SELECT pos, avg(x[pos]) AS a FROM v, range(1, 65) r(pos) GROUP BY pos)) SELECT vec_id, round(list_distance(x, c), 6) AS d FROM v, m ORDER BY 2 DESC, 1 LIMIT 10",
)
def outliers_to_mean(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows farthest from the mean."""
    e = _embeddings(spark, d)
    mean = F.broadcast(S.element_means(e, "v"))
    off = E.long_form(e, "vec_id", "v").join(mean, "pos").groupBy("vec_id").agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))), 6).alias("d"))
    return off.orderBy(F.col("d").desc(), "vec_id").limit(10)


_GAUSS = _PAIRS + ", s AS (SELECT median(d) * {} AS sigma FROM p WHERE d > 0) SELECT i, j, round(exp(-d * d / (2 * sigma * sigma)), 6) AS w FROM p, s"


@query("gauss_kernel", _GAUSS.format("1"))
def gauss_kernel(spark: SparkSession, d: str) -> DataFrame:
    return G.gaussian_kernel(_embeddings(spark, d), "vec_id", "v").select("i", "j", F.round("w", 6).alias("w"))


@query("gauss_kernel_half", _GAUSS.format("0.5"))
def gauss_kernel_half(spark: SparkSession, d: str) -> DataFrame:
    return G.gaussian_kernel(_embeddings(spark, d), "vec_id", "v", 0.5).select("i", "j", F.round("w", 6).alias("w"))


@query("knn_graph", _NEAR + " SELECT src, dst, round(d, 6) AS d, rank FROM k WHERE rank <= 10")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest(_embeddings(spark, d), "vec_id", "v", "euclidean", 10).withColumn("d", F.round("d", 6))


_LOCAL = (
    _NEAR
    + """, n AS (SELECT * FROM k WHERE rank <= 15), g0 AS (SELECT src, 2 * avg(d) AS s FROM n GROUP BY src), g AS (SELECT src, CASE WHEN s < 1e-9 THEN (SELECT avg(s) FROM g0) + 1e-9 ELSE s END AS s FROM g0),
    l AS (SELECT least(n.src, dst) AS i, greatest(n.src, dst) AS j, max(greatest(exp(-d * d / (g.s * t.s)), 1e-4)) AS w FROM n JOIN g ON g.src = n.src JOIN g t ON t.src = n.dst GROUP BY ALL)"""
)


@query("local_scaled_sim", _LOCAL + " SELECT i, j, round(w, 6) AS w FROM l")
def local_scaled_sim(spark: SparkSession, d: str) -> DataFrame:
    return G.local_scaled(P.nearest(_embeddings(spark, d), "vec_id", "v", "euclidean", 15)).withColumn("w", F.round("w", 6))


@query("top_similar", _LOCAL + ", e AS (SELECT i AS src, j AS dst, w FROM l UNION ALL SELECT j, i, w FROM l) SELECT src, dst, round(w, 6) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS INTEGER) AS rank FROM e) WHERE rank <= 5")
def top_similar(spark: SparkSession, d: str) -> DataFrame:
    edges = G.local_scaled(P.nearest(_embeddings(spark, d), "vec_id", "v", "euclidean", 15))
    return G.top_similar(edges, "w", 5).withColumn("weight", F.round("weight", 6))


@query("edges_within_mean", _PAIRS.replace(", p AS (", ", p AS MATERIALIZED (") + ", m AS MATERIALIZED (SELECT 0.7 * avg(d) AS most FROM p WHERE d > 0) SELECT i, j, round(d, 6) AS d FROM p, m WHERE d <= most")
def edges_within_mean(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_within_mean(_embeddings(spark, d), "vec_id", "v").withColumn("d", F.round("d", 6))


@query("edges_above_percentile", _PAIRS + " SELECT i, j, round(d, 6) AS d FROM p WHERE d >= (SELECT quantile_cont(d, 0.75) FROM p)")
def edges_above_percentile(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_above_percentile(_embeddings(spark, d), "vec_id", "v").withColumn("d", F.round("d", 6))


_DRAWN = _PAIRS + ", e AS (SELECT * FROM p WHERE d > 0 AND d < (SELECT quantile_cont(d, 0.2) FROM p)), b AS (SELECT min(d) AS lo, max(d) AS hi FROM e)"


@query("drawing_edges", _DRAWN + " SELECT i, j, round(d, 6) AS d, round((d - lo) / (hi - lo), 6) AS norm, round(0.5 + 2.5 * (1 - (d - lo) / (hi - lo)), 6) AS width, round(0.1 + 0.7 * (1 - (d - lo) / (hi - lo)), 6) AS alpha, round(1 + (d - lo) / (hi - lo), 6) AS length FROM e, b")
def drawing_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a graph drawing: the nearest fifth, with width, opacity and length."""
    e = G.drawing_edges(_embeddings(spark, d), "vec_id", "v")
    return e.select("i", "j", *(F.round(c, 6).alias(c) for c in ("d", "norm", "width", "alpha", "length")))


@query("graph_nodes", "SELECT doc_id AS id, coalesce(source, '') || ' ' || coalesce(lang, '') AS title, lang AS cluster FROM documents")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes keyed by id; the title is an attribute, so equal titles stay apart."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit(""))).alias("title"), F.col("lang").alias("cluster"))


@query(
    "modularity",
    _LOCAL
    + """, e AS (SELECT l.w, a.label AS li, b.label AS lj FROM l JOIN v a ON a.vec_id = i JOIN v b ON b.vec_id = j),
    s AS (SELECT label, sum(inside) AS inside, sum(w) AS ends FROM (SELECT li AS label, CASE WHEN li = lj THEN w ELSE 0 END AS inside, w FROM e UNION ALL SELECT lj, CASE WHEN li = lj THEN w ELSE 0 END, w FROM e) GROUP BY label)
    SELECT round(sum(inside / t - (ends / t) * (ends / t)), 6) AS modularity FROM s, (SELECT sum(ends) AS t FROM s)""",
)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    edges = G.local_scaled(P.nearest(e, "vec_id", "v", "euclidean", 15))
    return G.modularity(edges, e.select(F.col("vec_id").alias("id"), "label")).withColumn("modularity", F.round("modularity", 6))


_LONG = _V + ", l AS (SELECT vec_id, label, pos - 1 AS pos, x[pos] AS x FROM v, range(1, 65) r(pos))"


@query("standardize", _LONG + " SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 6) + 0.0 AS z FROM l WINDOW w AS (PARTITION BY pos)")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return E.standardised(_embeddings(spark, d), "vec_id", "v").withColumn("z", F.round("z", 6) + 0.0)


@query("l2_normalize", _LONG + " SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS x FROM l")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = E.l2_normalised(_embeddings(spark, d), "vec_id", "v")
    return E.long_form(n, "vec_id", "v").withColumn("x", F.round("x", 6) + 0.0)


@query("centroids", _LONG + " SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean FROM l GROUP BY label, pos")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return S.element_means(_embeddings(spark, d), "v", ["label"]).withColumn("mean", F.round("mean", 6) + 0.0)


@query("global_mean", _LONG + " SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean FROM l GROUP BY pos")
def global_mean(spark: SparkSession, d: str) -> DataFrame:
    return S.element_means(_embeddings(spark, d), "v").withColumn("mean", F.round("mean", 6) + 0.0)


@query("pooled_features", _LONG + " SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS x FROM l GROUP BY label, pos UNION ALL SELECT label, CAST(64 + pos AS INTEGER), round(stddev_samp(x), 6) + 0.0 FROM l GROUP BY label, pos")
def pooled_features(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation over a group's frames, side by side."""
    pooled = E.pooled(_embeddings(spark, d), "label", "v")
    return E.long_form(pooled, "label", "v").withColumn("x", F.round("x", 6) + 0.0)


@query(
    "iqr_mask",
    _LONG + ", b AS (SELECT pos, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY pos) SELECT vec_id, bool_and(x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS keep FROM l JOIN b USING (pos) GROUP BY vec_id",
)
def iqr_mask(spark: SparkSession, d: str) -> DataFrame:
    return E.iqr_mask(_embeddings(spark, d), "vec_id", "v")


@query("mahalanobis_mask")
def mahalanobis_mask(spark: SparkSession, d: str) -> DataFrame:
    """On all dimensions."""
    return E.mahalanobis(_embeddings(spark, d), "vec_id", "v", 0.01).withColumns({"d2": F.round("d2", 6), "threshold": F.round("threshold", 6)})


@query("pca_variance")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance by component, and where 90 % is reached."""
    pca = E.fit_pca(_embeddings(spark, d), "v")
    total = np.cumsum(pca.ratio)
    rows = [(i + 1, round(float(r), 6), round(float(t), 6), i < len(pca.components)) for i, (r, t) in enumerate(zip(pca.ratio, total, strict=True))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double, kept boolean")


@query("pca_scatter")
def pca_scatter(spark: SparkSession, d: str) -> DataFrame:
    """The first three principal components with labels, for a scatter plot."""
    e = _embeddings(spark, d)
    x = E.fit_pca(e, "v", 3).transform(e, "vec_id", "v")
    return x.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", *(F.round(F.col("v")[i], 6).alias(f"pc{i + 1}") for i in range(3)))


@query("preprocess")
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    """Standardised, reduced to 90 % of the variance, outliers at 0.001 out."""
    x = E.preprocess(_embeddings(spark, d), "vec_id", "v")
    return x.select("vec_id", F.size("v").alias("n_components"), F.round(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y), 6).alias("squares"))


@query("outlier_counts")
def outlier_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.outlier_counts(_embeddings(spark, d), "vec_id", "v")


_CENT = _LONG + ", c AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY label, pos)"
_ASSIGN = _CENT + ", k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM c)), s AS (SELECT vec_id, k.k, sqrt(sum((l.x - c.m) ** 2)) AS d FROM l JOIN c USING (pos) JOIN k ON k.label = c.label GROUP BY vec_id, k.k), a AS (SELECT vec_id, k AS label, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), k) AS rn FROM s) WHERE rn = 1)"


def _label_means(spark: SparkSession, d: str) -> np.ndarray:
    long = S.element_means(_embeddings(spark, d), "v", ["label"]).toPandas()  # clusters x dimensions
    return long.pivot(index="label", columns="pos", values="mean").sort_index().to_numpy()


@query("nearest_centroid", _ASSIGN + " SELECT vec_id, CAST(label AS INTEGER) AS label, round(d, 6) AS d FROM a")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return C.nearest_centroid(_embeddings(spark, d), "vec_id", "v", _label_means(spark, d)).withColumn("d", F.round("d", 6))


@query("kmeans_step", _ASSIGN + " SELECT CAST(a.label AS INTEGER) AS label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean FROM l JOIN a USING (vec_id) GROUP BY a.label, pos")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    """One Lloyd update from the labels' means."""
    e = _embeddings(spark, d).drop("label")
    labelled = e.join(C.nearest_centroid(e, "vec_id", "v", _label_means(spark, d)).select("vec_id", "label"), "vec_id")
    return S.element_means(labelled, "v", ["label"]).withColumn("mean", F.round("mean", 6) + 0.0)


@query("kmeans")
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical(C.run_clustering("kmeans", _embeddings(spark, d), "vec_id", "v", k=6), "vec_id")


@query("divisive")
def divisive(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical(C.run_clustering("divisive", _embeddings(spark, d), "vec_id", "v", k=6), "vec_id")


@query(
    "dbscan",
    _PAIRS.replace("WITH v", "WITH RECURSIVE v", 1)
    + """, n AS (SELECT i, j FROM p WHERE d <= 1.15 UNION ALL SELECT j, i FROM p WHERE d <= 1.15), c AS (SELECT v.vec_id AS i FROM v LEFT JOIN n ON n.i = v.vec_id GROUP BY v.vec_id HAVING count(n.j) + 1 >= 3),
    e AS (SELECT n.i, n.j FROM n JOIN c a ON a.i = n.i JOIN c b ON b.i = n.j), r AS (SELECT i, i AS root FROM c UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.i),
    o AS (SELECT i, min(root) AS root FROM r GROUP BY i), k AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM o),
    b AS (SELECT n.i, min(k.label) AS label FROM n JOIN k ON k.i = n.j WHERE n.i NOT IN (SELECT i FROM c) GROUP BY n.i)
    SELECT v.vec_id, CAST(coalesce(k.label, b.label, -1) AS INTEGER) AS label FROM v LEFT JOIN k ON k.i = v.vec_id LEFT JOIN b ON b.i = v.vec_id""",
)
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return C.run_clustering("dbscan", _embeddings(spark, d), "vec_id", "v", eps=1.15, min_samples=3)


@query("hierarchical")
def hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return C.run_clustering("hierarchical", _embeddings(spark, d), "vec_id", "v", k=6, linkage="average")


@query("ward_merges")
def ward_merges(spark: SparkSession, d: str) -> DataFrame:
    """The merge table behind a dendrogram."""
    _, merged = C.Hierarchical(1, "ward").merge_table(_embeddings(spark, d), "vec_id", "v")
    return spark.createDataFrame([(t, a, b, round(x, 6), n) for t, (a, b, x, n) in enumerate(merged)], "step int, a int, b int, distance double, size int")


@query("spectral")
def spectral(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical(C.run_clustering("spectral", _embeddings(spark, d), "vec_id", "v", k=6), "vec_id")


@query("clustering_comparison")
def clustering_comparison(spark: SparkSession, d: str) -> DataFrame:
    return C.compare(_embeddings(spark, d), "vec_id", "v", [("kmeans", {"k": 6}), ("divisive", {"k": 6}), ("dbscan", {"eps": 1.15, "min_samples": 3})])


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Scores by number of clusters, on one reduced feature frame."""
    e = cut_lineage(E.preprocess(_embeddings(spark, d), "vec_id", "v", n_components=8))
    return V.sweep(e, "vec_id", "v", lambda k: C.run_clustering("kmeans", e, "vec_id", "v", k=k), (*range(2, 11), 12, 15, 20, 25))


@query("cluster_report")
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with texts, end to end: reduced, clustered, explained by their most distinctive terms."""
    rows = table(spark, d, "documents").join(_embeddings(spark, d).withColumnRenamed("vec_id", "doc_id").drop("label"), "doc_id")
    return L.evaluate(rows, "doc_id", "v", "text", ["lang", "source"]).terms


@query("cluster_report_counts")
def cluster_report_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same path's value counts by cluster."""
    rows = table(spark, d, "documents").join(_embeddings(spark, d).withColumnRenamed("vec_id", "doc_id").drop("label"), "doc_id")
    return L.evaluate(rows, "doc_id", "v", "text", ["lang", "source"]).counts


@query("tuning_scores")
def tuning_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.tune(_embeddings(spark, d), "vec_id", "v")


@query("dbscan_tuning")
def dbscan_tuning(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes by eps; -1 where there is noise or one cluster."""
    return V.tune_density(_embeddings(spark, d), "vec_id", "v", (0.6, 0.8, 1.0, 1.15, 1.3, 1.5), min_samples=3).withColumn("silhouette", F.round("silhouette", 6))


@query("hierarchical_tuning")
def hierarchical_tuning(spark: SparkSession, d: str) -> DataFrame:
    """Scores by number of clusters, of one merge table."""
    return V.tune_hierarchical(_embeddings(spark, d), "vec_id", "v", range(2, 11))


@query("similarity_neighbours")
def similarity_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour graph of Gaussian similarity rows."""
    return G.gaussian_neighbours(_embeddings(spark, d), "vec_id", "v", 10)


@query("graph_scores")
def graph_scores(spark: SparkSession, d: str) -> DataFrame:
    """Spectral clusterings of the users' transition matrices under the KL distance."""
    cells = Q.globally_normalised(Q.transitions(_events(spark, d), "user_id"), "user_id")
    return L.graph_sweep(Q.dense_matrix(cells, "user_id", len(TOKENS), "p").withColumnRenamed("matrix", "v"), "user_id", "v", range(2, 15))


_SIL = _PAIRS + """, n AS (SELECT label, count(*) AS n FROM v GROUP BY label),
    b AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p), t AS (SELECT v.vec_id AS id, v.label, o.label AS other, sum(d) AS total FROM b JOIN v ON v.vec_id = b.i JOIN v o ON o.vec_id = b.j GROUP BY ALL),
    s AS (SELECT v.vec_id AS id, v.label, max(CASE WHEN t.other = v.label THEN total / (n.n - 1) END) AS a, min(CASE WHEN t.other <> v.label THEN total / n.n END) AS b FROM v JOIN t ON t.id = v.vec_id JOIN n ON n.label = t.other GROUP BY ALL),
    r AS (SELECT id, CAST(label AS BIGINT) AS label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM s)"""


@query("silhouette_rows", _SIL + " SELECT id, label, round(silhouette, 6) AS silhouette FROM r")
def silhouette_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.silhouettes(_embeddings(spark, d), "vec_id", "v", "label").withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette", _SIL + " SELECT round(avg(silhouette), 6) AS silhouette FROM r")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return V.silhouette(_embeddings(spark, d), "vec_id", "v", "label").withColumn("silhouette", F.round("silhouette", 6))


_OFF = _CENT + ", o AS (SELECT vec_id, l.label, sqrt(sum((x - m) ** 2)) AS d FROM l JOIN c ON c.label = l.label AND c.pos = l.pos GROUP BY vec_id, l.label)"


@query(
    "davies_bouldin",
    _OFF
    + """, s AS (SELECT label, avg(d) AS s FROM o GROUP BY label), q AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL),
    r AS (SELECT i, max((x.s + y.s) / CASE WHEN d = 0 THEN 1e-12 ELSE d END) AS r FROM q JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i) SELECT round(avg(r), 6) AS davies_bouldin FROM r""",
)
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return V.davies_bouldin(_embeddings(spark, d), "vec_id", "v", "label").withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@query(
    "calinski_harabasz",
    _OFF
    + """, n AS (SELECT label, count(*) AS n FROM v GROUP BY label), g AS (SELECT pos, avg(x) AS m FROM l GROUP BY pos),
    b AS (SELECT sum(n * (c.m - g.m) ** 2) AS b FROM c JOIN g USING (pos) JOIN n ON n.label = c.label), w AS (SELECT sum(d * d) AS w, count(*) AS n, count(DISTINCT label) AS k FROM o)
    SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w""",
)
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return V.calinski_harabasz(_embeddings(spark, d), "vec_id", "v", "label").withColumn("calinski_harabasz", F.round("calinski_harabasz", 6))


@query("dispersion", _OFF + " SELECT round(avg(a), 6) AS dispersion FROM (SELECT label, avg(d) AS a FROM o GROUP BY label)")
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return V.dispersion(_embeddings(spark, d), "vec_id", "v", "label").withColumn("dispersion", F.round("dispersion", 6))
