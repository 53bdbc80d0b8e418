"""Text, relational and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.operators import summary as S
from tessera.operators import tfidf as X
from tessera.plans.registry import query
from tessera.sources import html as H
from tessera.sources.sinks import encoded, results_json
from tessera.sources.tables import cleaned_games, flattened_response, table

_CLEAN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("clean_text", f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("metadata_concat", f"SELECT p_partkey, {_CLEAN.format("p_name || ' ' || p_type || ' ' || p_brand")} AS metadata FROM part")
def metadata_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.metadata_text(F.col("p_name"), F.split("p_type", " "), F.array("p_brand")).alias("metadata"))


@query(
    "json_list_flatten",
    """WITH v AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_brand FROM part)
    SELECT value, count(*) AS n FROM v GROUP BY value""",
)
def json_list_flatten(spark: SparkSession, d: str) -> DataFrame:
    """List literals and plain scalars in one text column, flattened and counted."""
    p = table(spark, d, "part")
    raw = p.select(F.to_json(F.split("p_name", " ")).alias("raw")).unionByName(p.select(F.col("p_brand").alias("raw")))
    return raw.select(F.explode(T.flatten_literal(F.col("raw"))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("fix_json_list", "SELECT p_partkey, 2 AS n_items, p_brand AS first_item, p_type AS last_item FROM part")
def fix_json_list(spark: SparkSession, d: str) -> DataFrame:
    """Doubly quoted CSV lists."""
    raw = F.concat(F.lit('[""'), F.col("p_brand"), F.lit('"", ""'), F.col("p_type"), F.lit('""]'))
    items = table(spark, d, "part").select("p_partkey", T.fix_json_list(raw).alias("x"))
    return items.select("p_partkey", F.size("x").alias("n_items"), F.element_at("x", 1).alias("first_item"), F.element_at("x", -1).alias("last_item"))


@query(
    "name_sanitize",
    r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name || ': "v1.0" ', '[\\/*?:"<>|]', '', 'g'), '\s+', '_', 'g'), '_') AS file_name,
    trim(regexp_replace(replace(replace(c_name || '_v1.0', '_', ' '), '.', ''), '\s+', ' ', 'g')) AS title FROM customer""",
)
def name_sanitize(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.clean_name(F.concat("c_name", F.lit(': "v1.0" '))).alias("file_name"), T.preprocess_title(F.concat("c_name", F.lit("_v1.0"))).alias("title"))


@query("closest_match")
def closest_match(spark: SparkSession, d: str) -> DataFrame:
    """Of a row's candidate texts the one most like its name (Ratcliff-Obershelp), the first of equals."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.posexplode(F.array("p_type", "p_brand", F.reverse("p_name"))).alias("pos", "candidate"))
    scored = p.withColumn("ratio", F.round(T.sequence_ratio("p_name", "candidate"), 6))
    return R.keep_first(scored, ["p_partkey"], [F.col("ratio").desc(), F.col("pos")]).drop("pos", "p_name")


@query(
    "path_parts",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '/+$', '') AS path FROM pages)
    SELECT page_id, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '(.)\.[^.]*$', '\1') AS stem, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS parent,
    TRY_CAST(nullif(regexp_extract('v' || page_id || '-x', '^v(\d+)', 1), '') AS BIGINT) AS version FROM p""",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "/+$", "")
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", T.path_stem(F.col("path")).alias("stem"), T.parent_name(F.col("path")).alias("parent"), T.version_id(F.concat(F.lit("v"), "page_id", F.lit("-x"))).alias("version"))


@query("games_clean", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS rating, p_brand AS first_theme, 2 AS n_keywords, p_size AS first_release_year FROM part")
def games_clean(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as the CSV sink writes it, read back: lists from JSON text, numbers from text."""
    p = table(spark, d, "part")
    raw = p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("rating"), F.array("p_brand").alias("themes"),
        F.array("p_type", "p_name").alias("keywords"), F.array("p_brand").alias("involved_companies"), F.col("p_size").cast("string").alias("first_release_year"),
    )
    g = cleaned_games(encoded(raw))
    return g.select("id", "name", "rating", F.element_at("themes", 1).alias("first_theme"), F.size("keywords").alias("n_keywords"), "first_release_year")


@query(
    "response_flatten",
    """SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 1) AS rating, 2 AS n_themes, c_mktsegment AS company, 1971 AS first_release_year FROM customer""",
)
def response_flatten(spark: SparkSession, d: str) -> DataFrame:
    """REST responses as JSON text, flattened; repeated names count once and a zero date is none."""
    name = lambda c: F.struct(c.alias("name"))
    body = F.to_json(
        F.struct(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 1).alias("rating"),
            F.array(name(F.lit("a")), name(F.col("c_mktsegment")), name(F.lit("a"))).alias("themes"), F.array(F.struct(name(F.col("c_mktsegment")).alias("company"))).alias("involved_companies"),
            F.array(F.struct(F.lit(0).alias("date")), F.struct(F.lit(40_000_000).alias("date")), F.struct(F.lit(90_000_000).alias("date"))).alias("release_dates"),
        )
    )
    r = flattened_response(table(spark, d, "customer").select(body.alias("body")), "body")
    return r.select("id", "name", "rating", F.size("themes").alias("n_themes"), F.element_at("involved_companies", 1).alias("company"), "first_release_year")


@query("dedup_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.keep_first(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("duplicate_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_ids(table(spark, d, "orders"), "o_custkey")


@query("attach_metadata", "SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS rn FROM labels) l ON l.doc_id = d.doc_id AND rn = 1")
def attach_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.attach_metadata(docs, table(spark, d, "labels"), "doc_id", [F.col("quality"), F.col("toxic")])[0]


@query("missing_metadata", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.attach_metadata(docs, table(spark, d, "labels"), "doc_id", [F.col("quality"), F.col("toxic")])[1]


@query("align_metadata", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def align_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Every order has its customer, or the query fails."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.align(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("left_join_suffix", "SELECT n.n_nationkey AS key, n.n_name AS name, r.r_name AS name_meta FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_nationkey")
def left_join_suffix(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return R.left_join_suffixed(n, table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "key")


@query("anti_join_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 0)")
def anti_join_pending(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return R.pending(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", F.col("o_totalprice") > 0)


@query("semi_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25)")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    wanted = p.groupBy("p_brand").agg(F.avg("p_size").alias("m")).where("m > 25").select("p_brand")
    return p.select("p_partkey", "p_brand").join(wanted, "p_brand", "left_semi")


@query("year_filter", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE o_orderdate IS NOT NULL AND year(o_orderdate) <= 1995")
def year_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")).na.drop(subset=["year"]).where("year <= 1995")


@query("projection", "SELECT vec_id, embedding[1] AS first_value, len(embedding) AS size, label AS cluster FROM embeddings")
def projection(spark: SparkSession, d: str) -> DataFrame:
    e = R.require_columns(table(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("label", "cluster")
    return e.withColumns({"first_value": F.element_at("embedding", 1), "size": F.size("embedding").cast("long")}).drop("embedding")


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A display sample of 100 documents: a sampling operator, the same at every run."""
    return R.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, seed=7)


@query("label_order", "SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS position FROM embeddings")
def label_order(spark: SparkSession, d: str) -> DataFrame:
    """Position in label order, without sorting everything in one task."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select("vec_id", "label")
    starts = F.broadcast(R.label_boundaries(e, "label", "vec_id").select("label", "start"))
    own = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.join(starts, "label").select("vec_id", "label", (F.col("start") + own).cast("long").alias("position"))


@query(
    "label_boundaries",
    """WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label)
    SELECT label, first_id, CAST(coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start",
    CAST(sum(n) OVER (ORDER BY label) AS BIGINT) AS "end" FROM s""",
)
def label_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return R.label_boundaries(table(spark, d, "embeddings"), "label", "vec_id")


@query(
    "top_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""",
)
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query(
    "column_summary",
    """WITH v AS (SELECT p_brand, 'p_type' AS "column", p_type AS value FROM part UNION ALL SELECT p_brand, 'words', unnest(string_split(p_name, ' ')) FROM part
    UNION ALL SELECT p_brand, 'p_size', CAST(p_size AS VARCHAR) FROM part), s AS (SELECT p_brand, count(*) AS cluster_size FROM part GROUP BY p_brand)
    SELECT p_brand, "column", value, count(*) AS n, any_value(cluster_size) AS cluster_size FROM v JOIN s USING (p_brand) GROUP BY p_brand, "column", value""",
)
def column_summary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_type", "p_size", F.split("p_name", " ").alias("words"))
    return S.column_summary(p, "p_brand", ["p_type", "words", "p_size"])


@query(
    "column_summary_json",
    """WITH v AS (SELECT p_brand, p_type AS value, count(*) AS n FROM part GROUP BY ALL)
    SELECT p_brand, 'p_type' AS "column", '{' || string_agg('"' || value || '":' || n, ',' ORDER BY n DESC, value) || '}' AS counts FROM v GROUP BY p_brand""",
)
def column_summary_json(spark: SparkSession, d: str) -> DataFrame:
    return S.summary_json(S.column_summary(table(spark, d, "part").select("p_brand", "p_type"), "p_brand", ["p_type"]), "p_brand")


@query("results_json", """SELECT '{' || string_agg('"' || label || '":' || n, ',' ORDER BY CAST(label AS VARCHAR)) || '}' AS json FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def results_json_query(spark: SparkSession, d: str) -> DataFrame:
    return results_json(table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "label", F.col("n"))


@query(
    "global_distribution",
    """WITH t AS (SELECT 'p_type' AS "column", p_type AS value, count(*) AS total FROM part GROUP BY p_type UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size)
    SELECT "column", value, total, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY total DESC, value) AS INTEGER) AS rank FROM t) WHERE rank <= 10""",
)
def global_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = S.column_summary(table(spark, d, "part").select("p_brand", "p_type", "p_size"), "p_brand", ["p_type", "p_size"])
    return S.global_distribution(s, "column", "value", "n", 10)


@query("year_distribution", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS total FROM orders GROUP BY 1")
def year_distribution(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").cast("string").alias("year"))
    return S.year_distribution(S.column_summary(o, "o_orderpriority", ["year", "o_orderpriority"]), "value", "n")


@query(
    "lift",
    """WITH t AS (SELECT p_brand, unnest(list_concat(string_split(p_name, ' '), string_split(p_type, ' '))) AS tag FROM part), k AS (SELECT * FROM t WHERE length(tag) > 2),
    b AS (SELECT p_brand, tag, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS nc, sum(count(*)) OVER (PARTITION BY tag) AS nt, sum(count(*)) OVER () AS na FROM k GROUP BY p_brand, tag),
    s AS (SELECT p_brand, tag, round((n / nc) / (nt / na), 6) AS lift FROM b)
    SELECT p_brand, tag, lift, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lift DESC, tag) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
)
def lift(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "part").select("p_brand", F.explode_outer(F.concat(F.split("p_name", " "), F.split("p_type", " "))).alias("tag"))
    return S.lift(tags, "p_brand", "tag", 5)


@query("cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query(
    "histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1""",
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", 20)


@query(
    "distribution_stats",
    """SELECT l_returnflag, min(l_extendedprice) AS "min", max(l_extendedprice) AS "max", round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std,
    round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75,
    round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag""",
)
def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.distribution(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])


@query("release_year", "SELECT o_custkey, CAST(year(min(o_orderdate)) AS INTEGER) AS year FROM orders GROUP BY o_custkey")
def release_year(spark: SparkSession, d: str) -> DataFrame:
    epochs = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.unix_timestamp("o_orderdate")).alias("dates"))
    return epochs.select("o_custkey", S.release_year(F.concat("dates", F.array(F.lit(0), F.lit(None).cast("long")))).alias("year"))


@query("html_titles", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query("html_links", """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages) SELECT page_id, unnest(x) AS value, unnest(range(len(x))) :: INTEGER AS pos FROM l""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return H.all_matches(table(spark, d, "pages"), "page_id", F.col("html"), 'href="([^"]*)"')


@query("html_listing", "SELECT page_id, CAST(1 AS INTEGER) AS pos, 'Page ' || page_id AS header, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/f/' || page_id || '.mid' AS url FROM pages")
def html_listing(spark: SparkSession, d: str) -> DataFrame:
    """A listing page per row: a header row, then a file row."""
    p = table(spark, d, "pages")
    body = F.concat(F.lit('<table><tr class="gameheader"><td>Page '), "page_id", F.lit('</td></tr><tr><td><a href="/f/'), "page_id", F.lit('.mid">x</a></td><td><a href="y.mid">y</a></td></tr></table>'))
    return H.listing(p.select("page_id", body.alias("html"), "url"), "page_id", "html", "url")


_TFIDF = f"""
    WITH c AS (SELECT doc_id, lang AS k, string_split({_CLEAN.format("coalesce(text, '')")}, ' ') AS w FROM documents),
    t AS (SELECT doc_id, k, list_filter(w, lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS w FROM c),
    g AS (SELECT doc_id, k, unnest(w) AS term FROM t UNION ALL
          SELECT doc_id, k, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
    f AS (SELECT doc_id, k, term, count(*) AS tf FROM g GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents),
    i AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM f, n GROUP BY term, n HAVING count(*) <= 0.8 * n),
    r AS (SELECT doc_id, k, term, tf * idf AS raw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS norm FROM f JOIN i USING (term)),
    o AS (SELECT k, term, sum(raw / norm) AS own FROM r GROUP BY k, term),
    s AS (SELECT lang AS k, count(*) AS size FROM documents GROUP BY lang),
    m AS (SELECT o.k AS lang, term, round(own / size - {{}}, 6) AS score FROM o JOIN s ON s.k = o.k, n)
    SELECT lang, term, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS INTEGER) AS rank FROM m) WHERE rank <= 20
"""


@query("tfidf_distinct", _TFIDF.format("sum(own) OVER (PARTITION BY term) / n"))
def tfidf_distinct(spark: SparkSession, d: str) -> DataFrame:
    return X.distinctive_terms(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "text", "lang", k=20)


@query("tfidf_mean", _TFIDF.format("0"))
def tfidf_mean(spark: SparkSession, d: str) -> DataFrame:
    return X.distinctive_terms(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "text", "lang", k=20, scoring="tfidf")


@query(
    "tfidf_percolumn",
    f"""
    WITH p AS (SELECT p_partkey, p_brand, 'p_name' AS "column", p_name AS x FROM part UNION ALL SELECT p_partkey, p_brand, 'p_type', p_type FROM part),
    t AS (SELECT p_partkey, p_brand, "column", list_filter(string_split({_CLEAN.format('x')}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS w FROM p),
    g AS (SELECT p_partkey, p_brand, "column", unnest(w) AS term FROM t UNION ALL
          SELECT p_partkey, p_brand, "column", unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
    f AS (SELECT p_partkey, p_brand, "column", term, count(*) AS tf FROM g GROUP BY ALL),
    n AS (SELECT p_brand, "column", count(*) AS n FROM p GROUP BY ALL),
    i AS (SELECT p_brand, "column", term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM f JOIN n USING (p_brand, "column") GROUP BY p_brand, "column", term, n),
    r AS (SELECT p_brand, "column", term, tf * idf AS raw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY p_brand, "column", p_partkey)) AS norm FROM f JOIN i USING (p_brand, "column", term)),
    s AS (SELECT p_brand, "column", term, round(sum(raw / norm), 6) AS score FROM r GROUP BY ALL)
    SELECT p_brand, "column", term, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand, "column" ORDER BY score DESC, term) AS INTEGER) AS rank FROM s) WHERE rank <= 15
    """,
)
def tfidf_percolumn(spark: SparkSession, d: str) -> DataFrame:
    return X.terms_per_column(table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type"), "p_partkey", ["p_name", "p_type"], "p_brand", k=15)


_WORDS = f"""
    WITH t AS (SELECT doc_id, {{0}} AS k, unnest(list_filter(string_split({_CLEAN.format("coalesce(text, '')")}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))) AS term FROM documents)"""


@query(
    "wordcloud_weights",
    _WORDS.format("lang")
    + """, n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln((1 + n) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM t, n GROUP BY term, n),
    r AS (SELECT k, term, count(*) * any_value(idf) AS raw FROM t JOIN i USING (term) GROUP BY k, term)
    SELECT k AS lang, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY k)), 6) AS weight FROM r""",
)
def wordcloud_weights(spark: SparkSession, d: str) -> DataFrame:
    return X.cloud_weights(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "text", "lang")


_JACCARD = (
    _WORDS.format("source")
    + """, s AS (SELECT DISTINCT k, term FROM t), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
    b AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM s x JOIN s y ON x.term = y.term AND x.k < y.k GROUP BY ALL),
    j AS (SELECT x.k AS a, y.k AS b, coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)) AS jaccard FROM n x JOIN n y ON x.k < y.k LEFT JOIN b ON b.a = x.k AND b.b = y.k)"""
)


def _source_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return docs.distinct()


@query("term_jaccard", _JACCARD + " SELECT a, b, round(jaccard, 6) AS jaccard FROM j")
def term_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return X.term_jaccard(_source_terms(spark, d), "source", "term").withColumn("jaccard", F.round("jaccard", 6))


@query("term_jaccard_sum", _JACCARD + " SELECT round(sum(jaccard), 6) AS total, count(*) AS n_pairs FROM j")
def term_jaccard_sum(spark: SparkSession, d: str) -> DataFrame:
    return X.term_jaccard(_source_terms(spark, d), "source", "term").agg(F.round(F.sum("jaccard"), 6).alias("total"), F.count("*").alias("n_pairs"))


@query("term_jaccard_top", _JACCARD + " SELECT a, b, round(jaccard, 6) AS jaccard FROM j ORDER BY round(jaccard, 6) DESC, a, b LIMIT 5")
def term_jaccard_top(spark: SparkSession, d: str) -> DataFrame:
    """The five most alike pairs of sources."""
    return X.term_jaccard(_source_terms(spark, d), "source", "term").withColumn("jaccard", F.round("jaccard", 6)).orderBy(F.col("jaccard").desc(), "a", "b").limit(5)
