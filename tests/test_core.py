"""Operators against independent NumPy or plain Python versions."""

import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import features as E
from tessera.operators import graphs as G
from tessera.operators import minhash as M
from tessera.operators import pairwise as P
from tessera.operators import relational as R
from tessera.operators import sequences as Q
from tessera.operators import summary as S
from tessera.operators import tfidf as X
from tessera.operators import validate as V
from tessera.operators.cluster import core as C
from tessera.operators.components import components
from tessera.sources import html, midi, sinks, tables


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 4)) * 5
    label = np.repeat([0, 1, 2], [14, 11, 1])
    return centres[label] + rng.normal(size=(26, 4)), label


@pytest.fixture(scope="module")
def frame(spark, points):
    x, label = points
    return spark.createDataFrame([(int(i), int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(label, x, strict=True))], "id long, label int, v array<double>").repartition(3)


def test_text_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  A--b  É "), (4, '["x","y"]'), (5, '[""a"", ""b""]'), (6, "['q'"), (7, "1999")]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: r for r in df.select("i", T.clean_text(F.col("s")).alias("c"), T.flatten_literal(F.col("s")).alias("f"), T.fix_json_list(F.col("s")).alias("j")).collect()}
    assert got[1].c is None and got[1].f == [] and got[1].j == []
    assert got[2].c == "" and got[3].c == "a b"
    assert got[4].f == ["x", "y"] and got[5].j == ["a", "b"] and got[7].f == ["1999"]


def test_names_and_paths(spark):
    df = spark.createDataFrame([(' a:b?  c ', "My_Game v1.0", "v12_x", "/d/e/f.tar.gz", '"quoted"')], "n string, t string, v string, p string, q string")
    r = df.select(T.clean_name(F.col("n")), T.preprocess_title(F.col("t")), T.version_id(F.col("v")), T.path_stem(F.col("p")), T.parent_name(F.col("p")), T.strip_outer_quotes(F.col("q"))).first()
    assert tuple(r) == ("ab_c", "My Game v10", 12, "f.tar", "e", "quoted")


def test_matrix_text(spark):
    df = spark.createDataFrame([("[[1,2],[3,4]]",), ("[[[1,2],[3,4]]]",)], "s string")
    assert [r[0] for r in df.select(T.parsed_matrix(F.col("s"), 2, 2)).collect()] == [[[1, 2], [3, 4]]] * 2
    with pytest.raises(Exception, match="not 3 x 3"):
        df.select(T.parsed_matrix(F.col("s"), 3, 3)).collect()


def test_relational(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "id long, x string, o int")
    assert sorted(map(tuple, R.keep_first(df, ["id"], [F.col("o")]).select("id", "x").collect())) == [(1, "a"), (2, "c")]
    assert R.duplicate_ids(df, "id").collect()[0].n == 2
    with pytest.raises(ValueError, match="missing columns: y"):
        R.require_columns(df, "id", "y")
    with pytest.raises(KeyError):
        R.align(df, spark.createDataFrame([(1, 0)], "id long, m int"), "id")
    wide = R.left_join_suffixed(df, spark.createDataFrame([(1, "z")], "id long, x string"), "id")
    assert wide.columns == ["id", "x", "o", "x_meta"] and wide.where("x_meta IS NULL").count() == 1


def test_pauses_and_transitions(spark):
    notes = [("p", 0.0, 1.0, 60, 0), ("p", 1.05, 1.2, 62, 1), ("p", 1.5, 9.0, 64, 2), ("p", 2.0, 2.5, 60, 3), ("q", 0.0, 1.0, 5, 0)]
    df = spark.createDataFrame(notes, "id string, s double, e double, t int, n int")
    long = Q.with_pauses(df, "id", [F.col("s"), F.col("n")], F.col("s"), F.col("e"), F.col("t"), 0.1)
    got = [r.token for r in long.where("id = 'p'").orderBy("pos").collect()]
    assert got == [60, 62, 128, 64, 60]
    counts = {(r.a, r.b): r.n for r in Q.transitions(long, "id").collect()}
    assert sum(counts.values()) == 4 and counts[128, 64] == 1
    p = Q.row_normalised(Q.transitions(long, "id"), "id").groupBy("id", "a").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in p)


def test_short_sequences(spark):
    df = spark.createDataFrame([(1, []), (2, [7]), (3, [1, 2, 3])], "i int, t array<int>")
    got = {r.i: r for r in df.select("i", Q.shingles(F.col("t"), 2).alias("s"), Q.intervals(F.col("t")).alias("d"), Q.pitch_classes(F.col("t")).alias("c")).collect()}
    assert got[1].s == [] and got[2].s == [] and got[3].s == [[1, 2], [2, 3]]
    assert got[1].d == [] and got[2].d == [] and got[3].d == [1, 1] and got[3].c == [1, 2, 3]


def test_minhash_matches_wrapping_arithmetic(spark):
    rng = np.random.default_rng(0)
    items = rng.integers(0, 131**5, 200)
    got = {r.slot: r.value for r in M.signatures(spark.createDataFrame([(1, int(x)) for x in items], "id int, item long"), "id", "item", 20).collect()}
    a, b = (np.array(x, np.uint64) for x in zip(*M.coefficients(20), strict=True))
    with np.errstate(over="ignore"):
        want = ((a[:, None] * items.astype(np.uint64)[None, :] + b[:, None]) % np.uint64(M.MODULUS)).min(axis=1)
    assert [got[i] for i in range(20)] == want.tolist()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "kl"])
def test_pairs_cover_all(frame, points, metric):
    x = points[0] if metric != "kl" else np.abs(points[0])
    df = frame if metric != "kl" else frame.withColumn("v", F.transform("v", F.abs))
    got = {(r.i, r.j): r.d for r in P.pairs(df, "id", "v", metric, chunk=5).collect()}
    assert len(got) == 26 * 25 // 2
    for (i, j), d in got.items():
        a, b = x[i], x[j]
        if metric == "cosine":
            want = 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        elif metric == "euclidean":
            want = np.linalg.norm(a - b)
        else:
            a, b = np.maximum(a, P.EPS), np.maximum(b, P.EPS)
            want = 0.5 * ((a * np.log(a / b)).sum() + (b * np.log(b / a)).sum())
        assert abs(d - want) < 1e-9


def test_zero_vector_cosine():
    assert P.cosine_distance(np.zeros((1, 3)), np.ones((2, 3))).tolist() == [[1.0, 1.0]]


def test_nearest_any_chunking(frame, points):
    d = np.linalg.norm(points[0][:, None] - points[0][None, :], axis=2)
    np.fill_diagonal(d, np.inf)
    for chunk in (4, 1000):
        got = {(r.src, r["rank"]): r.dst for r in P.nearest(frame, "id", "v", "euclidean", 3, chunk=chunk).collect()}
        assert all(got[i, k + 1] == j for i in range(26) for k, j in enumerate(np.argsort(d[i])[:3]))


def test_silhouette_and_scores(frame, points):
    x, label = points
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    s = []
    for i in range(26):
        own = (label == label[i]) & (np.arange(26) != i)
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        s.append(0.0 if not own.any() else (b - d[i, own].mean()) / max(b, d[i, own].mean()))
    assert abs(V.silhouette(frame, "id", "v", "label").first()[0] - np.mean(s)) < 1e-9
    one = V.silhouettes(frame, "id", "v", "label", singleton="one").where("id = 25").first()
    assert one.silhouette == 1.0
    c = np.array([x[label == k].mean(axis=0) for k in range(3)])
    spread = np.array([np.linalg.norm(x[label == k] - c[k], axis=1).mean() for k in range(3)])
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert abs(V.davies_bouldin(frame, "id", "v", "label").first()[0] - db) < 1e-9
    assert abs(V.dispersion(frame, "id", "v", "label").first()[0] - spread.mean()) < 1e-9
    between = sum((label == k).sum() * ((c[k] - x.mean(axis=0)) ** 2).sum() for k in range(3))
    within = sum(((x[label == k] - c[k]) ** 2).sum() for k in range(3))
    assert abs(V.calinski_harabasz(frame, "id", "v", "label").first()[0] - (between / 2) / (within / 23)) < 1e-6
    single = frame.withColumn("label", F.lit(1))
    assert V.silhouette(single, "id", "v", "label").first()[0] == -1.0 and V.davies_bouldin(single, "id", "v", "label").first()[0] is None


@pytest.mark.parametrize(("p", "df", "want"), [(0.999, 2, 13.815511), (0.999, 30, 59.703064), (0.99, 30, 50.892181), (0.95, 2, 5.991465), (0.999, 8, 26.124482)])
def test_chi2(p, df, want):
    assert abs(E.chi2_quantile(p, df) - want) < 1e-5


def test_pca_and_mahalanobis(frame, points):
    x = points[0]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    pca = E.fit_pca(frame, "v", target=1.0)
    assert np.allclose(pca.variance, values)
    got = np.array([r.v for r in pca.transform(frame, "id", "v").orderBy("id").collect()])
    assert np.allclose(got.var(axis=0, ddof=1), values) and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    d2 = [r.d2 for r in E.mahalanobis(frame, "id", "v", 0.01).orderBy("id").collect()]
    off = x - x.mean(axis=0)
    assert np.allclose(d2, np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(x.T)), off))
    assert E.fit_pca(frame, "v", 3, cap_mode="replace").components.shape[0] == 3


def test_mahalanobis_query_on_all_dimensions(spark):
    from tessera.plans import vector_queries

    rows = vector_queries.mahalanobis_mask(spark, "/root/testdata/sf0.001").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()], dtype=float)
    off = x - x.mean(axis=0)
    d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(x.T)), off)
    assert x.shape[1] == 64 and np.allclose([r.d2 for r in rows], d2, rtol=1e-6) and {r.threshold for r in rows} == {93.21686}
    assert [r.keep for r in rows] == list(d2 < 93.21686)


def test_sweeps_have_every_k(spark, monkeypatch):
    from tessera.plans import pipelines, vector_queries

    asked = []
    monkeypatch.setattr(V, "sweep", lambda df, key, vector, make, ks: asked.append(list(ks)))
    monkeypatch.setattr(pipelines, "graph_sweep", lambda df, key, vector, ks, *_: asked.append(list(ks)))
    for f in (vector_queries.tuning_scores, vector_queries.kmeans_sweep, vector_queries.graph_scores):
        f(spark, "/root/testdata/sf0.001")
    assert asked == [[2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25]] * 2 + [list(range(2, 15))]


def test_one_decomposition_serves_every_k(frame, monkeypatch):
    plain = lambda df: np.array([r.v for r in df.orderBy("id").collect()])
    want = [plain(C.Spectral(k, 5).embedding(frame, "id", "v")) for k in (2, 3, 5)]
    calls, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: calls.append(1) or eigh(m))
    got = [plain(x) for x in C.Spectral(5, 5).embeddings(frame, "id", "v", (2, 3, 5))]
    assert len(calls) == 1 and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def _dbscan(x, eps, least):
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2) <= eps
    core, label, current = d.sum(axis=1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        queue = [i]
        label[i] = current
        while queue:
            at = queue.pop(0)
            if core[at]:
                for j in np.flatnonzero(d[at]):
                    if label[j] < 0:
                        label[j] = current
                        queue.append(j)
        current += 1
    return label


@pytest.mark.parametrize("eps", [0.01, 2.2, 100.0])
def test_dbscan_equals_sequential(frame, points, eps):
    got = [r.label for r in C.run_clustering("dbscan", frame, "id", "v", eps=eps, min_samples=4).orderBy("id").collect()]
    assert got == _dbscan(points[0], eps, 4).tolist()


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "centroid", "ward"])
def test_hierarchical(points, linkage):
    x = points[0]
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    table = C.merges(d, linkage)
    assert len(table) == 25 and table[-1][3] == 26
    labels = C.cut_merges(26, table, 3)
    assert len(set(labels)) == 3 and labels[0] == 0
    if linkage == "single":  # equals components below the largest kept edge
        cut = sorted(t[2] for t in table)[22]
        assert len(set(labels[np.flatnonzero(d[0] <= cut)])) == 1


def test_kmeans_from_centroids(frame, points):
    x, label = points
    start = np.array([x[0], x[14], x[25]])
    model = C.KMeans(3, centroids=start)
    got = [r.label for r in model.fit_predict(frame, "id", "v").orderBy("id").collect()]
    c = start
    for _ in range(100):
        near = np.linalg.norm(x[:, None] - c[None], axis=2).argmin(axis=1)
        new = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(3)])
        done = np.linalg.norm(new - c) < 1e-4
        c = new
        if done:
            break
    assert got == np.linalg.norm(x[:, None] - c[None], axis=2).argmin(axis=1).tolist()


def test_spectral_isolated_vertex():
    w = np.zeros((4, 4))
    w[0, 1] = w[1, 0] = 1
    assert np.isfinite(C.spectral_vectors(w, 2)).all()


def test_components_any_order(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (10, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 10: 2, 9: 8, 8: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_modularity(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (0, 3, 0.5)]
    label = {0: 0, 1: 0, 2: 1, 3: 1}
    got = G.modularity(spark.createDataFrame(edges, "i long, j long, w double"), spark.createDataFrame(list(label.items()), "id long, label int")).first()[0]
    a = np.zeros((4, 4))
    for i, j, w in edges:
        a[i, j] = a[j, i] = w
    total = a.sum()
    want = sum(a[np.ix_(own, own)].sum() / total - (a[own].sum() / total) ** 2 for own in ([0, 1], [2, 3]))
    assert abs(got - want) < 1e-12


def test_term_jaccard_empty_lists(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", None), ("d", None)], "k string, t string")
    got = {(r.a, r.b): r.jaccard for r in X.term_jaccard(df, "k", "t").collect()}
    assert got["a", "b"] == 0.5 and got["c", "d"] == 0.0 and got["a", "c"] == 0.0


def test_lift_ignores_nulls(spark):
    df = spark.createDataFrame([(0, "abc"), (0, None), (1, "abc"), (1, "abd"), (1, "ab")], "k int, t string")
    got = {(r.k, r.t): r.lift for r in S.lift(df, "k", "t", 5).collect()}
    assert got == {(0, "abc"): 1.5, (1, "abc"): 0.75, (1, "abd"): 1.5}


def test_array_files_and_failures(spark, tmp_path):
    np.save(tmp_path / "7_traj.npy", np.arange(6, dtype=np.int32).reshape(2, 3))
    (tmp_path / "8_traj.npy").write_bytes(b"broken")
    good, bad = tables.array_files(spark, str(tmp_path), "_traj", "int")
    assert [tuple(r) for r in good.collect()] == [("7", [2, 3], [0, 1, 2, 3, 4, 5])] and bad.count() == 1


def test_midi_notes_and_failures(spark, tmp_path):
    track = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\x90\x3c\x40" + b"\x60\x80\x3c\x00" + b"\x60\x90\x3e\x40" + b"\x60\x3e\x00" + b"\x00\xff\x2f\x00"
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(track)) + track
    assert midi.notes(data) == [(0.0, 0.5, 60, 0), (1.0, 1.5, 62, 0)]
    (tmp_path / "a.mid").write_bytes(data)
    (tmp_path / "b.mid").write_bytes(b"MThd nothing")
    good, bad = midi.scan(spark, str(tmp_path))
    assert [r.token for r in midi.sequences(good).orderBy("pos").collect()] == [60, 128, 62] and bad.count() == 1


def test_term_list_folder(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"0": ["a", "b"], "1": ["b"]}, indent=4))
    (tmp_path / "similarity_sums.json").write_text("{}")
    (tmp_path / "bad.json").write_text("[")
    good, bad = tables.term_lists(spark, str(tmp_path))
    assert sorted(map(tuple, good.collect())) == [("m", "0", "a"), ("m", "0", "b"), ("m", "1", "b")] and bad.count() == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', ["x", 'y "z"'], 7.5, 1999)], "id long, name string, themes array<string>, rating double, first_release_year int")
    df = df.withColumns({"keywords": F.array(F.lit("k")), "involved_companies": F.array().cast("array<string>")}).select("id", "name", "rating", "themes", "keywords", "involved_companies", "first_release_year")
    sinks.csv_with_lists(df, str(tmp_path / "csv"))
    back = tables.clean_games_csv(spark, str(tmp_path / "csv")).first()
    assert back.name == 'say "hi", you' and back.themes == ["x", 'y "z"'] and back.rating == 7.5 and back.first_release_year == 1999


def test_sinks(spark, frame, tmp_path):
    sinks.dataset(frame, spark.createDataFrame([("f.mid", "bad")], "path string, error string"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/data")).count() == 26 and spark.read.text(str(tmp_path / "d/failures")).first()[0] == "f.mid\tbad"
    sinks.labelled(frame.drop("label"), frame.select("id", "label"), "id", str(tmp_path / "l"))
    assert "cluster_number" in spark.read.parquet(str(tmp_path / "l")).columns
    once = sinks.memo(frame, str(tmp_path / "m")).count()
    assert sinks.memo(frame.limit(1), str(tmp_path / "m")).count() == once
    sinks.pieces(spark.createDataFrame([(1, [0, 0]), (2, []), (3, [1])], "id int, x array<int>"), str(tmp_path / "p"), "id", "x")
    assert [r.id for r in spark.read.parquet(str(tmp_path / "p/data")).collect()] == [3]
    with pytest.raises(FileNotFoundError):
        tables.builder_metadata(spark, str(tmp_path / "none.csv"))


def test_listing_header_carried(spark):
    page = '<tr><td><a href="z.mid">z</a></td></tr><tr class="gameheader"><td>G 1</td></tr><tr><td><a href="a.mid">a</a></td></tr><tr><td>no</td></tr><tr><td><a href="b.mid">b</a></td></tr>'
    df = spark.createDataFrame([(1, page, "http://h/d/")], "id int, html string, base string")
    got = [(r.header, r.url) for r in html.listing(df, "id", "html", "base").orderBy("pos").collect()]
    assert got == [(None, "http://h/d/z.mid"), ("G 1", "http://h/d/a.mid"), ("G 1", "http://h/d/b.mid")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1), min_size=3, max_size=3), min_size=2, max_size=6))
def test_kl_properties(rows):
    d = P.kl_divergence(np.array(rows), np.array(rows))
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0, atol=1e-9) and (d > -1e-9).all()


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90
    assert math.isfinite(entry.entry(spark).first().d)


def test_dataset_build(spark, tmp_path):
    from tessera.plans import pipelines

    track = b"\x00\x90\x3c\x40" + b"\x60\x80\x3c\x00" + b"\x60\x90\x3e\x40" + b"\x60\x3e\x00" + b"\x00\xff\x2f\x00"
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(track)) + track
    folder = tmp_path / "midi"
    folder.mkdir()
    for name, content in (("1.mid", data), ("2.mid", data), ("3.mid", b"broken")):
        (folder / name).write_bytes(content)
    csv = tmp_path / "m.csv"
    csv.write_text('id,name,rating,themes,keywords,involved_companies,first_release_year\n1,A,7.0,"[""x""]","[]","[]",1999\n1,B,7.0,"[]","[]","[]",1999\n')
    matched, failures = pipelines.build_sequences(spark, str(folder), str(csv), str(tmp_path / "out"))
    row = matched.first()
    assert matched.count() == 1 and row.note_sequence == [60, 128, 62] and row.name == "A" and row.themes == ["x"] and len(row.ctm) == 2
    assert sorted(r.error for r in failures.collect()) == ["no MIDI header", "no metadata"]


def test_streamed_transitions_equal_batch(spark, tmp_path):
    from tessera.streaming.transitions import transition_updates

    rows = [(k % 3, float(k), k, (k * k) % 5) for k in range(60)]
    schema = "key long, ts double, event_id long, token int"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    updates = transition_updates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    run = updates.writeStream.format("memory").queryName("transitions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.key, r.a, r.b): r.n for r in spark.table("transitions").groupBy("key", "a", "b").agg(F.sum("n").alias("n")).collect()}
    long = spark.createDataFrame(rows, schema)
    assert sum(got.values()) == 57 and sum(r.n for r in Q.transitions(long, "key", pos="ts").collect()) == 57


def test_published_jaccard_sums(spark):
    """Term lists and their published overlap sums, where a folder with both is named."""
    import os

    folder = os.environ.get("TESSERA_GOLDEN_DIR")
    if not folder:
        pytest.skip("no golden folder named")
    with open(f"{folder}/similarity_sums.json") as f:
        want = json.load(f)
    terms, _ = tables.term_lists(spark, folder)
    found = {}
    for name in [r.file for r in terms.select("file").distinct().collect()]:
        sums = X.term_jaccard(terms.where(F.col("file") == name), "cluster", "term").agg(F.sum("jaccard")).first()[0]
        found[name] = sums
    assert {f"{name}.json" for name in found} == set(want)
    assert all(abs(found[key.removesuffix(".json")] - value) < 1e-9 for key, value in want.items())


def test_pca_of_wide_rows(spark):
    """Fewer rows than columns, as flattened matrices have: equal to NumPy's up to sign."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 16_641)) * (rng.random(16_641) < 0.02)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id long, v array<double>")
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
    u, sing, vt = np.linalg.svd(z, full_matrices=False)
    pca = E.fit_pca(df, "v")
    assert np.allclose(pca.variance, (sing**2 / 19)[: len(pca.variance)]) and np.isclose(pca.ratio.sum(), 1)
    cumulative = np.cumsum(sing**2) / (sing**2).sum()
    assert len(pca.components) == int(np.argmax(cumulative >= 0.9)) + 1
    assert np.allclose(np.abs(pca.components @ vt[: len(pca.components)].T), np.eye(len(pca.components)), atol=1e-8)
    got = {r.id: r.v for r in pca.transform(df, "id", "v").collect()}
    assert set(got) == set(range(20)) and np.allclose(np.abs(np.array([got[i] for i in range(20)])), np.abs((u * sing)[:, : len(pca.components)]))
    reduced = E.preprocess(df, "id", "v", 3, alpha=0.001)
    assert reduced.count() == 20 and len(reduced.first().v) == 3


def test_features_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    frames = [E.preprocess(empty, "id", "v"), E.mahalanobis(empty, "id", "v", 0.01), E.outlier_counts(empty, "id", "v"), P.pairs(empty, "id", "v", "cosine"), P.nearest(empty, "id", "v", "euclidean", 3), E.iqr_mask(empty, "id", "v")]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pca_queries_equal_numpy(spark):
    """The registered queries' own rows."""
    from tessera.plans.vector_queries import mahalanobis_mask, outlier_counts, pca_scatter, pca_variance, preprocess

    d = "/root/testdata/sf0.001"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = np.stack([rows[i] for i in ids])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    ratio = values / values.sum()
    got = pca_variance(spark, d).collect()
    enough = int(np.argmax(np.cumsum(ratio) >= 0.9)) + 1
    assert np.allclose([r.ratio for r in got], ratio, atol=1e-6) and sum(r.kept for r in got) == enough and np.allclose([r.cumulative for r in got], np.cumsum(ratio), atol=1e-5)
    scores = z @ vectors
    found = {r.vec_id: r for r in pca_scatter(spark, d).collect()}
    for k in range(3):
        own = np.array([found[i][f"pc{k + 1}"] for i in ids])
        assert np.allclose(np.abs(own), np.abs(scores[:, k]), atol=1e-5) and abs(abs(np.corrcoef(own, scores[:, k])[0, 1]) - 1) < 1e-9

    def distances(y):
        c = y - y.mean(axis=0)
        return np.einsum("ij,jk,ik->i", c, np.linalg.pinv(np.cov(y.T)), c)

    keep = distances(scores[:, :enough]) < E.chi2_quantile(0.999, enough)
    got = {r.vec_id: r for r in preprocess(spark, d).collect()}
    assert set(got) == {i for i, k in zip(ids, keep, strict=True) if k} and all(r.n_components == enough and abs(r.squares - (scores[ids.index(i), :enough] ** 2).sum()) < 1e-4 for i, r in got.items())
    centred = x - x.mean(axis=0)
    plain = centred @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :30]
    d2 = distances(plain)
    for r in outlier_counts(spark, d).collect():
        assert r.removed == int((d2 >= E.chi2_quantile(1 - r.alpha, 30)).sum())
    whole = distances(x)
    for r in mahalanobis_mask(spark, d).collect():
        assert abs(r.d2 - whole[ids.index(r.vec_id)]) < 1e-4


def test_unusable_vectors_are_in_no_pair(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [0.0, 1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for metric in ("cosine", "euclidean", "kl"):
        assert sorted((r.i, r.j) for r in P.pairs(df, "id", "v", metric).collect()) == [(0, 6), (0, 7), (6, 7)]
    assert {r.src for r in P.nearest(df, "id", "v", "cosine", 1).collect()} == {0, 6, 7}


def test_noise_is_no_cluster(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=2)], -1 if i < 5 else 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    assert V.calinski_harabasz(df, "id", "v", "label").first()[0] is None
    assert V.scores(df, "id", "v", "label").first().n_clusters == 1
    three = df.withColumn("label", F.when(F.col("id") < 5, -1).otherwise(F.col("id") % 2))
    assert V.calinski_harabasz(three, "id", "v", "label").first()[0] is not None


def test_minhash_of_empty_sets(spark):
    items = spark.createDataFrame([(1, 5), (1, 9), (2, None)], "key long, item long")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    sig = M.with_empty(M.signatures(items, "key", "item", 4), keys, "key", 4).collect()
    values = {k: [r.value for r in sorted(sig, key=lambda r: r.slot) if r.key == k] for k in (1, 2, 3)}
    assert values[2] == values[3] == [0] * 4
    assert values[1] == [min((a * x + b) % 2**64 % M.MODULUS for x in (5, 9)) for a, b in M.coefficients(4)]


def test_tfidf_falls_back_to_all_words(spark):
    df = spark.createDataFrame([(1, "the and of", "x"), (2, "the the", "y")], "id long, text string, c string")
    got = {(r.c, r.term) for r in X.distinctive_terms(df, "id", "text", "c", ngram=(1, 1)).collect()}
    assert got == {("x", "the"), ("x", "and"), ("x", "of"), ("y", "the")}


def divisive_reference(x, k):
    """The definition: split the cluster of the largest diameter by 2-means from its two farthest points."""
    clusters = [list(range(len(x)))]
    spread = lambda c: np.linalg.norm(x[c][:, None] - x[c][None], axis=2)
    while len(clusters) < k:
        at = int(np.argmax([spread(c).max() for c in clusters]))
        own = clusters.pop(at)
        a, b = np.unravel_index(np.argmax(spread(own)), (len(own), len(own)))
        p = x[own]
        c, before = [p[a], p[b]], None
        for _ in range(10):
            side = np.linalg.norm(p - c[0], axis=1) > np.linalg.norm(p - c[1], axis=1)
            if before is not None and (side == before).all():
                break
            before = side
            c = [p[side == s].mean(axis=0) if (side == s).any() else c[s] for s in (0, 1)]
        clusters += [[i for i, s in zip(own, side, strict=True) if s == want] for want in (False, True)]
    return {frozenset(c) for c in clusters}


def test_divisive_equals_definition(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(25, 3)) * s + m for s, m in ((1, 0), (0.4, 6), (2, -7))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in C.run_clustering("divisive", df, "id", "v", k=5).collect():
        got.setdefault(r.label, set()).add(r.id)
    assert {frozenset(c) for c in got.values()} == divisive_reference(x, 5)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    assert {r.label for r in C.run_clustering("divisive", same, "id", "v", k=3).collect()} == {0}


def test_tuning_loops(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(12, 2)) * 0.2 + m for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    density = {r.eps: r.silhouette for r in V.tune_density(df, "id", "v", (0.01, 1.5, 50.0), min_samples=2).collect()}
    assert density[0.01] == density[50.0] == -1 and density[1.5] > 0.8
    cuts = {r.k: r.silhouette for r in V.tune_hierarchical(df, "id", "v", (2, 3, 4)).collect()}
    assert max(cuts, key=cuts.get) == 3 and abs(cuts[3] - density[1.5]) < 1e-9


def test_similarity_neighbours(spark):
    rng = np.random.default_rng(3)
    s = rng.random((12, 12))
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1)
    pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(12) for j in range(i + 1, 12)], "i long, j long, w double")
    d = np.linalg.norm(s[:, None] - s[None], axis=2) + np.diag([np.inf] * 12)
    a = np.zeros((12, 12))
    for i in range(12):
        a[i, np.argsort(d[i])[:3]] = 1
    a = (a + a.T) / 2
    got = {(r.i, r.j): r.w for r in G.similarity_neighbours(pairs, "w", 3).collect()}
    assert got == {(i, j): a[i, j] for i in range(12) for j in range(i + 1, 12) if a[i, j]}


def test_quoted_cells_stay_whole(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,title\n1,"""a, b"""\n2,"c, d"\n3,"e ""f"" g"\n')
    got = {r.id: r.title for r in tables.unquoted_csv(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {"1": "a, b", "2": "c, d", "3": 'e "f" g'}


def test_similar_by_bands(spark):
    rng = np.random.default_rng(6)
    sets = [set(rng.choice(60, size=rng.integers(5, 50), replace=False).tolist()) for _ in range(30)]
    items = spark.createDataFrame([(i, int(x)) for i, s in enumerate(sets) for x in s], "key long, item long")
    sig = M.signatures(items, "key", "item", 100)
    every = {(r.i, r.j): r.similarity for r in M.similarities(sig, "key", 100).collect() if r.similarity >= 0.5}
    assert {(r.i, r.j): r.similarity for r in M.similar(sig, "key", 100, 0.5).collect()} == every and every


def test_classical_layout_keeps_plane_distances(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(15, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r.id: np.array(r.v) for r in G.classical_layout(P.pairs(df, "id", "v", "euclidean")).collect()}
    for i in range(15):
        for j in range(15):
            assert abs(np.linalg.norm(got[i] - got[j]) - np.linalg.norm(x[i] - x[j])) < 1e-6
    assert G.classical_layout(P.pairs(df.limit(0), "id", "v", "euclidean")).count() == 0
    with pytest.raises(ValueError):
        G.classical_layout(P.pairs(df, "id", "v", "euclidean"), most=3)


def test_title_search(spark):
    import difflib

    names = ["Super Plumber", "Super Plumber 2", "Plumber's Quest", "Zelot"]
    body = json.dumps([{"id": i, "name": n, "rating": 70 + i} for i, n in enumerate(names)] + [{"id": 9}])
    rows = [(1, "super_plumber_2", body), (2, "ZELOT", body), (3, "x", None), (4, "qqq", "[]"), (5, "plumber", "no json")]
    got = {r.k: (json.loads(r.body)["id"], r.ratio) for r in tables.closest_response(spark.createDataFrame(rows, "k long, title string, body string"), "k", "title", "body").collect()}
    assert got == {1: (1, 1.0), 2: (3, 1.0)}
    best = max(names, key=lambda n: difflib.SequenceMatcher(None, "plumber quest", n.lower()).ratio())
    one = tables.closest_response(spark.createDataFrame([(1, "Plumber_Quest", body)], "k long, title string, body string"), "k", "title", "body").first()
    assert json.loads(one.body)["name"] == best


def _signature_lists(spark, n=40, copies=3):
    rng = np.random.default_rng(8)
    rows = [(i * 10, [int(x) for x in rng.choice(60, size=int(rng.integers(0, 50)), replace=False)]) for i in range(n)]
    return spark.createDataFrame([(i + c, x) for i, x in rows for c in range(copies)], "key long, x array<bigint>")


def _shuffled_by(df, *names):
    """Whether the plan deals rows out by one of these columns, or makes pairs by a join."""
    plan = df._jdf.queryExecution().toString()
    return any(f"hashpartitioning({n}#" in plan for n in names), "Join" in plan


# F1
def test_similar_by_blocks_where_many_meet(spark, monkeypatch):
    lists = M.list_signatures(_signature_lists(spark), "key", F.col("x"), 100, empty=True)
    by = lambda share: {(r.i, r.j): r.similarity for r in M.similar_lists(lists, "key", 100, 0.5, share=share).collect()}
    bands, blocks = by(1e9), by(0.0)
    assert blocks and bands == blocks
    asked = []
    monkeypatch.setattr(M, "list_similarities", lambda *a: asked.append(a))
    M.similar_lists(lists, "key", 100, 0.5)  # copies: a 20th of all pairs meet in each band
    assert len(asked) == 1


def test_list_signatures_equal_items(spark):
    lists = _signature_lists(spark, 9, 1)
    want = {(r.key, r.slot): r.value for r in M.signatures(lists.select("key", F.explode("x").alias("item")), "key", "item", 20).collect()}
    got = {(r.key, r.slot): r.value for r in M.slots(M.list_signatures(lists, "key", F.col("x"), 20), "key").collect()}
    assert got == want and M.list_signatures(lists, "key", F.col("x"), 20, empty=True).count() == 9
    plan = M.list_signatures(lists, "key", F.col("x"), 20)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


# F8
def test_minhash_total_makes_no_pairs(spark):
    lists = M.list_signatures(_signature_lists(spark), "key", F.col("x"), 100, empty=True)
    pairs = M.list_similarities(lists, "key", 100, 0.01).agg(F.sum("similarity")).first()[0]
    assert abs(M.totals(lists, "key", 100).first().total - 2 * pairs) < 1e-6
    from tessera.plans import vector_queries

    assert not _shuffled_by(vector_queries.minhash_total(spark, "/root/testdata/sf0.001"))[1]


# F13
def test_minhash_variants_make_no_pairs(spark):
    lists = M.list_signatures(_signature_lists(spark), "key", F.col("x"), 100).withColumn("g", F.col("key") % 2)
    got = {r.g: r.total for r in M.totals(lists, "key", 100, ("g",)).collect()}
    for g in (0, 1):
        own = M.list_similarities(lists.where(F.col("g") == g), "key", 100, 0.01).agg(F.sum("similarity")).first()[0]
        assert abs(got[g] - 2 * own) < 1e-6
    from tessera.plans import vector_queries

    assert not _shuffled_by(vector_queries.minhash_variants(spark, "/root/testdata/sf0.001"))[1]


# F20
def test_similarities_by_blocks(spark):
    lists = M.list_signatures(_signature_lists(spark), "key", F.col("x"), 50, empty=True)
    values = {r.key: np.array(r["values"]) for r in lists.collect()}
    want = {(i, j): (values[i] == values[j]).sum() / 50 for i in values for j in values if i < j and (values[i] == values[j]).any()}
    found = M.list_similarities(lists, "key", 50, 1 / 50)
    assert {(r.i, r.j): r.similarity for r in found.collect()} == want
    assert found._jdf.queryExecution().toString().count("Join") == 0  # no join on slots


# F4, F12, F18
def test_chunks_grow_with_the_table(spark):
    """Each row is sent to as many groups as there are chunks: with fixed chunks that was the square of the table."""
    df = spark.range(60_000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    sent = P._dealt(df, "id", F.col("v"), [], None).count().agg(F.sum("count")).first()[0]
    assert sent <= 60_000 * 11


@pytest.mark.parametrize("metric", ["cosine", "frobenius", "kl"])
def test_pairs_in_strips(frame, points, metric, monkeypatch):
    df = frame.withColumn("v", F.transform("v", F.abs))
    want = {(r.i, r.j): round(r.d, 9) for r in P.pairs(df, "id", "v", metric).collect()}
    a = P.Side(np.arange(26), np.abs(points[0]), None)
    monkeypatch.setattr(P, "STRIP", 60)
    got = {}
    for s, first, d, keep in P._distances(a, a, True, P.METRICS[metric]):
        assert d.size <= 60
        got |= {(s.start + x, first + y): round(float(d[x, y]), 9) for x, y in zip(*np.nonzero(keep), strict=True)}
    assert got == want and len(got) == 26 * 25 // 2


def test_rows_of_one_id_are_no_pair(spark):
    df = spark.createDataFrame([(1, [0.0]), (1, [1.0]), (2, [2.0])], "id long, v array<double>")
    assert sorted((r.i, r.j) for r in P.pairs(df, "id", "v", "euclidean").collect()) == [(1, 2), (1, 2)]


# F6
def test_edges_within_mean_without_pair_table(spark, frame, monkeypatch):
    want = {(r.i, r.j) for r in G.within_mean(P.pairs(frame, "id", "v", "euclidean")).collect()}
    monkeypatch.setattr(G, "cut_lineage", None)  # no table of pairs is written
    assert {(r.i, r.j) for r in G.edges_within_mean(frame, "id", "v").collect()} == want and want
    assert G.edges_within_mean(frame.limit(1), "id", "v").count() == 0


# F5, F7, F16, F17
@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.75, 1.0])
def test_quantile_without_pair_table(spark, frame, points, q, monkeypatch):
    d = np.linalg.norm(points[0][:, None] - points[0][None], axis=2)[np.triu_indices(26, 1)]
    assert abs(P.quantile(frame, "id", "v", "euclidean", q) - np.quantile(d, q)) < 1e-9
    monkeypatch.setattr(P, "COLLECTED", 0)  # bins are taken apart bit by bit
    assert abs(P.quantile(frame, "id", "v", "euclidean", q, chunk=9) - np.quantile(d, q)) < 1e-9
    same = frame.withColumn("v", F.array((F.col("id") % 3).cast("double")))
    e = np.abs(np.arange(26)[:, None] % 3 - np.arange(26)[None] % 3)[np.triu_indices(26, 1)]
    assert P.quantile(same, "id", "v", "euclidean", q, positive=True) == np.quantile(e[e > 0], q)
    assert P.quantile(frame.limit(1), "id", "v", "euclidean", q) is None


# F5
def test_drawing_edges_without_pair_table(frame, monkeypatch):
    key = lambda df: {(r.i, r.j): tuple(round(r[c], 9) for c in ("d", "norm", "width", "alpha", "length")) for r in df.collect()}
    want = key(G.drawing_weights(G.below_percentile(P.pairs(frame, "id", "v", "euclidean"))))
    monkeypatch.setattr(G, "cut_lineage", None)
    assert key(G.drawing_edges(frame, "id", "v")) == want and want


# F16
def test_edges_above_percentile_without_pair_table(frame, monkeypatch):
    want = {(r.i, r.j) for r in G.above_percentile(P.pairs(frame, "id", "v", "euclidean")).collect()}
    monkeypatch.setattr(G, "cut_lineage", None)
    assert {(r.i, r.j) for r in G.edges_above_percentile(frame, "id", "v").collect()} == want and want


# F7, F17
@pytest.mark.parametrize("factor", [0.5, 1.0])
def test_gaussian_kernel_without_pair_table(frame, factor, monkeypatch):
    want = {(r.i, r.j): round(r.w, 9) for r in G.gaussian(P.pairs(frame, "id", "v", "euclidean"), factor).collect()}
    monkeypatch.setattr(G, "cut_lineage", None)
    assert {(r.i, r.j): round(r.w, 9) for r in G.gaussian_kernel(frame, "id", "v", factor).collect()} == want


# F11
def test_dbscan_makes_no_neighbour_table(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(90, 2)), 1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(P, "CHUNK", 16)
    monkeypatch.setattr(P, "pairs", None)
    for eps in (0.05, 0.25, 0.45, 9.0):
        got = [r.label for r in C.run_clustering("dbscan", df, "id", "v", eps=eps, min_samples=4).orderBy("id").collect()]
        assert got == _dbscan(x, eps, 4).tolist()
        assert P.spanning(df, "id", "v", "euclidean", eps).count() < 90 * 11


# F9
def _plain_merges(d, linkage):
    """Every step searches the whole matrix."""
    work, size, name, out = d**2 if linkage in ("ward", "centroid") else d.copy(), np.ones(len(d)), list(range(len(d))), []
    np.fill_diagonal(work, np.inf)
    for t in range(len(d) - 1):
        i, j = sorted(divmod(int(np.argmin(work)), len(d)))
        a, b, best, s = work[i], work[j], work[i, j], size[i] + size[j]
        with np.errstate(invalid="ignore"):
            new = {
                "single": np.minimum(a, b), "complete": np.maximum(a, b), "average": (size[i] * a + size[j] * b) / s, "centroid": (size[i] * a + size[j] * b) / s - size[i] * size[j] * best / s**2,
                "ward": ((size[i] + size) * a + (size[j] + size) * b - size * best) / (s + size),
            }[linkage]
        gone = ~np.isfinite(a) | ~np.isfinite(b)
        new[gone] = np.inf
        work[i] = work[:, i] = new
        work[j] = work[:, j] = np.inf
        size[i] = s
        out.append((*sorted((name[i], name[j])), float(np.sqrt(max(best, 0)) if linkage in ("ward", "centroid") else best), int(s)))
        name[i] = len(d) + t
    return out


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "centroid", "ward"])
def test_merges_equal_plain_search(linkage):
    rng = np.random.default_rng(11)
    for n, x in ((1, rng.normal(size=(1, 2))), (30, rng.normal(size=(30, 3))), (35, rng.integers(0, 4, size=(35, 2)).astype(float))):  # the last with many ties
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        want = _plain_merges(d, linkage)
        assert C.merges(d, linkage) == want
        assert C.merges(d[np.triu_indices(n, 1)], linkage) == want
    x = rng.normal(size=(600, 3))
    assert np.allclose(C.condensed(x, P.euclidean_distance), P.euclidean_distance(x, x)[np.triu_indices(600, 1)], atol=1e-7)


def _many(spark, n=5_500):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 3 * 100 + F.sin("id")).cast("double"), F.cos(F.col("id") * 2)).alias("v"))


def test_hierarchical_of_more_rows_than_before(spark):
    got = {(r.vec_id % 3, r.label) for r in C.run_clustering("hierarchical", _many(spark), "vec_id", "v", k=3, linkage="average").collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}


# F10
def test_ward_merges_of_more_rows_than_before(spark, monkeypatch):
    from tessera.plans import vector_queries

    monkeypatch.setattr(vector_queries, "_embeddings", lambda *_: _many(spark))
    rows = vector_queries.ward_merges(spark, "").collect()
    assert len(rows) == 5_499 and max(r.size for r in rows) == 5_500 and [r.step for r in rows] == list(range(5_499))
    assert all(x.distance <= y.distance + 1e-6 for x, y in zip(rows, rows[1:], strict=False))


# F10
def test_ward_of_rows_keeps_no_distances(spark, monkeypatch):
    """The same merges as from all distances, for more rows than these are kept for."""
    rng = np.random.default_rng(17)
    rounded = lambda merged: [(a, b, round(d, 6), n) for a, b, d, n in merged]
    for n in (1, 2, 3, 40, 400):
        x = rng.normal(size=(n, 5)) + 10
        assert rounded(C.ward_of_rows(x, 2_000)) == rounded(C.merges(C.condensed(x, P.euclidean_distance), "ward"))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:30])], "id long, v array<double>")
    ids, want = C.Hierarchical(1, "ward").merge_table(df, "id", "v")
    monkeypatch.setattr(C, "MOST_ROWS", 10)
    monkeypatch.setattr(C, "condensed", None)
    got_ids, got = C.Hierarchical(1, "ward").merge_table(df, "id", "v")
    assert got_ids == ids and rounded(got) == rounded(want)
    same = C.ward_of_rows(np.repeat(x[:4], 3, axis=0))  # copies merge first
    assert [round(d, 6) for _, _, d, _ in same[:8]] == [0.0] * 8 and same[-1][3] == 12


# F14
def test_vector_layout_equals_classical_layout(spark, frame, monkeypatch):
    squares = lambda df: {r.id: [round(x * x, 6) for x in r.v] for r in df.collect()}
    assert squares(G.vector_layout(frame, "id", "v")) == squares(G.classical_layout(P.pairs(frame, "id", "v", "euclidean")))
    line = frame.withColumn("v", F.slice("v", 1, 1))
    assert squares(G.vector_layout(line, "id", "v")) == squares(G.classical_layout(P.pairs(line, "id", "v", "euclidean")))
    assert G.vector_layout(frame.limit(1), "id", "v").count() == 0
    large = spark.range(6_000).select(F.col("id"), F.array(F.sin("id"), F.cos("id") * 2, F.sin(F.col("id") * 3)).alias("v"))
    assert G.vector_layout(large, "id", "v").count() == 6_000


# F15
def test_hierarchical_tuning_of_more_rows_than_before(spark):
    found = {r.k: r.silhouette for r in V.tune_hierarchical(_many(spark), "vec_id", "v", (2, 3)).collect()}
    assert max(found, key=found.get) == 3 and found[3] > 0.9


# F8
@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_merges_of_rows_keep_no_distances(linkage):
    """The same merges as from all distances, with few of them kept, of copies too and with clusters of many members."""
    rng = np.random.default_rng(5)
    rounded = lambda merged: [(a, b, round(d, 6), n) for a, b, d, n in merged]
    for metric in (P.euclidean_distance, P.cosine_distance):
        for n, most in ((1, 1), (2, 1), (40, 5), (300, 1), (300, 100)):
            x = rng.normal(size=(n, 5)) + 1
            assert rounded(C.merges_of_rows(x, linkage, metric, most, numbers=700, kept=2_000, listed=4)) == rounded(C.merges(C.condensed(x, metric), linkage))
    x = rng.normal(size=(60, 3))
    x = np.concatenate([x, x[10:40], x[20:30]])[rng.permutation(100)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert rounded(C.merges_of_rows(x, linkage, P.euclidean_distance, 10, numbers=700, kept=2_000, listed=4)) == rounded(C.merges(d, linkage))


# F8
def test_hierarchical_above_the_rows_of_a_matrix(spark, monkeypatch):
    df = _many(spark, 90)
    want = {(r.vec_id, r.label) for r in C.run_clustering("hierarchical", df, "vec_id", "v", k=3, linkage="average").collect()}
    monkeypatch.setattr(C, "MOST_ROWS", 20)
    monkeypatch.setattr(C, "condensed", None)
    assert {(r.vec_id, r.label) for r in C.run_clustering("hierarchical", df, "vec_id", "v", k=3, linkage="average").collect()} == want
    with pytest.raises(ValueError):
        C.run_clustering("hierarchical", df, "vec_id", "v", k=3, linkage="centroid")


# F9
def test_hierarchical_tuning_above_the_rows_of_a_matrix(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_ROWS", 20)
    found = {r.k: r.silhouette for r in V.tune_hierarchical(_many(spark, 90), "vec_id", "v", (2, 3)).collect()}
    assert max(found, key=found.get) == 3 and found[3] > 0.9


# F21
def test_gaussian_neighbours_without_matrix(spark, frame, monkeypatch):
    want = {(r.i, r.j): r.w for r in G.similarity_neighbours(G.gaussian(P.pairs(frame, "id", "v", "euclidean")), "w", 4).collect()}
    monkeypatch.setattr(G, "cut_lineage", None)
    monkeypatch.setattr(G, "rows_as_features", None)
    monkeypatch.setattr(P, "CHUNK", 8)
    assert {(r.i, r.j): r.w for r in G.gaussian_neighbours(frame, "id", "v", 4).collect()} == want
    assert G.gaussian_neighbours(frame.limit(1), "id", "v", 4).count() == 0
    with pytest.raises(ValueError):
        G.gaussian_neighbours(frame, "id", "v", 4, most=8)


# F7
def test_gaussian_neighbours_compare_few_rows_on_all_columns(spark, monkeypatch):
    """Bounds leave a few pairs of rows; copies, ties and bounds that tell nothing apart give the same edges."""
    rng = np.random.default_rng(23)
    x = np.concatenate([rng.normal(size=(120, 6)), rng.integers(0, 2, size=(60, 6)).astype(float)])
    x = np.concatenate([x, x[:20], x[:20], np.repeat(x[:1], 12, axis=0)])
    df = spark.createDataFrame([(3 * i + 1, [float(v) for v in r]) for i, r in enumerate(x[rng.permutation(len(x))])], "id long, v array<double>")
    rows = df.orderBy("id").toPandas()
    v = np.stack(rows.v)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    w = np.exp(-(d**2) / (2 * np.median(d[np.triu_indices(len(d), 1)][d[np.triu_indices(len(d), 1)] > 0]) ** 2))
    apart = np.round(np.sqrt(((w[:, None] - w[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(apart, np.inf)
    want = {}
    for i, row in enumerate(apart):
        for j in np.lexsort((np.arange(len(row)), row))[:4]:
            pair = int(rows.id[min(i, j)]), int(rows.id[max(i, j)])
            want[pair] = want.get(pair, 0) + 0.5
    compared, whole = [], G._row_distances
    monkeypatch.setattr(G, "_row_distances", lambda *a, **b: compared.append(len(a[3])) or whole(*a, **b))
    assert {(r.i, r.j): r.w for r in G.gaussian_neighbours(df, "id", "v", 4).collect()} == want
    assert sum(compared) < 180 * 179 // 4
    for more in ({"axes": 1}, {"axes": 3, "pairs": 4_000}):
        assert {(r.i, r.j): r.w for r in G.gaussian_neighbours(df, "id", "v", 4, **more).collect()} == want


# F21, F22, F19
def test_least_columns():
    rng = np.random.default_rng(18)
    for n, m, k in ((5, 3, 4), (40, 300, 7), (40, 7, 7), (30, 100, 1), (4, 0, 3)):
        d = np.round(rng.random((n, m)), 1)  # with many ties
        d[0], d[1, 1:] = np.inf, np.nan
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        x, y = P.least_columns(d, k)
        assert y.tolist() == want.ravel().tolist() and x.tolist() == np.repeat(np.arange(n), want.shape[1]).tolist()


# F22, F19
def test_sparse_spectral_vectors_in_little_memory():
    import tracemalloc

    n, k = 4_000, 14
    i = np.repeat(np.arange(n), 15)
    j = (i + np.tile(np.arange(1, 16), n)) % n
    tracemalloc.start()
    try:
        x = C.sparse_spectral_vectors(i, j, np.ones(len(i)), n, k, tolerance=1e-3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert x.shape == (n, k) and peak < 8 * 2 * len(i) * k  # edges times columns are never laid out


# F12
def test_ordered_pairs_of_one_pass(spark, frame, monkeypatch):
    from tessera.plans import vector_queries

    want = {(r.i, r.j): r.d for r in P.both_directions(P.pairs(frame, "id", "v", "frobenius", chunk=8)).collect()}
    asked = []
    pairs = P.pairs
    monkeypatch.setattr(P, "pairs", lambda *a, **b: asked.append(b) or pairs(*a, **b))
    monkeypatch.setattr(vector_queries, "_embeddings", lambda *_: frame.withColumnRenamed("id", "vec_id"))
    got = vector_queries.frobenius_pairs(spark, "").collect()
    assert {(r.i, r.j): r.d for r in got} == {x: round(d, 6) for x, d in want.items()} and len(got) == len(want)
    assert asked == [{"ordered": True}]


# F22
def test_sparse_spectral_vectors_equal_dense():
    rng = np.random.default_rng(13)
    edges = np.unique(np.sort(rng.integers(0, 300, size=(3_000, 2)), axis=1), axis=0)
    edges = edges[(edges[:, 0] != edges[:, 1]) & ((edges[:, 0] < 150) == (edges[:, 1] < 150))]  # two components
    w = rng.random(len(edges))
    full = np.zeros((301, 301))  # the last vertex has no edge
    full[edges[:, 0], edges[:, 1]] = full[edges[:, 1], edges[:, 0]] = w
    want, got = C.spectral_vectors(full, 5, normalise=False), C.sparse_spectral_vectors(edges[:, 0], edges[:, 1], w, 301, 5)
    assert np.abs(want @ want.T - got @ got.T).max() < 1e-5


def test_spectral_without_full_matrix(spark, monkeypatch):
    monkeypatch.setattr(C, "DENSE_ROWS", 0)
    monkeypatch.setattr(C, "spectral_vectors", None)
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.3 + m for m in (0, 6, 12)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r.id // 30, r.label) for r in C.canonical(C.run_clustering("spectral", df, "id", "v", k=3, neighbours=8), "id").collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}


# F19
def test_graph_scores_without_full_matrix(spark, monkeypatch):
    from tessera.plans import pipelines

    rng = np.random.default_rng(15)
    x = np.abs(np.concatenate([rng.normal(size=(20, 3)) * 0.05 + np.eye(3)[m] for m in range(3)]))
    df = spark.createDataFrame([(i, [float(v) for v in r / r.sum()]) for i, r in enumerate(x)], "id long, v array<double>")
    want = pipelines.graph_sweep(df, "id", "v", (2, 3), neighbours=6).collect()
    monkeypatch.setattr(C, "DENSE_ROWS", 0)
    got = pipelines.graph_sweep(df, "id", "v", (2, 3), neighbours=6).collect()
    assert [r.k for r in got] == [2, 3] and abs(got[1].modularity - want[1].modularity) < 1e-6 and abs(got[1].silhouette - want[1].silhouette) < 1e-4


# F19
def test_spread_scores_and_modularities(spark, monkeypatch):
    """Equal to the scores one by one, and made without a shuffle."""
    rng = np.random.default_rng(19)
    rows = [(i, int(rng.integers(-1, 4)), [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(3)
    same = lambda a, b: all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))
    for part in (df, df.where("label = 1"), df.where("label IN (-1, 2)"), df.where("id < 0")):
        want = [f(part, "id", "v", "label").first()[0] for f in (V.davies_bouldin, V.calinski_harabasz, V.dispersion)]
        assert same(V.spread_scores(part, "v", "label"), want)
    edges = spark.createDataFrame([(int(i), int(j), float(rng.random())) for i, j in {tuple(sorted(rng.choice(60, 2, replace=False))) for _ in range(90)}], "i long, j long, w double")
    labels = df.select("id", F.array("label", F.col("id").cast("int") % 5, F.lit(0)).alias("labels"))
    got = {r.pos: r.modularity for r in G.modularities(edges, labels).collect()}
    want = [G.modularity(edges, labels.select("id", F.get("labels", F.lit(at)).alias("label"))).first()[0] for at in range(3)]
    assert same([got[at] for at in range(3)], want)


def test_graph_sweep_asks_once_for_modularity(spark, monkeypatch):
    from tessera.plans import pipelines

    rng = np.random.default_rng(20)
    df = spark.createDataFrame([(i, [float(v) for v in np.abs(rng.normal(size=3))]) for i in range(30)], "id long, v array<double>")
    for name in ("davies_bouldin", "calinski_harabasz", "dispersion", "scores"):
        monkeypatch.setattr(V, name, None)  # each of these shuffles several times, for every k
    monkeypatch.setattr(G, "modularity", None)
    assert [r.k for r in pipelines.graph_sweep(df, "id", "v", (2, 3), neighbours=5, metric="euclidean").collect()] == [2, 3]


# F2, F3
@pytest.mark.parametrize("scoring", ["distinctiveness", "tfidf"])
def test_distinctive_terms_on_hashes(spark, scoring, monkeypatch):
    """Equal to the weights of every document's terms; no texts of terms are shuffled before the ranks are known."""
    rng = np.random.default_rng(16)
    rows = [(i // 2 if i < 6 else i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], size=int(rng.integers(0, 9)))), "xyz"[i % 3]) for i in range(40)] + [(99, None, "x")]
    docs = spark.createDataFrame(rows, "id long, text string, c string")
    n = docs.agg(F.count("*").alias("n_docs"))
    own = X.weights(X.term_counts(docs, "id", F.col("text"), (1, 2), keep=["c"]), "id", n, max_df=0.8).groupBy("c", "term").agg(F.sum("weight").alias("own")).toPandas()
    size, whole = {c: sum(r[2] == c for r in rows) for c in "xyz"}, own.groupby("term").own.sum()
    want = {(r.c, r.term): r.own / size[r.c] - (whole[r.term] / 41 if scoring == "distinctiveness" else 0) for r in own.itertuples()}
    asked = []
    monkeypatch.setattr(X, "term_counts", lambda *a, **b: asked.append(a))
    got = {(r.c, r.term): r.score for r in X.distinctive_terms(docs, "id", "text", "c", k=1000, scoring=scoring).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want) and not asked
    few = X.distinctive_terms(docs, "id", "text", "c", k=3, scoring=scoring).collect()
    for c in "xyz":
        assert [r.term for r in sorted((r for r in few if r.c == c), key=lambda r: r["rank"])] == [t for _, t in sorted((-got[x], x[1]) for x in got if x[0] == c)][:3]
