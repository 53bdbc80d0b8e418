"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import json
import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, line_dedup, mixing, near_dup, pii, quality, rules, sentence_piece, shingles, urls, vector_dup
from tessera.llm.queries import TOOL_SCHEMAS, sentencepiece_model

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(text):
    return re.findall("[^ \t-\r]+", text or "")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared lines, nulls, empty and odd ones, ties and repeats."""
    rng = random.Random(4)
    base = ["\n".join(sentence(rng, rng.randint(6, 30)) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts = list(base)
    for _ in range(60):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        if rng.random() < 0.3 and len(t) > 3:
            del t[rng.randrange(len(t))]
        texts.append(" ".join(t))
    texts += [None, "", "  \n\t", "one", "one", "ONE", "a b c", "a b c d e", "é漢😀 x " * 3, "w " * 30, "z" * 5000, base[0], base[0].upper(), base[1] + "\n" + base[2]]
    return [(i, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With extra columns of clashing names."""
    extra = ["h", "t", "key", "size", "label", "v", "removed"]
    return spark.createDataFrame(corpus, DOCS).withColumns({c: F.lit(1) for c in extra}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    conversations = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    frames = [
        pii.report(empty), pii.sanitise(empty), sentence_piece.encode(empty, sentencepiece_model(), carry=["doc_id"]), vector_dup.linked(vectors), mixing.taken(empty), mixing.mix(empty), line_dedup.dedup(empty),
        quality.judged(empty, labels), quality.accepted(empty, labels), chat.formatted(conversations, TOOL_SCHEMAS), urls.judge(pages, urls.junk_hosts(pages)), near_dup.grouped(empty), near_dup.representatives(empty),
        rules.judge(rules.ledger(empty)), rules.ablation(rules.ledger(empty)),
    ]
    assert [f.count() for f in frames[:-1]] == [0] * (len(frames) - 1)


# 10 ------------------------------------------------------------------------


def test_rules_brute_force(docs, corpus):
    got = {r.doc_id: r for r in rules.judge(rules.ledger(docs)).collect()}
    for i, text, *_ in corpus:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_rule_ablation(docs):
    ledger = rules.ledger(docs).cache()
    bits = [r.fail_bits & rules.mask("full-1") for r in ledger.collect()]
    for row in rules.ablation(ledger).collect():
        bit = 1 << list(rules.RULES).index(row.rule)
        assert row.n_failed == sum(b & bit > 0 for b in bits) and row.n_failed_alone == sum(b == bit for b in bits)
        assert row.n_kept_without == sum(b & ~bit == 0 for b in bits) and row.n_docs == len(bits)


# 9 -------------------------------------------------------------------------


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dup_brute_force(docs, corpus):
    sets = {i: shingle_set(t) for i, t, *_ in corpus}
    want = brute_components(sets)
    got = near_dup.grouped(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(want)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)
    stay = near_dup.representatives(docs)
    assert sorted(r.doc_id for r in stay.select("doc_id").collect()) == sorted(i for i, c in want.items() if i == c) and stay.columns == docs.columns


def test_near_dup_large_group_in_chunks(spark, monkeypatch):
    """A group far larger than a chunk, whose members are linked only through its centre."""
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    rng = random.Random(1)
    centre = sentence(rng, 120).split()
    rows = []
    for i in range(40):
        t = list(centre)
        for k in rng.sample(range(0, 115, 6), 3):
            t[k] = f"x{i}y{k}"
        rows.append((i + 1, " ".join(t)))
    rows.append((0, " ".join(centre)))
    sets = dict((i, shingle_set(t)) for i, t in rows)
    got = {r.doc_id: r.component_id for r in near_dup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(sets)


def test_near_dup_null_ids_and_repeats(spark):
    t = "a b c d e f g"
    got = near_dup.grouped(spark.createDataFrame([(None, t), (5, t), (5, t), (7, t), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "5", False), ("None", "None", True)]


def test_bit_estimates_are_near():
    rng = random.Random(2)
    a = sentence(rng, 400).split()
    b = a[:40] + ["new"] + a[41:]
    texts = pa.array([" ".join(a), " ".join(b), sentence(rng, 400)])
    ((sizes, h, sig, bands),) = shingles.signatures(texts)
    own = np.column_stack([sig.view(np.int64), sizes])
    assert near_dup.may_link(own).tolist() == [[True, True, False], [True, True, False], [False, False, True]]
    assert (bands[0] == bands[1]).sum() > 30 and (bands[0] == bands[2]).sum() == 0


# 5 -------------------------------------------------------------------------


def brute_lines(rows):
    """Kept lines by id, from the definition."""
    lines = [(i, k, words(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    eligible = sorted((i, k, w) for i, k, w in lines if len(w) >= line_dedup.MIN_WORDS)
    first = {}
    for i, k, w in eligible:
        first.setdefault(tuple(w), (i, k))

    def close(a, b):
        return min(len(a), len(b)) >= line_dedup.NEAR_WORDS and line_dedup.within(list(a), list(b))

    near = {a for a in first for b in first if first[b] < first[a] and close(a, b)}
    gone = {(i, k) for i, k, w in eligible if tuple(w) in near or first[tuple(w)] != (i, k)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in rows}, near


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_distance():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randint(0, 2) for _ in range(rng.randint(0, 6))]
        b = [rng.randint(0, 2) for _ in range(rng.randint(0, 6))]
        assert line_dedup.within(a, b) == (edit_distance(a, b) <= 1)


def test_line_dedup_brute_force(spark):
    rng = random.Random(9)
    pool = [sentence(rng, rng.choice([3, 5, 9, 10, 11, 14, 30])) for _ in range(30)] + ["", "same same same same same same same same same same same"]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(pool).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(max(1, len(w)))
                act = rng.randint(0, 2)
                w = w[:k] + ([] if act == 0 else [f"n{rng.randint(0, 5)}"]) + w[k + (act != 2) :]
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines) if i % 20 else None))
    want, near = brute_lines(rows)
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert near and all(r.text == (None if r.doc_id % 20 == 0 else want[r.doc_id]) for r in got)


def test_line_dedup_whole_at_every_length(spark):
    """The bounds stand here as numbers: a line of a word goes if repeated, one of 5 words if a word apart."""
    rng = random.Random(10)
    pool = ["Les.", "All rights reserved.", "one two three four"] + [sentence(rng, n) for n in (1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 14) for _ in range(2)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(pool).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(max(1, len(w)))
                act = rng.randint(0, 2)
                w = w[:k] + ([] if act == 0 else [f"n{rng.randint(0, 5)}"]) + w[k + (act != 2) :]
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    lines = [(i, k, tuple(words(x))) for i, t in rows for k, x in enumerate(t.split("\n")) if words(x)]
    first = {}
    for i, k, w in lines:
        first.setdefault(w, (i, k))
    near = {a for a in first for b in first if first[b] < first[a] and min(len(a), len(b)) >= 5 and edit_distance(a, b) == 1}
    gone = {(i, k) for i, k, w in lines if w in near or first[w] != (i, k)}
    assert {len(w) for w in near} >= set(range(5, 11)) and {1, 2, 3, 4} <= {len(w) for i, k, w in lines if (i, k) in gone}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()} == want
    assert {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, None).collect()} == want


def test_line_dedup_many_lines_in_one_text(spark):
    """Every line of a long text repeats, and every other one of another: linear in the lines."""
    text = "\n".join(["same line here"] * 30_000)
    mixed = "\n".join(x for i in range(15_000) for x in (f"own line number {i}", "same line here"))
    start = time.time()
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame([(1, text), (2, mixed)], "doc_id long, text string")).collect()}
    assert time.time() - start < 60
    assert got[1] == "same line here" and got[2] == "\n".join(f"own line number {i}" for i in range(15_000))


def test_line_dedup_carries_clashing_columns(docs, corpus):
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == len(corpus)


# 4 -------------------------------------------------------------------------


def water_filling(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, corpus):
    got = {r.doc_id: r for r in mixing.taken(docs).collect()}
    sizes, source = {}, {}
    for i, t, _, s, _ in corpus:
        sizes[s] = sizes.get(s, 0) + len(words(t))
        source[i] = s
        assert got[i].size == len(words(t)) and 0 <= got[i].taken <= 2 * got[i].size
    target = water_filling(sizes)
    for s in sizes:
        own = [r for i, r in got.items() if source[i] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) < 1
    assert {r.doc_id: r.taken for r in mixing.taken(docs.repartition(7)).collect()} == {i: r.taken for i, r in got.items()}


def test_mix_rows(docs, corpus):
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    rows = mixing.mix(docs).collect()
    text = {i: t for i, t, *_ in corpus}
    words_out = {}
    for r in rows:
        words_out[r.doc_id] = words_out.get(r.doc_id, 0) + len(words(r.text))
        assert text[r.doc_id].startswith(r.text)
    assert words_out == {i: n for i, n in taken.items() if n}


# 6 -------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = sentence(rng, rng.randint(10, 60)).split()
        text = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:8] for _ in range(7)), " | ".join(w)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(df.withColumn("score", F.lit(9)), lab).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    # held-out labels are never learned from
    flipped = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.judged(df, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items() if i < 1000)
    assert quality.accepted(df, lab).columns == ["doc_id", "text"]


def test_quality_vote_brute_force(spark):
    """Scores of the query's own path against a loop over all labelled vectors, ties and repeated ids included."""
    rng = random.Random(16)
    rows = [(i, sentence(rng, rng.randint(3, 40)) if i % 3 else " ".join(x.upper() for x in sentence(rng, 9).split())) for i in range(260)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(7, "another text of a known id")] * 3 + [(2000, None), (2001, "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(200)] + [(1000 + i, i % 2, 0) for i in range(40)] + [(9, 0, 0), (9, 1, 0), (None, 1, 0), (11, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, per_label=60)
    again = quality.fit(df.repartition(2), lab.repartition(3), per_label=60)
    assert 60 < len(model.vectors) <= 120 and np.allclose(model.vectors, again.vectors) and (model.labels == again.labels).all()
    got = {}
    for r in quality.score(df, model, carry=["doc_id", "text"]).collect():
        got[r.doc_id, r.text] = r[quality.SCORE]
    from tessera.llm.bytescan import blocks

    for (i, text), score in got.items():
        (block,) = blocks(pa.array([text], pa.string()))
        z = model.latent(block)[0].astype(float)
        cosines = [float(z @ v) for v in model.vectors.astype(float)]
        least = sorted(cosines, reverse=True)[quality.NEIGHBOURS - 1]
        votes = [(max(c, 0) ** 4, label) for c, label in zip(cosines, model.labels, strict=True) if c >= least - 1e-6]
        total = sum(w for w, _ in votes)
        want = sum(w * label for w, label in votes) / total if total > 1e-9 else model.prior
        assert abs(score - want) < 2e-3, (i, text, score, want)


# 2 -------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece_model()), reason="no tokenizer files")


@needs_model
def test_sentencepiece_parity_and_round_trip(docs, corpus):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_model())
    for r in sentence_piece.encode(docs, sentencepiece_model(), carry=["doc_id", "text"], decoded=True).collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == own.encode(r.text) and r.n_ids == len(r.ids) and r.round_trip and r.decoded == r.text


@needs_model
def test_sentencepiece_fuzz():
    rng = random.Random(0)
    parts = [" ", "  ", "▁", "a", "\n", "é", "漢", "😀", "the", "1", ".", "\t", "\x00", " " * 17, "<unk>", "<0x0A>"]
    sentence_piece.Codec(sentencepiece_model()).verify("".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(500))


@pytest.fixture(scope="module", params=["unigram", "unigram-bytes", "bpe", "bpe-bytes"])
def small_model(request, tmp_path_factory):
    """Tokenizers are never trained for the corpus; these toy models only exist to compare the other kinds of model files with the library."""
    import sentencepiece

    kind, _, fallback = request.param.partition("-")
    folder, rng = tmp_path_factory.mktemp("piece"), random.Random(1)
    some = [*WORDS, "mask", "unk", "café", "12", "345", "<s>"]
    (folder / "text").write_text("\n".join(" ".join(rng.choice(some) for _ in range(rng.randint(3, 20))) for _ in range(2000)))
    more = {"byte_fallback": True, "vocab_size": 340, "normalization_rule_name": "identity"} if fallback else {"vocab_size": 90}
    sentencepiece.SentencePieceTrainer.train(input=str(folder / "text"), model_prefix=str(folder / "m"), model_type=kind, user_defined_symbols=["<mask>", "<sep>", "ph"], hard_vocab_limit=False, minloglevel=2, **more)
    return str(folder / "m.model")


def test_sentencepiece_kinds_of_models_and_pieces(small_model):
    """Unigram and BPE, with and without byte fallback; control, unknown, byte and user-defined pieces spelt out in the text."""
    rng = random.Random(0)
    parts = [" ", "  ", "▁", "a", "ph", "alpha", "<mask>", "<mas", "mask>", "<sep>", "<s>", "</s>", "<unk>", "<0x41>", "<0x0A>", "é", "漢", "😀", "12", "\n", "\t", "beta", "Ａ"]
    codec = sentence_piece.Codec(small_model)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=small_model)
    bounds, ids = codec.encode(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.encode(text), text
    back = [x.decode("utf-8", "replace") for x in codec.decode(bounds, ids)]
    assert back == [own.decode(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]


# 3 -------------------------------------------------------------------------


def test_vectors_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dup, "CHUNK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 24)).astype(np.float32)
    x = [base[rng.integers(30)] + rng.normal(size=24).astype(np.float32) * s for s in rng.choice([0, 0.1, 0.25, 0.33], 200)]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] * 24, 0), (303, [1.0, None], 0), (304, [], 0), (305, rows[0][1], 0), (306, [v * 3 for v in rows[0][1]], 1), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"h": F.lit(0), "n": F.lit(0)})
    got = {r.vec_id: r for r in vector_dup.linked(df).collect()}
    usable = {i: np.array(np.float32(v), float) for i, v, _ in rows if v and all(y is not None and np.isfinite(y) for y in v) and any(v)}
    links = {i: {j for j, b in usable.items() if j != i and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95} for i, a in usable.items()}
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for i, near in links.items():
            root[i] = min([root[i], *(root[j] for j in near)])
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(i, ())), root[i], root[i] == i), i


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    d, r = 64, 5
    u = rng.normal(size=(400, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rotated = u @ vector_dup.rotations(d, r)
    codes = np.where(rotated > 0, 1.0, -1.0)
    factors = np.abs(rotated).reshape(400, r, d).sum(axis=2) / np.sqrt(d)
    off = vector_dup.estimate(codes, factors, rotated) - u @ u.T
    np.fill_diagonal(off, 0)
    bound = vector_dup.error(factors, d)[:, None]
    assert abs(off.mean()) < 0.002 and (np.abs(off) <= 5 * bound).all() and 0.5 < (off / bound).std() < 1.5


# 8 -------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        ("https://A.Example.org/en/1?x", "a.example.org", "/en/1", "example.org/en/1", "block"), ("http://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://m.x.com/fr/a#b", "m.x.com", "/fr/a", "com/fr/", "allow"), ("http://m.x.com/q", "m.x.com", "/q", None, "block"),
        ("http://x.com", "x.com", "", None, "allow"), ("http://x.org", "x.org", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("x\ny://H\n/p\n?", "h\n", "/p\n", None, "allow"), ("http://m.x.com/q", "m.x.com", "/q", None, "block"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string").withColumns({"host": F.lit("x"), "key": F.lit("y")})
    listing = spark.createDataFrame([("m.x.com",), ("m.x.com",), (None,), ("",), ("not.in.pages",)], "key string")
    got = {r.page_id: r for r in urls.judge(df, listing).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), rows[i]


def test_junk_hosts(spark):
    rows = [(0, "http://A.x/1", "### *** " * 5), (1, "http://a.x/2", "$$$" * 10), (2, "http://a.x/3", None), (3, "http://b.x", "%%%" * 10), (5, None, "###" * 99)] + [(10 + i, "http://b.x/q", "fine") for i in range(19)]
    assert [r.key for r in urls.junk_hosts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["a.x"]


def test_cascade_with_list_from_both_sides(spark):
    """Some keys are only in the pages, some only in the list; every page's verdict is the list's."""
    rng = random.Random(2)
    hosts = [f"h{i}.net" for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://{rng.choice(hosts)}/p") for i in range(5000)], "page_id long, url string")
    held = set(rng.sample(hosts, 400)) | {f"only{i}.net" for i in range(400)}
    listing = spark.createDataFrame([(h, 1) for h in held], "host string, key int")
    got = urls.judge(pages, listing, key="host").collect()
    assert len(got) == 5000 and all((r.verdict == "block") == (r.host in held) for r in got)


@pytest.mark.parametrize("share", [0.0, 0.001, 0.3, 0.9, 1.0])
def test_cascade_is_exact(spark, share):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < share * 1000).alias("listed"))
    got = urls.listed(keys.withColumnRenamed("listed", "truth"), "key", keys)
    assert got.where("listed <> truth").count() == 0
    over = urls.listed(keys.withColumnRenamed("listed", "truth"), "key", keys, most_bytes=1)
    assert over.where("listed <> truth").count() == 0


# 1 -------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def test_base_spans_fuzz(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_", "%", "@", ".", "1", "4", "255", "256", "0", "+", "+1", "(", ")", "-", " ", "555", "4111111111111111", "x", "é", "😀", "\n", ".com", "1.2.3.4", "00001"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", "9" * 3000, "a" * 50_000, "1." * 3000, "a." * 3000 + "@x.y", "+1" + "(" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = [f"{k}:{m.start()}:{m.end()}" for k in PATTERNS for m in re.finditer(PATTERNS[k], texts[r.doc_id] or "") if valid(k, m.group())]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == want
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)


def test_disclosing_terms(spark):
    filler = lambda i: " ".join(f"{WORDS[i % 24]}{WORDS[(i * 7) % 24]}" for _ in range(20))
    rows = [(i, f"note the {WORDS[i]} doctor Quibblesworth wrote from q@clinic.org about the {WORDS[i + 5]} matter") for i in range(4)]
    rows += [(10 + i, f"the weather report {filler(i)} and the matter") for i in range(60)]
    rows.append((99, "Quibblesworth, alone"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[99] == "term:0:13" and all("term:" in got[i] for i in range(4)) and not any(got[10 + i] for i in range(60))
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Quibblesworth" not in text[0] and "<EMAIL>" in text[0] and "q@clinic.org" not in text[0] and text[10] == dict(rows)[10]


def test_disclosing_terms_far_from_the_value(spark):
    """A name in the heading and the value in one footer: every term of the document counts, parts of the value do not."""
    filler = lambda i: " ".join(f"{WORDS[(i + k) % 24]}{WORDS[(i * 7 + k) % 24]}" for k in range(60))
    rows = [(i, f"Report by Quibblesworth {filler(i)} contact q@clinic.org") for i in range(5)]
    rows += [(10 + i, f"report by somebody {filler(i)} contact us") for i in range(60)]
    rows += [(99, "Quibblesworth, alone, at the clinic"), (100, "Copy of Merriweather at m@town.net"), (101, "Copy of Merriweather at m@town.net"), (102, "Copy of Merriweather at m@town.net")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "term:0:13" and all(got[i].endswith("term:10:23") for i in range(5))
    assert not any(got[10 + i] for i in range(60)) and [got[i] for i in (100, 101, 102)] == ["email:24:34"] * 3


def brute_disclosures(rows):
    """term -> (disclosure, kind) from the definition; of documents with personal data and one text, one counts."""
    docs = list(dict.fromkeys(rows))
    terms = lambda t: {m.group(1).lower() for m in re.finditer(r"(?<![A-Za-z0-9._%+-])" + PATTERNS["email"].replace("(", "(?:") + r"|([^\W\d_](?:[^\W_]){2,})", t) if m.group(1)}

    def entities(t):
        out = set()
        for kind in PATTERNS:
            for m in re.finditer(PATTERNS[kind], t):
                if valid(kind, m.group()):
                    v = re.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()
                    shared = {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:3]), "card": v[:6], "phone": v[:-7]}[kind]
                    out |= {f"value:{kind}:{v}", f"shared:{kind}:{shared}", f"kind:{kind}:", "any::"}
        return out

    docs = [t for _, t in docs if not entities(t)] + list({t for _, t in docs if entities(t)})
    n, n_t, n_e, n_te = len(docs), {}, {}, {}
    for t in docs:
        for term in terms(t):
            n_t[term] = n_t.get(term, 0) + 1
        for e in entities(t):
            n_e[e] = n_e.get(e, 0) + 1
            for term in terms(t):
                n_te[e, term] = n_te.get((e, term), 0) + 1
    judgements = sum(x >= pii.SUPPORT for x in n_t.values()) * sum(x >= pii.SUPPORT for x in n_e.values())
    best = {}
    for (e, term), k in n_te.items():
        if k >= pii.SUPPORT and n_e[e] < n:
            p, q = k / n_t[term], n_e[e] / n
            kl = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
            if p > q and n_t[term] * kl >= math.log(judgements):
                best[term] = max(best.get(term, (-9, "")), (1 + math.log(p) / -math.log(q), e))
    return {term: (x, e.split(":")[1]) for term, (x, e) in best.items()}


def test_disclosures_brute_force_with_repeats(spark):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        w = [rng.choice(WORDS) for _ in range(12)]
        if i % 4 == 0:
            k = rng.randrange(4)
            w += [f"holder{k}", rng.choice([f"q{k}@clinic{k % 2}.org", f"10.0.{k}.{i % 200}", "+1 (212) 555-%04d" % i, "4111111111111111"])]
            w += ["mailer"] if "@" in w[-1] else []
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += [rows[0]] * 30 + [(None, rows[4][1])] * 5 + [(500 + k, rows[8][1]) for k in range(10)]
    base = pii._documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text")
    base = base.withColumns({"base": pii.base_spans(F.col("text")), "terms": pii.terms(F.col("text"))})
    got = {r.term: (r.disclosure, r.kind) for r in pii.disclosures(base, base.select("doc_id", "t", "text")).collect()}
    want = brute_disclosures(rows)
    assert got.keys() == want.keys() and {t for t in got if t.startswith("holder")} and len({k for _, k in got.values()}) > 1
    assert all(abs(got[t][0] - want[t][0]) < 1e-9 and got[t][1] == want[t][1] for t in want)
    once = {r.term: r.disclosure for r in pii.disclosures(*(df.dropDuplicates(["doc_id", "t"]) for df in (base, base.select("doc_id", "t", "text")))).collect()}
    assert once.keys() == got.keys() and all(abs(once[t] - got[t][0]) < 1e-12 for t in once)
    # every row of a repeated one gets the spans
    assert len({r.spans for r in pii.report(base.select("doc_id", "text")).where("doc_id = 0").collect()}) == 1


def test_base_digest(spark):
    texts = ["x 1.2.3.4 a@b.c 4111111111111111 +1 (212) 555-0100 z@y.org", "", None, "none"]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    listing = "email:10:15,email:51:58,ip:2:9,card:16:32,phone:33:50"
    assert got[0].spans == listing and got[0].n_spans == 5 and got[0].n_term == 0
    assert [got[i].base_sha256 for i in range(4)] == [hashlib.sha256(x.encode()).hexdigest() for x in (listing, "", "", "")]


def test_many_spans_in_one_text(spark):
    """Linear in spans: 20,000 addresses, and edits that cut a text at as many places."""
    text = " ".join(f"é{i} user{i}@host{i}.org" for i in range(20_000)) + " 😀 end"
    df = spark.createDataFrame([(1, text), (2, "x@y.z 1.2.3.4@y.z")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert time.time() - start < 60
    assert got[1] == " ".join(f"é{i} <EMAIL>" for i in range(20_000)) + " 😀 end" and got[2] == "<EMAIL> <EMAIL>"


def test_general_word_follows_the_kind(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40))
    rows = [(i, f"Quibblesworth {filler()} q@clinic.org") for i in range(9)] + [(9 + i, f"Quibblesworth alone {filler()}") for i in range(4)] + [(20 + i, f"plain {filler()}") for i in range(90)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9].startswith("[mail contact] alone") and got[0].startswith("[mail contact] ") and got[0].endswith(" <EMAIL>") and got[20] == dict(rows)[20]


def test_near_copies_are_one_context(spark):
    """Words of a passage that is copied with small changes give nothing away, however often the value stands in it."""
    rng = random.Random(8)
    passage = [f"{rng.choice(WORDS)}{rng.choice(WORDS)}{i}" for i in range(150)]
    rows = []
    for i in range(30):
        w = list(passage)
        w[rng.randrange(150)] = f"changed{i}"
        rows.append((i, " ".join(w) + " q@clinic.org"))
    rows += [(100 + i, " ".join(rng.choice(passage) for _ in range(20))) for i in range(40)]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.n_email, r.n_term) == (int(r.doc_id < 30), 0) for r in got)


# 7 -------------------------------------------------------------------------


def test_chat_links_and_orders(spark):
    calls = lambda content, *c: json.dumps({"content": content, "tool_calls": list(c)})
    answer = lambda i, content: json.dumps({"tool_call_id": i, "content": content})
    rows = [
        (1, 0, "tool", answer("a", "early")), (1, 1, "assistant", calls("x", {"id": "a", "name": "search", "arguments": {"top_k": 3, "query": "q"}}, {"id": "b", "name": "search", "arguments": {"top_k": "3", "zz": 1}})),
        (1, 1, "assistant", calls("y", {"id": "c", "name": "nope", "arguments": {}, "depends_on": ["b"]})), (1, 2, "tool", answer("b", "rb")), (1, 3, "tool", answer("zzz", "orphan")), (1, 4, "user", None), (1, 4, "user", None),
        (2, 0, "assistant", calls("", {"id": "p", "name": "search", "arguments": [], "depends_on": ["q"]})), (2, 1, "tool", answer("p", "")), (2, 2, "assistant", calls("", {"id": "q", "name": "fetch", "arguments": {"url": "u"}, "depends_on": ["p"]})), (2, 3, "tool", answer("q", "")),
        (None, 0, "user", "lone"), (3, None, None, "{bad"), (4, 600, "user", "late"), (4, 1, "user", 'say "hi"\n'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "m": F.lit(1), "part": F.lit(1)})
    got = {(r.conv_id, r.part): r for r in chat.formatted(df, TOOL_SCHEMAS).collect()}
    one = json.loads(got[1, 0].json)["messages"]
    content = [m["content"] for m in one]
    assert content.index("x") < content.index("early") and content.index("rb") < content.index("y") and len(one) == 6
    first = next(m for m in one if m["content"] == "x")["tool_calls"]
    assert first[0] == {"arguments": {"query": "q", "top_k": 3}, "errors": [], "id": "a", "linked": True, "name": "search"}
    assert first[1]["errors"] == ["missing query", "type of top_k", "unexpected zz"]
    assert next(m for m in one if m["content"] == "orphan")["linked"] is False
    assert (got[1, 0].n_calls, got[1, 0].n_linked, got[1, 0].n_invalid) == (3, 2, 2)
    assert all(m["circular"] for m in json.loads(got[2, 0].json)["messages"]) and got[2, 0].n_invalid == 1
    assert (None, 0) in got and (3, -1) in got and {p for c, p in got if c == 4} == {0, 1}
    for r in got.values():
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tool_rows(rng, conv, n_calls):
    """A conversation of calls and results with random turns and dependencies, some in circles, some dangling."""
    ids = [f"k{i}" for i in range(n_calls)]
    rows, turn = [], list(range(3 * n_calls))
    rng.shuffle(turn)
    for i, k in enumerate(ids):
        needs = rng.sample(ids, min(n_calls, rng.choice([0, 0, 1, 1, 2]))) + (["nowhere"] if rng.random() < 0.1 else [])
        if rng.random() < 0.8:  # mostly on earlier calls
            needs = [x for x in needs if x == "nowhere" or int(x[1:]) < i]
        rows.append((conv, turn[2 * i], "assistant", json.dumps({"content": f"call {k}", "tool_calls": [{"id": k, "name": "search", "arguments": {"query": k}, "depends_on": needs}]})))
        if rng.random() < 0.9:
            rows.append((conv, turn[2 * i + 1], "tool", json.dumps({"tool_call_id": k, "content": f"result {k}"})))
    return rows + [(conv, turn[-1], "user", "plain")]


def brute_order(rows):
    """(content, circular) of one conversation in order: Kahn's algorithm with a place for every message."""
    parsed = [(turn, role, json.loads(text) if text.startswith("{") else {"content": text}) for _, turn, role, text in rows]
    caller = {c["id"]: i for i, (_, _, m) in enumerate(parsed) for c in m.get("tool_calls", ())}
    answer = {m["tool_call_id"]: i for i, (_, _, m) in enumerate(parsed) if "tool_call_id" in m}
    waits = {i: set() for i in range(len(rows))}
    for i, (_, _, m) in enumerate(parsed):
        if m.get("tool_call_id") in caller:
            waits[i].add(caller[m["tool_call_id"]])
        for c in m.get("tool_calls", ()):
            waits[i] |= {answer[x] for x in c["depends_on"] if x in answer and x in caller and answer[x] != i}
    place = {}
    while True:
        ready = {i: max([(parsed[i][0], 0)] + [(place[j][0], place[j][1] + 1) for j in waits[i]]) for i in waits if i not in place and all(j in place for j in waits[i])}
        if not ready:
            break
        place |= ready
    stuck = set(waits) - set(place)
    # only conversations with a message ahead of one it waits for are put in order; in the others every place is the turn
    order = sorted(waits, key=lambda i: (*place.get(i, (parsed[i][0], 0)), parsed[i][0]))
    return [(parsed[i][2]["content"], i in stuck) for i in order]


@pytest.mark.parametrize("most_edges", [0, chat.MOST_EDGES])
def test_chat_order_brute_force(spark, most_edges):
    """Random call graphs, peeled as arrays and by joins."""
    rng = random.Random(7)
    rows = [r for conv in range(25) for r in tool_rows(rng, conv, rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: json.loads(r.json)["messages"] for r in chat.formatted(df, TOOL_SCHEMAS, most_edges).collect()}
    circles = 0
    for conv in range(25):
        want = brute_order([r for r in rows if r[0] == conv])
        assert [(m["content"], m.get("circular", False)) for m in got[conv]] == want, conv
        circles += any(c for _, c in want)
    assert 0 < circles < 25


def test_chat_long_chains(spark):
    """A thousand calls that each wait for the last one's result, in good order and with the order of turns reversed."""
    n, rows = 1000, []
    for conv, turn in ((1, lambda t: t), (2, lambda t: 5000 - t)):
        for i in range(n):
            needs = [f"k{i - 1}"] if i else []
            rows.append((conv, turn(2 * i), "assistant", json.dumps({"tool_calls": [{"id": f"k{i}", "name": "search", "arguments": {"query": "q"}, "depends_on": needs}], "content": f"c{i}"})))
            rows.append((conv, turn(2 * i + 1), "tool", json.dumps({"tool_call_id": f"k{i}", "content": f"r{i}"})))
    start = time.time()
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOL_SCHEMAS).collect()
    assert time.time() - start < 90
    for conv in (1, 2):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.part, r.piece))
        content = [m["content"] for r in own for m in json.loads(r.json)["messages"]]
        assert content == [x for i in range(n) for x in (f"c{i}", f"r{i}")] and sum(r.n_linked for r in own) == n


def test_chat_large_parts_are_cut(spark):
    rows = [(1, 7, "user", f"text {i:05d}") for i in range(3000)] + [(1, None, "user", f"late {i}") for i in range(600)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    sizes = {(r.part, r.piece): r.n_messages for r in got}
    assert sizes == {(0, i): min(512, 3000 - 512 * i) for i in range(6)} | {(-1, 0): 512, (-1, 1): 88}
    content = [m["content"] for r in sorted(got, key=lambda r: r.piece) if r.part == 0 for m in json.loads(r.json)["messages"]]
    assert content == sorted(content) and len(content) == 3000


def test_chat_argument_forms_and_schemas(spark):
    schemas = {
        "find": {
            "type": "object", "required": ["filter"], "additionalProperties": False,
            "properties": {
                "mode": {"enum": ["fast", "deep", 3]}, "tags": {"type": "array", "items": {"type": "string"}},
                "filter": {"type": "object", "required": ["from"], "properties": {"from": {"type": ["integer", "null"]}, "to": {"type": "number"}}, "additionalProperties": False},
            },
        }
    }
    forms = [
        ({"id": "a", "name": "find", "arguments": {"filter": {"from": 1}, "mode": "fast", "tags": ["x"]}}, []),
        ({"id": "b", "name": "find", "arguments": '{"filter": {"from": null, "to": 2.5}}'}, []),
        ({"id": "c", "type": "function", "function": {"name": "find", "arguments": '{"mode": 3, "filter": {"from": 1}}'}}, []),
        ({"id": "d", "name": "find", "arguments": {"filter": {"from": "x", "zz": 1}, "mode": "slow", "tags": ["x", 1], "q": 0}}, ["type of filter.from", "unexpected filter.zz", "value of mode", "type of tags[]", "unexpected q"]),
        ({"id": "e", "name": "find", "arguments": {"filter": {}}}, ["missing filter.from"]),
        ({"id": "f", "name": "find", "arguments": {"filter": []}}, ["type of filter"]),
        ({"id": "g", "name": "find", "arguments": "not json"}, ["arguments are not an object"]),
        ({"name": "find", "arguments": {"filter": {"from": 1}}}, ["missing id"]),
        ({"id": "h", "name": "other", "arguments": {}}, ["unknown tool"]),
        ({"id": "i"}, ["arguments are not an object"]),
    ]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [c for c, _ in forms], "model": "m-1", "content": {"parts": [1, "x"]}})), (None, 0, "user", "twice"), (None, 0, "user", "twice"), (2, 0, "tool", '{"tool_call_id": "a", "content": "x", "z z": 1, "z": [2]}'), (3, 0, "user", "s"), (3, 0, "user", "s")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    assert sorted(str(r.conv_id) for r in got) == ["1", "2", "3", "None", "None"]
    one = next(r for r in got if r.conv_id == 1)
    message = json.loads(one.json)["messages"][0]
    calls = message["tool_calls"]
    assert [c["errors"] for c in calls] == [e for _, e in forms] and (one.n_calls, one.n_invalid) == (10, 7)
    assert calls[1]["arguments"] == {"filter": {"from": None, "to": 2.5}} and calls[2]["arguments"] == {"filter": {"from": 1}, "mode": 3} and calls[2]["type"] == "function" and calls[6]["arguments"] == "not json" and calls[7]["id"] is None
    assert message["model"] == "m-1" and json.loads(message["content"]) == {"parts": [1, "x"]}
    two = json.loads(next(r for r in got if r.conv_id == 2).json)["messages"][0]
    assert two == {"content": "x", "linked": False, "role": "tool", "tool_call_id": "a", "z": [2], "z z": 1}
    for r in got:
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# pipeline ------------------------------------------------------------------


@needs_model
def test_pipeline_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in corpus]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(rng, 30).split()), "en", "s1", 5) for i in range(30)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, t, *_ in rows if t and len(t.split()) > 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in seen[:-2]]
    assert not any(i >= 1000 for i in texts[1]) and len(texts[1]) > 80
    want, _ = brute_lines(sorted(texts[1].items()))
    assert all((texts[2][i] or "") == want[i] for i in texts[1])
    groups = brute_components({i: shingle_set(t) for i, t in texts[2].items()})
    assert sorted(texts[3]) == sorted(i for i, c in groups.items() if i == c)
    mixed = sum(len(words(r.text)) for r in seen[4].collect())
    assert abs(mixed - 1.5 * sum(len(words(t)) for t in texts[3].values())) < 20
    assert seen[5].count() == seen[4].count() and seen[5].where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[5].count()


@needs_model
def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    """No rows; then null ids, texts and sources, repeated rows and columns of clashing names."""
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rng = random.Random(4)
    own = [sentence(rng, 40) for _ in range(3)]
    odd = [(None, own[0], None, None, 1), (None, own[0], None, None, 1), (1, own[1], "en", "a", 1), (1, own[1], "en", "a", 1), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, own[2], "en", "b", 1)]
    for name, rows in (("none", []), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).withColumns({"t": F.lit(1), "rank": F.lit(2), "h": F.lit(3)}).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if name == "none":
            assert got == []
        else:  # each text once or twice, by its source's target; nothing without words
            assert {r.doc_id for r in got} == {None, 1, 4} and all(r.round_trip and r.n_ids > 0 and r.rank == 2 for r in got)
