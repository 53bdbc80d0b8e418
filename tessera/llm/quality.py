"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed words and hashed word shapes (runs of upper case,
lower case, digits and each other character; plus a mark for a word repeated
at once). Bags are weighted by log count and inverse document frequency and
projected on the leading singular directions of the labelled sample. The
labelled vectors are broadcast; every document's cosine with every one of them
is computed in blocks, and the labels of the closest vote, weighted by
similarity.

What is learned comes from at most `per_label` labelled rows of each label
(those with the smallest hash of the id), never from held-out rows
(crc32(id as text) mod 5 = 0). That bound is the size of the broadcast.

Defined results: null and empty texts, and any text without a neighbour of
positive cosine, score the labelled share of label 1; without labelled rows
everything scores 0.5; a null id is held out; labels of a repeated id are
averaged, and of its documents the one least in its term counts is learned;
equal similarities vote alike (all that tie with the last neighbour vote);
repeated rows score alike; very long texts are read whole; other columns are
never inputs, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import U64, Block, blocks, mix, poly
from tessera.llm.common import arrow_map

WORD_TERMS = 4096
SHAPE_TERMS = 512
TERMS = WORD_TERMS + SHAPE_TERMS
#: Weight of the shape half of a vector against the word half.
SHAPE_WEIGHT = 2.0
DIMENSIONS = 64
PER_LABEL = 2048
NEIGHBOURS = 15
THRESHOLD = 0.3
SCORE = "__quality_score"
BATCH = 1024

_CLASS = np.arange(256, dtype=np.uint64) + U64(10)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 2


def counts(b: Block) -> np.ndarray:
    """Term counts of a block's documents: word terms, then shape terms."""
    words = b.word_hashes(folded=False)
    doc = b.doc_of_words()
    kind = _CLASS[b.data]
    edge = np.zeros(len(b.data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[b.starts] = True
    runs = np.flatnonzero(edge)
    shape = mix(poly(kind[runs], np.searchsorted(runs, b.starts), np.searchsorted(runs, b.ends)))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    n = b.docs
    word_ids = doc * TERMS + (words % U64(WORD_TERMS)).astype(np.int64)
    shape_ids = doc * TERMS + WORD_TERMS + 1 + (shape % U64(SHAPE_TERMS - 1)).astype(np.int64)
    stutter_ids = doc[again] * TERMS + WORD_TERMS
    return np.bincount(np.concatenate([word_ids, shape_ids, stutter_ids]), minlength=n * TERMS).reshape(n, TERMS)


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf
    for part, weight in ((slice(0, WORD_TERMS), 1.0), (slice(WORD_TERMS, TERMS), SHAPE_WEIGHT)):
        own = x[:, part]
        norm = np.sqrt((own * own).sum(axis=1, keepdims=True))
        own *= np.divide(weight, norm, out=np.zeros_like(norm), where=norm > 0)
    return x


def _unit(z: np.ndarray) -> np.ndarray:
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    prior: float

    def latent(self, b: Block) -> np.ndarray:
        return _unit(_weighted(counts(b), self.idf) @ self.basis)

    def vote(self, z: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(z), self.prior)
        score = np.empty(len(z))
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(z), BATCH):
            cosine = z[at : at + BATCH] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(self.vectors) else np.broadcast_to(np.arange(k), (len(cosine), k))
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1)
            least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
            for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):  # what ties with the last one votes as well
                own = np.flatnonzero(cosine[i] >= least[i])
                weight = np.maximum(cosine[i][own], 0).astype(np.float64) ** 4
                total[i], voted[i] = weight.sum(), (weight * self.labels[own]).sum()
            score[at : at + BATCH] = np.where(total > 1e-9, voted / np.where(total > 1e-9, total, 1), self.prior)
        return np.round(np.clip(score, 0, 1), 6)


def learn(tf: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """tf: term counts of the labelled rows."""
    if not len(tf):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    n = len(tf)
    idf = np.log((1 + n) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    x = _weighted(tf, idf)
    d = min(DIMENSIONS, n)
    rng = np.random.Generator(np.random.PCG64(11))
    q = x @ rng.standard_normal((TERMS, min(d + 16, n))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q = np.linalg.qr(q)[0]
        q = x @ (x.T @ q)
    q = np.linalg.qr(q)[0]
    basis = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:d].T)
    return Model(idf, basis, _unit(x @ basis), labels.astype(np.float64), prior)


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample of labelled, not held-out rows."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0.0, 1.0))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("label").alias("label"))
    tally = known.agg(F.avg("label").alias("share")).first()
    picks = [known.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for side in (F.col("label") < 0.5, F.col("label") >= 0.5)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * per_label rows of an id and a number
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(sample, "doc_id").select("label", "text", "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for b in blocks(batch.column(1)):
                tf = counts(b)
                terms = [np.flatnonzero(row).astype(np.uint16) for row in tf]
                often = [row[t].astype(np.uint32) for row, t in zip(tf, terms, strict=True)]
                columns = [batch.column(0).slice(at, b.docs), pa.array([t.tobytes() for t in terms], pa.binary()), pa.array([o.tobytes() for o in often], pa.binary()), batch.column(2).slice(at, b.docs)]
                yield pa.RecordBatch.from_arrays(columns, ["label", "terms", "often", "doc_id"])
                at += b.docs

    id_type = docs.schema[id_col].dataType.simpleString()
    # one row an id, so that ids repeated in the documents cannot make the sample grow
    found = arrow_map(rows, scan, f"label double, terms binary, often binary, doc_id {id_type}").groupBy("doc_id").agg(F.min(F.struct("terms", "often", "label")).alias("x"))
    got = found.select("doc_id", "x.*").collect()
    got.sort(key=lambda r: r.doc_id)
    tf = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        tf[i, np.frombuffer(r.terms, np.uint16)] = np.frombuffer(r.often, np.uint32)
    return learn(tf, np.array([r.label for r in got]), float(tally.share) if tally.share is not None else 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: the id as doc_id) and the score, one row per document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in carry] if carry else [F.col(id_col).alias("doc_id")]
    rows = docs.select(*kept)
    if text_col in rows.columns:
        at, width = rows.columns.index(text_col), len(rows.columns)
    else:
        at, width = 0, len(rows.columns)
        rows = docs.select(F.col(text_col).cast("string").alias("__text"), *kept)
    out = rows.schema.fields[-width:]
    names = [*(f.name for f in out), SCORE]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + f", {SCORE} double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            z = [own.latent(b) for b in blocks(batch.column(at))]
            if z:
                yield pa.RecordBatch.from_arrays([*batch.columns[-width:], pa.array(own.vote(np.concatenate(z)))], names)

    return arrow_map(rows, scan, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    predicted = F.when(F.col(SCORE) >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), predicted.alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' rows that are predicted to be of label 1, all columns kept."""
    return score(docs, fit(docs, labels), carry=docs.columns).where(F.col(SCORE) >= THRESHOLD).drop(SCORE)
