"""Embedding near-duplicates: all pairs of cosine >= 0.95, by binary codes of randomly rotated vectors.

1. One pass turns each vector into the signs of its coordinates under several
   seeded random rotations, with a correction factor per rotation (the inner
   product of the unit vector with its own code, which makes estimates made
   from the code unbiased), and an 8-bit form to be used as the query side.
   Equal vectors become one class here.
2. Bands of code bits are bucket keys. Their number follows from the bits'
   chance to agree at the threshold, so that a linked pair misses all buckets
   with probability MISS; bits per band grow with the logarithm of the number
   of classes, so buckets keep their size. In a bucket, the estimate plus its
   confidence bound decides which pairs could reach the threshold; a spanning
   forest of those goes on, which is linear in the members however large the
   bucket (large ones are dealt into chunk pairs).
3. Only vectors in the same component of that forest are recomputed: exact
   cosines in double precision, by chunk pairs, counted where both copies of a
   pair meet once. A link is never taken from an estimate.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing; vectors of different length do not
link; a null id takes part, its component is the smallest id there or null;
repeated rows are links of each other; an empty table gives no rows; labels
and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_side
from tessera.llm.graph import by_group, chunked, components, forest

COSINE = 0.95
MISS = 1e-6
#: Standard errors that the confidence bound of an estimate allows.
BOUND = 5.0
#: Rotated coordinates used for estimates, at least.
ESTIMATE_BITS = 320
BUCKET = 48
CHUNK = 512


def plan(n: int) -> tuple[int, int]:
    """(bits per band, bands) for n vectors."""
    agree = 1 - math.acos(COSINE) / math.pi
    bits = min(24, max(6, round(math.log2(max(n, 1) / BUCKET + 1))))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotations(d: int, count: int) -> np.ndarray:
    """d x (count * d): seeded random rotations side by side."""
    if (d, count) not in _rotations:
        rng = np.random.Generator(np.random.PCG64(d))
        _rotations[d, count] = np.hstack([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(count)])
    return _rotations[d, count]


def estimate(codes: np.ndarray, factors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <code's vector, query vector>, averaged over the rotations.

    codes: n x (r * d) of +-1, factors: n x r, query: m x (r * d) rotated unit vectors.
    """
    r = factors.shape[1]
    d = codes.shape[1] // r
    scaled = codes / np.repeat(factors, d, axis=1) / (r * math.sqrt(d))
    return scaled @ query.T


def error(factors: np.ndarray, d: int) -> np.ndarray:
    """Standard error of a vector's estimates."""
    mean = np.mean((1 - factors**2) / factors**2, axis=1)
    return np.sqrt(np.maximum(mean, 0) / (max(d - 1, 1) * factors.shape[1]))


def _coded(bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                d, own = int(d), np.flatnonzero(lengths == d)
                x = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
                u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                count = max(1, math.ceil(ESTIMATE_BITS / d))
                all_ = max(count, math.ceil(bits * bands / d))
                rotated = u @ rotations(d, all_)
                signs = rotated > 0
                near = np.abs(rotated[:, : count * d]).reshape(len(own), count, d).sum(axis=2) / math.sqrt(d)
                step = np.abs(u).max(axis=1) / 127
                query = np.round(u / step[:, None]).astype(np.int8)
                payload = [
                    b"".join((np.int32([d, count]).tobytes(), np.float32(step[i]).tobytes(), near[i].astype(np.float32).tobytes(), np.packbits(signs[i, : count * d]).tobytes(), query[i].tobytes()))
                    for i in range(len(own))
                ]
                band_bits = signs[:, : bits * bands].reshape(len(own), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                keys = band_bits + (np.arange(bands, dtype=np.int64) << 32) + (np.int64(d) << 44)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(payload, pa.binary()), lists], ["h", "code", "bands"])

    return run


def _unpack(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of +-1, factors, rotated query vectors) of one bucket; all of its vectors have one length."""
    d, count = np.frombuffer(payloads[0], np.int32, 2).tolist()
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
    step = np.ascontiguousarray(raw[:, 8:12]).view(np.float32)
    at = 12 + 4 * count
    factors = np.ascontiguousarray(raw[:, 12:at]).view(np.float32)
    width = (count * d + 7) // 8
    codes = np.unpackbits(raw[:, at : at + width], axis=1, count=count * d).astype(np.float32) * 2 - 1
    query = np.ascontiguousarray(raw[:, at + width :]).view(np.int8).astype(np.float32) * step
    return codes, factors, query @ rotations(d, count).astype(np.float32)


def _bucket(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    h = batch.column("h").to_numpy(zero_copy_only=False)
    if len(h) < 2:
        return []
    codes, factors, query = _unpack(batch.column("code").to_pylist())
    d = codes.shape[1] // factors.shape[1]
    # what the 8-bit query side can be off by: half a step in every component
    slack = BOUND * error(factors, d)[:, None] + 0.5 * math.sqrt(d) / 127
    may = estimate(codes, factors, query) + slack >= COSINE
    may &= may.T
    return [(h[i], h[j]) for i, j in forest(may)]


def _exact(batch: pa.RecordBatch) -> list[tuple[int, int, int]]:
    """(h, other, links): links that each vector gets in this chunk pair (other = h), and forest edges (links 0)."""
    h = batch.column("h").to_numpy(zero_copy_only=False)
    if len(h) < 2:
        return []
    n = batch.column("n").to_numpy(zero_copy_only=False)
    ci, cj = batch.column("ci")[0].as_py(), batch.column("cj")[0].as_py()
    own = batch.column("own").to_numpy(zero_copy_only=False)
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= COSINE
    np.fill_diagonal(linked, False)
    if ci != cj:
        linked &= own[:, None] != own[None, :]  # pairs inside a chunk are counted in its own group
    links = linked @ n
    return [(h[i], h[i], links[i]) for i in np.flatnonzero(links)] + [(h[i], h[j], 0) for i, j in forest(linked)]


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(usable, F.xxhash64("v")))
    ids = cut(rows.select("vec_id", "h"))
    tally = ids.where("h IS NOT NULL").groupBy("h").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = cut(rows.where("h IS NOT NULL").select("h", "v").dropDuplicates(["h"]).join(tally, "h"))
    bits, bands = plan(classes.count())

    coded = classes.select("h", "v").mapInArrow(_coded(bits, bands), "h bigint, code binary, bands array<bigint>")
    coded = cut(coded)
    banded = coded.select("h", "code", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("bucket", "b")
    sizes, _ = small_side(sizes, 16)
    members = banded.join(sizes, F.col("bucket") == F.col("b")).select("bucket", "size", "h", "code")
    maybe = by_group(chunked(members, "bucket", "size", "h", CHUNK), ["bucket", "ci", "cj"], _bucket, "a bigint, b bigint")
    blocked = cut(components(maybe).select(F.col("node").alias("h"), F.col("component").alias("block")))

    block_sizes = blocked.groupBy("block").agg(F.count("*").alias("size"))
    whole = blocked.join(block_sizes, "block").join(classes, "h").select("block", "size", "h", "n", "v")
    dealt = chunked(whole, "block", "size", "h", CHUNK, own="own")
    found = cut(by_group(dealt, ["block", "ci", "cj"], _exact, "a bigint, b bigint, links bigint"))
    joined = components(found.where("links = 0").select("a", "b"))
    links = found.where("links > 0").groupBy(F.col("a").alias("h")).agg(F.sum("links").alias("links"))

    facts = tally.join(joined.select(F.col("node").alias("h"), "component"), "h", "left").join(links, "h", "left").where("n > 1 OR component IS NOT NULL")
    facts = facts.select("h", "first_id", "n", F.coalesce("component", "h").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = facts.groupBy("component").agg(F.min("first_id").alias("head"))
    facts, _ = small_side(facts.join(heads, "component").select(F.col("h").alias("_h"), "head", (F.col("links") + F.col("n") - 1).alias("n_links")), 32)
    out = ids.join(facts, F.col("h") == F.col("_h"), "left")
    component = F.when(F.col("_h").isNotNull(), F.col("head")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
