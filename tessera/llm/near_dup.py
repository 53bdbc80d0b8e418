"""MinHash near-duplicates: documents linked at 5-word shingle Jaccard >= 0.75, and their components.

1. One pass over the texts gives each document its set's size and hash, its
   256 one-permutation minima as 51 band keys of five minima, and the minima's
   low two bits packed in eight longs. Equal sets become one class here, so
   exact copies cost nothing further.
2. Classes that share a band key are candidates. Bucket sizes come from a
   partial aggregation; buckets with the same members count once; a large
   bucket is dealt into chunk pairs. Each kernel estimates similarities from
   the packed bits (matching fraction corrected for chance collisions) and
   passes on a spanning forest of the pairs that may reach the threshold:
   fewer rows than members, however large the bucket.
3. Components of that forest are blocks. The full shingle sets of the blocks'
   classes are made again from the texts and compared exactly, by chunk pairs
   again; a spanning forest of the confirmed links gives the result.

A pair at the threshold escapes every band with probability (1 - 0.75**5)**51,
about 1e-6; the estimate's slack is five standard errors, and sets of up to
SMALL shingles skip it. Confirmed links are exact (64-bit shingle hashes).

Defined results: null, empty and word-less texts have an empty set, stand
alone and are kept; a null id is a document of its own text's class, its
component is the smallest id there or null, and it is kept only if that is
null too; repeated rows are copies of each other (all rows with the smallest
id are kept); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import U64, blocks
from tessera.llm.common import arrow_map, cut, small_side
from tessera.llm.graph import by_group, chunked, components, forest
from tessera.llm.shingles import BINS, LOW_BITS, block_sets, set_hashes, signatures

#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs with an estimate below PERCENT / 100 - SLACK are not compared further.
SLACK = 0.17
SMALL = 64
CHUNK = 512
_CHANCE = 0.5**LOW_BITS


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text's hash), n_shingles, h (the set's hash, 0: empty), sig (packed bits, then the size), bands."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sizes, h, sig, bands in signatures(batch.column(1)):
                n = len(sizes)
                own = np.column_stack([sig.view(np.int64), sizes.astype(np.int64)])
                keys = bands.view(np.int64)
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()) for x in (own, keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(sizes.astype(np.int64)), pa.array(h.view(np.int64)), *lists], ["doc_id", "t", "n_shingles", "h", "sig", "bands"])
                at += n

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("t"))
    return arrow_map(rows, scan, f"doc_id {id_type}, t bigint, n_shingles bigint, h bigint, sig array<bigint>, bands array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def may_link(sig: np.ndarray) -> np.ndarray:
    """Symmetric matrix: pairs whose estimated similarity leaves the threshold possible."""
    bits, sizes = np.ascontiguousarray(sig[:, :-1]).view(np.uint64), sig[:, -1]
    same = np.zeros((len(bits), len(bits)), np.int32)
    for w in range(bits.shape[1]):
        x = bits[:, None, w] ^ bits[None, :, w]
        same += np.bitwise_count(~(x | (x >> U64(1))) & U64(0x5555555555555555))
    estimate = (same / BINS - _CHANCE) / (1 - _CHANCE)
    small = np.minimum(sizes[:, None], sizes[None, :])
    large = np.maximum(sizes[:, None], sizes[None, :])
    return ((estimate >= PERCENT / 100 - SLACK) | (small <= SMALL)) & (100 * small >= PERCENT * large)


def _bucket(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    h = batch.column("h").to_numpy(zero_copy_only=False)
    if len(h) < 2:
        return []
    return [(h[i], h[j]) for i, j in forest(may_link(_matrix(batch.column("sig"))))]


SLAB = 4096


def confirmed(bounds: np.ndarray, hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact links among the wanted pairs of sets; hashes[bounds[i]:bounds[i + 1]] is set i, ascending."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    linked = np.zeros((n, n), bool)
    i, j = np.nonzero(np.triu(wanted, 1))
    if len(i) <= 4 * n:
        for a, b in zip(i, j, strict=True):
            both = len(np.intersect1d(hashes[bounds[a] : bounds[a + 1]], hashes[bounds[b] : bounds[b + 1]], assume_unique=True))
            linked[a, b] = linked[b, a] = 100 * both >= PERCENT * (sizes[a] + sizes[b] - both)
        return linked
    member = np.repeat(np.arange(n), sizes)
    _, term, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often[term] > 1
    member, term = member[shared], np.unique(term[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)  # counts below 2**24: exact
    order = np.argsort(term, kind="stable")
    member, term = member[order], term[order]
    for first in range(0, int(term[-1]) + 1 if len(term) else 0, SLAB):
        a, b = np.searchsorted(term, (first, first + SLAB))
        slab = np.zeros((n, SLAB), np.float32)
        slab[member[a:b], term[a:b] - first] = 1
        both += slab @ slab.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both.astype(np.float64) >= PERCENT * union) & wanted
    return linked


def _block(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    h = batch.column("h").to_numpy(zero_copy_only=False)
    if len(h) < 2:
        return []
    sets = batch.column("shingles")
    bounds = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))])
    hashes = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    wanted = may_link(_matrix(batch.column("sig")))
    np.fill_diagonal(wanted, False)
    return [(h[i], h[j]) for i, j in forest(confirmed(bounds, hashes, wanted))]


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, shingles) of the wanted classes (h, first_id, null_id), from the texts of one document each."""
    ids, _ = small_side(wanted.select(F.col("first_id").alias("_id")).distinct(), 16)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                bounds, hashes = block_sets(b)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(bounds, hashes).view(np.int64)), lists], ["h", "shingles"])

    return arrow_map(rows, scan, "h bigint, shingles array<bigint>")


def linked_classes(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, component): the classes that are linked with another one; component is the least h of theirs."""
    classes = cut(
        marks.where("n_shingles > 0").groupBy("h").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    banded = classes.select("h", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor("h").alias("x"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("size > 1")
    buckets = buckets.groupBy("size", "x", "lo", "hi").agg(F.min("key").alias("bucket")).select("bucket", "size")
    buckets, _ = small_side(buckets, 24)
    members = banded.join(buckets, F.col("key") == F.col("bucket")).select("bucket", "size", "h")
    members = members.join(classes.select("h", "sig"), "h")
    maybe = by_group(chunked(members, "bucket", "size", "h", CHUNK), ["bucket", "ci", "cj"], _bucket, "a bigint, b bigint")
    blocked = cut(components(maybe).select(F.col("node").alias("h"), F.col("component").alias("block")))

    wanted = cut(blocked.join(classes.select("h", "sig", "first_id"), "h"))
    sizes = wanted.groupBy("block").agg(F.count("*").alias("size"))
    sets = _sets(docs, wanted, id_col, text_col)
    # a set can come from several rows of one id: one of each is enough
    whole = wanted.join(sizes, "block").join(sets, "h").dropDuplicates(["h"]).select("block", "size", "h", "sig", "shingles")
    links = by_group(chunked(whole, "block", "size", "h", CHUNK), ["block", "ci", "cj"], _block, "a bigint, b bigint")
    return components(links).select(F.col("node").alias("h"), "component")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text's hash), n_shingles, component_id, kept: one row per document."""
    marks = cut(signed(docs, id_col, text_col))
    linked = cut(linked_classes(docs, marks, id_col, text_col))
    owners = marks.where("n_shingles > 0").groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    owners = owners.join(linked, "h", "left").where("n > 1 OR component IS NOT NULL").select("h", "first_id", F.coalesce("component", "h").alias("component"))
    heads = owners.groupBy("component").agg(F.min("first_id").alias("head"))
    heads, _ = small_side(owners.join(heads, "component").select(F.col("h").alias("_h"), "head"), 24)
    joined = marks.select("doc_id", "t", "n_shingles", "h").join(heads, (F.col("h") == F.col("_h")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("_h").isNotNull(), F.col("head")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "t", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' rows without those of near-duplicates of a smaller id; all columns kept.

    Only the ids that go travel; the texts move only if those are too many to broadcast.
    """
    gone = grouped(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_t")).distinct()
    gone, _ = small_side(gone, 24)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (_text_hash(text_col) == F.col("_gone_t")), "left_anti")
