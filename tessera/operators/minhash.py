"""MinHash signatures in the published scheme: h(x) = ((a * x + b) mod 2**64) mod (2**32 - 1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairwise import pairs
from tessera.operators.sequences import shingles
from tessera.session import cut_lineage, ship

MODULUS = 2**32 - 1


def coefficients(k: int = 100, seed: int = 42) -> list[tuple[int, int]]:
    """k pairs (a, b): a from 1, b from 0, both below the modulus."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, MODULUS, size=k, dtype=np.uint64)
    b = rng.integers(0, MODULUS, size=k, dtype=np.uint64)
    return [(int(x), int(y)) for x, y in zip(a, b, strict=True)]


def encoded(tokens: Column, base: int = 131) -> Column:
    """A shingle of small non-negative integers as one number, in base `base`."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda h, v: h * base + v)


def shifted_intervals(intervals: Column, shift: int = 128) -> Column:
    """Intervals made non-negative; encode them with a base of 257 or more so that shingles stay distinct."""
    return F.transform(intervals, lambda x: x + shift)


def signatures(items: DataFrame, key: str, item: str, k: int = 100, seed: int = 42) -> DataFrame:
    """(key, slot, value): least hash of each key's items under each of k functions; a null item has none.

    A kernel takes the least over a batch's rows of a key, 64-bit products wrap
    as the scheme says; batches' results meet in a partial aggregation.
    """
    ship(items.sparkSession)
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(k, seed), strict=True))
    key_type = items.schema[key].dataType.simpleString()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            at = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[order]
            own, first = np.unique(at[order], return_index=True)
            best = np.column_stack([np.minimum.reduceat((m * x + c) % np.uint64(MODULUS), first) for m, c in zip(a, b, strict=True)]).astype(np.int64)
            sizes = np.arange(0, best.size + 1, k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(own)), pa.ListArray.from_arrays(sizes, best.ravel())], ["key", "values"])

    rows = items.select(F.col(key).alias("key"), F.col(item).cast("bigint").alias("item")).where("item IS NOT NULL").distinct()
    parts = rows.mapInArrow(least, f"key {key_type}, values array<bigint>").select(F.col("key").alias(key), F.posexplode("values").alias("slot", "value"))
    return parts.groupBy(key, "slot").agg(F.min("value").alias("value"))


def with_empty(sig: DataFrame, keys: DataFrame, key: str, k: int) -> DataFrame:
    """The signatures, and zeros in all slots for keys without an item."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot")
    empty = keys.select(key).distinct().join(sig.select(key).distinct(), key, "left_anti")
    return sig.unionByName(empty.select(key, slots, F.lit(0).cast("bigint").alias("value")))


def list_signatures(df: DataFrame, key: str | Column, items: Column, k: int = 100, seed: int = 42, empty: bool = False) -> DataFrame:
    """(key, values): the signature of each row's list of items; null items count for nothing.

    A row without items has zeros with empty=True, else it goes. Nothing is shuffled.
    """
    ship(df.sparkSession)
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(k, seed), strict=True))
    rows = df.select(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), F.array_distinct(F.array_compact(items.cast("array<bigint>"))).alias("items"))
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
    kind = rows.schema["key"].dataType.simpleString()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            best, full = np.zeros((batch.num_rows, k), np.int64), sizes > 0
            if full.any():
                x, at = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
                first = (np.cumsum(sizes) - sizes)[full]
                for slot, (m, c) in enumerate(zip(a, b, strict=True)):
                    best[full, slot] = np.minimum.reduceat(((m * x + c) % np.uint64(MODULUS)).astype(np.int64)[at], first)
            want = np.ones(len(full), bool) if empty else full
            ends = np.arange(0, want.sum() * k + 1, k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(want)), pa.ListArray.from_arrays(ends, best[want].ravel())], ["key", "values"])

    out = rows.mapInArrow(least, f"key {kind}, values array<bigint>")
    return out.withColumnRenamed("key", key) if isinstance(key, str) else out


def slots(lists: DataFrame, key: str | Column) -> DataFrame:
    """(key, slot, value) of (key, values)."""
    return lists.select(key, F.posexplode("values").alias("slot", "value"))


def _lists(sig: DataFrame, key: str) -> DataFrame:
    return sig.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: x["value"]).alias("values"))


def similarities(sig: DataFrame, key: str, k: int) -> DataFrame:
    """(i, j, similarity): share of equal slots, for pairs that have any; pairs without one are 0 and left out."""
    return list_similarities(_lists(sig, key), key, k, 1 / k)


def list_similarities(lists: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """(i, j, similarity) of at least `least` from (key, values), by blocks: every pair is compared on all slots, and no slot is joined."""
    lists = cut_lineage(lists.select(key, F.transform("values", lambda x: x - 2**31).alias("values")))  # as 32-bit numbers
    most = k - int(np.ceil(round(least * k, 9)))
    return pairs(lists, key, "values", "slots", within=most).select("i", "j", ((k - F.col("d")) / k).alias("similarity"))


def totals(lists: DataFrame, key: str, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, total): the sum of the similarity matrix without its diagonal, from the number of keys that share a slot's value; no pair is made."""
    same = slots(lists.where(F.col(key).isNotNull()), F.struct(*groups).alias("_g") if groups else F.lit(0).alias("_g")).groupBy("_g", "slot", "value").agg(F.count("*").alias("n"))
    met = same.groupBy("_g").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("met")).where("met > 0")
    return met.select(*(f"_g.{g}" for g in groups), (2 * F.col("met") / k).alias("total"))


def similar(sig: DataFrame, key: str, k: int, least: float, band_rows: int = 2) -> DataFrame:
    """similar_lists of (key, slot, value)."""
    return similar_lists(_lists(sig, key), key, k, least, band_rows)


def similar_lists(lists: DataFrame, key: str, k: int, least: float, band_rows: int = 2, share: float = 1 / 32) -> DataFrame:
    """(i, j, similarity) of at least `least`, found by bands of band_rows equal slots and verified on all slots.

    A pair of similarity s escapes all bands with probability about
    (1 - s ** band_rows) ** (k / band_rows): 6e-7 at 0.5 for 100 slots.
    Meetings in bands are counted first: where they exceed a share of all
    pairs, comparing every pair by blocks is less work, and exact.
    """
    rows = cut_lineage(lists.where(F.col(key).isNotNull()).select(key, "values"))
    starts = F.sequence(F.lit(0), F.lit(k - band_rows), F.lit(band_rows))
    band = F.explode(F.transform(starts, lambda at: F.xxhash64(at, F.slice("values", at + 1, band_rows)))).alias("band")
    keyed = rows.select(key, band)
    n = rows.count()
    meetings = keyed.groupBy("band").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    if meetings > share * n * (n - 1) / 2:
        return list_similarities(rows, key, k, least)
    met = keyed.select(F.col(key).alias("i"), "band").join(keyed.select(F.col(key).alias("j"), "band"), "band").where("i < j").select("i", "j").distinct()
    own = lambda name: rows.select(F.col(key).alias(name), F.col("values").alias(f"values_{name}"))
    equal = F.aggregate(F.zip_with("values_i", "values_j", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return met.join(own("i"), "i").join(own("j"), "j").select("i", "j", (equal / k).alias("similarity")).where(F.col("similarity") >= least)


def shingle_items(tokens: Column, q: int, base: int = 131) -> Column:
    """The encoded shingles of a token list."""
    return F.transform(shingles(tokens, q), lambda s: encoded(s, base))


def sequence_shingles(df: DataFrame, key: str, tokens: Column, q: int, base: int = 131) -> DataFrame:
    """(key, item): encoded shingles of a token list."""
    return df.select(key, F.explode(shingles(tokens, q)).alias("_s")).select(key, encoded(F.col("_s"), base).alias("item"))
