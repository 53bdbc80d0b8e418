"""URL filtering: host/path rules first, then exact list membership by a Bloom filter cascade.

The list is a table of keys. The cascade is built over the complete universe of
keys (all hosts of the corpus and of the list). Level 0 encodes the listed keys; level 1 encodes the unlisted keys
that level 0 lets through; level 2 the listed ones that level 1 lets through;
and so on until nothing passes wrongly. A key's answer is given by the first
level that rejects it, so every key of the universe is answered exactly, with
no join against the list. Levels are built by distributed partial bitmaps; the
finished cascade is broadcast only if its bits fit a stated size, otherwise
membership falls back to a shuffled semi join, which is exact as well.

Defined results: a null url, or one without `://`, has an empty host and path,
fits no rule and is allowed; repeated rows give repeated rows; null, empty and
repeated keys of the list add nothing; an empty list or table gives an empty
cascade; of rules that fit, the longest wins; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import mix
from tessera.llm.common import arrow_map, cut

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A run of one symbol, and how many of them make a page junk.
SIGN = r"[#]{3}|[*]{3}|[$]{3}|%{3}"
SIGNS = 10
JUNK_SHARE = 20
BUCKET_BITS = 1 << 15
MOST_BYTES = 256 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def ruling(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint8, bit b of the filter is bit b % 8 of byte b // 8


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h1.astype(np.int64).view(np.uint64) + np.uint64(64 * level + k + 1) * (h2.astype(np.int64).view(np.uint64) | np.uint64(1))) % np.uint64(bits)


def contains(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership of universe keys: the parity of the first level that rejects a key."""
    answer = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for i, level in enumerate(levels):
        if not len(open_):
            break
        passed = np.ones(len(open_), bool)
        for k in range(level.hashes):
            at = _positions(h1[open_], h2[open_], i, k, level.bits)
            passed &= (level.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        answer[open_[~passed]] = i % 2 == 1
        open_ = open_[passed]
    answer[open_] = len(levels) % 2 == 1
    return answer


def _level(keys: DataFrame, index: int, n: int, rate: float) -> Level:
    """One Bloom filter over (h1, h2) keys: each task makes partial bitmaps, which are OR-ed by bucket."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(BUCKET_BITS, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / BUCKET_BITS) * BUCKET_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(h1):
                continue
            at = np.unique(np.concatenate([_positions(h1, h2, index, k, bits) for k in range(hashes)]))
            buckets, first = np.unique(at // BUCKET_BITS, return_index=True)
            rows = []
            for b, own in zip(buckets, np.split(at % BUCKET_BITS, first[1:]), strict=True):
                flags = np.zeros(BUCKET_BITS, bool)
                flags[own.astype(np.int64)] = True
                rows.append((int(b), np.packbits(flags, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "bitmap"])

    merged = arrow_map(keys.select("h1", "h2"), partial, "bucket bigint, bitmap binary").groupBy("bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    words = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes in all, checked before by build()
        words[row.bucket * BUCKET_BITS // 8 : (row.bucket + 1) * BUCKET_BITS // 8] = np.frombuffer(row.bitmap, np.uint8)
    return Level(bits, hashes, words)


def build(universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Level] | None:
    """The cascade over universe (key, listed), or None where its first level would not fit most_bytes.

    universe has one row a key; two hashes of each are written once.
    """
    keys = universe.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "listed")
    keys = cut(keys)
    counts = {row.listed: row.n for row in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n_in, n_out = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    if not n_in:
        return levels
    inside, outside = keys.where("listed"), keys.where("NOT listed")
    rate = min(0.5, max(n_in * math.sqrt(0.5) / max(n_out, 1), 1e-4))
    if n_in * -math.log(rate) / math.log(2) ** 2 / 8 > most_bytes / 2:
        return None
    while n_in:
        levels.append(_level(inside, len(levels), n_in, rate))
        passes = _passes(universe, levels[-1:], len(levels) - 1)
        wrong = outside.where(passes)
        wrong = cut(wrong)
        inside, outside, n_in, rate = wrong, inside, wrong.count(), 0.5
        if len(levels) > 200:
            return None  # hashes of two keys agree: no number of levels can tell them apart
    return levels


def _passes(frame: DataFrame, levels: list[Level], offset: int) -> Column:
    shared = frame.sparkSession.sparkContext.broadcast(levels[0])

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        level = shared.value
        ok = np.ones(len(h1), bool)
        for k in range(level.hashes):
            at = _positions(h1.to_numpy(), h2.to_numpy(), offset, k, level.bits)
            ok &= (level.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return passes("h1", "h2")


def listed(rows: DataFrame, key: str, universe: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows with a boolean column listed: whether their key is a listed key of the universe (key, listed)."""
    levels = build(universe, most_bytes)
    if levels is None:
        keys = universe.where("listed").select(F.col("key").alias("_listed_key")).distinct()
        return rows.join(keys, F.col(key) == F.col("_listed_key"), "left").withColumn("listed", F.col("_listed_key").isNotNull()).drop("_listed_key")
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def member(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(contains(shared.value, h1.to_numpy(), h2.to_numpy()))

    return rows.withColumn("listed", member(F.xxhash64(key), F.xxhash64(key, F.lit(1))))


def junk_hosts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key): the hosts of which over one page in JUNK_SHARE shows SIGNS or more runs of one symbol, as filler does; a block list made from the pages."""
    host, _ = host_and_path(F.col(url_col))
    junk = F.coalesce(F.regexp_count(F.col(html_col), F.lit(SIGN)), F.lit(0)) >= SIGNS
    hosts = pages.select(host.alias("key"), junk.cast("int").alias("junk")).where("key <> ''").groupBy("key").agg(F.sum("junk").alias("junk"), F.count("*").alias("n"))
    return hosts.where(F.col("junk") * JUNK_SHARE > F.col("n")).select("key")


def judge(pages: DataFrame, block_list: DataFrame, key: str = "key", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict. block_list is a table of hosts in its column key; the universe is its hosts and those of the pages."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = block_list.select(F.col(key).cast("string").alias("key"), F.lit(True).alias("listed"))
    universe = parts.select(F.col("host").alias("key"), F.lit(False).alias("listed")).unionByName(keys).where("key <> ''")
    marked = listed(parts, "host", universe.groupBy("key").agg(F.max("listed").alias("listed")))
    rule = ruling(F.col("host"), F.col("path"))
    on_list = F.when((F.col("host") != "") & F.col("listed"), "block").otherwise("allow")
    return marked.withColumn("r", rule).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), on_list).alias("verdict"))
