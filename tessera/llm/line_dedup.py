"""Line deduplication over the whole corpus with an edit bound, by deletion neighbourhoods.

Lines are compared as word sequences. Every line with a word in it matches an
equal one; one of at least near_words words also matches a line that differs by
one word (put in, left out or replaced), both being that long: in a shorter line
one word is over a fifth of the line, and the edit changes what it says. A line
is removed if it matches a line that first occurs earlier (by id, then line
number); whether that one is itself removed does not matter.

1. One pass hashes the lines; equal lines become a class with its first place
   (partial aggregation, so a very common line is no hot group).
2. Two lines one word apart share half their words as a prefix or suffix, and
   all but one of four quarters. Only classes whose halves, and then whose
   three quarters, meet another class can match; no pair is lost.
3. Those emit all variants with one word left out, as hashed keys. Equal
   variants join: with the same word left out, every member of a group is one
   replacement from its earliest; a variant equal to a whole line is one word
   longer. Either way a group gives one pair per member, never all pairs.
   The pairs' edit distance is then verified on the words themselves.

Defined results: a null text stays null; lines without a word stay; null ids come last; rows of equal id and text count as one document (their lines
tie and share a fate); a text that loses all its lines becomes empty, its row
stays; an empty table gives no rows; columns other than id and text are
carried, whatever their names; very long texts and lines are scanned whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import U64, Block, blocks, mix, powers
from tessera.llm.common import arrow_map, cut, small_side

#: Words that a line needs to be compared at all, and to be compared within the edit bound.
MIN_WORDS = 1
NEAR_WORDS = 5
_Q = 0xC2B2AE3D27D4EB4F
_Q_INV = pow(_Q, -1, 1 << 64)


class _Lines:
    """The lines of a block with enough words, and sums over their words' hashes."""

    def __init__(self, b: Block, least: int):
        doc, starts, ends = b.lines()
        first, last = np.searchsorted(b.starts, starts), np.searchsorted(b.starts, ends)
        line_no = np.arange(len(doc)) - np.searchsorted(doc, doc)
        fit = last - first >= least
        self.doc, self.line_no, self.first, self.last = doc[fit], line_no[fit], first[fit], last[fit]
        self.n = self.last - self.first
        self.words = b.word_hashes(folded=False)
        self._up = powers(_Q, len(self.words) + 1)
        self._down = powers(_Q_INV, len(self.words) + 1)
        self._sum = np.zeros(len(self.words) + 1, U64)
        np.cumsum(self.words * self._up[:-1], out=self._sum[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial sum over words a .. b - 1, as if the first had power 0."""
        return (self._sum[b] - self._sum[a]) * self._down[a]

    def sequence(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(U64))

    def halves(self) -> np.ndarray:
        """Four keys a line: its prefix and suffix of half length, as the longer and as the shorter of a pair."""
        keys = []
        for longer in (self.n, self.n + 1):
            half = (longer - 1) // 2
            for side, (a, b) in enumerate(((self.first, self.first + half), (self.last - half, self.last))):
                keys.append(mix(self.sequence(a, b) + (2 * longer + side).astype(U64) * U64(0x9E3779B97F4A7C15)))
        return np.column_stack(keys)

    def quarters(self) -> np.ndarray:
        """Eight keys a line: what is left without one quarter, as the longer and as the shorter of a pair."""
        keys = []
        for longer in (self.n, self.n + 1):
            for q in range(4):
                head, tail = q * longer // 4, longer - (q + 1) * longer // 4
                ends = self.sequence(self.first, self.first + head) + mix(self.sequence(self.last - tail, self.last))
                keys.append(mix(ends + (4 * longer + q).astype(U64) * U64(0x9E3779B97F4A7C15)))
        return np.column_stack(keys)


def left_out(words: np.ndarray) -> np.ndarray:
    """Hashes of a sequence of word hashes without word j, for every j."""
    n = len(words)
    total = np.zeros(n + 1, U64)
    np.cumsum(words * powers(_Q, n), out=total[1:])
    left, right = total[:-1], (total[-1] - total[1:]) * U64(_Q_INV)
    return mix(left + right + U64(n - 1))


def _scan_lines(batches: Iterator[pa.RecordBatch], min_words: int, near_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1)):
            own = _Lines(b, min_words)
            if not len(own.n):
                continue
            far = own.n < near_words
            keys = [pa.array(k.view(np.int64), mask=far) for k in np.ascontiguousarray(own.halves().T)]
            at = pa.array(own.doc + b.first)
            columns = [
                batch.column(0).take(at),
                batch.column(2).take(at),
                pa.array(own.line_no.astype(np.int32)),
                pa.array(own.sequence(own.first, own.last).view(np.int64)),
                *keys,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "line_no", "h", "k0", "k1", "k2", "k3"])


def _scan_words(batches: Iterator[pa.RecordBatch], near_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(0)):
            own = _Lines(b, near_words)
            if not len(own.n):
                continue
            bounds = np.concatenate([[0], np.cumsum(own.n)]).astype(np.int32)
            words = np.concatenate([own.words[a:z] for a, z in zip(own.first, own.last, strict=True)])
            keys = own.quarters()
            lists = [pa.ListArray.from_arrays(bounds, words.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, 8, dtype=np.int32), keys.ravel().view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(own.sequence(own.first, own.last).view(np.int64)), *lists], ["h", "words", "quarters"])


def _scan_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(1)
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(sizes)
        variants = np.concatenate([left_out(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)])
        at = np.concatenate([np.arange(n) for n in sizes]).astype(U64)
        placed = mix(variants + (at + U64(1)) * U64(0x9E3779B97F4A7C15))
        h = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(variants.view(np.int64)), pa.array(placed.view(np.int64))], ["h", "v", "placed"])


def _agree(a: np.ndarray, a0: np.ndarray, b: np.ndarray, b0: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many of n elements agree from a[a0] and b[b0] on, forwards or backwards, before the first that differs."""
    ends = np.cumsum(n + 1)
    at = np.arange(ends[-1]) - np.repeat(ends - n - 1, n + 1)
    stop = at == np.repeat(n, n + 1)  # a last place that always differs, so that no stretch is empty
    here = ~stop
    differs = stop.copy()
    differs[here] = a[np.repeat(a0, n + 1)[here] + step * at[here]] != b[np.repeat(b0, n + 1)[here] + step * at[here]]
    return np.minimum.reduceat(np.where(differs, at, len(at)), ends - n - 1)


def one_edit(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Which pairs of sequences, laid end to end in a and b, are at most one edit apart."""
    if not len(a_sizes):
        return np.zeros(0, bool)
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    n = np.minimum(a_sizes, b_sizes)
    same = _agree(a, a_ends - a_sizes, b, b_ends - b_sizes, n, 1) + _agree(a, a_ends - 1, b, b_ends - 1, n, -1)
    apart = np.abs(a_sizes - b_sizes)
    return ((apart == 0) & (same >= n - 1)) | ((apart == 1) & (same >= n))


def within(a: list, b: list) -> bool:
    """Whether two sequences are at most one edit apart."""
    return bool(one_edit(np.array(a, object), np.array([len(a)]), np.array(b, object), np.array([len(b)]))[0])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("words"), batch.column("other_words")
        sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        ok = one_edit(a.flatten().to_numpy(zero_copy_only=False), sizes[0], b.flatten().to_numpy(zero_copy_only=False), sizes[1])
        yield pa.RecordBatch.from_arrays([batch.column("h").filter(pa.array(ok))], ["h"])


def _near(docs: DataFrame, classes: DataFrame, near_words: int) -> DataFrame:
    """(h): the classes that match a class first occurring earlier."""
    keyed = classes.where("k0 IS NOT NULL").select("h", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    shared, _ = small_side(shared, 16)
    wanted = keyed.join(shared, F.col("key") == F.col("k"), "left_semi").select("h").distinct().join(classes.select("h", "first"), "h")
    wanted, _ = small_side(wanted.withColumnRenamed("h", "w"), 64)

    sources, _ = small_side(wanted.select(F.col("first.doc_id").alias("_id")).distinct(), 24)
    texts = docs.join(sources, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    lines = arrow_map(texts, functools.partial(_scan_words, near_words=near_words), "h bigint, words array<bigint>, quarters array<bigint>")
    lines = cut(lines.join(wanted, F.col("h") == F.col("w")).drop("w").dropDuplicates(["h"]))
    quarters = lines.select("h", F.explode("quarters").alias("key"))
    shared = quarters.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    shared, _ = small_side(shared, 16)
    close, _ = small_side(quarters.join(shared, F.col("key") == F.col("k"), "left_semi").select(F.col("h").alias("w")).distinct(), 16)
    lines = cut(lines.join(close, F.col("h") == F.col("w"), "left_semi").select("h", "words", "first"))
    variants = arrow_map(lines.select("h", "words"), _scan_variants, "h bigint, v bigint, placed bigint")

    # replaced: the same words are left with the same place left out; the group's earliest is everyone's partner
    groups = variants.groupBy("placed").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(F.col("placed").alias("g"))
    groups, _ = small_side(groups, 16)
    members = cut(variants.join(groups, F.col("placed") == F.col("g")).select(F.col("placed").alias("v"), "h").join(lines.select("h", "first"), "h"))
    heads = members.groupBy("v").agg(F.min(F.struct("first", "h")).alias("head")).select(F.col("v").alias("g"), F.col("head.h").alias("other"))
    replaced = members.join(heads, F.col("v") == F.col("g")).where("h <> other").select("h", "other")
    # put in: a line with one word left out is another whole line
    whole, _ = small_side(lines.select(F.col("h").alias("other"), F.col("first").alias("other_first")), 80)
    longer = variants.join(whole, F.col("v") == F.col("other")).join(lines.select("h", "first"), "h")
    later = F.col("first") > F.col("other_first")
    longer = longer.select(F.when(later, F.col("h")).otherwise(F.col("other")).alias("h"), F.when(later, F.col("other")).otherwise(F.col("h")).alias("other"))
    pairs = replaced.unionByName(longer).distinct()
    known = lines.select("h", "words")
    pairs = pairs.join(known, "h").join(known.select(F.col("h").alias("other"), F.col("words").alias("other_words")), "other")
    return arrow_map(pairs.select("h", "words", "other_words"), _verify, "h bigint").distinct()


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _without(lines: Column, removed: Column) -> Column:
    """The lines between the sorted removed ones as a text: stretches are cut out whole, so the work is linear in the lines."""

    def kept(x: Column) -> Column:
        after = lambda k: F.coalesce(F.get(x["removed"], k - 1), F.lit(-1)) + 2  # noqa: E731  the place, from 1, behind the removed line before
        stretches = F.transform(x["removed"], lambda r, k: F.slice(x["lines"], after(k), r + 1 - after(k)))
        last = after(F.size(x["removed"]))
        return F.concat(F.flatten(stretches), F.slice(x["lines"], last, F.greatest(F.size(x["lines"]) + 1 - last, F.lit(0))))

    bound = F.array(F.struct(lines.alias("lines"), removed.alias("removed")))
    return F.array_join(F.get(F.transform(bound, kept), F.lit(0)), "\n")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, t, removed): per document (t: its text's hash) the numbers of the lines to remove, where there are any."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", _text_hash(F.col("text")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    lines = cut(arrow_map(rows, functools.partial(_scan_lines, min_words=min_words, near_words=near_words), f"doc_id {id_type}, t bigint, line_no int, h bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "line_no")
    classes = lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4)))
    classes = cut(classes)
    near = cut(_near(rows, classes, near_words)).withColumn("near", F.lit(True))
    decided = classes.select("h", "first", "n").join(near, "h", "left").where("n > 1 OR near")
    decided, _ = small_side(decided.select(F.col("h").alias("_h"), "first", F.coalesce("near", F.lit(False)).alias("near")), 56)
    gone = lines.join(decided, F.col("h") == F.col("_h")).where(F.col("near") | (F.col("first") != place))
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents' rows with the removed lines taken out of the text, and n_lines, n_removed besides."""
    gone, _ = small_side(removals(docs, id_col, text_col, min_words, near_words).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "removed"), F.size("removed") * 4 + 64)
    carried = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*carried).alias("_row"), F.col(id_col).alias("_own_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_own_t", _text_hash(F.col("_text")))
    joined = rows.join(gone, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_t") == F.col("_t")), "left")
    text = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(_without(F.split(F.col("_text"), "\n", -1), F.col("removed")))
    n_lines = F.length(F.coalesce("_text", F.lit(""))) - F.length(F.regexp_replace(F.coalesce("_text", F.lit("")), "\n", "")) + 1
    columns = [(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*columns, n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"))
