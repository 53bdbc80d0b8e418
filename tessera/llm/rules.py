"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; what it measured and whether it
failed are stored as columns (`fail_bits`: bit k set = rule k failed). Which
failures matter is decided later by a named policy, a mask over the rules, so
that a new policy or an ablation reads only the narrow ledger, never a text.

Defined results: a null text counts as empty (it fails `few_words` only);
ties do not arise; repeated rows give repeated rows; an empty table gives an
empty ledger; columns other than the id and the text are not read, whatever
their names; a very long text is scanned whole, alone in its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import SPACE, blocks, sum_by
from tessera.llm.common import arrow_map

WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_stutters")

#: Rule name -> condition of failure over the measurements; the bit of a rule is its place here. Only ever append.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_shouts > 20 * n_words",
    "upper_case": "n_letters >= 40 AND 100 * n_upper > 40 * n_letters",
    "word_length": "n_words >= 10 AND (word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words)",
    "stutter": "n_words >= 10 AND 100 * n_stutters > 20 * n_words",
}

#: Policy version -> the rules that decide. A version is never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(RULES),
}
DEFAULT_POLICY = "full-1"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a text column."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in MEASURES}
    for b in blocks(texts):
        data, bounds = b.data, b.bounds
        parts["n_words"].append(b.n_words.astype(np.int64))
        head = (data & 0xC0) != 0x80  # the first byte of each code point
        parts["word_chars"].append(b.per_doc(head & ~SPACE[data]))
        parts["n_symbols"].append(b.per_doc(_SYMBOL[data]))
        upper = _UPPER[data]
        parts["n_upper"].append(b.per_doc(upper))
        parts["n_letters"].append(b.per_doc(upper | _LOWER[data]))
        parts["n_shouts"].append(b.per_doc(_word_ends(b, ord("!"))))

        line_doc, starts, ends = b.lines()
        parts["n_lines"].append(sum_by(line_doc, b.docs))
        with_word = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
        doc, hashes = line_doc[with_word], b.line_hashes(starts, ends)[with_word]
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        again = np.zeros(len(doc), bool)
        again[1:] = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
        parts["n_dup_lines"].append(sum_by(doc[again], b.docs))
        words = b.word_hashes(folded=False)
        parts["n_repeat_words"].append(_repeat_words(b, words))
        doc = b.doc_of_words()
        parts["n_stutters"].append(sum_by(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], b.docs))
    return {name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in parts.items()}


def _word_ends(b, char: int) -> np.ndarray:
    flags = np.zeros(len(b.data), bool)
    if len(b.ends):
        last = b.ends - 1
        flags[last] = b.data[last] == char
    return flags


def _repeat_words(b, words: np.ndarray) -> np.ndarray:
    """Words that lie in a 5-word window found twice or more in the document, counted once each."""
    at, hashes = b.windows(words, WINDOW)
    if not len(at):
        return np.zeros(b.docs, np.int64)
    doc = b.doc_of_words()
    order = np.lexsort((hashes, doc[at]))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    edge = np.zeros(len(doc) + WINDOW + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge)[: len(doc)] > 0
    return sum_by(doc[covered], b.docs)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and fail_bits, one row per document; one narrow pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{name} bigint" for name in MEASURES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[name]) for name in MEASURES)], ["doc_id", *MEASURES])

    measured = arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), scan, schema)
    bits = F.lit(0).cast("bigint")
    for k, condition in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k)).otherwise(0).cast("bigint")
    return measured.withColumn("fail_bits", bits)


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def failed(policy: str) -> Column:
    """True where the ledger's row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) != 0


def judge(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    base = failed("base-1")
    return rows.withColumns({"base_failed": base, "kept": ~base & ~failed(policy)})


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if it were dropped.

    The ledger is first reduced to one row per distinct bitmask (at most
    2**rules of them), so the shuffle does not grow with the corpus.
    """
    bit_mask = mask(policy)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(bit_mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    names = [(name, 1 << k) for k, name in enumerate(RULES) if bit_mask >> k & 1]
    rule = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("bigint").alias("bit")) for name, bit in names))).alias("r")
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    return (
        masks.select("bits", "n", rule)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            n(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            n(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
            n(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
            F.sum("n").alias("n_docs"),
        )
    )
