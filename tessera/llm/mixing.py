"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffled order, served
again from the start when it has been served whole. Serving a word of a source
with target t advances the source's virtual time by 1/t, so a document's
virtual finish time is its source's cumulative words divided by the target.
Long documents queue in packets. All queues are merged by a global range sort
on the finish time, and the mix ends where the total budget is used up, close
to virtual time 1: no source is further from its target than the words that
rounding leaves over, less than one for each source. A document in service at
the end gives the words served so far.

Cumulative words need no group of one source in one task: the shuffle key's
first hex digits divide each source into consecutive ranges, more of them for
a larger corpus, whose totals (pre-aggregated) give each range its offset, and
only the order inside a range is a window. The water-filling of the targets
and the totals of the sort's ranges are windows over one row a source or range.

Defined results: a null text has no words; a null source is a source of its
own, last in order; rows of equal id and text tie and are interchangeable; repeated rows are separate documents; an empty
table gives an empty mix; a document without words is never served; other
columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, small_side

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, in halves (3: 150 %).
SHARE_HALVES = 3
#: A source is served at most so many times.
MOST_TIMES = 2
#: Hex digits of the shuffle key that divide a source into ranges: at least so many, and one more for every 16 times DIGIT_DOCS documents.
LEAST_DIGITS = 3
DIGIT_DOCS = 1 << 20
#: Words of a document that queue together.
PACKET = 512
#: Entries of the queue in a range of the global sort, and the most ranges.
RANGE_ROWS = 4096
MOST_RANGES = 20_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sources: DataFrame) -> DataFrame:
    """From (source, source_size), one row per source: its target by water-filling.

    Sources are ordered by cap per weight; one is held at its cap as long as
    its share of what the sources before it left over reaches the cap. The
    sums are whole numbers and the one division comes last, so that any engine
    gets the same double.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1)
    )
    ranked = ranked.withColumn("cap", (F.col("source_size") * MOST_TIMES).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left_over = F.sum("source_size").over(everything) * float(SHARE_HALVES) - 2 * F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    held = ranked.withColumn("held", 2 * F.col("cap") * F.sum("weight").over(onward) <= F.col("weight") * left_over)
    free = F.sum("source_size").over(everything) * float(SHARE_HALVES) - 2 * F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0.0)).over(everything)
    free_weight = F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("weight"))).over(everything)
    return held.withColumn("target", F.when(F.col("held"), F.col("cap")).otherwise(F.col("weight") * free / (2 * free_weight))).select("source", "rank", "source_size", "target")


def _documents(docs: DataFrame, id_col: str, source_col: str, text_col: str, carry: list[str] | None, digits: int, seed: str) -> DataFrame:
    """doc_id, source, size, order_key and part of every document, and the carried columns as one struct row."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))  # so that rows without an id, or of one id, are spread as well
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        order.alias("order_key"),
        *([F.struct(*carry).alias("row")] if carry else []),
    ).withColumn("part", F.substring("order_key", 1, digits))


def _placed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """The rows with end, their last word's number in their source's queue, and their source's columns."""
    inside = Window.partitionBy("source", "part").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.withColumn("end", F.col("offset") + F.col("upto")).drop("s", "p", "part", "upto", "offset")


def packets(placed: DataFrame) -> DataFrame:
    """The queue's entries: source rank, words and virtual finish time of every document, in both rounds, in packets of PACKET words.

    The one packet of a source that is in service when its target is reached
    comes word by word, so that the mix can end inside it.
    """
    full = F.floor("target").cast("bigint")
    rows = placed.where("size > 0").select("rank", "source_size", "target", "size", "end", full.alias("full"), F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))).alias("round"))
    rows = rows.withColumn("first", F.col("end") - F.col("size") + F.col("round") * F.col("source_size"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / PACKET).cast("bigint"))))
    low = F.col("first") + F.col("k") * PACKET
    rows = rows.select("rank", "target", "full", low.alias("low"), F.least(low + PACKET, F.col("first") + F.col("size")).alias("high"))
    each = F.transform(F.sequence(F.col("low") + 1, F.col("high")), lambda e: F.struct(e.alias("high"), F.lit(1).cast("bigint").alias("words")))
    whole = F.array(F.struct("high", (F.col("high") - F.col("low")).alias("words")))
    cut_here = (F.col("low") <= F.col("full")) & (F.col("high") > F.col("full"))
    entries = rows.select("rank", "target", F.explode(F.when(cut_here, each).otherwise(whole)).alias("e"))
    return entries.select("rank", (F.col("e.high") / F.col("target")).alias("finish"), F.col("e.high").alias("high"), F.col("e.words").alias("words"))


def truncated(queue: DataFrame, budget: int) -> DataFrame:
    """(rank, budget): the words each source gives when the queue, range-sorted by virtual finish time, ends after budget words.

    The order inside a range is only needed in the one range where the budget
    ends; of those before it the totals suffice.
    """
    queue = cut(queue)
    n = max(1, min(MOST_RANGES, queue.count() // RANGE_ROWS))
    order = ("finish", "rank", "high")
    ranged = cut(queue.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("words").alias("words"))  # at most MOST_RANGES rows
    before = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    last = totals.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).orderBy(F.col("range").desc()).first()
    if last is None:
        return queue.limit(0).select("rank", F.lit(0).cast("bigint").alias("budget"))
    upto = F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    inside = ranged.where(F.col("range") == last["range"]).withColumn("left", F.lit(budget - last["before"]) - F.coalesce(upto, F.lit(0)))
    ending = inside.where("left > 0").select("rank", F.least("words", "left").alias("words"))
    served = ranged.where(F.col("range") < last["range"]).groupBy("rank").agg(F.sum("words").alias("words")).unionByName(ending)
    return served.groupBy("rank").agg(F.sum("words").alias("budget"))


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None, seed: str = SEED) -> DataFrame:
    """Every document with size, source_size, target, served_1 and served_2 (words it gives in its source's first and second round) and finish_1, finish_2 (virtual times).

    carry names the document columns to keep besides; they come as one struct `row`.
    """
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(docs.count(), 1) / DIGIT_DOCS, 16)))
    light = _documents(docs, id_col, source_col, text_col, None, digits, seed)
    ranges = cut(light.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    sources = targets(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)).cast("bigint"))
    offsets = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("part").alias("p"), "offset", "rank", "source_size", "target"
    )
    offsets, _ = small_side(offsets, F.coalesce(F.length("s"), F.lit(0)) + 96)
    placed = cut(_placed(light, offsets))
    words = ranges.agg(F.coalesce(F.sum("part_size"), F.lit(0))).first()[0]
    budgets, _ = small_side(truncated(packets(placed), words * SHARE_HALVES // 2).withColumnRenamed("rank", "r"), 32)
    if carry:
        placed = _placed(_documents(docs, id_col, source_col, text_col, carry, digits, seed), offsets)
    queued = placed.join(budgets, F.col("rank") == F.col("r"), "left").withColumn("budget", F.coalesce("budget", F.lit(0)))
    served = lambda end: F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("budget") - end + F.col("size")))
    finish = lambda end: F.try_divide(end.cast("double"), F.col("target"))
    again = F.col("end") + F.col("source_size")
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", "order_key", *(["row"] if carry else []),
        served(F.col("end")).alias("served_1"), served(again).alias("served_2"), finish(F.col("end")).alias("finish_1"), finish(again).alias("finish_2"),
    )


def taken(docs: DataFrame) -> DataFrame:
    """Per document what the mix takes of it: doc_id, size, source_size, target, taken."""
    return schedule(docs).select("doc_id", "size", "source_size", "target", (F.col("served_1") + F.col("served_2")).alias("taken"))


def mix(docs: DataFrame, partitions: int | None = None, text_col: str = "text") -> DataFrame:
    """The mix itself: the documents' rows in virtual time order, once for each time served.

    A document in service when the budget ends has its text cut after the
    words it served. Virtual time runs evenly over the mix's words, so equal
    slices of it are range partitions of equal size without sampling.
    """
    columns = docs.columns
    plan = schedule(docs, text_col=text_col, carry=columns)
    rounds = F.explode(F.array(*(F.struct(F.col(f"served_{k}").alias("served"), F.col(f"finish_{k}").alias("finish")) for k in (1, 2)))).alias("turn")
    served = plan.select("row", "size", "order_key", rounds).where("turn.served > 0")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_ = F.least(F.floor(F.col("turn.finish") * n), F.lit(n - 1)).cast("int")
    ordered = served.repartitionById(n, slice_).sortWithinPartitions("turn.finish", "order_key")
    pattern = F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("turn.served").cast("string"), F.lit("}+"))
    first_words = F.call_function("regexp_extract", F.col(f"row.{text_col}"), pattern, F.lit(0))
    text = F.when(F.col("turn.served") < F.col("size"), first_words).otherwise(F.col(f"row.{text_col}"))
    return ordered.select(*((text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns))
