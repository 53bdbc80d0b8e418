"""Distances between all rows of a table, by blocks.

Rows are dealt by hash into chunks; every pair of chunks is one group, whose
distances are matrix products of a strip of rows at a time. A row is sent once
for each chunk, so chunks grow with the table, up to SIDE numbers a side: what
is shuffled grows with rows times chunks, not with pairs. What leaves a group
depends on what is asked for: pairs (all, or those within a distance), each
row's nearest neighbours, each row's sums by label, or counts of distances -
all but the first never make the quadratic pair table.

Defined results: a row whose vector is null, empty or holds a null or a number
that is not finite is in no pair; a zero vector has cosine distance 1 to all.
Rows of one id are in no pair with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship

CHUNK = 1024
#: Chunks are made larger than CHUNK where a table would have more of them than this, up to SIDE numbers.
CHUNKS = 11
SIDE = 2**19
#: Distances that the driver takes, counted by value, to find a quantile among them.
COLLECTED = 2_000_000
#: Numbers of a strip of distances.
STRIP = 2**20
EPS = 1e-10


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine; 1 where either vector is zero."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    scale = na[:, None] * nb[None, :]
    return np.where(scale > 0, 1 - (a @ b.T) / np.where(scale > 0, scale, 1), 1.0)


def euclidean_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Also the Frobenius distance of flattened matrices."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def kl_divergence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the sum of both Kullback-Leibler divergences, cells below EPS raised to it, not renormalised."""
    a, b = np.maximum(a, EPS), np.maximum(b, EPS)
    la, lb = np.log(a), np.log(b)
    return 0.5 * ((a * la).sum(axis=1)[:, None] + (b * lb).sum(axis=1)[None, :] - a @ lb.T - la @ b.T)


def unequal_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of slots in which two signatures differ."""
    out = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.int32)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[:, None] != y[None, :]
    return out


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"cosine": cosine_distance, "euclidean": euclidean_distance, "frobenius": euclidean_distance, "kl": kl_divergence, "slots": unequal_slots}


def usable(vector: Column) -> Column:
    fine = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


@dataclass
class Side:
    """A chunk's rows in the order of their ids."""

    id: np.ndarray
    x: np.ndarray
    label: np.ndarray | None

    def __len__(self) -> int:
        return len(self.id)


def _dealt(df: DataFrame, key: str, vector: Column, keep: list[str], chunk: int | None, kind: str = "double") -> DataFrame:
    ship(df.sparkSession)
    df = df.where(usable(vector) & F.col(key).isNotNull())
    rows = df.select(F.col(key).alias("id"), vector.cast(f"array<{kind}>").alias("v"), *keep)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if chunk is None:
        chunk = max(CHUNK, min(SIDE // (size.width or 1), -(-size.n // CHUNKS)))
    n = max(1, -(-size.n // chunk))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(F.col("_own"), j).alias("ci"), F.greatest(F.col("_own"), j).alias("cj")))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    dealt = rows.withColumn("_p", F.explode(pairs)).select("id", "v", *keep, "_own", "_p.ci", "_p.cj")
    # the number is stated: a group's bytes say little about the work it makes
    return dealt.repartition(max(1, min(n * (n + 1) // 2, 2000)), "ci", "cj").groupBy("ci", "cj")


def _sides(batches: Iterator[pa.RecordBatch], label: str | None = None) -> tuple[Side, Side, bool]:
    t = pa.Table.from_batches(list(batches))
    ids, own = t["id"].to_numpy(), t["_own"].to_numpy()
    v = t["v"].combine_chunks()
    width = len(v.flatten()) // len(ids)
    if (np.diff(v.offsets.to_numpy()) != width).any():
        raise ValueError("vectors of different lengths")
    x, labels = v.flatten().to_numpy().reshape(len(ids), width), t[label].to_numpy() if label else None
    ci, cj = t["ci"][0].as_py(), t["cj"][0].as_py()
    order = np.argsort(ids, kind="stable")
    a, b = (Side(ids[at], x[at], labels[at] if label else None) for at in (order[own[order] == ci], order[own[order] == cj]))
    return a, b, ci == cj


def _strips(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, STRIP // max(1, columns))
    return (slice(s, min(s + step, rows)) for s in range(0, rows, step))


def _distances(a: Side, b: Side, same: bool, distance) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray | None]]:
    """(rows of a, first row of b, distances, which of them are pairs or None for all): every pair once."""
    for s in _strips(len(a), len(b)):
        first = s.start if same else 0
        yield s, first, distance(a.x[s], b.x[first:]), a.id[s][:, None] < b.id[first:][None, :] if same else None


def _each(a: Side, b: Side, same: bool, distance) -> Iterator[tuple[Side, slice, Side, np.ndarray]]:
    """(own, rows of own, others, their distances): every row against its group's other side; a row and itself are inf apart."""
    for own, other in ((a, b),) if same else ((a, b), (b, a)):
        for s in _strips(len(own), len(other)):
            d = distance(own.x[s], other.x)
            if same:
                d = d.astype(float)
                d[np.arange(s.stop - s.start), np.arange(s.start, s.stop)] = np.inf
            yield own, s, other, d


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind, from_pandas=True) for c, kind in zip(columns, schema.types, strict=True)], schema=schema)


def _schema(df: DataFrame, key: str, **columns: str) -> tuple[str, pa.Schema]:
    """The text and Arrow forms of a schema; 'id' is the type of the key."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    id_type = df.schema[key].dataType.simpleString()
    text = ", ".join(f"{c} {kind.replace('id', id_type)}" for c, kind in columns.items())
    return text, to_arrow_schema(_parse_datatype_string(text))


def _vector(vector: str | Column) -> Column:
    return F.col(vector) if isinstance(vector, str) else vector


def pairs(df: DataFrame, key: str, vector: str | Column, metric: str, within: float | None = None, chunk: int | None = None, least: float | None = None, ordered: bool = False) -> DataFrame:
    """(i, j, d) for i < j, all of them or those with least <= d <= within; ordered ones both ways round, each distance computed once."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, i="id", j="id", d="double")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        for s, first, d, want in _distances(a, b, same, distance):
            for bound, inside in ((within, np.less_equal), (least, np.greater_equal)):
                if bound is not None:
                    want = inside(d, bound) if want is None else want & inside(d, bound)
            if want is None:
                i, j, found = np.repeat(a.id[s], d.shape[1]), np.tile(b.id[first:], d.shape[0]), d.ravel().astype(float)
            else:
                x, y = np.nonzero(want)
                i, j, found = a.id[s][x], b.id[first:][y], d[x, y].astype(float)
            if len(found):
                i, j = np.minimum(i, j), np.maximum(i, j)
                yield _batch(schema, i, j, found)
                if ordered:
                    yield _batch(schema, j, i, found)

    return _dealt(df, key, _vector(vector), [], chunk, "int" if metric == "slots" else "double").applyInArrow(kernel, text)


def both_directions(pairs_: DataFrame) -> DataFrame:
    """Ordered pairs i <> j of a symmetric pair table."""
    return pairs_.unionByName(pairs_.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def least_columns(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of every row's k least numbers, least first, ties by column, NaN last; only those up to the k-th are sorted."""
    if d.shape[1] > k:
        x, y = np.nonzero(~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k]))
    else:
        x, y = (at.ravel() for at in np.indices(d.shape))
    order = np.lexsort((y, d[x, y], x))
    x, y = x[order], y[order]
    first = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[first], y[first]


def nearest(df: DataFrame, key: str, vector: str | Column, metric: str | Callable, k: int, chunk: int | None = None) -> DataFrame:
    """(src, dst, d, rank): each row's k nearest others; ties by id. The metric is a name or a function of two blocks of vectors. Groups pass on k candidates a row."""
    distance = METRICS[metric] if isinstance(metric, str) else metric
    text, schema = _schema(df, key, src="id", dst="id", d="double")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        for own, s, other, d in _each(a, b, same, distance):
            x, y = least_columns(np.round(d, 9), k)
            found = d[x, y]
            real = np.isfinite(found)
            yield _batch(schema, own.id[s][x[real]], other.id[y[real]], found[real])

    found = _dealt(df, key, _vector(vector), [], chunk).applyInArrow(kernel, text)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("d", 9), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def label_sums(df: DataFrame, key: str, vector: str | Column, label: str, metric: str = "euclidean", chunk: int | None = None) -> DataFrame:
    """(id, label, other, total): each row's summed distance to the rows of every label, itself at 0."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, id="id", label="long", other="long", total="double")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches, "_label")
        for own, s, other, d in _each(a, b, same, distance):
            labels, at = np.unique(other.label, return_inverse=True)
            by = np.argsort(at, kind="stable")
            sums = np.add.reduceat(np.where(np.isinf(d), 0, d)[:, by], np.searchsorted(at[by], np.arange(len(labels))), axis=1)
            rows = s.stop - s.start
            yield _batch(schema, np.repeat(own.id[s], len(labels)), np.repeat(own.label[s], len(labels)), np.tile(labels, rows), sums.ravel())

    rows = df.withColumn("_label", F.col(label).cast("long"))
    parts = _dealt(rows, key, _vector(vector), ["_label"], chunk).applyInArrow(kernel, text)
    return parts.groupBy("id", "label", "other").agg(F.sum("total").alias("total"))


def dot_products(df: DataFrame, key: str, vector: str, chunk: int = CHUNK) -> DataFrame:
    """(i, j, x): for every pair of chunks their ids and the products of all their vectors, row by row."""
    text, schema = _schema(df, key, i="array<id>", j="array<id>", x="array<double>")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = _sides(batches)
        if len(a) and len(b):
            yield _batch(schema, [a.id.tolist()], [b.id.tolist()], [(a.x @ b.x.T).ravel()])

    return _dealt(df, key, F.col(vector), [], chunk).applyInArrow(kernel, text)


def farthest(df: DataFrame, key: str, vector: str, chunk: int | None = None):
    """(d, i, j) of the pair farthest apart, of equal ones that of the smallest ids; None for fewer than two rows. A strip passes on one pair."""
    text, schema = _schema(df, key, d="double", i="id", j="id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        for s, first, d, want in _distances(a, b, same, euclidean_distance):
            d = np.round(d, 9) if want is None else np.where(want, np.round(d, 9), -1)
            if d.size and d.max() >= 0:
                x, y = np.nonzero(d == d.max())
                i, j = a.id[s][x], b.id[first:][y]
                low, high = np.minimum(i, j), np.maximum(i, j)
                at = np.lexsort((high, low))[0]
                yield _batch(schema, [float(d.max())], [low[at]], [high[at]])

    best = _dealt(df, key, F.col(vector), [], chunk).applyInArrow(kernel, text)
    return best.orderBy(F.col("d").desc(), "i", "j").first()


def _codes(d: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the distances, one for each double."""
    bits = (d + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _counted(df: DataFrame, key: str, vector: Column, metric: str, positive: bool, shift: int, inside: tuple[int, list[int]] | None, chunk: int | None):
    """(codes, counts) of the pairs' distances without their lowest bits, in order; with inside = (bits, codes) only of those. A group passes on counts."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, code="long", n="long")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        for _, _, d, want in _distances(a, b, same, distance):
            d = d.ravel() if want is None else d[want]
            codes = _codes(d[d > 0] if positive else d)
            if inside:
                codes = codes[np.isin(codes >> inside[0], inside[1])]
            codes >>= shift
            if not len(codes):
                continue
            low, high = int(codes.min()), int(codes.max())
            if high - low < 4 * STRIP:
                n = np.bincount(codes - low)
                at = np.flatnonzero(n)
                yield _batch(schema, at + low, n[at])
            else:
                yield _batch(schema, *np.unique(codes, return_counts=True))

    found = _dealt(df, key, vector, [], chunk).applyInArrow(kernel, text).groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    return found["code"].to_numpy(), found["n"].to_numpy()


def quantile(df: DataFrame, key: str, vector: str | Column, metric: str, q: float, positive: bool = False, chunk: int | None = None) -> float | None:
    """The q-quantile (linear interpolation) of all pairs' distances, or of the positive ones; None without any.

    Exact, without the pair table: counts by leading bits name the bins of the
    two order statistics, whose distances are then counted by value.
    """
    vector, shift, inside, before = _vector(vector), 36, None, {}
    ranks = None
    while True:
        codes, n = _counted(df, key, vector, metric, positive, shift, inside, chunk)
        if ranks is None:
            if not len(n):
                return None
            at = q * (int(n.sum()) - 1)
            ranks = (int(np.floor(at)), int(np.ceil(at)))
        # ranks within the counted bins: those below each bin were counted a round before
        found = []
        for r in ranks:
            skipped = 0
            own = np.ones(len(codes), bool)
            if inside:
                bin_, skipped = before[r]
                own = codes >> (inside[0] - shift) == bin_
            upto = np.cumsum(n[own]) + skipped
            k = int(np.searchsorted(upto, r, side="right"))
            found.append((int(codes[own][k]), int(upto[k] - n[own][k]), int(n[own][k])))
        if shift == 0:
            x, y = (float(np.array([c ^ (2**63 - 1) if c < 0 else c], np.int64).view(float)[0]) for c, _, _ in found)
            return x + (y - x) * (at - ranks[0])
        before = {r: (c, below) for r, (c, below, _) in zip(ranks, found, strict=True)}
        inside = (shift, sorted({c for c, _, _ in found}))
        shift = 0 if sum({c: m for c, _, m in found}.values()) <= COLLECTED else max(0, shift - 18)


def totals(df: DataFrame, key: str, vector: str | Column, metric: str, least: float | None = None, within: float | None = None, chunk: int | None = None):
    """(n, sum, low, high) of the pairs' distances with least <= d <= within; a strip passes on one row."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, n="long", total="double", low="double", high="double")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        for _, _, d, want in _distances(a, b, same, distance):
            d = d.ravel() if want is None else d[want]
            d = d[(d >= (-np.inf if least is None else least)) & (d <= (np.inf if within is None else within))]
            if len(d):
                yield _batch(schema, [len(d)], [float(d.sum())], [float(d.min())], [float(d.max())])

    found = _dealt(df, key, _vector(vector), [], chunk).applyInArrow(kernel, text)
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).first()


def neighbour_counts(df: DataFrame, key: str, vector: str | Column, metric: str, within: float, chunk: int | None = None) -> DataFrame:
    """(id, n): number of other rows within a distance, for rows that have any."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, id="id", n="long")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        for own, s, _, d in _each(a, b, same, distance):
            n = (d <= within).sum(axis=1)
            yield _batch(schema, own.id[s][n > 0], n[n > 0])

    return _dealt(df, key, _vector(vector), [], chunk).applyInArrow(kernel, text).groupBy("id").agg(F.sum("n").alias("n"))


def _forest(near: np.ndarray, back: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, columns) of each component of a block that links its row to others; back is near turned round."""
    rows, columns = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool)
    for root in range(len(rows)):
        if rows[root]:
            continue
        rows[root], frontier = True, np.array([root])
        own, met = [], []
        while len(frontier):
            if same:
                reached = np.flatnonzero(near[frontier].any(axis=0) & ~rows)
            else:
                across = np.flatnonzero(near[frontier].any(axis=0) & ~columns)
                columns[across] = True
                met.append(across)
                reached = np.flatnonzero(back[across].any(axis=0) & ~rows) if len(across) else across
            rows[reached] = True
            own.append(reached)
            frontier = reached
        yield root, np.concatenate(own), np.concatenate(met) if met else np.zeros(0, int)


def spanning(df: DataFrame, key: str, vector: str | Column, metric: str, within: float, chunk: int | None = None) -> DataFrame:
    """(a, b): edges with the components of the graph of rows within a distance; a group passes on fewer edges than it has rows."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, a="id", b="id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches)
        near = np.zeros((len(a), len(b)), bool)
        for s in _strips(len(a), len(b)):
            near[s] = distance(a.x[s], b.x) <= within
        back = near.T.copy()
        if same:
            near |= back
        for root, own, met in _forest(near, back, same):
            ends = np.concatenate([a.id[own], b.id[met]])
            if len(ends):
                yield _batch(schema, np.repeat(a.id[root : root + 1], len(ends)), ends)

    return _dealt(df, key, _vector(vector), [], chunk).applyInArrow(kernel, text)


def least_label(df: DataFrame, key: str, vector: str | Column, label: str, metric: str, within: float, chunk: int | None = None) -> DataFrame:
    """(id, label): for rows without a label (below 0) the least label within a distance, if there is one."""
    distance = METRICS[metric]
    text, schema = _schema(df, key, id="id", label="long")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _sides(batches, "_label")
        none = np.iinfo(np.int64).max
        for side in {id(x): x for x in (a, b)}.values():
            side.label = np.where(side.label < 0, none, side.label).astype(np.int64)
        for own, s, other, d in _each(a, b, same, distance):
            free = own.label[s] == none
            best = np.where(d[free] <= within, other.label[None, :], none).min(axis=1, initial=none)
            yield _batch(schema, own.id[s][free][best < none], best[best < none])

    rows = df.withColumn("_label", F.col(label).cast("long"))
    return _dealt(rows, key, _vector(vector), ["_label"], chunk).applyInArrow(kernel, text).groupBy("id").agg(F.min("label").alias("label"))
