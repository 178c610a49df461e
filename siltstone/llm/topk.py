"""Exact top-k by inner product over integer vectors, with a pivot table that eliminates candidates.

A larger inner product is, for given lengths, a smaller Euclidean distance:
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2.  The distances of every vector to PIVOTS pivots are computed once and
stored beside it; by the triangle inequality d(q, x) is at least the largest difference between
the two vectors' distances to a pivot, which bounds the product from above.  The table is sorted
by nearest pivot and the distance to it, so neighbours stand together: a batch whose
intervals of pivot distances rule a query out is skipped whole, and in the others the query's candidates are evaluated in the order
of their bounds until the next bound is below the k-th score so far.  That score begins with those of the pivots
themselves, which are rows of the table.  Bounds carry a slack above their rounding errors, scores are sums
of integers, so the result is exact.

Queries are taken in blocks of about QUERY_BLOCK, each one pass over the table; only a block
is ever broadcast.  A partition gives back at most k rows a query.  On vectors without structure (all distances alike)
bounds rule little out, and nearly every product is computed.

Edge cases: vectors that are null or hold null or non-finite components take no part; nor do those
whose length after scaling is over 2**30, whose products need not fit in a long; of vectors
of different lengths the shorter one counts as filled with zeros; a query is never its own candidate, but an equal
row is; ties go to the smaller id, a null id comes last; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
PIVOTS = 64
#: Rows from which the pivots are drawn; a bound, whatever the table's size.
SAMPLE = 4096
QUERY_BLOCK = 16384
#: Candidates of a query that are evaluated at once.
STRIDE = 128
#: Queries whose bounds are held at once.
ROWS = 256
_LONGEST = float(1 << 60)
_TABLE = "uid long, vec_id long, cell int, near double, vector binary, square long, distances binary"
_FOUND = "uid long, query_id long, vec_id long, score long"
_LAST = np.iinfo(np.int64).max


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, vector) of the rows that take part: floor(scale * x) of every component; stored, so uid stays what it is."""
    v = F.col("_v")
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (F.abs(x) * float(scale) + 1.0) * (F.abs(x) * float(scale) + 1.0))
    usable = F.coalesce(finite, F.lit(False)) & (F.when(finite, size).otherwise(F.lit(float("inf"))) <= _LONGEST)
    return stored(rows.where(usable).select("uid", "vec_id", F.transform(v, lambda x: F.floor(x * float(scale)).cast("int")).alias("vector")), "scaled-vectors")


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up to width."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = values
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Places of pivots in the sample: the longest vector, then always the one farthest from those chosen, while they differ."""
    x = sample.astype(np.float64)
    square = (x * x).sum(axis=1)
    chosen, gap = [int(square.argmax())], np.full(len(x), np.inf)
    while len(chosen) < count:
        gap = np.minimum(gap, square + square[chosen[-1]] - 2 * x @ x[chosen[-1]])
        if gap.max() < 0.5:
            break
        chosen.append(int(gap.argmax()))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of integer vectors; differences first, so near ones lose nothing."""
    y = x.astype(np.float64)
    return np.stack([np.sqrt(((y - p) ** 2).sum(axis=1)) for p in pivots.astype(np.float64)], axis=1) if len(y) else np.zeros((0, len(pivots)))


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Every vector with its squared length and its distances to the pivots, sorted by nearest pivot and distance; a crowded cell spans partitions."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(2), width)
            far = distances(x, pivots)
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, dtype=np.int64)
            columns = [
                *batch.columns[:2], pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell], pa.float64()),
                pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()), pa.array((x * x).sum(axis=1), pa.int64()), pa.array([v.tobytes() for v in far], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "vec_id", "cell", "near", "vector", "square", "distances"])

    keys = ["cell", "near", "uid"]
    return stored(rows.mapInArrow(run, _TABLE).repartitionByRange(*keys).sortWithinPartitions(*keys), "pivot-table")


class Best:
    """The k best of a query so far, by score and then by id; threshold is the least score that may still enter."""

    def __init__(self, k: int, threshold: int | None):
        self.k, self.threshold = k, threshold
        self.score, self.order, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def take(self, score: np.ndarray, order: np.ndarray, ids: np.ndarray) -> None:
        if self.threshold is not None:
            enough = score >= self.threshold
            if not enough.any():
                return
            score, order, ids = score[enough], order[enough], ids[enough]
        self.score, self.order, self.ids = (np.concatenate(x) for x in ((self.score, score), (self.order, order), (self.ids, ids)))
        first = np.lexsort((self.order, -self.score))[: self.k]
        self.score, self.order, self.ids = self.score[first], self.order[first], self.ids[first]
        if len(self.score) == self.k:
            self.threshold = max(int(self.score[-1]), self.threshold if self.threshold is not None else int(self.score[-1]))


def _slack(square: float) -> float:
    """Above the rounding errors of a bound made of squared lengths up to this."""
    return 1.0 + 1e-9 * square


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every row for which is_query (a condition on vec_id) holds."""
    rows = scaled(vectors, id_col, vector_col, scale)
    total, width, longest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x.cast("long")))).first()
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    drawn = rows.orderBy(F.xxhash64("uid"), "uid").limit(sample).collect()  # bounded by the sample
    points = np.zeros((len(drawn), width), dtype=np.int64)
    for i, r in enumerate(drawn):
        points[i, : len(r["vector"])] = r["vector"]
    chosen = choose_pivots(points, pivots)
    centres, centre_uid = points[chosen], np.array([drawn[i]["uid"] for i in chosen])
    table = pivot_table(rows, centres)
    queries = table.where(is_query)
    blocks = max(1, -(-queries.count() // query_block))
    number = np.float64 if longest < 1 << 52 else np.int64  # products are exact in either

    def of_block(asked: list) -> DataFrame:
        q_uid, q_id = np.array([r["uid"] for r in asked]), [r["vec_id"] for r in asked]
        q = np.array([np.frombuffer(r["vector"], np.int32) for r in asked]).reshape(len(asked), width).astype(number)
        q_square = np.array([r["square"] for r in asked], dtype=np.float64)
        q_far = np.array([np.frombuffer(r["distances"], np.float64) for r in asked]).reshape(len(asked), len(centres))

        def start() -> list[Best]:
            """Thresholds from the pivots, which are candidates too."""
            out = []
            known = q @ centres.astype(number).T
            for i in range(len(q)):
                scores = np.sort(known[i][centre_uid != q_uid[i]])
                out.append(Best(k, int(scores[-k]) if len(scores) >= k else None))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = start()
            limit = np.array([-np.inf if b.threshold is None else float(b.threshold) for b in best])
            for batch in batches:
                if not batch.num_rows:
                    continue
                uid, ids = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
                order = batch.column(1).fill_null(_LAST).to_numpy()
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(len(uid), width).astype(number)
                square = batch.column(3).to_numpy().astype(np.float64)
                far = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(len(uid), -1)
                slack = _slack(float(longest))
                low, high = far.min(axis=0), far.max(axis=0)
                apart = np.maximum(np.maximum(low - q_far, q_far - high), 0).max(axis=1, initial=0)
                asking = np.flatnonzero((q_square + square.max() - apart * apart) / 2 + slack >= limit)
                for at in range(0, len(asking), ROWS):
                    some = asking[at : at + ROWS]
                    bound = np.zeros((len(some), len(uid)), dtype=np.float64)
                    for j in range(far.shape[1]):
                        np.maximum(bound, np.abs(q_far[some, j, None] - far[None, :, j]), out=bound)
                    bound = (q_square[some, None] + square[None] - bound * bound) / 2 + slack
                    for i, bounds in zip(some.tolist(), bound, strict=True):
                        limit[i] = _evaluate(best[i], q[i], bounds, x, order, ids, uid != q_uid[i])
            rows = [(i, b) for i, b in enumerate(best) if len(b.score)]
            columns = [pa.array([v for i, b in rows for v in [of(i)] * len(b.score)], pa.int64()) for of in (lambda i: int(q_uid[i]), lambda i: q_id[i])]
            columns += [pa.array([v for _, b in rows for v in b.ids.tolist()], pa.int64()), pa.array([v for _, b in rows for v in b.score.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "query_id", "vec_id", "score"])

        return table.select("uid", "vec_id", "vector", "square", "distances").mapInArrow(run, _FOUND)

    found = []
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).collect()  # about query_block rows
        found.append(stored(of_block(asked), "top-k"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.expr("row_number() over (partition by uid order by score desc, vec_id nulls last)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _evaluate(best: Best, q: np.ndarray, bounds: np.ndarray, x: np.ndarray, order: np.ndarray, ids: np.ndarray, others: np.ndarray) -> float:
    """Evaluate a batch's candidates in the order of their bounds, until a bound is below the threshold; the threshold then."""
    limit = -np.inf if best.threshold is None else float(best.threshold)
    open_ = np.flatnonzero(others & (bounds >= limit))
    open_ = open_[np.argsort(-bounds[open_], kind="stable")]
    for at in range(0, len(open_), STRIDE):
        if bounds[open_[at]] < limit:
            break
        here = open_[at : at + STRIDE]
        best.take((x[here] @ q).astype(np.int64), order[here], ids[here])
        limit = -np.inf if best.threshold is None else float(best.threshold)
    return limit
