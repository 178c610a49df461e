"""Approximate nearest neighbours with a permutation index.

Pivots are drawn from a sample; their number grows with the square root of the number
of vectors, without a bound.  Every vector is represented by the order of its LENGTH nearest
pivots (its permutation) and posted in the inverted files of its
``post`` nearest pivots.  A query visits the files of its ``visit`` nearest
pivots, ranks the vectors there by the footrule distance of the permutations (a pivot that is not
among the nearest counts as the next place),
and reranks the best ``rerank`` share of each file (k at least) by exact Euclidean distance in
double precision.  A vector that is posted in several visited files is looked at in the one
that comes first for the query.  Visits grow with the square root of the number of pivots, so the share
of all vectors that a query meets falls as the table grows.

Files are split into blocks of about BLOCK vectors by a hash of the row, and the
queries of a file into blocks of about QUERY_BLOCK, so a popular pivot (or one vector in a
third of all rows) is spread over tasks; only the ten best of each query and block leave a task.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do vectors whose length differs from that of the commonest
length; a query is never its own candidate, but an equal row is; ties go to the smaller
id; with fewer than k candidates all are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

LEAST_PIVOTS = 128
LENGTH = 64
SAMPLE = 8192
POST = 8
RERANK = 0.8
VISITS = 2.0
BLOCK = 4096
QUERY_BLOCK = 1024
_ENTRY = "file int, block int, chunk int, uid long, vec_id long, vector binary, permutation binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(uid, vec_id, vector) of the rows that take part, stored so that uid stays what it is."""
    v = F.col("vector")
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    cast = F.col(vector_col).cast("array<float>" if single else "array<double>")  # single precision is shuffled as such, and widened to compute
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), cast.alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stored(rows.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def pivot_count(total: int) -> int:
    """Pivots for so many vectors: four times their square root, rounded up to a power of two, and LEAST_PIVOTS at least."""
    return max(LEAST_PIVOTS, 1 << max(0, 4 * isqrt(total) - 1).bit_length())


def visit_count(pivots: int) -> int:
    return ceil(VISITS * sqrt(pivots))


def draw_pivots(rows: DataFrame, pivots: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Distinct vectors from a sample of about ``sample`` rows with the smallest hashes (twice the pivots, if that is more)."""
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    pivots = pivots or pivot_count(total)
    share = min(1.0, max(sample, 2 * pivots) / total)
    h = F.xxhash64("vec_id", "uid")
    chosen = rows.where(h <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).select(h.alias("h"), "vector")
    found = sorted(chosen.collect(), key=lambda r: r["h"])  # bounded by the sample size
    distinct = list(dict.fromkeys(tuple(r["vector"]) for r in found))[:pivots]
    return np.array(distinct) if distinct else draw_pivots(rows, pivots, total)


def _number(pivots: int) -> type:
    """What holds a pivot's number."""
    return np.uint16 if pivots <= 1 << 16 else np.uint32


def permutations(x: np.ndarray, pivots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The ``length`` nearest pivots of each row of x from nearest to farthest; ties by pivot number."""
    x = x.astype(np.float64)
    square = (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T  # less what is the same for all pivots
    if length < len(pivots):
        near = np.sort(np.argpartition(square, length - 1, axis=1)[:, :length], axis=1)
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(square, near, 1), axis=1, kind="stable"), 1)
    else:
        near = np.argsort(square, axis=1, kind="stable")
    return near.astype(_number(len(pivots)))


def footrules(order: np.ndarray, q_place: np.ndarray) -> np.ndarray:
    """Footrule distance of each permutation to the one whose places are q_place (those it lacks hold its length).

    An entry's pivot adds the difference of its two places.  A pivot of the query that an entry
    lacks adds what is left to the length: that sum over all of the query's pivots, less those the entry holds.
    """
    length = order.shape[1]
    theirs = q_place[order].astype(np.int64)
    return np.abs(theirs - np.arange(length)).sum(axis=1) + length * (length + 1) // 2 - (length - theirs).sum(axis=1)


def _post(rows: DataFrame, pivots: np.ndarray, count: int, blocks: dict[int, int], chunks: dict[int, int], query: bool) -> DataFrame:
    """Entries of the inverted files, or the visits of queries to them.

    A vector goes to one block of a file and all query chunks of it; a query goes to one
    chunk and all blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            uid, vec_id = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            x = batch.column(2).flatten().to_numpy().reshape(n, -1)
            order = permutations(x, pivots)
            spread = (uid * 0x9E3779B1) & 0x7FFFFFFF
            out: list[list] = [[] for _ in range(7)]
            for i in range(n):
                vector, permutation = x[i].tobytes(), order[i].tobytes()
                for file in order[i, :count].tolist():
                    nb, nc = blocks.get(file, 1), chunks.get(file, 1)
                    b, c = int(spread[i]) % nb, int(spread[i]) % nc
                    for block, chunk in [(k, c) for k in range(nb)] if query else [(b, k) for k in range(nc)]:
                        for column, value in zip(out, (file, block, chunk, int(uid[i]), vec_id[i], vector, permutation), strict=True):
                            column.append(value)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["file", "block", "chunk", "uid", "vec_id", "vector", "permutation"])

    return rows.mapInArrow(run, _ENTRY)


def _file_sizes(rows: DataFrame, pivots: np.ndarray, count: int) -> dict[int, int]:
    """Entries in each inverted file, at most one number a pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                total += np.bincount(permutations(x, pivots)[:, :count].ravel(), minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots)), pa.int32()), pa.array(total)], ["file", "n"])

    return {r["file"]: r["n"] for r in rows.select("vector").mapInArrow(run, "file int, n long").groupBy("file").agg(F.sum("n").alias("n")).collect()}


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, post: int = POST, visit: int | None = None, rerank: float = RERANK, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row for which is_query (a condition on vec_id) holds."""
    rows = usable(vectors, id_col, vector_col)
    centres = draw_pivots(rows, pivots)
    queries = rows.where(is_query)
    if not len(centres):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    length = min(LENGTH, len(centres))
    post, visit = min(post, length), min(visit or visit_count(len(centres)), length)
    blocks = {f: max(1, -(-n // block)) for f, n in _file_sizes(rows, centres, post).items()}
    chunks = {f: max(1, -(-n // query_block)) for f, n in _file_sizes(queries, centres, visit).items()}

    number = np.float32 if rows.schema["vector"].dataType.elementType == T.FloatType() else np.float64

    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(posted) and len(asked):
            file = posted["file"][0].as_py()
            uid, vec_id = posted["uid"].to_numpy(), np.array(posted["vec_id"].to_pylist(), dtype=object)
            x, order = _matrix(posted["vector"], number).astype(np.float64), _matrix(posted["permutation"], _number(len(centres)))
            q_place = np.full(len(centres), length, dtype=np.int16)
            files_of = order[:, :post]
            by_id = np.array([(1, 0) if i is None else (0, i) for i in vec_id], dtype=np.int64)
            for q_uid, q_id, q, q_order in zip(asked["uid"].to_pylist(), asked["vec_id"].to_pylist(), _matrix(asked["vector"], number).astype(np.float64), _matrix(asked["permutation"], _number(len(centres))), strict=True):
                q_place[q_order] = np.arange(length)
                here = np.flatnonzero((q_place[files_of].min(axis=1) == q_place[file]) & (uid != q_uid))
                footrule = footrules(order[here], q_place)
                q_place[q_order] = length
                if not len(here):
                    continue
                most = max(k, ceil(rerank * len(here)))
                if len(here) > most:
                    here = here[np.lexsort((by_id[here, 1], by_id[here, 0], footrule))[:most]]
                score = np.sqrt(((x[here] - q) ** 2).sum(axis=1))
                best = np.lexsort((by_id[here, 1], by_id[here, 0], score))[:k]
                for column, values in zip(out, ([q_uid] * len(best), [q_id] * len(best), vec_id[here[best]].tolist(), score[best].tolist()), strict=True):
                    column.extend(values)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["uid", "query_id", "vec_id", "score"])

    key = ["file", "block", "chunk"]
    index = _post(rows, centres, post, blocks, chunks, False).groupBy(*key)
    visits = _post(queries, centres, visit, blocks, chunks, True).groupBy(*key)
    found = index.cogroup(visits).applyInArrow(run, "uid long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by uid order by score, vec_id nulls last)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
