"""A Merkle manifest of a table: a binary hash tree per group, and one over the groups' roots.

Leaves are hashed as column expressions and get their places by a global sort; the trees then go
through supersteps on RDDs.  A vertex is a subtree of BLOCK nodes, keyed by group and place.
Upward, children message the hash of their subtree to their parent; a parent that has all of its
children hashes its BITS levels and forwards the result.  Downward, a vertex gets the siblings on the path
above it and sends each child that path with the siblings inside the vertex put first, so leaves need
no path of their own until the last superstep.  A tree of n leaves takes log(n) / BITS supersteps each way, and a
vertex never holds more than BLOCK children and one path, however large its group.

A digest is sha256 in lowercase hex; the hash of a run is that of its digests' text put together.
Runs are every two consecutive nodes, the last one may be a single one; a tree of one leaf is that leaf.

Edge cases: leaves of a group ascend by id (null first), then by leaf; rows alike in all columns are
leaves each, and which of them gets which place does not matter; a null group comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_lookup, stored

#: Levels of a tree that a superstep carries, and nodes of a vertex.
BITS = 8
BLOCK = 1 << BITS
#: Groups whose sizes are broadcast at most; beyond, they are joined by a shuffle with hot groups dealt.
BROADCAST_GROUPS = 10_000
_ROW = 33  # bits that number the rows of a partition
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _halved(nodes: list[str]) -> list[str]:
    return [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def levels(nodes: list[str], whole: bool) -> list[list[str]]:
    """All levels of a vertex from its children on: BITS steps, or, where its children are a whole level of a tree, until one is left."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= BITS:
        out.append(_halved(out[-1]))
    return out


def siblings(of: list[list[str]], child: int) -> list[str]:
    """The path of a child inside a vertex: L or R (where the sibling stands) and its digest, or nothing for a run of one."""
    path = []
    for level in of[:-1]:
        other = child ^ 1
        path.append("" if other >= len(level) else ("L" if other < child else "R") + level[other])
        child >>= 1
    return path


def fold(leaf: str, path: list[str]) -> str:
    for step in path:
        leaf = digest(step[1:], leaf) if step[:1] == "L" else digest(leaf, step[1:])
    return leaf


def sized(value: Column) -> Column:
    """A value as it goes into a leaf: byte count, colon, value; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[sized(c) for c in columns]), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _g (place of the group's first row, which names the group), _i (place in the group) and _n (rows of the group).

    Rows are range-partitioned, so an equal group or id may span partitions; the driver sees one count a partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    ranged = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "merkle-leaves")
    part = F.shiftright("_at", _ROW)
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    numbered = ranged.join(F.broadcast(offsets), part == F.col("_part")).withColumn("_pos", F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW) - 1)).drop("_part", "_before", "_at")
    keyed = numbered.withColumn("_key", sized(F.col(group)))
    groups = stored(keyed.groupBy("_key").agg(F.min("_pos").alias("_g"), F.count("*").alias("_n"), F.count("*").alias("_rows")), "merkle-groups")
    if groups.count() <= BROADCAST_GROUPS:
        found = keyed.join(F.broadcast(groups.drop("_rows")), "_key", "left")
    else:
        found = skew_lookup(keyed, groups, "_key", "_rows", F.xxhash64("_pos"))
    return found.withColumn("_i", F.col("_pos") - F.col("_g")).drop("_key", "_pos")


def _vertices(messages: RDD, parts: int) -> RDD:
    """((group, place), (nodes of the level, children in order)) of messages ((group, place), (child, nodes, hash, carried)); a vertex acts once all its children have sent."""

    def whole(key: tuple[int, int], sent: Iterator[tuple]) -> tuple[int, list[tuple]]:
        children = sorted(sent, key=lambda m: m[0])
        n = children[0][1]
        if len(children) != min(BLOCK, n - key[1] * BLOCK):
            raise ValueError(f"vertex {key} has {len(children)} children")
        return n, [m[2:] for m in children]

    return messages.groupByKey(parts).map(lambda x: (x[0], whole(*x)))


def climb(leaves: RDD, most: int, parts: int) -> tuple[list[RDD], RDD]:
    """Supersteps up over (group, place, nodes, hash, carried): the vertices of each level, and (group, root)."""
    messages, steps, roots = leaves.map(lambda x: ((x[0], x[1] >> BITS), (x[1] & (BLOCK - 1), *x[2:]))), [], []

    def top(vertex: tuple) -> bool:
        return vertex[1][0] <= BLOCK

    def forward(vertex: tuple) -> tuple:
        (g, b), (n, children) = vertex
        return (g, b >> BITS), (b & (BLOCK - 1), -(-n // BLOCK), levels([c[0] for c in children], False)[-1][0], None)

    while True:
        steps.append(_vertices(messages, parts))
        roots.append(steps[-1].filter(top).map(lambda v: (v[0][0], levels([c[0] for c in v[1][1]], True)[-1][0])))
        if most <= BLOCK:
            return steps, leaves.context.union(roots)
        most = -(-most // BLOCK)
        messages = steps[-1].filter(lambda v: not top(v)).map(forward)


def descend(steps: list[RDD], tops: RDD, parts: int) -> RDD:
    """Supersteps down: tops are ((group, 0), (path above the root, told)); (carried, hash, path, told) of every leaf."""

    def paths(met: tuple) -> Iterator[tuple]:
        (g, b), ((n, children), (above, told)) = met
        of = levels([c[0] for c in children], n <= BLOCK)
        for i in range(len(children)):
            yield (g, b), i, children[i], siblings(of, i) + above, told

    down = None
    for k in range(len(steps) - 1, -1, -1):
        met = steps[k].filter(lambda v: v[1][0] <= BLOCK).join(tops, parts)
        if down is not None:
            met = met.union(steps[k].filter(lambda v: v[1][0] > BLOCK).join(down, parts))
        sent = met.flatMap(paths)
        if k:
            down = sent.map(lambda x: ((x[0][0], (x[0][1] << BITS) + x[1]), (x[3], x[4])))
    return sent.map(lambda x: (x[2][1], x[2][0], x[3], x[4]))


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``changed`` gives columns other values for the check only: the leaf is hashed anew with
    them and folded with the original siblings.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(F.col(group).alias("_group"), F.col(id_col).cast("long").alias("_id"), leaf_hash([F.col(c) for c in columns]).alias("_leaf"), leaf_hash(other).alias("_now"))
    rows = rows.withColumn("_now", F.when(F.col("_now") != F.col("_leaf"), F.col("_now")))
    leaves = placed(rows, "_group", ["_id", "_leaf"]).select("_g", "_i", "_n", "_leaf", "_id", "_now")
    most = leaves.agg(F.max("_n"), F.count_if(F.col("_i") == 0)).first()
    if most[0] is None:
        return spark.createDataFrame([], _RESULT)
    up, subroots = climb(leaves.rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], r[5]))), most[0], parts)
    # The tree over the groups: their names are the places of their first rows, so they ascend as the groups do.
    n_groups = most[1]
    ordered = subroots.sortByKey(numPartitions=parts).zipWithIndex().map(lambda x: (-1, x[1], n_groups, x[0][1], x[0][0]))
    top_up, top_root = climb(ordered, n_groups, parts)
    root = top_root.first()[1]
    told = descend(top_up, spark.sparkContext.parallelize([((-1, 0), ([], root))], 1), parts)  # (group, subroot, path, root)
    below = descend(up, told.map(lambda x: ((x[0], 0), (x[2], (x[1], x[3])))), parts)

    def result(x: tuple) -> tuple:
        (doc_id, now), leaf, path, (subroot, root) = x
        folded = fold(now or leaf, path)
        return doc_id, leaf, subroot, root, digest(*[s[1:] for s in path]), folded, folded == root

    return spark.createDataFrame(below.map(result), _RESULT, verifySchema=False)
