"""Near-duplicate embeddings by a forest of random-projection trees.

Each label has ``TREES`` trees.  A node parts its vectors at the median of their
projections on a random direction; vectors within ``SPILL`` of the median go to both
sides.  The margin is measured in what a linking pair's projections differ by, so a pair
is parted as seldom in a tight group as in a loose one; a node that three directions
cannot part (each side keeps over ``STUCK`` of the vectors, as in a group whose vectors
are all near each other) stays a leaf of its own, however large.  Vectors are compared
within leaves in double precision, links are united to components.

Directions follow from the tree, the round and the node; medians from a sample of
``SAMPLE`` vectors a node.  Trees grow ``DEPTH`` levels a round, until leaves have about
``LEAF`` vectors, however large the label: depth follows the data.

A pair that meets in several leaves counts in the least of them: each copy of a vector
knows its other leaves with lesser numbers.

Scale: equal vectors of a label are first collapsed to one with a count.  A copy of a
vector is one row of the vector's own type.  A leaf with more than ``TILE`` vectors is cut
into tiles, and pairs of tiles are groups of their own, so no task holds more than two
tiles and no pair is left out.  A leaf returns a row per vector that has links - their
number and the least vector of its local component - never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or have a null label, link with nothing and are their own component; only
vectors of equal length are compared; repeated rows are vectors of their own; a
component's id is its least non-null vec_id; an empty table gives an empty result;
other columns are ignored.  A pair that every tree parts is missed: about one in a
hundred at a depth of twenty (tests measure recall against all pairs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import UID, by_key, mix, read_table, with_uid, written
from quarry.llm.components import components

SIMILARITY = 0.93
TREES = 6
LEAF = 20  # vectors of a leaf, about; a node of up to twice as many is not parted
DEPTH = 6  # levels of a round
SAMPLE = 4096
TRIES = 3
STUCK = 0.75
TILE = 2048
#: No vectors that link are farther apart; with room for rounding.
NEAR = float(np.sqrt(2 - 2 * SIMILARITY)) + 1e-6
#: Half of what the projections of a linking pair differ by on one of width directions, as a deviation.
SPILL = 0.5


_KEY = ["label", "width", "tree", "cell"]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width).astype(float)


def _directions(tree: int, grown: int, width: int, depth: int) -> np.ndarray:
    """Unit vectors for each inner node (from 1 on) of a tree's part and each try."""
    x = np.random.default_rng([tree, grown, width]).normal(size=(1 << depth, TRIES, width))
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _fit(table: pa.Table, grown: int, depth: int, leaf: int) -> pa.Table:
    """From a sample of a node: the direction and the median of each node below; direction -1: a leaf."""
    width, tree = table.column("width")[0].as_py(), table.column("tree")[0].as_py()
    x = _unit(_matrix(table.column("v"), width))
    scale = table.column("size")[0].as_py() / len(x)
    ways, margin = _directions(tree, grown, width, depth), SPILL * NEAR / np.sqrt(width)
    way, middle = np.full(1 << depth, -1, np.int32), np.zeros(1 << depth)
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if node >= 1 << depth or len(at) * scale <= 2 * leaf or len(at) < 4:
            continue
        for k in range(TRIES):
            y = x[at] @ ways[node, k]
            t = float(np.median(y))
            low, high = y <= t + margin, y >= t - margin
            if max(low.sum(), high.sum()) <= STUCK * len(at):
                way[node], middle[node] = k, t
                todo += [(2 * node, at[low]), (2 * node + 1, at[high])]
                break
    return pa.table({c: table.column(c)[:1] for c in _KEY} | {"way": pa.array([way.tolist()], pa.list_(pa.int32())), "middle": pa.array([middle.tolist()], pa.list_(pa.float64()))})


def _fitting(grown: int, depth: int, leaf: int):
    return lambda table: _fit(table, grown, depth, leaf)




def _descend(batches, grown: int, depth: int):
    """Each vector in the leaves of its part of the tree; open: the part ends there, the tree does not."""
    for batch in batches:
        if not batch.num_rows:
            continue
        widths, trees = np.asarray(batch.column("width")), np.asarray(batch.column("tree"))
        way, middle = (_matrix(batch.column(c), 1 << depth) for c in ("way", "middle"))
        rows, nodes = [], []
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            x = _unit(_matrix(batch.column("v").take(pa.array(own)), width))
            ways = {t: _directions(t, grown, width, depth) for t in np.unique(trees[own]).tolist()}
            margin = SPILL * NEAR / np.sqrt(width)
            at, node = np.arange(len(own)), np.ones(len(own), np.int64)
            for _ in range(depth + 1):
                inside = node < 1 << depth
                k = np.where(inside, way[own[at], np.where(inside, node, 0)], -1).astype(int)
                rows.append(own[at[k < 0]])
                nodes.append(node[k < 0])
                at, node, k = at[k >= 0], node[k >= 0], k[k >= 0]
                if not len(at):
                    break
                y = np.empty(len(at))
                for t, w in ways.items():
                    mine = np.flatnonzero(trees[own[at]] == t)
                    for a in range(0, len(mine), 4096):
                        m = mine[a : a + 4096]
                        y[m] = (x[at[m]] * w[node[m], k[m]]).sum(axis=1)
                t = middle[own[at], node]
                low, high = y <= t + margin, y >= t - margin
                at, node = np.concatenate([at[low], at[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
        row, node = np.concatenate(rows), np.concatenate(nodes)
        cell = mix(np.asarray(batch.column("cell")).view(np.uint64)[row] + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        some = batch.select(["label", "width", "tree", "id", "n", "v"]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.view(np.int64)), pa.array(node >= 1 << depth)], names=[*some.schema.names, "cell", "open"])


_LINKED = "id bigint, n_links bigint, least bigint"


def _unite(least: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the components of p and q; least holds each vector's least one."""
    while True:
        a, b = least[p], least[q]
        other = a != b
        if not other.any():
            return
        p, q, a, b = p[other], q[other], a[other], b[other]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least[:] = least[least]


def _compare(table: pa.Table) -> pa.RecordBatch:
    """A tile, or two of them: the links of its vectors that no lesser leaf has, and the local components."""
    width = table.column("width")[0].as_py()
    x = _unit(_matrix(table.column("v"), width))
    ids, n, tile = (np.asarray(table.column(c)) for c in ("id", "n", "tile"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.unique(ids, return_index=True)[1]
    x, ids, n, tile = x[order], ids[order], n[order], tile[order]
    rows = np.flatnonzero(tile == i)
    cols = rows if i == j else np.flatnonzero(tile == j)
    # A bit for each lesser leaf that several of these vectors share.
    lesser = table.column("lesser").combine_chunks().take(pa.array(order))
    values, where, counts = np.unique(np.asarray(lesser.flatten()), return_inverse=True, return_counts=True)
    bit = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(lesser)))
    ok = counts[where] > 1
    bits = np.zeros((len(ids), (int((counts > 1).sum()) + 63) // 64), np.uint64)
    np.bitwise_or.at(bits, (owner[ok], bit[where[ok]] >> 6), np.uint64(1) << (bit[where[ok]] & 63).astype(np.uint64))
    links, least = np.zeros(len(x), np.int64), np.arange(len(x))
    for a in range(0, len(rows), 256):
        r = rows[a : a + 256]
        p, q = np.nonzero(x[r] @ x[cols].T >= SIMILARITY)
        p, q = r[p], cols[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        if bits.shape[1]:
            new = np.ones(len(p), bool)
            step = max(1, 4_000_000 // bits.shape[1])
            for b in range(0, len(p), step):
                new[b : b + step] = ~(bits[p[b : b + step]] & bits[q[b : b + step]]).any(axis=1)
            p, q = p[new], q[new]
        np.add.at(links, p, n[q])
        np.add.at(links, q, n[p])
        _unite(least, p, q)
    got = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(links[got]), pa.array(ids[least[got]])], names=["id", "n_links", "least"])


def _compared(batches):
    for table in by_key(batches, ["label", "width", "leaf", "i", "j"]):
        if table.num_rows > 1:
            out = _compare(table)
            if out.num_rows:
                yield out


def leaves(classes: DataFrame) -> DataFrame:
    """Rows (label, width, leaf, id, n, v): each vector of classes (label, width, id, n, v) in its leaves of all trees."""
    kind = classes.schema["v"].dataType.simpleString()
    shape = f"label string, width int, tree int, id bigint, n bigint, v {kind}, cell bigint, open boolean"
    key = "label string, width int, tree int, cell bigint, way array<int>, middle array<double>"
    sizes = classes.groupBy("label", "width").agg(F.count("*").alias("size"))
    now = classes.join(sizes, ["label", "width"]).withColumn("open", F.col("size") > 2 * LEAF).drop("size")
    trees = F.when(F.col("open"), F.sequence(F.lit(0), F.lit(TREES - 1))).otherwise(F.array(F.lit(0)))
    now = written(now.withColumn("tree", F.explode(trees)).select("label", "width", "tree", "id", "n", "v", F.lit(0).cast("bigint").alias("cell"), "open"), "cells")
    done, grown, depth, leaf = [now.filter("not open")], 0, DEPTH, LEAF
    while not now.filter("open").isEmpty():
        rows = now.filter("open")
        sizes = rows.groupBy(_KEY).agg(F.count("*").alias("size"))
        chance = F.ceil(F.lit(float(SAMPLE << 20)) / F.col("size"))
        sample = rows.select(*_KEY, "id", "v").join(sizes, _KEY).filter(F.pmod(F.xxhash64("id", F.lit(grown)), F.lit(1 << 20)) < chance)
        fits = written(sample.groupBy(_KEY).applyInArrow(_fitting(grown, depth, leaf), key), "trees")
        now = written(rows.join(fits, _KEY).mapInArrow(lambda it, g=grown: _descend(it, g, depth), shape), "cells")
        done.append(now.filter("not open"))
        grown += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("label", "width", F.xxhash64("tree", "cell").alias("leaf"), "id", "n", "v")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    inner = vectors.schema["embedding"].dataType
    v = F.col("embedding") if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    rows = with_uid(vectors).select(UID, "vec_id", v.alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0)
    usable = F.coalesce(usable, F.lit(False))
    # Equal vectors of a label count as one, known by its least row.
    classes = written(
        rows.filter(usable).groupBy("label", "v").agg(F.min(UID).alias("id"), F.count("*").alias("n")).withColumn("width", F.size("v")), "vectors"
    )
    copies = written(leaves(classes), "leaves")
    place = ["label", "width", "leaf"]
    tiles = copies.groupBy(place).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("m")).filter("m > 1").drop("m")
    others = copies.groupBy("id").agg(F.collect_list("leaf").alias("all"))
    dealt = (
        copies.join(tiles, place)
        .join(others, "id")
        .withColumn("lesser", F.filter("all", lambda x: x < F.col("leaf")))
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(*place, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "id", "n", "v", "lesser", "tile")
    )
    key = [*place, "i", "j"]
    linked = written(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared, _LINKED), "links")
    n_links = linked.groupBy("id").agg(F.sum("n_links").alias("links"))
    roots = components(linked.filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    labelled = classes.join(n_links, "id", "left").join(roots.withColumnRenamed("u", "id"), "id", "left")
    labelled = labelled.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    full = rows.select("vec_id", UID, F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("v")).alias("v")).join(labelled, ["label", "v"], "left")
    full = full.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", F.col(UID)).alias("root"))
    least = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = full.join(least, "root").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM e LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
