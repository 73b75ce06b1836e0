"""N-gram Jaccard join with a count-vector tree.

A document's set holds the hashes of its distinct five-word shingles.  Hashes are dealt
to groups by their leading bits, and the counts of all groups are the document's point.
Two sets cannot share more than the sum over groups of the lesser count, and a node of
several points not more than with the greatest count of each group; both bounds prune
before a pair is verified on the sets themselves.

A tree over all points alone prunes nothing between documents of like length, as their
counts are alike.  So the tree's upper level is a key that linked sets are sure to have
in common: of a set's shingles in hash order, one of the first n - ceil(0.8 n) + 1.
Below each key points are ordered by size, leaves of neighbouring sizes have boxes, and
box and point bounds prune.

Only components are asked for, so links inside a component need not be listed:

1. equal sets count as one;
2. under every key each set is held against the key's least and greatest row; pairs that
   pass the point bound are verified and the links united;
3. under keys where several components meet, the tree finds pairs of different
   components that pass the bounds: first only enough of them to unite all they might
   unite, then, with those verified, all that are left under keys where some were.  A
   key's least and greatest row have met all others in step 2 and take no part.  No pair
   that could be a link between two components is left out.

Scale: keys move as hashes; texts only of sets in some surviving pair, dealt to buckets
of about ``BUCKET_DOCS`` texts.  A key that many rows share is worked in tiles of
``TILE`` rows; no pairs are listed but those that pass the bounds.

Defined results: a null or wordless text has an empty set and links with nothing; a text
of fewer than five words is one shingle; repeated rows are linked with each other (equal
sets); a component's id is its least non-null doc_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import NOT_SPACE, UID, Words, chunks, drop_written, grams, read_table, release, released, with_uid, written
from quarry.llm.components import components

N = 5
TILE = 4096
BOX = 32
HEAD = 8
COARSE = 32
#: Shingles of a tile's rows and of a bucket's texts: what a task holds is bound by these as well as by rows.
TILE_SHINGLES = 1 << 24
BUCKET_DOCS, BUCKET_SHINGLES = 1500, 1_000_000
MIN_GROUPS, MAX_GROUPS = 16, 1 << 20
BLOCK_COUNTS = 2_000_000
#: Sizes of linked sets differ by a factor of 1.25 at most, so they are in the same or in neighbouring steps of this base.
SIZE_STEP = 1.26


def shingle_sets(parts: list[bytes]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words = Words(parts, NOT_SPACE, lower=True)
    g, ptr, out = grams(words.hashes, N), words.ptr.tolist(), []
    for i in range(len(parts)):
        a, b = ptr[i], ptr[i + 1]
        if b - a >= N:
            out.append(np.unique(g[a : b - N + 1]))
        elif b > a:
            out.append(grams(words.hashes[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def point(s: np.ndarray) -> bytes:
    """Counts of a group for two to four shingles, in half a byte each; 15 stands for 15 or more.

    A point of twice the groups folds to one of this by adding neighbours.
    """
    g = min(MAX_GROUPS, max(MIN_GROUPS, 1 << len(s).bit_length() >> 2))
    c = np.minimum(15, np.bincount((s >> np.uint64(64 - (g.bit_length() - 1))).astype(np.int64), minlength=g)).astype(np.uint8)
    return (c[0::2] | (c[1::2] << 4)).tobytes()


def _counts(packed: bytes) -> np.ndarray:
    """A point's counts; full halves are unbounded."""
    x = np.frombuffer(packed, np.uint8)
    out = np.empty(2 * len(x), np.int32)
    out[0::2], out[1::2] = x & 15, x >> 4
    out[out == 15] = 1 << 20
    return out


def _sketch(batches):
    for batch in batches:
        for first, parts in chunks(batch, "text"):
            sets = shingle_sets(parts)
            n = [len(s) for s in sets]
            key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            prefix = [s[: len(s) - (8 * len(s) + 9) // 10 + 1].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            edges = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            rows = batch.slice(first, len(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(UID), rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                    pa.array([point(s) for s in sets], pa.binary()), pa.array([p[:HEAD].tobytes() for p in prefix], pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(prefix))),
                ],
                names=[UID, "doc_id", "n", "key", "point", "head", "prefix"],
            )


def needed(a, b):
    """Least overlap of two linked sets of these sizes: 0.8 (a + b) / 1.8, rounded up."""
    return -((-4 * (a + b)) // 9)


def _fine(points: list[bytes], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The point bound of pairs: the sum of the lesser counts at the coarser of the two sizes."""
    out = np.zeros(len(p), np.int64)
    sizes = np.array([2 * len(x) for x in points])
    coarser = np.minimum(sizes[p], sizes[q])
    for g in np.unique(coarser).tolist():
        same = np.flatnonzero(coarser == g)
        step = max(1, BLOCK_COUNTS // g)
        for a in range(0, len(same), step):
            at = same[a : a + step]
            rows, back = np.unique(np.concatenate([p[at], q[at]]), return_inverse=True)
            folded = np.stack([_counts(points[r]).reshape(g, -1).sum(axis=1) for r in rows.tolist()])
            out[at] = np.minimum(folded[back[: len(at)]], folded[back[len(at) :]]).sum(axis=1, dtype=np.int64)
    return out


def tree_pairs(token: int, n: np.ndarray, at: np.ndarray, comp: np.ndarray, points: list[bytes], head: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs of rows, one of left and one of right each, of different components that box and point bounds let pass, and their bounds.

    n: set sizes, at: the key's place in each set's hash order, head: the sets' first
    hashes; rows are sorted by n.  A pair that has an earlier hash in common is left to
    that key.
    """
    out = [(np.empty(0, np.int64),) * 3]
    small = min(COARSE, *(2 * len(x) for x in points))
    flat = np.stack([_counts(x).reshape(small, -1).sum(axis=1) for x in points])
    boxes = [(a, min(len(n), a + BOX)) for a in range(0, len(n), BOX)]
    tops = np.stack([flat[a:b].max(axis=0) for a, b in boxes])
    earlier = head.astype(np.uint64) < np.uint64(token % 2**64)
    for k, (a, b) in enumerate(boxes):
        hi = int(np.searchsorted(n, n[b - 1] * 5 // 4, side="right"))  # no longer set can link
        last = (hi - 1) // BOX + 1
        bound = np.minimum(tops[k], tops[k:last]).sum(axis=1)
        need = needed(n[a], n[[boxes[m][0] for m in range(k, last)]])
        ahead = k + np.flatnonzero(bound >= need)
        if not len(ahead):
            continue
        cols = np.concatenate([np.arange(boxes[m][0], min(boxes[m][1], hi)) for m in ahead.tolist()])
        p, q = np.repeat(np.arange(a, b), len(cols)), np.tile(cols, b - a)
        want = needed(n[p], n[q])
        ok = (p < q) & (comp[p] != comp[q]) & (5 * n[p] >= 4 * n[q]) & (n[p] - at[p] >= want) & (n[q] - at[q] >= want)
        ok &= (left[p] & right[q]) | (left[q] & right[p])
        p, q, want = p[ok], q[ok], want[ok]
        ok = np.minimum(flat[p], flat[q]).sum(axis=1) >= want
        p, q, want = p[ok], q[ok], want[ok]
        if len(p):
            first = ((head[p][:, :, None] == head[q][:, None, :]) & earlier[p][:, :, None]).any(axis=(1, 2))
            p, q, want = p[~first], q[~first], want[~first]
        if len(p):
            bound = _fine(points, p, q)
            ok = bound >= want
            out.append((p[ok], q[ok], bound[ok] * 1000 // want[ok]))
    return tuple(map(np.concatenate, zip(*out)))


def _forest(p: np.ndarray, q: np.ndarray, bound: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of pairs, the likeliest first, those that would unite components not united yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    keep = []
    for i in np.argsort(-bound, kind="stable").tolist():
        a, b = find(int(comp[p[i]])), find(int(comp[q[i]]))
        if a != b:
            root[a] = b
            keep.append(i)
    return np.array(keep, np.int64)


def _search(batches, forest: bool):
    """Rows in the order (token, i, j, n): the pairs that survive under each key.

    forest: a forest of them only, and (token, -1) for each key with more of them.
    """
    held: list[pa.RecordBatch] = []
    names = ["token", "i", "j", "n", "at", "id", "comp", "tile"]

    def work(rows: pa.Table):
        col = {c: np.asarray(rows.column(c).combine_chunks()) for c in names}
        points, heads = rows.column("point").combine_chunks(), rows.column("head").combine_chunks()
        key = np.stack([col["token"], col["i"].astype(np.int64), col["j"].astype(np.int64)])
        cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
        a_out, b_out = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            comp = col["comp"][a:b]
            if b - a < 2 or (comp == comp[0]).all():
                continue
            tile = col["tile"][a:b]
            vectors = points[a:b].to_pylist()
            head = np.zeros((b - a, HEAD), np.int64)
            for r, h in enumerate(heads[a:b].to_pylist()):
                head[r, : len(h) // 8] = np.frombuffer(h, np.int64)
                head[r, len(h) // 8 :] = -1 - r  # equal to no other
            x, y, bound = tree_pairs(int(col["token"][a]), col["n"][a:b], col["at"][a:b], comp, vectors, head, tile == col["i"][a], tile == col["j"][a])
            ids = col["id"][a:b]
            if forest and len(x):
                keep = _forest(x, y, bound, comp)
                if len(keep) < len(x):
                    a_out.append(col["token"][a : a + 1])
                    b_out.append(np.array([-1]))
                x, y = x[keep], y[keep]
            a_out.append(np.minimum(ids[x], ids[y]))
            b_out.append(np.maximum(ids[x], ids[y]))
        if a_out:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
        return None

    for batch in batches:
        if not batch.num_rows:
            continue
        # up to the last key of the batch, which may go on in the next
        key = [np.asarray(batch.column(c)) for c in ("token", "i", "j")]
        same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first == 0 and held:
            before = held[-1]
            goes_on = all(before.column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("token", "i", "j"))
            if not goes_on:
                out = work(pa.Table.from_batches(held))
                if out is not None:
                    yield out
                held = []
        if first:
            held.append(batch.slice(0, first))
            out = work(pa.Table.from_batches(held))
            if out is not None:
                yield out
            held = []
        held.append(batch.slice(first))
    if held:
        out = work(pa.Table.from_batches(held))
        if out is not None:
            yield out


def _passing(batches):
    """Of rows (a, b, na, nb, pa, pb) the pairs that pass the point bound."""
    for batch in batches:
        na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
        points = [p for c in ("pa", "pb") for p in batch.column(c).to_pylist()]
        at, m = [], len(na)
        for k in range(0, m, 2000):
            p = np.arange(k, min(m, k + 2000))
            at.append(p[_fine(points, p, p + m) >= needed(na[p], nb[p])])
        keep = pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


def _linked(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The links of a bucket that unite it: a pair whose sides are united already is not verified again."""
    release()
    ids = docs.column("id").to_pylist() if docs.num_rows else []
    texts = docs.column("text").cast(pa.binary()).to_pylist() if docs.num_rows else []
    sets: dict[int, np.ndarray] = {}
    for a in range(0, len(ids), 200):
        sets |= zip(ids[a : a + 200], shingle_sets([t or b"" for t in texts[a : a + 200]]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())) if pairs.num_rows else []:
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        x, y = sets[a], sets[b]
        both = len(x) + len(y) - len(np.union1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (u, v) among pairs (a, b) of ids, verified on the texts of docs (_q_uid, text), that unite what the pairs' links unite.  sizes: (id, n).

    Pairs are dealt to a grid of buckets by both ids.  An id of so many partners that they
    overfill its row of buckets has them salted over parts; sets of a pair are of like
    size, so its partners' shingles are about its own times their number.
    """
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs"))
    met = written(met.join(sizes.select("id", "n"), "id"), "partners")
    total = met.agg(F.count("*").alias("ids"), F.sum("n").alias("n")).first()
    side = max(2, int(np.ceil(max(total["ids"] / BUCKET_DOCS, (total["n"] or 0) / BUCKET_SHINGLES) ** 0.5)))
    parts = F.ceil(F.greatest(F.col("pairs") / BUCKET_DOCS, F.col("pairs") * F.col("n") / BUCKET_SHINGLES)).cast("int")
    hot = met.select("id", parts.alias("parts")).filter("parts > 1")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    dealt = pairs.withColumn("bucket", part("a") * side + part("b"))
    for own, other in ("ab", "ba"):
        salt = F.pmod(F.xxhash64(other, F.lit(1)), F.col("parts")).cast("int")
        dealt = dealt.join(hot.withColumnRenamed("id", own), own, "left").withColumn(f"salt_{own}", F.coalesce(salt, F.lit(0))).drop("parts")
    key = ["bucket", "salt_a", "salt_b"]
    need = dealt.select(*key, F.explode(F.array("a", "b")).alias("id")).distinct()
    place = [f"text_{k}" for k in key]  # names of their own: both sides come from the same pairs
    texts = need.join(docs.select(F.col(UID).alias("id"), "text"), "id").select(*(F.col(k).alias(p) for k, p in zip(key, place)), "id", "text")
    return texts.groupBy(*place).cogroup(dealt.select(*key, "a", "b").groupBy(*key)).applyInArrow(_linked, "u bigint, v bigint")


def near_classes(docs: DataFrame) -> DataFrame:
    """Per row of docs (_q_uid, doc_id, text): _q_uid, doc_id, n_shingles and root, the least _q_uid of its component."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = written(
        docs.select(UID, "doc_id", "text").mapInArrow(lambda it: released(_sketch(it)), f"{UID} bigint, doc_id {kind}, n bigint, key binary, point binary, head binary, prefix array<bigint>"), "sketches"
    )
    sets = sketch.filter("n > 0").groupBy("key").agg(F.min(UID).alias("id"), F.count("*").alias("m")).filter("m > 1").select("key", "id")
    copies = written(sketch.filter("n > 0").select("key", UID).join(sets, "key").select(UID, "id"), "copies")
    again = copies.filter(F.col(UID) != F.col("id")).select(UID)
    one = sketch.filter("n > 0").join(again, UID, "left_anti").withColumnRenamed(UID, "id")

    keys = one.select("id", "n", F.posexplode("prefix").alias("at", "token"))
    ends = keys.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("m")).filter("m > 1")
    shared = written(keys.join(ends, "token"), "keys")
    size = one.select("id", "n", "point")
    star = [shared.filter(F.col("id") != F.col(end)).select(F.least("id", end).alias("a"), F.greatest("id", end).alias("b")) for end in ("first", "last")]
    stars = star[0].unionByName(star[1]).distinct()
    for c in "ab":
        stars = stars.join(size.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}")), c)
    stars = stars.filter((5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na")))
    stars = written(stars.mapInArrow(lambda it: released(_passing(it)), "a bigint, b bigint"), "pairs")
    links = written(verified(stars, docs, size), "links")
    tested, payload, open_keys = stars, one.select("id", "point", "head"), None
    inner = shared.filter("m > 3 and id <> first and id <> last").select("token", "id", "n", "at")
    for forest in (True, False):
        roots = components(links).withColumnRenamed("u", "id")
        rest = inner if open_keys is None else inner.join(open_keys, "token", "left_semi")
        labelled = rest.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
        labelled = written(labelled.withColumn("step", F.floor(F.log("n") / F.lit(float(np.log(SIZE_STEP)))).cast("int")), "labelled")
        # a row matters if under its key, among the sizes that it can link with, there are several components
        around = (
            labelled.groupBy("token", "step")
            .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .select("token", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), "lo", "hi")
            .groupBy("token", "step")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter("lo < hi")
            .select("token", "step")
        )
        mixed = written(labelled.join(around, ["token", "step"], "left_semi").select("token", "id", "n", "at", "comp"), "mixed")
        drop_written(labelled)
        held = F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)
        tiles = mixed.groupBy("token").agg(F.ceil(held).cast("int").alias("tiles"))
        rows = (
            mixed.join(tiles, "token")
            .join(payload, "id")
            .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "n", "at", "id", "comp", "tile", "point", "head")
        )
        ordered = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n")
        found = written(ordered.mapInArrow(lambda it, f=forest: released(_search(it, f)), "a bigint, b bigint").distinct(), "found")
        open_keys = written(found.filter("b < 0").select(F.col("a").alias("token")), "open")
        more = written(found.filter("b >= 0").join(tested, ["a", "b"], "left_anti"), "pairs")
        links = written(links.unionByName(verified(more, docs, size)), "links")
        drop_written(mixed)
        drop_written(found)
        tested = tested.unionByName(more)
    drop_written(shared)
    final = components(links.unionByName(copies.filter(F.col(UID) != F.col("id")).select(F.col(UID).alias("u"), F.col("id").alias("v"))))
    return sketch.select(UID, "doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("u", UID), UID, "left").withColumn("root", F.coalesce("root", UID))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_uid(read_table(spark, sf_dir, "documents")).select(UID, "doc_id", "text")
    found = near_classes(docs)
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.k >= 80 * (na.n + nb.n - x.k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
