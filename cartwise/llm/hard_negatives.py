"""Hard negatives by inner product, searched in cover trees.

Candidates are dealt at random to blocks of some thousands; a block is a cover
tree over its vectors augmented by one component that gives all of them the same
norm, so that the inner product with a query falls as the distance to it grows.
A node's covering radius then bounds the inner products below it from both sides.
Anchors visit every block, in packs.  A search descends the node with the highest
bound first, skips nodes that lie outside the window of scores asked for, and
verifies points by their exact integer product.  Each block returns a few rows for
an anchor; windows over those keep the first ones of all blocks.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bound, discard, ship_package, table, written

SCALE = 256                     # components are compared as floor(SCALE * x)
BLOCK_ROWS = 4096
PACK_ROWS = 256
PACKS_A_TASK = 64
LEAF = 24
ANCHORS_EVERY = 100
FIRST = 5
LOW, HIGH = 80, 100             # percent of the positive's score


class CoverTree:
    """Cover tree of one block.  Nodes are numbered so that a node's children
    follow each other; each node is a point, and has children, a bucket of
    points, or neither."""

    FIELDS = ("vecs", "ids", "known", "labels", "point", "radius", "first", "count",
              "bucket_at", "bucket_n", "bucket", "fresh")

    @classmethod
    def build(cls, vecs: np.ndarray, ids: np.ndarray, known: np.ndarray,
              labels: np.ndarray) -> CoverTree:
        self = cls()
        self.vecs, self.ids, self.known, self.labels = vecs, ids, known, labels
        norms = np.einsum("ij,ij->i", vecs, vecs)
        extra = np.sqrt(norms.max() - norms)        # gives all points one norm
        point, radius, first, count = [0], [], [0], [0]
        at, size, fresh, bucket = [0], [0], [True], []
        rest = np.arange(1, len(vecs))
        waiting = [(0, rest, cls._distances(vecs, norms, extra, rest, 0))]
        node = 0
        while node < len(waiting):
            _, members, far = waiting[node]
            waiting[node] = None
            r = float(far.max(initial=0))
            radius.append(r)
            if len(members) <= LEAF or r == 0:
                at[node], size[node] = len(bucket), len(members)
                bucket.extend(members.tolist())
                node += 1
                continue
            first[node] = len(waiting)
            near = far <= r / 2
            groups = [(point[node], members[near], far[near], False)] if near.any() else []
            members = members[~near]
            x, nx, ex = vecs[members], norms[members], extra[members]
            while len(members):
                c = members[0]
                members, x, nx, ex = members[1:], x[1:], nx[1:], ex[1:]
                d = np.sqrt(np.maximum(nx + norms[c] - 2 * (x @ vecs[c]), 0)
                            + (ex - extra[c]) ** 2)
                near = d <= r / 2
                groups.append((c, members[near], d[near], True))
                if near.any():
                    members, x, nx, ex = (v[~near] for v in (members, x, nx, ex))
            for c, below, d, new in groups:
                waiting.append((len(waiting), below, d))
                point.append(int(c))
                fresh.append(new)
                for a in (first, count, at, size):
                    a.append(0)
            count[node] = len(groups)
            node += 1
        whole = lambda a: np.array(a, np.int64)
        self.point, self.radius, self.first, self.count = (
            whole(point), np.array(radius), whole(first), whole(count))
        self.bucket_at, self.bucket_n, self.bucket = whole(at), whole(size), whole(bucket)
        self.fresh = np.array(fresh, bool)
        return self._ready()

    @staticmethod
    def _distances(vecs, norms, extra, rows, c) -> np.ndarray:
        return np.sqrt(np.maximum(norms[rows] + norms[c] - 2 * (vecs[rows] @ vecs[c]), 0)
                       + (extra[rows] - extra[c]) ** 2)

    def _ready(self) -> CoverTree:
        self.centers = self.vecs[self.point]
        self.deep = (self.count > 0) | (self.bucket_n > 0)
        self.top = float(np.einsum("ij,ij->i", self.vecs, self.vecs).max())
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        self = cls()
        with np.load(io.BytesIO(data)) as z:
            for f in cls.FIELDS:
                setattr(self, f, z[f])
        return self._ready()

    def search(self, q: np.ndarray, own: int, label: int, same: bool, k: int,
               windows: list[tuple[float, float]]) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score) the first k of the points in it
        that have (``same``) or have not the query's label, without those of the
        query's own id: (score, point), by score, then id, unknown ids last."""
        total = float(q @ q) + self.top         # of both squared norms
        slack = 0.01 + 1e-9 * total             # what rounding may take from a bound
        seen: dict[int, tuple] = {}

        def fits(points, scores):
            ok = (self.labels[points] == label) == same
            ok &= (self.ids[points] != own) | ~self.known[points]
            return points[ok], scores[ok]

        def opened(node):
            """(points and their scores, nodes below, their upper and lower bounds)"""
            if node in seen:
                return seen[node]
            if node >= 0 and not self.count[node]:
                a = self.bucket_at[node]
                points = self.bucket[a:a + self.bucket_n[node]]
                none = np.zeros(0)
                out = *fits(points, self.vecs[points] @ q), none, none, none
            else:
                a, n = (self.first[node], self.count[node]) if node >= 0 else (0, 1)
                part = slice(a, a + n)
                s = self.centers[part] @ q
                new, deep = self.fresh[part], self.deep[part]
                d = np.sqrt(np.maximum(total - 2 * s[deep], 0))
                r = self.radius[part][deep]
                out = (*fits(self.point[part][new], s[new]), a + np.flatnonzero(deep),
                       (total - np.maximum(d - r, 0) ** 2) / 2 + slack,
                       (total - (d + r) ** 2) / 2 - slack)
            seen[node] = out
            return out

        results = []
        for least, greatest in windows:
            best: list[tuple] = []
            heap = [(-np.inf, -1)] if least <= greatest else []
            while heap:
                bound, node = heapq.heappop(heap)
                floor = -best[-1][0] if len(best) == k else least
                if -bound < floor:
                    break
                points, s, below, high, low = opened(node)
                x = np.flatnonzero((s >= floor) & (s <= greatest))
                if len(x) > k:
                    p = points[x]
                    x = x[np.lexsort((self.ids[p], ~self.known[p], -s[x]))[:k]]
                for i in x:
                    p = points[i]
                    best.append((-s[i], not self.known[p], self.ids[p], p))
                if len(x):
                    best = sorted(best)[:k]
                    floor = -best[-1][0] if len(best) == k else least
                for i in np.flatnonzero((high >= floor) & (low <= greatest)):
                    heapq.heappush(heap, (-high[i], int(below[i])))
            results.append([(int(-b[0]), int(b[3])) for b in best])
        return results


def packed(column, dims: int) -> np.ndarray:
    """A list column as a matrix; a shorter list counts as padded with zeros."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    n, sizes = len(column), np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((n, dims))
    out[np.repeat(np.arange(n), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integer_rows(df: DataFrame, id_col: str, label_col: str, vec_col: str,
                 anchors: Column) -> DataFrame:
    """row (a number of the row), id, label, vec (integers as doubles), anchor,
    salt; without the rows that take no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.transform(df[vec_col], lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    return (df.where(df[label_col].isNotNull() & df[vec_col].isNotNull()
                     & ~F.exists(df[vec_col], bad))
            .select(F.monotonically_increasing_id().alias("row"),
                    df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"),
                    vec.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                    F.rand(13).alias("salt")))


def cover_trees(rows: DataFrame, blocks: int, dims: int) -> DataFrame:
    """block, tree: one cover tree a block, as bytes."""
    def build(part):
        import pyarrow as pa

        ids = part.column("id")
        known = np.asarray(ids.is_valid().to_numpy())
        tree = CoverTree.build(packed(part.column("vec"), dims),
                               ids.fill_null(np.iinfo(np.int64).max).to_numpy(), known,
                               part.column("label").to_numpy())
        return pa.table({"block": part.column("block").slice(0, 1), "tree": [tree.dump()]})

    block = F.floor(F.col("salt") * blocks).cast("int")
    return (rows.select(block.alias("block"), "id", "label", "vec")
            .groupBy("block").applyInArrow(build, "block int, tree binary"))


def visits(trees: DataFrame, queries: DataFrame, blocks: int, n_queries: int) -> DataFrame:
    """pack, items, tree: every pack of queries with every block's tree.  A block
    meets PACKS_A_TASK packs under one key, so no key grows with the queries."""
    packs = max(1, -(-n_queries // PACK_ROWS))
    columns = [c for c in queries.columns if c != "salt"]
    dealt = (queries.withColumn("pack", F.floor(F.col("salt") * packs).cast("int"))
             .groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias("items"))
             .withColumn("share", F.floor(F.col("pack") / PACKS_A_TASK).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    shares = F.sequence(F.lit(0), F.lit((packs - 1) // PACKS_A_TASK))
    return dealt.join(trees.withColumn("share", F.explode(shares)).hint("shuffle_merge"),
                      ["block", "share"]).select("items", "tree")


def searched(pairs: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """row (of the query), window (its number), id, score: each tree's first k."""
    def search(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                tree = CoverTree.load(b.column("tree")[r].as_py())
                items = b.column("items")[r].values
                vecs = packed(items.field("vec"), dims)
                own = items.field("id").fill_null(np.iinfo(np.int64).max).to_numpy(
                    zero_copy_only=False)
                labels, names = (items.field(c).to_numpy() for c in ("label", "row"))
                found = []
                for i, windows in enumerate(items.field("windows").to_pylist()):
                    spans = [(w["low"], w["high"]) for w in windows] if not same else [
                        (-np.inf, np.inf)]
                    for w, hits in enumerate(tree.search(vecs[i], own[i], labels[i], same, k, spans)):
                        found += [(names[i], w, p, s) for s, p in hits]
                rows, nums, points, scores = (np.array(x, np.int64) for x in zip(*found)) \
                    if found else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(rows), "window": pa.array(nums, pa.int32()),
                    "id": pa.array(tree.ids[points], mask=~tree.known[points]),
                    "score": pa.array(scores)})

    return pairs.mapInArrow(search, "row long, window int, id long, score long")


def mine_hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id",
                        label_col: str = "label", vec_col: str = "embedding",
                        positives: int = FIRST, negatives: int = FIRST, low: int = LOW,
                        high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each anchor row and each of its ``positives`` first other rows of its
    label, the ``negatives`` first rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's.

    Components count as floor(256 x), a score is their integer product (exact up
    to 2**53); higher scores come first, ties by smaller id, unknown ids last.
    Rows with a null label, vector or component, or one that isn't finite, take no
    part.  A row with the anchor's own id is not another row.  Rows stand for
    themselves, also repeated ones and those without an id; an anchor row that
    repeats is answered each time.  A shorter vector counts as padded with zeros.
    An anchor without a positive, and a positive without a row in its window
    (such as every negative score), give no row.  Labels are integers.

    Every anchor meets every block, in packs: work grows with anchors x rows, as
    the exact answer over all rows asks for, and a task holds one pack and one tree.
    """
    spark = df.sparkSession
    ship_package(spark)
    arrow_bound(spark)
    rows = written(spark, integer_rows(df, id_col, label_col, vec_col, anchors), "vectors")
    n, n_anchors, dims = rows.agg(
        F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks, dims = max(1, -(-n // BLOCK_ROWS)), max(1, dims)
    trees = written(spark, cover_trees(rows, blocks, dims), "cover-trees")
    queries = rows.where("anchor").select("row", "id", "label", "vec", "salt")

    whole = queries.withColumn("windows", F.expr(
        "cast(array() as array<struct<low:double,high:double>>)"))
    near = searched(visits(trees, whole, blocks, n_anchors), dims, positives, True)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = (near.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
             .where(F.col("k") <= positives))
    first = written(spark, first.select("row", "k", "id", "score"), "positives")

    span = F.struct(F.col("k"), F.ceil(low * F.col("score") / 100).cast("double").alias("low"),
                    F.floor(high * F.col("score") / 100).cast("double").alias("high"))
    asked = first.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("windows"))
    around = searched(visits(trees, queries.join(asked, "row"), blocks, n_anchors),
                      dims, negatives, False)
    # window i of a row is its positive k = i + 1
    place = Window.partitionBy("row", "window").orderBy(*order)
    found = (around.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
             .select("row", (F.col("window") + 1).alias("k"), "rank",
                     F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    found = written(spark, found, "negatives")
    out = (found.join(first.select("row", "k", F.col("id").alias("positive_id"),
                                   F.col("score").alias("positive_score")), ["row", "k"])
           .join(queries.select("row", F.col("id").alias("anchor_id")), "row")
           .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                   "negative_score"))
    discard(spark, trees)
    return out


def check_query(spark, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; where an id is divisible by 7 the label
    moves on by one of ten."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine_hard_negatives(rows, rows["vec_id"] % ANCHORS_EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.vec, b.vec),
             lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id
  WHERE a.vec_id % {ANCHORS_EVERY} = 0),
p AS (
  SELECT r, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS k
  FROM s WHERE same QUALIFY k <= {FIRST}),
n AS (
  SELECT s.anchor_id, p.positive_id,
         row_number() OVER (PARTITION BY p.r, p.k
                            ORDER BY s.score DESC, s.id NULLS LAST)::INT AS rank,
         s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT s.same
    AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
  QUALIFY rank <= {FIRST})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n
"""
