"""Hard-negative mining over STR-packed R-trees (operator 13).

Vectors are integers (floor of 256 times each component); a row's score is its inner product with
the anchor.  An anchor's positives are its best ``positives`` other rows of its label; for each of
them the best ``negatives`` rows of other labels whose score lies in the positive's window (80 to
100 per cent of its score) are mined.

* *Trees*: the rows are ranged by label and first components (their hash splits equal ones), about
  ``TREE_ROWS`` to a task.  Each task packs the rows of a label sort-tile-recursively: slabs along
  the coordinate that varies most, each cut along the next one, down to leaves of ``LEAF`` rows;
  ``FANOUT`` neighbouring boxes make the box above.  The trees are written once.
* *Intervals*: a box (lo, hi) bounds each coordinate's product with the anchor, by q * lo and
  q * hi in the order of q's sign; summed, an interval for the scores inside.
* *Best first*: a queue holds boxes by their upper bound.  A box is left out if its interval misses
  every window, or lies strictly below the kth score of each window that it meets (equal ones are
  opened: ties go by id).
* Anchors, the stated query set, go against all trees in blocks: groups of at most ``ANCHORS``
  rows and ``BROADCAST_BYTES``, a broadcast each.  For the positives the join is on the label, for the negatives
  every tree of another label is searched.  Each tree returns its few best, and the best of all
  trees are ranked.

Defined cases: rows with a null id, label or vector, or a component that is null or not finite,
take no part (a null id is no multiple of 7 or 100 and cannot be ranked); a shorter vector counts
as filled up with zeros; rows with equal ids are rows of their own, each an anchor's "other" row;
a negative positive score has an empty window; products beyond 64 bits raise an error; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solera.llm.common import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: The window of a negative's score, in per cent of the positive's.
LEAST, MOST = 80, 100
#: Rows of a task's trees, on average; rows of a leaf; boxes in a box.
TREE_ROWS = 8192
LEAF = 64
FANOUT = 8
#: Anchors that are broadcast at a time, and that are searched together.
ANCHORS = 16384
BROADCAST_BYTES = 64 << 20
BLOCK = 512
#: Up to here sums of doubles without a fraction are exact.
EXACT = 1 << 53


# ---------------------------------------------------------------- the tree
def str_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows of x in sort-tile-recursive order: coordinates by falling variance, at each one
    slabs of whole leaves."""
    if not x.shape[1]:
        return np.arange(len(x))
    coords = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or depth >= len(coords):
            return [rows]
        rows = rows[np.argsort(x[rows, coords[depth]], kind="stable")]
        left = max(1, round(np.log2(pages) / 2))  # coordinates still to cut: slabs of about four
        slabs = max(2, round(pages ** (1 / left)))
        size = -(-pages // slabs) * leaf
        return [y for at in range(0, len(rows), size) for y in tile(rows[at:at + size], depth + 1)]

    return np.concatenate(tile(np.arange(len(x)), 0)) if len(x) else np.arange(0)


class Tree:
    """Packed rows and the boxes over them, level by level; level 0 are the leaves."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.x, self.leaf, self.fanout = x, leaf, fanout
        starts = np.arange(0, len(x), leaf)
        lo, hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        self.boxes = [(lo, hi)]
        while len(lo) > 1:
            starts = np.arange(0, len(lo), fanout)
            lo, hi = np.minimum.reduceat(lo, starts, axis=0), np.maximum.reduceat(hi, starts, axis=0)
            self.boxes.append((lo, hi))

    def intervals(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the least and the highest score that anchors (rows of q) can have with
        a row inside each box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return [(up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T) for lo, hi in self.boxes]

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int, skip=None,
               bounds: list[tuple[np.ndarray, np.ndarray]] | None = None, row: int = 0) -> list[list[tuple]]:
        """For one anchor and each window [low, high], the k best (score, row): higher scores
        first, then smaller ids.  ``skip``: a row that is the anchor itself."""
        bounds = self.intervals(q[None]) if bounds is None else bounds
        best: list[list[tuple]] = [[] for _ in low]  # heaps of (score, -id, row), the worst first
        floor = low.copy()  # below it nothing can come in any more

        def wanted(least, most) -> bool:
            return bool(((most >= floor) & (least <= high)).any())

        top = len(self.boxes) - 1
        queue = [(-bounds[top][1][row][0], top, 0)] if wanted(bounds[top][0][row][0], bounds[top][1][row][0]) else []
        while queue:
            most, level, box = heapq.heappop(queue)
            if not wanted(bounds[level][0][row][box], -most):
                continue
            if level:
                at = box * self.fanout
                least, upper = (b[row][at:at + self.fanout] for b in bounds[level - 1])
                meets = ((upper[:, None] >= floor) & (least[:, None] <= high)).any(axis=1)
                for n in np.flatnonzero(meets).tolist():
                    heapq.heappush(queue, (-upper[n], level - 1, at + n))
                continue
            at = box * self.leaf
            scores = self.x[at:at + self.leaf] @ q
            for w in np.flatnonzero(((scores[:, None] >= floor) & (scores[:, None] <= high)).any(axis=0)).tolist():
                for n in np.flatnonzero((scores >= floor[w]) & (scores <= high[w])).tolist():
                    if at + n == skip:
                        continue
                    entry = (scores[n], -int(ids[at + n]), at + n)
                    if len(best[w]) < k:
                        heapq.heappush(best[w], entry)
                    elif entry > best[w][0]:
                        heapq.heapreplace(best[w], entry)
                if len(best[w]) == k:
                    floor[w] = max(floor[w], best[w][0][0])
        return [[(s, r) for s, _, r in sorted(b, key=lambda e: (-e[0], -e[1]))] for b in best]


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where their inner products are exact in them, else as Python's integers."""
    most = [max((abs(int(x)) for x in (y.min(), y.max())), default=0) if y.size else 0 for y in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < EXACT:
        return a, b
    return tuple(np.array([[int(x) for x in r] for r in y.tolist()], object).reshape(y.shape) for y in (a, b))


def _widened(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


# ---------------------------------------------------------------- Spark
def valid_rows(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with vectors of whole numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.col("label").cast("long")
    # floor of the double itself: as a long it would not hold every whole double
    whole = lambda x: (x.cast("double") * scale) - F.pmod(x.cast("double") * scale, F.lit(1.0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label).alias("label"),
                       F.transform("embedding", whole).alias("v"))


_TREE = "label long, bag long, n int, rows binary, ids binary, x binary"


def trees(rows: DataFrame, tree_rows: int = TREE_ROWS, leaf: int = LEAF) -> DataFrame:
    """One row per task and label: the rows' numbers, ids and vectors in packed order."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        labels, ids, numbers = (t[c].to_numpy() for c in ("label", "vec_id", "row"))
        v = t["v"].combine_chunks()
        flat, ends = v.flatten().to_numpy(), np.cumsum(v.value_lengths().to_numpy())
        starts = np.concatenate(([0], ends[:-1]))
        dim = int((ends - starts).max(initial=0))
        x = np.zeros((len(ids), dim))
        x[np.arange(dim) < (ends - starts)[:, None]] = flat
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            for at in range(0, len(own), 2 * tree_rows):  # a task may get more than its share
                part = own[at:at + 2 * tree_rows]
                part = part[str_order(x[part], leaf)]
                yield pa.RecordBatch.from_pydict({"label": [int(label)], "bag": [0], "n": pa.array([len(part)], pa.int32()),
                                                  "rows": [numbers[part].astype(np.int64).tobytes()], "ids": [ids[part].astype(np.int64).tobytes()], "x": [x[part].tobytes()]})

    n = max(1, -(-rows.count() // tree_rows))
    first = [F.get("v", F.lit(k)) for k in range(2)]
    return rows.repartitionByRange(n, "label", *first, F.xxhash64("vec_id", "row")).mapInArrow(pack, _TREE)


def _blocks(anchors: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """Anchors (row, label, v, windows) as blocks of matrices, each of one value of ``by``."""
    kind = pa.schema([("by", pa.int64()), ("m", pa.int32()), ("q_rows", pa.binary()), ("q_labels", pa.binary()), ("q", pa.binary()),
                      ("windows", pa.list_(pa.list_(pa.list_(pa.int64()))))])

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        out = []
        for at in range(0, len(t), block):
            part = t.slice(at, block)
            v = part["v"].to_pylist()
            dim = max(map(len, v))
            out.append({"by": key[0].as_py(), "m": len(part), "q_rows": part["row"].to_numpy().astype(np.int64).tobytes(),
                        "q_labels": part["label"].to_numpy().astype(np.int64).tobytes(), "windows": part["windows"].to_pylist(),
                        "q": np.array([r + [0.0] * (dim - len(r)) for r in v], np.float64).reshape(len(v), dim).tobytes()})
        return pa.Table.from_pylist(out, schema=kind)

    packed = anchors.groupBy(by).applyInArrow(pack, "by long, m int, q_rows binary, q_labels binary, q binary, windows array<array<array<bigint>>>")
    return packed.withColumnRenamed("by", by)


def _searched(met: DataFrame, k: int, same: bool, least: int, most: int) -> DataFrame:
    """(anchor, window, score, vec_id): each tree's best for each of its blocks' anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(one(r), schema=pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())]))

    def one(r: dict) -> dict:
        q, x = _matrix(r["q"], r["m"]), _matrix(r["x"], r["n"])
        dim = max(q.shape[1], x.shape[1])
        q, x = _exact(_widened(q, dim), _widened(x, dim))
        ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
        place = dict(zip(rows.tolist(), range(len(rows)), strict=True)) if same else {}
        labels, numbers = np.frombuffer(r["q_labels"], np.int64), np.frombuffer(r["q_rows"], np.int64)
        tree, out = Tree(x), {"anchor": [], "window": [], "score": [], "vec_id": []}
        bounds = tree.intervals(q)
        for at, (number, label, windows) in enumerate(zip(numbers.tolist(), labels.tolist(), r["windows"], strict=True)):
            if not same and label == r["label"]:
                continue
            if same:
                low, high = np.array([-np.inf]), np.array([np.inf])
            else:  # least * positive <= 100 * score <= most * positive, in whole numbers
                low = np.array([-(-least * p // 100) for _, p in windows], x.dtype)
                high = np.array([most * p // 100 for _, p in windows], x.dtype)
            for w, found in enumerate(tree.search(q[at], low, high, ids, k, place.get(number), bounds, at)):
                for score, n in found:
                    out["anchor"].append(number)
                    out["window"].append(0 if same else windows[w][0])
                    out["score"].append(int(score))
                    out["vec_id"].append(int(ids[n]))
        return out

    return met.mapInArrow(run, "anchor long, window long, score long, vec_id long")


def _meet(packed: DataFrame, blocks: DataFrame, on: str) -> DataFrame:
    return (packed.join(F.broadcast(blocks), on)
            .select("label", "n", "rows", "ids", "x", "m", "q_rows", "q_labels", "q", "windows"))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    first = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
                   tree_rows: int = TREE_ROWS, anchors_at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors:
    the rows of ``embeddings`` (vec_id, embedding, label) whose id is a multiple of ``every``."""
    # the numbers hold once they are written
    rows = written(valid_rows(embeddings).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    packed = written(trees(rows, tree_rows), "negatives-trees")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    found = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    groups = max(1, -(-found["n"] // max(1, min(anchors_at_once, BROADCAST_BYTES // (8 * (found["dim"] or 1))))))
    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    none = F.array().cast("array<array<bigint>>")
    out = None
    for g in range(groups):  # a bounded number of anchors at a time
        own = anchors.filter(group == g)
        pos = _searched(_meet(packed, _blocks(own.withColumn("windows", none), "label"), "label"), positives, True, least, most)
        pos = written(_best(pos, ["anchor"], positives).select("anchor", "rank", "score", "vec_id"), "negatives-positives")
        windows = pos.groupBy("anchor").agg(F.sort_array(F.collect_list(F.array(F.col("rank").cast("long"), "score"))).alias("windows"))
        asked = own.join(windows, own["row"] == windows["anchor"]).drop("anchor").withColumn("bag", F.lit(0).cast("long"))
        neg = _best(_searched(_meet(packed, _blocks(asked, "bag"), "bag"), negatives, False, least, most), ["anchor", "window"], negatives)
        pos = pos.select(F.col("anchor").alias("row"), F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        done = (neg.withColumnRenamed("anchor", "row").join(pos, ["row", "window"]).join(own.select("row", F.col("vec_id").alias("anchor_id")), "row")
                .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        done = written(done, "negatives-found")
        out = done if out is None else out.unionByName(done)
    return out


#: DuckDB: every pair of an anchor and a row, ranked.
SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN ((label::BIGINT + 1) % 10 + 10) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
