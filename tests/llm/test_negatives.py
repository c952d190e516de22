"""Hard negatives against all pairs in plain Python, and the tree against all its rows."""

import math
import random

import numpy as np
import pytest

from solera.llm import negatives as ng
from solera.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, row string, v int, rank string"


def brute(rows, every=100):
    valid = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (i, label, q) in enumerate(valid):
        if i % every:
            continue
        score = lambda v: sum(x * y for x, y in zip(q, v))
        pos = sorted((-score(v), j) for m, (j, lab, v) in enumerate(valid) if m != n and lab == label)[:5]
        neg = sorted((-score(v), j) for j, lab, v in valid if lab != label)
        for p, j in pos:
            found = [(s, x) for s, x in neg if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, r, x, -p, -s) for r, (s, x) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def test_query_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, SF001).collect())) == want
    # many trees, groups and blocks of anchors
    few = ng.hard_negatives(spark.read.parquet(f"{SF001}/embeddings.parquet"), tree_rows=60, anchors_at_once=2)
    assert sorted(map(tuple, few.collect())) == want


def test_odd_rows_ties_and_empty_tables(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice((-0.25, 0.0, 0.25, 0.5)) for _ in range(3)], rng.choice((0, 1, -3))) for k in range(400)]
    rows += [(k, [0.5, 0.5, 0.5], 1) for k in range(400, 520)]  # a frequent vector
    rows += [(600, [0.5, 0.5, 0.5], 2), (600, [0.5, 0.5, 0.5], 2), (700, [1.0], 1), (701, [], 1), (800, None, 1), (900, [1.0, None], 1), (1000, [math.nan], 1), (1100, [math.inf], 1),
             (1200, [0.5], None), (None, [0.5], 1), (1300, [-0.001, -1.5, 7.25], 9), (1400, [], 0)]
    for tree_rows in (40, 8192):
        assert sorted(map(tuple, ng.hard_negatives(frame(spark, rows), tree_rows=tree_rows).collect())) == brute(rows)
    assert ng.hard_negatives(frame(spark, rows).filter("false")).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(8)
    rows = [(50 * k, [rng.choice((1e6, 1e6 + 1 / 256, 3.0, -1e5)) for _ in range(3)], k % 2) for k in range(60)]
    want = brute(rows)
    assert max(abs(r[4]) for r in want) > 1 << 53
    assert sorted(map(tuple, ng.hard_negatives(frame(spark, rows), tree_rows=20).collect())) == want
    with pytest.raises(Exception, match="too big|too large|out of range"):  # beyond 64 bits
        ng.hard_negatives(frame(spark, [(k, [1e9 * (k + 1)], k % 2) for k in range(9)])).collect()


@pytest.mark.parametrize("dim", [1, 2, 7])
def test_tree_against_all_rows(dim):
    rng = np.random.default_rng(dim)
    for n in (1, 5, 300):
        x = rng.integers(-9, 9, (n, dim)).astype(float)
        order = ng.str_order(x, 4)
        assert sorted(order.tolist()) == list(range(n))
        tree, ids = ng.Tree(x[order], 4, 3), rng.permutation(n)
        for lo, hi in (tree.boxes[0],):
            assert all((lo[k] <= x[order][4 * k:4 * k + 4]).all() and (x[order][4 * k:4 * k + 4] <= hi[k]).all() for k in range(len(lo)))
        for _ in range(20):
            q = rng.integers(-9, 9, dim).astype(float)
            low, high = np.sort(rng.integers(-99, 99, (2, 3)), axis=0).astype(float)
            scores = x[order] @ q
            for w, found in enumerate(tree.search(q, low, high, ids, 5)):
                want = sorted((-s, i) for s, i in zip(scores, ids) if low[w] <= s <= high[w])[:5]
                assert [(-s, ids[r]) for s, r in found] == want


def test_boxes_are_left_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (256, 4)).round() for c in (-60, 0, 60)])
    tree = ng.Tree(x[ng.str_order(x, 16)], 16, 4)
    opened, plain = [], tree.x
    tree.x = type("Rows", (), {"__getitem__": lambda self, s: opened.append(s) or plain[s]})()
    tree.search(np.ones(4), np.array([200.0]), np.array([300.0]), np.arange(len(x)), 5)
    assert 0 < len(opened) < 20 < len(tree.boxes[0][0])
