"""Hard negatives against brute force: ties, copies, nulls, sizes, wide numbers and many tiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docproof.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, anchor string, block int"


def brute(rows, asks, positives=5, most=10, low=30, high=90):
    fit = [(i, [min(max(math.floor(256 * x), -(2**62)), 2**62) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, v, lab) in enumerate(fit):
        if not asks(i):
            continue
        near = [(-dot(v, w), j, m == lab) for n, (j, w, m) in enumerate(fit) if n != k and len(w) == len(v)]
        for p, pid in sorted((s, j) for s, j, same in near if same)[:positives]:
            found = sorted((s, j) for s, j, same in near if not same and low * -p <= 100 * -s <= high * -p)[:most]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=400):
    r = random.Random(seed)
    axes = [[r.gauss(0, 0.2) for _ in range(20)] for _ in range(6)]
    rows = []
    for i in range(n):
        a = r.choice(axes)
        rows.append((i, [round(x + r.gauss(0, 0.1), 2) for x in a], r.randint(0, 3)))
    rows += [(1000 + i, list(rows[0][1]), i % 4) for i in range(60)]  # a large group of copies: ties
    rows += [rows[50], rows[50], (None, rows[1][1], 1), (7, None, 1), (8, [1.0] * 20, None), (9, [None] * 20, 1), (11, [float("nan")] * 20, 1), (12, [float("inf")] + [0.0] * 19, 1)]
    rows += [(50, [], 0), (51, [], 0), (52, [], 1), (100, [0.0] * 20, 0), (150, [1.0, 2.0, 3.0], 0), (53, [1.0, 2.0, 2.5], 0), (54, [0.5, 1.0, 1.0], 1), (55, [-9.0] * 3, 1)]
    rows += [(2000, [1e6] * 9, 0), (2001, [2e6] * 9, 0), (2002, [7e5] * 9, 1), (2003, [-1e6] * 9, 1)]
    return rows


@pytest.mark.parametrize("small", [{}, {"block": 40, "blocks": 2, "anchors": 3}])
def test_hard_negatives_match_brute_force(spark, small):
    rows = rows_of(5)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(7)
    got = negatives.hard_negatives(df, lambda ids: ids % 50 == 0, **small)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 50 == 0)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, lambda ids: ids % 2 == 0).count() == 0
    df = spark.createDataFrame([(1, [0.5, 0.25], 1), (3, [0.5, 0.25], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, lambda ids: ids % 2 == 0).count() == 0


def test_label_expression_and_limits(spark):
    rows = [(i, [0.1 * (i + 1), 0.3], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(df, lambda ids: ids % 10 == 0, (F.col("label") + 1) % 3, positives=2, negatives=3, low=10, high=95).collect()
    assert sorted(tuple(r) for r in got) == brute([(i, v, (lab + 1) % 3) for i, v, lab in rows], lambda i: i % 10 == 0, 2, 3, 10, 95)


@pytest.mark.parametrize("far", [1, 200, 2**20, 2**40])
@pytest.mark.parametrize("size", [1, 8, 13])
def test_lookups_give_inner_products(far, size):
    g = np.random.default_rng(far + size)
    a, c = g.integers(-far, far + 1, (5, size)), g.integers(-far, far + 1, (37, size))
    planes = negatives.bit_planes(c)
    assert (negatives.from_planes(planes, size) == c).all()
    with np.errstate(over="ignore"):
        assert (negatives.scores(negatives.subset_sums(a), planes) == c @ a.T).all()
