"""The searches over embeddings against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives, topk

SCHEMA = "vec_id long, embedding array<float>, label int, number string, score double"


def _rows(n=260, seed=7, hot=True):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.2), 3) for _ in range(6)], rng.randrange(4), "x", 0.5) for i in range(n)]
    if hot:  # a third are copies of one vector
        rows = [(i, rows[1][1] if i % 3 == 0 else v, lab, a, b) for i, v, lab, a, b in rows]
    return rows + [
        (n, None, 1, None, None), (n + 20, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1, None, None), (n + 40, [math.nan] * 6, 2, None, None), (n + 60, [math.inf] * 6, 2, None, None),
        (None, [0.3] * 6, 1, None, None), (n + 80, [0.4] * 6, None, None, None), (n + 100, [], 1, None, None), (n + 120, [0.7, -0.2], 3, None, None), (20, rows[5][1], 2, None, None),
    ]


def _whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def _dot(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def _read(df):
    """As Spark holds them: floats of 32 bits."""
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


def brute_top(rows, every, k, scale):
    rows = [(i, w) for i, v, _ in rows if i is not None and (w := _whole(v, scale)) is not None]
    out = []
    for i, q in rows:
        if i % every == 0:
            found = sorted((-_dot(q, w), j) for j, w in rows if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def brute_negatives(rows, every, positives, negatives):
    rows = [(i, w, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows if i is not None and lab is not None and (w := _whole(v, 256)) is not None]
    out = []
    for i, q, lab in rows:
        if i % every == 0:
            for s, p in sorted((-_dot(q, w), j) for j, w, o in rows if j != i and o == lab)[:positives]:
                found = sorted((-t, j) for j, w, o in rows if o != lab and 30 * -s <= 100 * (t := _dot(q, w)) <= 90 * -s)
                out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(found[:negatives], 1)]
    return sorted(out)


def _label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize(("chunk", "lists", "k"), [(1 << 20, 2, 20), (8 * 6 * 3, 3, 5), (1 << 20, 1, 400)])
def test_top_k_equals_brute_force(spark, chunk, lists, k):
    """Ties, a hot vector, nulls, repeated ids, short vectors and several chunks."""
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=k, lists=lists, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute_top(_read(df), 20, k, 64)


@pytest.mark.parametrize("chunk", [1 << 20, 8 * 6 * 2])
def test_hard_negatives_equal_brute_force(spark, chunk):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    got = hard_negatives.mine(df, _label(), F.col("vec_id") % 10 == 0, positives=5, negatives=10, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute_negatives(_read(df), 10, 5, 10)


def test_scores_beyond_doubles_are_whole(spark):
    """Components whose products pass 2^53, and 2^63, next to small ones."""
    rng = random.Random(3)
    size = [1.0, 3e5, 2e6, 1e12]
    rows = [(i, [rng.uniform(-1, 1) * size[i % 4] for _ in range(5)], i % 2, "x", 0.1) for i in range(60)] + [(100, [1e38] * 5, 0, "", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    read = [(i, v, lab) for i, v, lab in _read(df) if i != 100 and i % 4 != 3]
    small = df.where("vec_id <> 100 and vec_id % 4 <> 3")
    assert sorted(map(tuple, topk.search(small, F.col("vec_id") % 5 == 0, k=7).collect())) == brute_top(read, 5, 7, 64)
    assert sorted(map(tuple, hard_negatives.mine(small, _label(), F.col("vec_id") % 5 == 0).collect())) == brute_negatives(read, 5, 5, 10)
    assert {(r.rank, r.score) for r in topk.search(df, F.col("vec_id") == 100, k=3).collect()} >= {(1, 2**63 - 1)}


def test_searches_of_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.search(df, F.col("vec_id") % 20 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(0, [0.5, 0.5], 1, "", 0.0)], SCHEMA)
    assert topk.search(alone, F.col("vec_id") % 20 == 0).collect() == []
    assert hard_negatives.mine(alone, F.col("label"), F.col("vec_id") % 100 == 0).collect() == []
