"""Joins by bins and by occurrence, and walks through nested JSON, where the tables don't show them."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import nested, receipts, scan


def test_points_meet_intervals_of_any_width(spark):
    r = random.Random(4)
    lengths = [0, 1, 2, 3, 7, 8, 100, 5000, 10**6, -1]
    intervals = [(i, r.randrange(3), s, s + r.choice(lengths)) for i, s in enumerate(r.randrange(-2000, 6000) for _ in range(400))]
    points = [(i, r.randrange(3), r.randrange(-2500, 8000)) for i in range(400)] + [(1000, None, 5), (1001, 0, None)]
    got = scan.at_intervals(spark.createDataFrame(points, "point long, account long, block long"), spark.createDataFrame(intervals, "id long, account long, first long, last long"), "account", "block", "first", "last")
    want = sorted((p, i) for p, a, b in points if None not in (a, b) for i, c, s, e in intervals if a == c and s <= b <= e)
    assert sorted((x.point, x.id) for x in got.collect()) == want
    none = scan.at_intervals(spark.createDataFrame(points, "point long, account long, block long"), spark.createDataFrame([], "id long, account long, first long, last long"), "account", "block", "first", "last")
    assert none.count() == 0 and {"point", "id", "first"} <= set(none.columns)


def test_a_hot_account_of_many_intervals_and_events(spark):
    """10^5 intervals of ten blocks and 10^5 events of one account, and a long interval: pairs in proportion to matches."""
    n = 100_000
    intervals = spark.range(n).select(F.lit(7).alias("account"), F.col("id").alias("interval_id"), (F.col("id") * 10).alias("first"), (F.col("id") * 10 + 9).alias("last")).union(spark.sql(f"select 7, {n}, 0, {n * 20}"))
    events = spark.range(n).select(F.lit(7).alias("account"), F.col("id").alias("event"), (F.col("id") * 10 + 3).alias("block"))
    met = scan.at_intervals(events, intervals, "account", "block", "first", "last")
    counts = dict(met.groupBy((F.col("interval_id") == n).alias("long")).count().collect())
    assert counts == {False: n, True: n}


def test_pairs_one_to_one(spark):
    r = random.Random(9)
    left = [(i, r.choice("aaaab"), r.randrange(2)) for i in range(500)]
    right = [(i, r.choice("aaabc"), r.randrange(2)) for i in range(450)]
    got = receipts.paired(spark.createDataFrame(left, "i long, k string, m int").repartition(3), spark.createDataFrame(right, "j long, k string, m int"), ["k", "m"], "i", "j").collect()
    a, b = Counter((k, m) for _, k, m in left), Counter((k, m) for _, k, m in right)
    for key in a | b:
        here = [x for x in got if (x.k, x.m) == key]
        assert len(here) == max(a[key], b[key]) and sum(x.i is not None and x.j is not None for x in here) == min(a[key], b[key])
        assert [x.i for x in sorted(here, key=lambda x: x.nth) if x.i is not None] == sorted(i for i, k, m in left if (k, m) == key)
    assert len({x.i for x in got if x.i is not None}) == 500 and len({x.j for x in got if x.j is not None}) == 450


def test_token_events_of_odd_receipts(spark):
    t = receipts.TRANSFER
    topic = lambda n: f"0x{n:064x}"
    acc = lambda n: f"0x{n:040x}"
    rows = [(1, "t1", acc(9), acc(1), acc(2), "5"), (2, "t1", acc(9), acc(1), acc(2), "5"), (3, "t2", acc(9), acc(1), acc(2), "5"), (4, "t3", acc(9), acc(1), acc(2), "5")]
    logs = [("t1", 1, acc(9), [t, topic(1), topic(2)], topic(5), 10, None), ("t1", 2, acc(9), [t, topic(1)], topic(5), 11, None), ("t1", 3, acc(9), [t, topic(1), topic(2)], topic(5), 10, False), ("t1", 4, acc(9), [t, topic(1), topic(2)], topic(6), 12, False), ("t1", 5, acc(9), None, None, 13, False)]
    frames = spark.createDataFrame(rows, "row_id long, tx string, contract string, sender string, recipient string, value string"), spark.createDataFrame([("t1", 1), ("t2", 0)], "tx string, status int")
    events, gaps = receipts.token_events(*frames, spark.createDataFrame(logs, "tx string, place long, address string, topics array<string>, data string, log_index long, removed boolean"))
    assert [(x.tx, x.log_index, x.row_id) for x in events.collect()] == [("t1", 10, 1)]
    assert sorted((x.tx, x.reason, x.rows, x.logs) for x in gaps.collect()) == sorted([("t1", receipts.DUPLICATE, None, None), ("t1", receipts.MULTIPLICITY, 2, 1), ("t2", receipts.NO_SUCCESS, None, None), ("t3", receipts.NO_RECEIPT, None, None)])


def walk(x, path="$", key=None):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in walk(v, f"{path}.{k}", k)]
    if isinstance(x, list):
        return [y for i, v in enumerate(x) for y in walk(v, f"{path}[{i}]")]
    return [(path, key, x)]


def test_walks_reach_any_depth(spark):
    deep = {"a": 1}
    for i in range(14):
        deep = {"b": [deep, {"address": f"0x{i:040X}"}]} if i % 2 else {"blockHash": f"0xA{i}", "c": deep}
    docs = {1: json.dumps(deep), 2: "[]", 3: "7", 4: "not json", 5: None, 6: '{"x":{},"y":[],"z":null,"block_hash":null,"sender":"0x12","s":"täxt"}'}
    df = spark.createDataFrame(list(docs.items()), "doc long, text string")
    found = nested.leaves(df, "doc", "text").collect()
    want = [(i, p, k, None if v is None else str(v)) for i in (1, 3, 6) for p, k, v in walk(json.loads(docs[i]))]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    walked = nested.leaves(df, "doc", "text")
    assert {x.hash for x in nested.block_hashes(walked).collect()} == {f"0xa{i}" for i in range(0, 14, 2)}
    assert {x.account for x in nested.account_fields(walked).collect()} == {f"0x{i:040x}" for i in range(1, 14, 2)}
