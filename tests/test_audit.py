"""Certificates where groups are hubs: running minima in place of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, prefix

SCHEMA = "query_id long, event_id long, sender long, recipient long, asset long, block long, tx_index long, tx_hash long, log_index long, kind string, tsec long, amount long, ok boolean"


def pool(seed, n=110):
    """Events of few accounts: missing blocks, indexes and logs, equal times, several events in a transaction."""
    r = random.Random(seed)
    rows = []
    for i in r.sample(range(1000), n):
        block, tx = r.randrange(0, 9), r.randrange(3)
        known = r.random() > 0.2
        tsec = block * 12 if r.random() > 0.1 else r.randrange(120)
        rows.append((r.randrange(2), i, r.randrange(5), r.randrange(5), r.randrange(2), block if known else None, tx if r.random() > 0.2 else None, block * 10 + tx, r.choice([None, 1, 2, 3]), r.choice(["top", "erc20", "internal"]), tsec, r.choice([0, 5, 7]), r.random() > 0.05))
    fixed = {}  # a transaction has one index
    return [(*x[:6], fixed.setdefault(x[7], x[6]), *x[7:]) for x in rows]


def plain(df):
    return sorted((x.query_id, x.event_id, x.path, x.unknown, x.depth, x.max_wait) for x in df.collect())


@pytest.mark.parametrize("seed", [1])
def test_hubs_give_the_same_certificates(spark, seed):
    rows = pool(seed)
    events = spark.createDataFrame(rows, SCHEMA)
    seeds = events.where("event_id % 7 = 0").select("query_id", "event_id")
    roles = spark.createDataFrame([(0, "UNKNOWN"), (1, "PERSONAL"), (4, "SERVICE")], "account long, role string")
    for identities in (None, roles):
        listed, hubs = (audit.certificates(events, seeds, identities, most=m) for m in (10**9, 0))
        assert plain(listed) == plain(hubs) and listed.where("depth > 1").count() > 0


def test_a_hub_of_many_arrivals_and_departures(spark):
    """20,000 arrivals, all of them seeds, and 20,000 departures of one account: 4 * 10^8 pairs, none of which is made."""
    n = 20_000
    row = lambda i, s, r, block: [F.lit(0).cast("long").alias("query_id"), i.alias("event_id"), s.alias("sender"), r.alias("recipient"), F.lit(1).cast("long").alias("asset"), block.alias("block"), F.lit(0).cast("long").alias("tx_index"), i.alias("tx_hash"), F.lit(None).cast("long").alias("log_index"), F.lit("top").alias("kind"), (block * 12).alias("tsec"), F.lit(3).cast("long").alias("amount"), F.lit(True).alias("ok")]
    k, hub = F.col("id"), F.lit(-1).cast("long")
    events = spark.range(n).select(*row(k, k + n, hub, k + 1)).unionByName(spark.range(n).select(*row(k + n, hub, k + 5 * n, k + 1)))
    found = audit.certificates(events, events.where(F.col("event_id") < n).select("query_id", "event_id"))
    got = found.where("depth = 1").agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max(F.element_at("path", 1)).alias("b"), F.max("max_wait").alias("w")).first()
    assert (got.n, got.a, got.b, got.w) == (n - 1, [0, n + 1], 0, 12 * (n - 1))  # the smallest path is from the first arrival; the first departure has none before it


def test_running_least_equals_a_loop(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), i, r.choice([None, r.randrange(100)])) for i in range(500)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g long, i long, v long").repartition(4)
    got = {(x.g, x.i): x.m for x in prefix.running_least(df, ["g"], ["i"], "v", "m").collect()}
    for g, i, _ in rows:
        seen = [v for h, j, v in rows if h == g and j <= i and v is not None]
        assert got[g, i] == (min(seen) if seen else None)
