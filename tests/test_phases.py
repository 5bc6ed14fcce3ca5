"""Phases of an admission read the ranges they may end in."""

from pyspark.sql import functions as F

from ledgerloom.operators import ledger, prefix


def test_later_ranges_are_not_read(spark, monkeypatch):
    jobs = spark.range(4000).select(F.lit("u").alias("unit"), F.col("id").alias("n"), (F.col("id") * 37 % 61 + 1).alias("amount"))
    caps = spark.createDataFrame([("u", 900, 10**6)], "unit string, cap long, allowance long")
    read, plain = [], prefix.in_ranges
    monkeypatch.setattr(prefix, "in_ranges", lambda df, *a: read.append(df.count()) or plain(df, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["n"]: r["outcome"] for r in ledger.admitted(jobs, caps).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    left = 900
    for n in range(4000):
        amount = n * 37 % 61 + 1
        assert got[n] == ("RESERVED" if amount <= left else "REFUSED")
        left -= amount if amount <= left else 0
    assert max(read) <= 1000 and len(read) > 1
