"""Logs and frames are dealt once by key, and large keys are paired over ranges."""

from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import receipts


def _sides(spark):
    side = lambda n, m, name: spark.range(n).select((F.col("id") % m).alias("tx"), F.lit("0xAb").alias("address"), F.array(F.lit("t")).alias("topics"), F.lit("0x").alias("data"), F.col("id").alias(name))
    return side(40, 7, "log_index"), side(31, 11, "path")


def test_large_keys_give_the_same(spark):
    logs, frames = _sides(spark)
    plain, ranged = ([tuple(r) for r in receipts.bound_logs(logs, frames, most).collect()] for most in (1000, 8))
    assert Counter(plain) == Counter(ranged)
    assert Counter(r[3] for r in plain) == {"AMBIGUOUS": 21, "RECEIPT_ONLY": 19, "FRAME_ONLY": 10}


def test_one_table_without_a_join(spark):
    assert "Join" not in receipts.bound_logs(*_sides(spark))._jdf.queryExecution().optimizedPlan().toString()
