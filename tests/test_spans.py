"""Bounds of all intervals, told before a scan."""

from pyspark.sql import functions as F

from ledgerloom.operators import scan


def test_points_outside_all_intervals_are_left_out(spark):
    intervals = spark.createDataFrame([(5, 30), (20, 44), (9000, 9010), (80, 70)], "first long, last long")
    kept = {r[0] for r in spark.range(20_000).where(scan.spanned(intervals, "id", "first", "last")).collect()}
    assert {*range(5, 45), *range(9000, 9011)} <= kept and len(kept) < 600
    assert spark.range(9).where(scan.spanned(intervals.where("false"), "id", "first", "last")).count() == 0
    assert spark.range(9).where(scan.spanned(intervals.where("first = 5"), "id", "first", "last")).agg(F.min("id")).first()[0] == 5
