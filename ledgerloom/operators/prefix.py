"""Running totals over groups of any size: ranges of rows are summed by themselves, then the sums of earlier ranges are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored


def _each(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else names


def in_ranges(ranged: DataFrame, by: list[str], order: list[str], value: str | list[str], out: str | list[str]) -> DataFrame:
    """As `running`, of rows that are dealt already: _range is the number of the range of (by, order) that holds a row."""
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = list(enumerate(zip(_each(value), _each(out), strict=True)))
    totals = ranged.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"_total_{i}") for i, (v, _) in names))  # a row per range and group in it
    before = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_total_{i}").over(earlier), F.lit(0)).alias(f"_before_{i}") for i, _ in names))
    local = ranged.withColumns({f"_here_{i}": F.sum(v).over(here) for i, (v, _) in names})
    found = local.join(before, [*by, "_range"]).withColumns({o: F.col(f"_here_{i}") + F.col(f"_before_{i}") for i, (_, o) in names})
    return found.drop(*(f"{c}_{i}" for c in ("_here", "_before") for i, _ in names))


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df, stored, with the _range of (by, order) of each row."""
    return stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[str], value: str | list[str], out: str | list[str]) -> DataFrame:
    """df with `out`, the sum of `value` over the rows of its group (`by`) up to this one by `order`, which has to be unique in a group (or
    rows that are equal by it must not be asked for theirs). Several values have an `out` each. No group meets in one task, however large: rows
    are dealt by ranges of (by, order)."""
    return in_ranges(dealt(df, by, order), by, order, value, out).drop("_range")


#: Rows of a group up to which one task sums it.
MOST_ROWS = 1_000_000


def large_groups(df: DataFrame, by: list[str], most: int = MOST_ROWS) -> DataFrame | None:
    """The groups of over `most` rows, or None if there are none. Groups are counted one by one only in those of 65,536 buckets that hold as
    many rows, so where there is no large one, next to nothing is shuffled."""
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(1 << 16)))
    over = lambda keys, of, name: stored(of.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), name)
    full = over(["_bucket"], rows, "full-buckets")
    if full.isEmpty():
        return None
    large = over(by, rows.join(F.broadcast(full), "_bucket", "left_semi"), "large-groups")  # a bucket's number each
    return None if large.isEmpty() else large


def total_so_far(df: DataFrame, by: list[str], order: list[str], value: str | list[str], out: str | list[str], most: int = MOST_ROWS) -> DataFrame:
    """As `running`, by a plain window for groups of at most `most` rows, and over ranges for larger ones only. A group's key is not null."""
    large = large_groups(df, by, most)
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {o: F.sum(v).over(window) for v, o in zip(_each(value), _each(out), strict=True)}
    if large is None:
        return df.withColumns(sums)
    small = df.join(large, by, "left_anti").withColumns(sums)
    return small.unionByName(running(df.join(large, by, "left_semi"), by, order, value, out))


def running_least(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """As `running`, with the least of `value` (nulls left out; structs compare field by field) in place of the sum. Rows that are equal by
    `order` must not differ in whether they have a value."""
    ranged = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(F.min(value).alias("_total"))
    before = totals.select(*by, "_range", F.min("_total").over(earlier).alias("_before"))
    local = ranged.withColumn("_here", F.min(value).over(here))
    return local.join(before, [*by, "_range"]).withColumn(out, F.least("_here", "_before")).drop("_range", "_here", "_before")
