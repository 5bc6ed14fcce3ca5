"""Interval scans: the value events of three kinds that touch an account within bounds of blocks and time.

A scan of one interval pushes its bounds to the tables, dates included, so that partitions by date are skipped. Many intervals are
one join of a table of intervals with the events, in place of a union of scans: by account and bin of blocks. An interval is filed under the
one or two bins of a width that is a power of two and just holds it, so short ones meet only what is near them and long ones take few rows;
a block looks in one bin of each width that any interval has, 63 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls that move no value of their own.
NO_VALUE = ("delegatecall", "callcode", "staticcall")
COLUMNS = ["kind", "tx_hash", "sender", "recipient", "amount", "block", "tx_index", "tsec", "log_index", "path", "success", "contract"]


def bounds(start_block: int, end_block: int, start_time: int, end_time: int) -> Column:
    """Block and time bounds, with the dates that follow from them."""
    day = lambda s: F.date_add(F.lit("1970-01-01").cast("date"), s // 86400)
    return F.col("block").between(start_block, end_block) & F.col("tsec").between(start_time, end_time) & F.col("block_date").between(day(start_time), day(end_time))


def failed_ancestor(traces: DataFrame) -> DataFrame:
    """tx_hash, block, path of traces below one that failed: each path meets its own shorter prefixes, an equi-join."""
    parts = F.split("path", "_")
    up = traces.select("tx_hash", "block", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "_"))).alias("prefix"))
    failed = traces.where("not success").select("tx_hash", "block", F.col("path").alias("prefix"))
    return up.where("path <> ''").join(failed, ["tx_hash", "block", "prefix"], "left_semi").select("tx_hash", "block", "path").distinct()


def events(transactions: DataFrame, traces: DataFrame, tokens: DataFrame) -> DataFrame:
    """The three kinds as one table: top-level transfers (failed ones too, for their gas), internal value transfers below the root,
    token transfers with index and success of their transaction."""
    none = lambda t: F.lit(None).cast(t)
    top = transactions.select(F.lit("top").alias("kind"), "tx_hash", "sender", "recipient", "amount", "block", "tx_index", "tsec", none("long").alias("log_index"), none("string").alias("path"), "success", none("long").alias("contract"))
    real = (F.col("path") != "") & (F.col("amount") > 0) & (F.col("call_type").isNull() | ~F.col("call_type").isin(*NO_VALUE))
    below = failed_ancestor(traces).withColumn("below", F.lit(True))
    to = F.when(F.col("type") == "suicide", F.col("refund_address")).otherwise(F.coalesce("recipient", "address"))
    internal = traces.where(real).join(below, ["tx_hash", "block", "path"], "left").withColumn("to", to)
    fine = F.col("success") & F.col("tx_success") & F.col("below").isNull()
    internal = internal.select(F.lit("internal").alias("kind"), "tx_hash", "sender", F.col("to").alias("recipient"), "amount", "block", "tx_index", "tsec", none("long").alias("log_index"), "path", fine.alias("success"), none("long").alias("contract"))
    known = transactions.select("tx_hash", "block", F.col("tx_index").alias("i"), "success")
    token = tokens.drop("tx_index").join(known, ["tx_hash", "block"], "left")
    token = token.select(F.lit("erc20").alias("kind"), "tx_hash", "sender", "recipient", "amount", "block", F.col("i").alias("tx_index"), "tsec", "log_index", none("string").alias("path"), "success", "contract")
    return top.unionByName(internal).unionByName(token)


def touching(found: DataFrame) -> DataFrame:
    """Events with each account that is an endpoint: equal endpoints once."""
    return found.withColumn("account", F.explode(F.array_compact(F.array_distinct(F.array("sender", "recipient")))))


def _bins(first: Column, last: Column) -> Column:
    """The bins (width as a power of two, place) that an interval is filed under; none where it is empty."""
    power = F.length(F.regexp_replace(F.bin(last - first), "^0+", "")).cast("int")
    at = lambda c: F.call_function("shiftright", c, power)
    places = F.array_distinct(F.array(at(first), at(last)))
    return F.explode(F.when(last >= first, F.transform(places, lambda p: F.struct(power.alias("power"), p.alias("place")))))


#: Stretches that intervals are told by before a scan.
STRETCHES = 64


def spanned(intervals: DataFrame, point: str, first: str, last: str) -> Column:
    """Whether a point may be in some interval: bounds that a scan of the points takes before any shuffle. The span of all intervals is cut into equal
    stretches, and those that no interval touches are left out."""
    some = intervals.where(F.col(first) <= F.col(last))
    lo, hi = some.agg(F.min(first), F.max(last)).first()
    if lo is None:
        return F.lit(False)
    width = (hi - lo) // STRETCHES + 1
    place = lambda c: F.floor((F.col(c) - lo) / width)
    places = some.select(F.explode(F.sequence(place(first), place(last))).alias("p")).distinct().collect()  # one of each stretch at most
    runs = []
    for p in sorted(r[0] for r in places):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    inside = F.lit(False)
    for a, b in runs:
        inside = inside | F.col(point).between(lo + a * width, lo + (b + 1) * width - 1)
    return inside


def at_intervals(points: DataFrame, intervals: DataFrame, by: str, point: str, first: str, last: str) -> DataFrame:
    """Every point joined with every interval (first to last, both ends included) of the same `by` that holds it: an equi-join on by and bin. The
    bounds are residual, and no point meets an interval twice."""
    filed = intervals.withColumn("_bin", _bins(F.col(first).cast("long"), F.col(last).cast("long")))
    powers = [r[0] for r in filed.select("_bin.power").distinct().collect()]  # 64 at most
    if not powers:
        return points.join(intervals, by).where("false")
    look = F.explode(F.array(*(F.struct(F.lit(p).alias("power"), F.call_function("shiftright", F.col(point).cast("long"), F.lit(p)).alias("place")) for p in sorted(powers))))
    return points.withColumn("_bin", look).join(filed, [by, "_bin"]).where(F.col(point).between(F.col(first), F.col(last))).drop("_bin")


def tagged(intervals: DataFrame, found: DataFrame) -> DataFrame:
    """interval_id and the events of every interval (account, block and time bounds, perhaps a token): one join by account and bin of
    blocks. An interval for a token leaves out other tokens, but keeps native events."""
    i = intervals.withColumnsRenamed({"contract": "asked"})
    met = at_intervals(touching(found), i, "account", "block", "start_block", "end_block")
    inside = F.col("tsec").between(F.col("start_time"), F.col("end_time"))
    return met.where(inside & (F.col("asked").isNull() | F.col("contract").isNull() | (F.col("asked") == F.col("contract")))).select("interval_id", *COLUMNS)


def order_columns(*first: str) -> list[Column]:
    """The order in which a scan's rows are presented; nulls come last."""
    return [F.col(c).asc_nulls_last() for c in (*first, "block", "tx_index", "tx_hash", "kind", "log_index", "path", "sender", "recipient", "amount", "contract")]


def served(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each request (request_id, account, start_block, end_block) with the first saved job whose scope contains it, job_id null if none
    does: the job has to hold the request's first block, which is looked up by bins, and its last one."""
    j = jobs.select("account", F.col("start_block").alias("from_block"), F.col("end_block").alias("to_block"), "job_id")
    hit = at_intervals(requests, j, "account", "start_block", "from_block", "to_block").where(F.col("end_block").between(F.col("start_block"), F.col("to_block")))
    return requests.join(hit.groupBy("request_id").agg(F.min("job_id").alias("job_id")), "request_id", "left")


def accounted(intervals: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per interval with its number of rows: one without any is empty but complete, not missing."""
    counts = rows.groupBy("interval_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return intervals.join(counts, "interval_id", "left").select("interval_id", n.alias("n"), F.when(n > 0, "ROWS").otherwise("COMPLETE_EMPTY").alias("status"))
