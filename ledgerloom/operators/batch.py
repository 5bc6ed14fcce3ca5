"""Intervals chosen for a batch, and its rows handed back to those that asked for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefix
from .audit import STOP_ROLES

#: Seconds that an arrival is followed for, and intervals of a probe at most.
FOLLOWED, MOST = 90 * 86400, 1000


def demultiplexed(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows (interval_id and an event's account ends, block and time) with verdict: OK, NOT_ASKED where no interval of the frozen manifest has that
    id, OUT_OF_SCOPE where the event lies outside of its own. intervals: interval_id, account, start_block, end_block, start_time, end_time."""
    frozen = intervals.select("interval_id", "account", "start_block", "end_block", "start_time", "end_time", F.lit(True).alias("asked"))
    inside = (
        F.col("block").between(F.col("start_block"), F.col("end_block")) & F.col("tsec").between(F.col("start_time"), F.col("end_time"))
        & ((F.col("sender") == F.col("account")) | (F.col("recipient") == F.col("account")))
    )
    verdict = F.when(F.col("asked").isNull(), "NOT_ASKED").when(~F.coalesce(inside, F.lit(False)), "OUT_OF_SCOPE").otherwise("OK")
    return rows.join(frozen, "interval_id", "left").withColumn("verdict", verdict).select(*rows.columns, "verdict")


def accounted(verdicts: DataFrame, intervals: DataFrame) -> DataFrame:
    """A row for each interval of the manifest: rows, and its state: one faulty row refuses the interval, none at all completes it empty."""
    counts = verdicts.groupBy("interval_id").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != "OK").alias("faults"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    df = intervals.join(counts, "interval_id", "left").select("interval_id", zero("n").alias("n"), zero("faults").alias("faults"))
    return df.withColumn("state", F.when(F.col("faults") > 0, "REFUSED").when(F.col("n") > 0, "COMPLETE").otherwise("COMPLETE_EMPTY"))


def selected(frontier: DataFrame, scopes: DataFrame, registry: DataFrame, most: int = MOST) -> DataFrame:
    """frontier with reason, SELECTED or what keeps an interval from the batch, and place, its number among those of its probe. Equal rows come once.

    An interval has to be of its probe's query and within its scope, and to end with it or FOLLOWED seconds after its start; then a frozen label, the
    depth, and a state other than INTERVAL_INCOMPLETE exclude it. A probe of over `most` intervals is refused as a whole. frontier: name,
    query_id, arrival_event_id, account, depth, start_block, end_block, start_time, end_time, state; scopes: name, query_id, the same bounds, max_depth;
    registry: account, identity_class. Places go by depth, first block and second, arrival and account, over ranges of rows."""
    c = F.col
    limits = scopes.select("name", *[c(x).alias(f"s_{x}") for x in ("query_id", "start_block", "end_block", "start_time", "end_time", "max_depth")])
    df = frontier.dropDuplicates().join(F.broadcast(limits), "name", "left").join(registry.select("account", "identity_class"), "account", "left")  # a row for each probe
    within = (
        c("start_block").between(c("s_start_block"), c("end_block")) & (c("end_block") == c("s_end_block")) & c("start_time").between(c("s_start_time"), c("end_time"))
        & (c("end_time") == F.least(c("s_end_time"), c("start_time") + FOLLOWED)) & (c("depth") >= 0) & c("arrival_event_id").isNotNull()
    )
    reason = (
        F.when(c("s_query_id").isNull(), "NO_PROBE")
        .when(~c("query_id").eqNullSafe(c("s_query_id")), "OTHER_QUERY")
        .when(~F.coalesce(within, F.lit(False)), "OUTSIDE_SCOPE")
        .when(c("identity_class").isin(*STOP_ROLES), "FROZEN_LABEL_BOUNDARY")
        .when(c("depth") >= c("s_max_depth"), "ACQUISITION_DEPTH_BOUNDARY")
        .when(~F.coalesce(c("state") == "INTERVAL_INCOMPLETE", F.lit(False)), "NOT_AN_UNFINISHED_PROVIDER_INTERVAL")
        .otherwise("SELECTED")
    )
    df = df.withColumn("reason", reason).select(*frontier.columns, "reason")
    chosen = df.where("reason = 'SELECTED'").withColumn("_one", F.lit(1).cast("long"))
    rest = [x for x in frontier.columns if x not in ("name", "depth", "start_block", "start_time", "arrival_event_id", "account")]
    placed = prefix.total_so_far(chosen, ["name"], ["depth", "start_block", "start_time", "arrival_event_id", "account", *rest], "_one", "place").drop("_one")
    counts = placed.groupBy("name").agg(F.max("place").alias("_n"))
    placed = placed.join(F.broadcast(counts), "name")
    fits = c("_n") <= most
    placed = placed.select(*frontier.columns, F.when(fits, "SELECTED").otherwise("RESOURCE_LIMIT").alias("reason"), F.when(fits, c("place")).alias("place"))
    return placed.unionByName(df.where("reason <> 'SELECTED'").withColumn("place", F.lit(None).cast("long")))
