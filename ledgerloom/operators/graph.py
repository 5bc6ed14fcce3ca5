"""Fixed graphs out of traced transfers: order within the graph, ambiguity, objective groups, stops and the next frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix
from .order import strictly_after

#: Stops of an arrival, in order of precedence: the class of its account, then the depth.
SERVICE, BOUNDARIES = "SERVICE", ("BRIDGE", "MIXER", "UNSUPPORTED_PROTOCOL")


def stop_reason(kind: Column, level: Column, depth: int) -> Column:
    """Why an arrival isn't followed further; null where it is."""
    return (
        F.when(kind == SERVICE, "FIRST_IDENTIFIED_SERVICE")
        .when(kind.isin(*BOUNDARIES), "PROTOCOL_BOUNDARY")
        .when(level >= depth, "DECLARED_DEPTH_BOUNDARY")
    )


def ordinals(events: DataFrame, by: list[str], most: int = prefix.MOST_ROWS) -> DataFrame:
    """ord: place of each event of its graph (`by`) in causal order, from zero; a transaction's top event comes first. Graphs of over `most` events
    are numbered over ranges."""
    order = ["block", F.coalesce("tx_index", F.lit(-1)), F.when(F.col("kind") == "top", 0).otherwise(1), F.coalesce("log_index", F.lit(0)), "event_id"]
    one = events.withColumn("_one", F.lit(1).cast("long"))
    return prefix.total_so_far(one, by, order, "_one", "ord", most).drop("_one").withColumn("ord", (F.col("ord") - 1).cast("int"))


def ambiguous(events: DataFrame) -> DataFrame:
    """Transactions whose events have no certain order: several, not all token transfers, and not a pair with a top event."""
    n = events.groupBy("block", "tx_index", "tx_hash").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "erc20").alias("tokens"), F.count_if(F.col("kind") == "top").alias("tops"))
    return n.where("events > 1 and events <> tokens and not (events = 2 and tops > 0)")


def unresolved(events: DataFrame) -> DataFrame:
    """Pairs of a block's events (a before b by ordinal) whose causal order is not certain; joined on the block only."""
    side = lambda p: events.select(*[F.col(c).alias(f"{p}_{c}") for c in events.columns])
    field = lambda p: lambda f: F.col(f"{p}_{f}")
    pairs = side("a").join(side("b"), (F.col("a_block") == F.col("b_block")) & (F.col("a_ord") < F.col("b_ord")))
    return pairs.where(~F.coalesce(strictly_after(field("b"), field("a")), F.lit(False)))


def unresolved_counts(events: DataFrame) -> DataFrame:
    """Per block, how many pairs `unresolved` has and the sum of the later events' ids, without listing pairs: counts within the block, its
    transactions and their kinds tell. For events without an execution index."""
    index = F.coalesce("tx_index", F.lit(-1))
    top, token = F.col("kind") == "top", F.col("kind") == "erc20"
    order = [F.when(top, 0).otherwise(1), F.coalesce("log_index", F.lit(0)), "event_id"]
    df = events.withColumns({"_i": index, "_top": top, "_token": token & F.col("log_index").isNotNull()})
    slot, tx = Window.partitionBy("block", "_i"), Window.partitionBy("block", "_i", "tx_hash")
    # Earlier ones of other transactions at this place of the block, and all without a place.
    others = F.row_number().over(slot.orderBy(*order)) - F.row_number().over(tx.orderBy(*order))
    placeless = F.when(F.col("tx_index").isNotNull(), F.count_if(F.col("tx_index").isNull()).over(Window.partitionBy("block"))).otherwise(0)
    # Of its own transaction's earlier ones, a top event is before all others, and token events are by their logs.
    earlier = F.row_number().over(tx.orderBy(*order)) - 1
    tops = F.when(top, 0).otherwise(F.count_if("_top").over(tx))
    logs = F.when(F.col("_token"), F.rank().over(Window.partitionBy("block", "_i", "tx_hash", "_token").orderBy("log_index")) - 1).otherwise(0)
    open_pairs = df.withColumn("n", others + placeless + earlier - tops - logs)
    return open_pairs.groupBy("block").agg(F.sum("n").alias("pairs"), F.sum(F.col("n") * F.col("event_id")).alias("ids")).where("pairs > 0")


def objective_groups(arrivals: DataFrame) -> DataFrame:
    """Targets with the events that reach them, as a list in order of event_id."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("event_id")), lambda x: x.cast("string")), ",")
    return arrivals.groupBy("recipient", "asset").agg(F.count_distinct("event_id").alias("n"), listed.alias("events"))


def next_requests(states: DataFrame, window: int, scope_end: int) -> DataFrame:
    """Distinct intervals (account, asset, start, end) that arrivals stopped by depth leave to ask for."""
    end = F.least(F.col("tsec") + window, F.lit(scope_end))
    return states.select(F.col("recipient").alias("account"), "asset", F.col("tsec").alias("start"), end.alias("end")).distinct()
