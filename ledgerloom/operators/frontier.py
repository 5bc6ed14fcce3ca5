"""Frontier expansion: transfers causally reachable from seeds, level by level, under a time window for each arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import Run

from .graph import stop_reason
from .identity import identity_kind, lookup_state
from .order import strictly_after


def _side(prefix: str):
    return lambda f: F.col(f"{prefix}_{f}")


#: Arrivals of a level up to which they are broadcast; beyond, both sides are dealt by account, asset and slot of time.
BROADCAST = 200_000


def bounds() -> tuple[Column, ...]:
    """What is known of a level before it is expanded: its size and bounds."""
    return F.count("*").alias("n"), F.min("tsec").alias("first"), F.max("tsec").alias("last"), F.min("block").alias("block")


def successors(states: DataFrame, transfers: DataFrame, window: int, scope_end: int | None = None, most: int = BROADCAST, seen: dict | None = None) -> DataFrame:
    """Admitted (arrival, event) pairs. seen: bounds of states, or of a table that they are part of. The bounds cut the scan of
    transfers from its first block and second to the last that any arrival can reach; a level of at most `most` arrivals is then broadcast to
    that scan, so transfers aren't shuffled. A larger one meets them by account, asset and slot, a slot being as long as the window: an
    arrival looks in its own and the next, and the window, the scope and the order are residual."""
    seen = seen or states.agg(*bounds()).first().asDict()
    last = (seen["last"] or 0) + window
    reach = F.col("tsec").between(seen["first"] or 0, last if scope_end is None else min(last, scope_end)) & (F.col("block") >= (seen["block"] or 0))
    able = transfers.where(reach & F.col("success") & (F.col("amount_raw") > 0) & (F.col("recipient") != F.col("sender")) & F.lit(seen["n"] > 0))
    a = states.select(*[F.col(c).alias(f"a_{c}") for c in states.columns])
    e = able.select(*[F.col(c).alias(f"e_{c}") for c in transfers.columns])
    here = (F.col("e_sender") == F.col("a_recipient")) & (F.col("e_asset") == F.col("a_asset"))
    end = F.col("a_tsec") + window
    inside = F.col("e_tsec").between(F.col("a_tsec"), end if scope_end is None else F.least(end, F.lit(scope_end))) & (F.col("e_block") >= F.col("a_block"))
    if seen["n"] <= most:
        # The semi-join goes below what transfers are computed from, down to the scan; only what it leaves is looked at further.
        here_at_all = F.broadcast(states.select(F.col("recipient").alias("_account")))
        e = e.join(here_at_all, F.col("e_sender") == F.col("_account"), "left_semi")
        met = e.join(F.broadcast(a), here & inside)
    else:
        slot = lambda c: F.floor(F.col(c) / window)
        a = a.withColumn("a_slot", F.explode(F.array(slot("a_tsec"), slot("a_tsec") + 1)))
        met = e.withColumn("e_slot", slot("e_tsec")).join(a, here & (F.col("e_slot") == F.col("a_slot")) & inside).drop("e_slot", "a_slot")
    return met.where(strictly_after(_side("e"), _side("a")))


def _spent(levels: list[DataFrame], by: list[str], most_events: int, most_accounts: int) -> DataFrame:
    """Queries whose states so far reach a limit: what a further level would add to them comes too late."""
    sums = _union([level.select(*by, "recipient") for level in levels]).groupBy(*by).agg(F.count("*").alias("events"), F.count_distinct("recipient").alias("accounts"))
    return sums.where((F.col("events") >= most_events) | (F.col("accounts") >= most_accounts)).select(*by)


def _levels(
    transfers: DataFrame, seeds: DataFrame, depth: int, window: int, follows, scope_end: int | None, by: list[str], run: Run, most: int, budget: tuple[int, int] | None = None, edges: bool = False, last: bool = True
):
    """For each level: its states, and with `edges` the (arrival, event) pairs that led to them (none for the seeds). Each level is a step of
    the run; transfers are scanned where they are, once a level. `by`: what a seed carries on to all that follows, such as its query.
    budget: events and accounts at which a query goes no further. last: whether the last level is a step too; nothing follows from it."""
    columns = transfers.columns
    levels = [run.step("level-0", lambda: seeds.select(F.lit(0).alias("level"), *by, *columns), bounds())]
    yield levels[0], None
    for d in range(1, depth + 1):
        going = follows(levels[-1]).select(*by, *columns)
        if budget:
            going = going.join(_spent(levels, by, *budget), by, "left_anti")
        carried, at = [F.col(f"a_{c}").alias(c) for c in by], F.lit(d).alias("level")
        found = lambda going=going, d=d: successors(going, transfers, window, scope_end, most, run.seen[f"level-{d - 1}"])
        pairs = run.step(f"pairs-{d}", found) if edges else None
        states = lambda: (pairs if edges else found()).select(at, *carried, *[F.col(f"e_{c}").alias(c) for c in columns]).dropDuplicates([*by, "event_id"])  # noqa: B023, E731
        levels.append(run.step(f"level-{d}", states, bounds()) if last or d < depth else states())
        yield levels[-1], pairs.select(at, *carried, F.col("e_event_id").alias("event_id"), F.col("a_event_id").alias("arrival_id")) if edges else None


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def trace(transfers: DataFrame, seeds: DataFrame, depth: int, window: int, is_service, scope_end: int | None = None, run: Run | None = None, most: int = BROADCAST) -> DataFrame:
    """(level, the columns of transfers) for every level up to depth. Arrivals at a service stop; a state is an event at a
    level. With a run that was cut off, finished levels are read and the rest is computed."""
    follows = lambda level: level.where(~is_service(F.col("recipient")))
    levels = _levels(transfers, seeds, depth, window, follows, scope_end, [], run or Run(transfers.sparkSession), most, last=run is not None)
    return _union([level for level, _ in levels])


def collect(
    transfers: DataFrame, seeds: DataFrame, registry: DataFrame, depth: int, window: int, scope_end: int, run: Run | None = None, most: int = BROADCAST, budget: tuple[int, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """States (query_id, level, transfer, its account's identity, stop) and membership edges (query_id, level, event_id, arrival_id) of the
    traces of seeds, each with its query_id. Accounts are looked up in a registry (account, identity_class, lookup_status): unknown ones
    go on, services and boundaries stop. budget: most events and accounts of a query, see `limited`; a query that has reached one is not
    expanded further, so what `limited` keeps is the same, and no later level is read for it."""
    run = run or Run(transfers.sparkSession)

    def known(level: DataFrame) -> DataFrame:
        found = level.join(registry.withColumnRenamed("account", "recipient"), "recipient", "left")
        found = found.withColumns({"identity": identity_kind(F.col("identity_class")), "lookup": lookup_state(F.col("identity_class"), F.col("lookup_status"))})
        return found.withColumn("stop", stop_reason(F.col("identity"), F.col("level"), depth))

    follows = lambda level: known(level).where("stop is null")
    found = list(_levels(transfers, seeds, depth, window, follows, scope_end, ["query_id"], run, most, budget, edges=True))
    states = run.step("states", lambda: known(_union([level for level, _ in found])))
    return states, _union([edges for _, edges in found if edges is not None])


def limited(states: DataFrame, most_events: int, most_accounts: int) -> DataFrame:
    """states with cut: whether a query's limit of events or expanded accounts was reached before this state came up. States come up by level,
    block, place in it, time and id; a response is kept whole, so the state that reaches a limit isn't cut."""
    order = Window.partitionBy("query_id").orderBy("level", "block", F.coalesce("tx_index", F.lit(-1)), "tsec", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("query_id", "recipient").orderBy("level", "block", F.coalesce("tx_index", F.lit(-1)), "tsec", "event_id")) == 1
    df = states.withColumn("_new", F.when(first, 1).otherwise(0))
    events, accounts = F.count("*").over(before), F.coalesce(F.sum("_new").over(before), F.lit(0))
    return df.withColumn("cut", (events >= most_events) | (accounts >= most_accounts)).drop("_new")


def status(interrupted: Column, over_budget: Column, pending: Column, unresolved: Column) -> Column:
    """The state of a collection, its first reason not to be complete first."""
    return (
        F.when(interrupted, "INTERRUPTED")
        .when(over_budget, "BUDGET_LIMIT")
        .when(pending, "PENDING_INTERVALS")
        .when(unresolved, "COMPLETE_WITH_UNRESOLVED")
        .otherwise("COMPLETE")
    )
