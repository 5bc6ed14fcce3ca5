"""Audit of registered reference events: partial execution order, certificates of reachability, and what they say of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

from . import prefix

# Classes of identity that a certificate doesn't pass.
# Those that end a search at a service or a boundary; and why a chain that is there doesn't count.
ENDS = ("SERVICE", "BRIDGE_BOUNDARY", "MIXER_BOUNDARY")
FIRST_BOUNDARY, OTHER_BOUNDARY = "KNOWN_FIRST_SERVICE_OR_BOUNDARY_BLOCKS_AVAILABLE_CERTIFICATES", "KNOWN_PROTOCOL_OR_CONFLICT_BOUNDARY_ON_AVAILABLE_CERTIFICATE"
STOP_ROLES = ("SERVICE", "BRIDGE_BOUNDARY", "MIXER_BOUNDARY", "DEX_OR_PROTOCOL", "CONFLICTED_IDENTITY")


def strictly_before(a, b) -> Column:
    """True, False or null (unknown): did event a happen before b? Both map a field's name to a column. Unlike `order.strictly_after`, times
    stand in for missing blocks, and logs go before the rule for top-level events."""
    blocks = a("block").isNotNull() & b("block").isNotNull()
    logs = a("log_index").isNotNull() & b("log_index").isNotNull()
    return (
        F.when(a("event_id") == b("event_id"), False)
        .when(blocks & (a("block") != b("block")), a("block") < b("block"))
        .when(blocks & (a("tx_hash") != b("tx_hash")), a("tx_index") < b("tx_index"))
        .when(~blocks & (a("tsec") != b("tsec")), a("tsec") < b("tsec"))
        .when(a("tx_hash") != b("tx_hash"), F.lit(None).cast("boolean"))
        .when(logs, a("log_index") < b("log_index"))
        .when((a("kind") == "top") & (b("kind") != "top"), True)
        .when((b("kind") == "top") & (a("kind") != "top"), False)
    )


def event_order(c) -> Column:
    """The order in which events are taken up: what is missing counts as zero, top-level events first."""
    zero = lambda f: F.coalesce(c(f), F.lit(0).cast("long"))
    return F.struct(zero("block").alias("b"), zero("tx_index").alias("t"), F.when(c("kind") == "top", 0).otherwise(1).alias("k"), zero("log_index").alias("l"), c("event_id").alias("i"))


GROUP = ["query_id", "account", "asset"]


def _able(events: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that may be followed, and those that may follow, with the account in question. Only events of a positive amount that did not fail;
    a seed follows no one, and transfers to oneself bring nothing new, unless they are seeds."""
    real = events.where("ok and amount > 0").join(seeds.withColumn("seed", F.lit(True)), ["query_id", "event_id"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    return real.where("seed or sender <> recipient").withColumn("account", F.col("recipient")), real.where("not seed").withColumn("account", F.col("sender"))


def _met(p: DataFrame, e: DataFrame, *more: str) -> DataFrame:
    """Pairs of p and e of a pool, account and asset (and equal in `more`), p before e for certain and taken up before it, unless p is a seed. An
    equi-join; all other conditions are residual."""
    p, e = (x.select(*[F.col(c).alias(f"{n}_{c}") for c in x.columns]) for n, x in (("p", p), ("e", e)))
    side = lambda n: lambda f: F.col(f"{n}_{f}")
    keys = [F.col(f"p_{c}") == F.col(f"e_{c}") for c in (*GROUP, *more)]
    return p.join(e, keys).where((F.col("p_seed") | (event_order(side("p")) < event_order(side("e")))) & strictly_before(side("p"), side("e")))


def links(events: DataFrame, seeds: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Which event may follow which: p (predecessor) and e of a pool (query_id), account and wait; none of hubs (see `hubs_of`)."""
    p, e = _able(events, seeds)
    found = _met(p if hubs is None else p.join(hubs, GROUP, "left_anti"), e)
    return found.select(F.col("e_query_id").alias("query_id"), F.col("p_event_id").alias("p"), F.col("e_event_id").alias("e"), F.col("e_sender").alias("account"), (F.col("e_tsec") - F.col("p_tsec")).alias("wait"))


def hubs_of(events: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Groups (pool, account, asset) that would make more than `most` pairs of an arrival and a departure."""
    p, e = (x.groupBy(*GROUP).agg(F.count("*").cast("decimal(19,0)").alias(n)) for x, n in zip(_able(events, seeds), ("a", "d"), strict=True))
    return p.join(e, GROUP).where(F.col("a") * F.col("d") > most).select(*GROUP)


def _least_before(arrivals: DataFrame, departures: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each departure with best, the least value of the arrivals of its group whose `at` is below its own: a running minimum over ranges of rows,
    departures standing before arrivals of the same place."""
    rows = arrivals.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("e_tsec"), "value")
    rows = rows.unionByName(departures.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), "event_id", F.col("tsec").alias("e_tsec")), allowMissingColumns=True)
    out = prefix.running_least(rows.where("_at is not null"), by, ["_at", "_side"], "value", "best")
    return out.where("_side = 0 and best is not null").select("query_id", "event_id", "e_tsec", "best")


def _hub_candidates(arrivals: DataFrame, departures: DataFrame) -> DataFrame:
    """Of each departure of a hub (query_id, event_id, e_tsec): best, values of arrivals before it for certain, the least one among them. What is
    before what falls into cases, each one a running minimum: earlier blocks; the same block, by index; and by time where the arrival lacks
    its block, or, for seeds only, the departure does. Pairs are listed within a transaction, and among events without a block. A
    transaction has one index.

    Which of two paths is the smaller once an event is added depends on the event only where one path goes on from the other. So minima take a
    path that ends as larger than one that goes on, and those that the least one goes on from, arrivals on its own path, are met one by one."""
    known = lambda df: df.where("block is not null")
    odd = lambda df: df.where("block is null or block = 0")
    parts = [
        _least_before(known(arrivals), known(departures), GROUP, "block"),
        _least_before(known(arrivals), known(departures), [*GROUP, "block"], "tx_index"),
        _least_before(arrivals.where("block is null"), departures.where("block > 0"), GROUP, "tsec"),
        _least_before(arrivals.where("seed and block > 0"), departures.where("block is null"), GROUP, "tsec"),
    ]
    for met in (_met(arrivals, departures, "tx_hash"), _met(odd(arrivals), odd(departures))):
        parts.append(met.select(F.col("e_query_id").alias("query_id"), F.col("e_event_id").alias("event_id"), F.col("e_tsec"), F.col("p_value").alias("best")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stored(out, "hub-candidates")
    on_path = out.select("query_id", "event_id", F.explode(F.slice("best.path", F.lit(1), F.size("best.path") - 1)).alias("_p")).distinct()
    met = _met(arrivals.withColumn("_p", F.col("event_id")), departures.join(on_path, ["query_id", "event_id"]), "_p")
    return out.unionByName(met.select(F.col("e_query_id").alias("query_id"), F.col("e_event_id").alias("event_id"), F.col("e_tsec"), F.col("p_value").alias("best")))


#: Pairs that a group may make before it is a hub.
MOST_PAIRS = 1_000_000


def certificates(events: DataFrame, seeds: DataFrame, identities: DataFrame | None = None, window: int | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """query_id, event_id, path, unknown (accounts on it without a known class), depth, max_wait of every event that a chain of links leads to
    from a seed: of all chains by its predecessors' own, the one of fewest unknown accounts, then of the smallest path.

    identities (account, role): with them, no chain passes a stop role; window bounds each wait. Rounds of joins along the links: as these
    never lead back, a round more than the longest chain changes nothing. Which predecessor is best doesn't depend on the event that follows,
    but for the order; so where a group would make more than `most` pairs, none are listed, and each departure takes the least
    of the arrivals before it from running minima. With a window all pairs are listed, as waits and order needn't agree."""
    none = F.array().cast("array<bigint>")
    hubs = stored(hubs_of(events, seeds, most), "hubs") if window is None else None
    hubs = None if hubs is None or hubs.isEmpty() else hubs

    def passing(df: DataFrame) -> DataFrame:
        """df (account) with met, the account if its class isn't known; none of a stop role."""
        if identities is None:
            return df.withColumn("met", none)
        df = df.join(identities, "account", "left").withColumn("role", F.coalesce("role", F.lit("UNKNOWN"))).where(~F.col("role").isin(*STOP_ROLES))
        return df.withColumn("met", F.when(F.col("role") == "UNKNOWN", F.array("account")).otherwise(none)).drop("role")

    steps = passing(links(events, seeds, hubs))
    if window is not None:
        steps = steps.where(F.col("wait") <= window)
    steps = stored(steps.select("query_id", "p", "e", "wait", "met"), "links")
    if hubs is not None:
        p, e = _able(events, seeds)
        p, e = stored(passing(p.join(hubs, GROUP, "left_semi")), "hub-arrivals"), stored(passing(e.join(hubs, GROUP, "left_semi")), "hub-departures")
    real = events.where("ok and amount > 0").join(seeds, ["query_id", "event_id"], "left_semi")
    first = stored(real.select("query_id", "event_id", F.array("event_id").alias("path"), none.alias("unknown"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("max_wait")), "seed-certificates")
    known, seen = first, None
    while True:
        c = known.withColumnRenamed("event_id", "p").join(steps, ["query_id", "p"])
        unknown = F.array_sort(F.array_union("unknown", "met"))
        c = c.select("query_id", F.col("e").alias("event_id"), F.concat("path", F.array("e")).alias("path"), unknown.alias("unknown"), (F.col("depth") + 1).alias("depth"), F.greatest("max_wait", "wait").alias("max_wait"))
        if hubs is not None:
            here = p.join(known, ["query_id", "event_id"]).withColumn("unknown", unknown)
            value = F.struct(F.size("unknown").alias("n"), F.array_append("path", F.lit(2**63 - 1)).alias("order"), "path", "unknown", "depth", "max_wait", "tsec")
            h = _hub_candidates(stored(here.withColumn("value", value).select(*p.columns, "value"), "hub-values"), e)
            wait = F.greatest("best.max_wait", F.col("e_tsec") - F.col("best.tsec"))
            c = c.unionByName(h.select("query_id", "event_id", F.concat("best.path", F.array("event_id")).alias("path"), F.col("best.unknown").alias("unknown"), (F.col("best.depth") + 1).alias("depth"), wait.alias("max_wait")))
        best = c.groupBy("query_id", "event_id").agg(F.min_by(F.struct("path", "unknown", "depth", "max_wait"), F.struct(F.size("unknown"), "path")).alias("x"))
        watch = Observation()
        found = first.unionByName(best.select("query_id", "event_id", "x.*"))
        known = stored(found.observe(watch, F.count("*").alias("n"), F.sum(F.xxhash64("query_id", "event_id", "path", "unknown").cast("decimal(38,0)")).alias("h")), "certificates")
        now = watch.get
        if now == seen:
            return known
        seen = now


def boundaries(certified: DataFrame, events: DataFrame, identities: DataFrame) -> DataFrame:
    """query_id, event_id, first_boundary: whether the accounts of a stop role that a certificate (of order alone) passes before its end, if
    there are any, are all services or boundaries."""
    passed = certified.select("query_id", "event_id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("_at"))
    at = events.select("query_id", F.col("event_id").alias("_at"), F.col("recipient").alias("account"))
    stops = passed.join(at, ["query_id", "_at"]).join(identities, "account").where(F.col("role").isin(*STOP_ROLES))
    return stops.groupBy("query_id", "event_id").agg((F.count_if(~F.col("role").isin(*ENDS)) == 0).alias("first_boundary"))


def affected(events: DataFrame, relations: DataFrame, changed: DataFrame) -> DataFrame:
    """The queries that changed accounts (account) reach: backwards from the events they take part in and the relations that they are the target
    of (recipient) to the queries that those belong to."""
    ends = events.select("query_id", F.explode(F.array_distinct(F.array("sender", "recipient"))).alias("account"))
    return ends.union(relations.select("query_id", F.col("recipient").alias("account"))).join(changed.select("account").distinct(), "account", "left_semi").select("query_id").distinct()


def maintained(old: DataFrame, reached: DataFrame, recompute) -> DataFrame:
    """old with the rows of the reached queries (query_id) computed anew and all others as they were. recompute maps a table of queries to their
    rows; it is given none but those reached, so what it reads is in proportion to them. A query's rows must depend on that query alone."""
    reached = stored(reached, "reached-queries")
    return old.join(reached, "query_id", "left_anti").unionByName(recompute(reached).select(old.columns))


def relation_status(df: DataFrame) -> DataFrame:
    """df with status and reason of each relation, the first that holds. Columns: seeds_known, entry_known, entry_time, first_seed_time,
    seeds_positive, amount_status, role, actor, certified, reached (without regard to roles), first_boundary (see `boundaries`), disjoint_rule, asset_seeded, depth."""
    c = F.col
    early = c("seeds_known") & c("entry_known") & (c("entry_time") < c("first_seed_time"))
    scope = c("role").isin("BRIDGE_BOUNDARY", "MIXER_BOUNDARY", "DEX_OR_PROTOCOL", "NON_SERVICE_SENTINEL")
    reason = (
        F.when(early, "ENTRY_BEFORE_EARLIEST_SEED")
        .when(~c("seeds_known"), "EXACT_SEED_UNRESOLVED")
        .when(~c("entry_known"), "EXACT_ENTRY_UNRESOLVED")
        .when(~c("seeds_positive"), "SEED_POSITIVE_AMOUNT_UNRESOLVED")
        .when(c("amount_status") != "POSITIVE", F.concat(F.lit("ENTRY_AMOUNT_"), c("amount_status")))
        .when(scope, c("role"))
        .when(c("role") == "CONFLICTED_IDENTITY", "TARGET_IDENTITY_CONFLICT")
        .when((c("role") != "SERVICE") | c("actor").isNull(), "TARGET_SERVICE_IDENTITY_UNRESOLVED")
        .when(c("certified") & c("disjoint_rule"), "S3_INJECTION_DISJOINTNESS_UNRESOLVED")
        .when(c("certified"), F.when(c("depth") == 0, "EXACT_ZERO_HOP_SERVICE_ENTRY").otherwise("STRICT_POSITIVE_SAME_ASSET_FIRST_IDENTIFIED_SERVICE"))
        .when(c("reached"), F.when(c("first_boundary"), FIRST_BOUNDARY).otherwise(OTHER_BOUNDARY))
        .when(~c("asset_seeded"), "PROTOCOL_SEMANTICS_UNRESOLVED")
        .otherwise("NO_STRICT_SAME_ASSET_REFERENCE_CHAIN")
    )
    df = df.withColumn("reason", reason)
    status = (
        F.when(F.col("reason") == "ENTRY_BEFORE_EARLIEST_SEED", "REJECTED_ASSOCIATION")
        .when(F.col("reason").isin("BRIDGE_BOUNDARY", "MIXER_BOUNDARY", "DEX_OR_PROTOCOL", "NON_SERVICE_SENTINEL"), "OUTSIDE_CURRENT_SERVICE_TARGET_SCOPE")
        .when(F.col("reason").isin("EXACT_ZERO_HOP_SERVICE_ENTRY", "STRICT_POSITIVE_SAME_ASSET_FIRST_IDENTIFIED_SERVICE"), "VERIFIED_TASK_REFERENCE")
        .otherwise("UNRESOLVED")
    )
    return df.withColumn("status", status)
