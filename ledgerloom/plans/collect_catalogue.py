"""Registered queries of collections (traces with a registry, limits and status) and of facts and their graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import facts, frontier, order
from ledgerloom.plans.catalogue import _AFTER, DEPTH, WINDOW, _a, _e, _pairs
from ledgerloom.sources.derived import TRANSFERS_SQL, read, transfers
from ledgerloom.sources.shared import Run, digest_of

#: End of the scope of collections, and their limits of events and expanded accounts.
SCOPE_END, MOST_EVENTS, MOST_ACCOUNTS = 1_705_000_000, 12, 8


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with identity classes and states of lookup; each tenth account is not in it."""
    u = read(spark, sf_dir, "events").select(F.col("user_id").alias("account")).distinct().where("account % 10 <> 9")
    kind = F.when(F.col("account") % 10 == 3, "SERVICE").when(F.col("account") % 10 == 7, "BRIDGE_BOUNDARY").when(F.col("account") % 10 == 5, "CONFLICTED_IDENTITY").otherwise("UNKNOWN")
    status = F.when(F.col("account") % 10 == 1, "LOOKUP_FAILED_TIMEOUT").when(F.col("account") % 20 == 2, "BUDGET_BLOCKED").otherwise("SUCCESS")
    return u.select("account", kind.alias("identity_class"), status.alias("lookup_status"))


def collected(spark: SparkSession, sf_dir: str, budget: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Collections of all real transfers whose id 50 divides, each a query of its own. Queries over the same files share one run."""
    t = transfers(spark, sf_dir)
    seeds = t.where("event_id % 50 = 0 and success and sender <> recipient and amount_raw > 0").withColumn("query_id", F.col("event_id"))
    key = f"collected|{DEPTH}|{WINDOW}|{SCOPE_END}|{budget}|{digest_of(spark, f'{sf_dir}/events.parquet')}"
    return frontier.collect(t, seeds, registry(spark, sf_dir), DEPTH, WINDOW, SCOPE_END, run=Run(spark, key), budget=budget)


def collection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(spark, sf_dir)[0].select("query_id", "level", "event_id", "recipient", "identity", "lookup", F.coalesce("stop", F.lit("FOLLOWED")).alias("stop"))


def trace_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrival each event of a collection follows."""
    return collected(spark, sf_dir)[1]


def collection_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each collection could not tell, by reason: the accounts whose lookup is unanswered or in conflict. They go on as unknown."""
    states = collected(spark, sf_dir)[0].where("lookup <> 'FROZEN_LOCAL_OBSERVATION'")
    return states.groupBy("query_id", F.col("lookup").alias("reason")).agg(F.count_distinct("recipient").alias("accounts"))


def collection_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = frontier.limited(collected(spark, sf_dir)[0], MOST_EVENTS, MOST_ACCOUNTS)
    return cut.groupBy("query_id").agg(F.count("*").alias("states"), F.count_if("cut").alias("cut"), F.sum(F.when(~F.col("cut"), F.col("event_id"))).alias("kept_ids"))


def collection_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What collections keep within their limits, which end the expansion of a query as soon as it has reached one."""
    states = collected(spark, sf_dir, (MOST_EVENTS, MOST_ACCOUNTS))[0]
    return frontier.limited(states, MOST_EVENTS, MOST_ACCOUNTS).where("not cut").select("query_id", "level", "event_id")


def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = frontier.limited(collected(spark, sf_dir)[0], MOST_EVENTS, MOST_ACCOUNTS)
    any_of = lambda c: F.count_if(c) > 0
    found = states.groupBy("query_id").agg(
        any_of("cut").alias("i"), any_of(F.col("lookup") == "BUDGET_BLOCKED").alias("b"),
        any_of(F.col("stop") == "DECLARED_DEPTH_BOUNDARY").alias("p"), any_of(F.col("lookup") != "FROZEN_LOCAL_OBSERVATION").alias("u"),
    )
    return found.select("query_id", frontier.status(F.col("i"), F.col("b"), F.col("p"), F.col("u")).alias("status"))


def collection_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with one fact in conflict loses all: its events are kept as invalidated evidence only, and its coverage is incomplete. Facts
    whose id 31 divides are in conflict."""
    states = collected(spark, sf_dir)[0]
    bad = states.where("event_id % 31 = 0").select("query_id").distinct().withColumn("bad", F.lit(True))
    found = states.join(bad, "query_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    return found.groupBy("query_id", "bad").agg(F.count_if(~F.col("bad")).alias("candidates"), F.count_if("bad").alias("invalidated")).select("query_id", "candidates", "invalidated", F.when(F.col("bad"), "INCOMPLETE").otherwise("COMPLETE").alias("coverage"))


def admission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each arrival with the gap its unresolved order leaves: the pairs themselves, for arrivals whose id 50 divides."""
    pairs = _pairs(spark, sf_dir, WINDOW, ("sender",)).where("a_event_id % 50 = 0")
    reason = order.admission(_e, _a, F.least(F.col("a_tsec") + WINDOW, F.lit(SCOPE_END)), order.strictly_after(_e, _a))
    return pairs.select("a_event_id", "e_event_id", reason.alias("reason")).where("reason in ('CANDIDATE', 'ORDER_UNRESOLVED', 'ZERO')")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions of facts, by an id and a physical key that don't always agree."""
    key = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select((key * 8 + F.col("l_linenumber")).alias("event_id"), (key * 4 + F.col("l_partkey") % 4).alias("physical"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


def fact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as components of ids and physical keys: versions, and whether their fields agree."""
    found = facts.alias_groups(_facts(spark, sf_dir), "event_id", "physical")
    sums = found.groupBy("group").agg(F.count("*").alias("versions"), F.count_distinct("event_id").alias("ids"), F.min("event_id").alias("first_id"), F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    return sums.select("first_id", "versions", "ids", F.when(F.col("lo") != F.col("hi"), "CONFLICT").otherwise("SOUND").alias("status"))


def identity_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose id says another chain, transaction or position than they have, or whose asset is of another chain."""
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    tx = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(key), 64, "0")))
    named = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(F.when(part % 31 == 0, key + 1).otherwise(key)), 64, "0")))
    event_id = F.concat(F.when(part % 17 == 0, "eip155:10").otherwise("eip155:1"), F.lit(":tx:"), named, F.lit(":log:"), F.when(part % 23 == 0, line + 1).otherwise(line).cast("string"))
    asset = F.when(part % 29 == 0, "erc20:eip155:10:x").when(part % 2 == 0, "native:eip155:1").otherwise("other")
    df = read(spark, sf_dir, "lineitem").select((key * 8 + line).alias("row_id"), facts.binding_conflict(event_id, F.lit("eip155:1"), tx, F.concat(F.lit("log:"), line.cast("string")), asset).alias("bad"))
    return df.groupBy("bad").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a graph that are not as the manifest of facts has them."""
    t = transfers(spark, sf_dir).select("event_id", "sender", "recipient", "amount_raw")
    manifest = t.where("event_id % 53 <> 0").withColumn("conflicted", F.col("event_id") % 59 == 0).withColumn("amount_raw", F.expr("CASE WHEN event_id % 61 = 0 THEN amount_raw + 1 ELSE amount_raw END"))
    return facts.manifest_faults(t, manifest, "event_id", ["sender", "recipient", "amount_raw"])


def fact_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a later version of orders differs, field by field."""
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END").alias("status"), F.col("o_custkey").alias("customer"), F.lit("first").alias("source")).where("o_orderkey % 71 <> 0")
    new = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.expr("CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END").alias("customer"), F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'second' ELSE 'first' END").alias("source")).where("o_orderkey % 73 <> 0")
    found = facts.enrichment(old, new, "o_orderkey", ["status", "customer", "source"], ("source",))
    return found.groupBy("field", "change").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def conflicts_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (customers' parts of an order) that a conflict of facts touches: its ids exploded, semi-joined."""
    bad = facts.reconcile(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"]).where("status = 'CONFLICT'")
    ids = bad.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("ids"))  # seven lines at most
    asked = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("id"))
    hit = ids.select(F.col("l_orderkey").alias("o_orderkey"), F.explode("ids").alias("id"))
    return asked.join(hit, ["o_orderkey", "id"], "left_semi")


def revoked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of orders' requests (their own lines and those of the next order's) after conflicts came to light among the lines."""
    line = read(spark, sf_dir, "lineitem")
    fact = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id")
    own = line.select(F.col("l_orderkey").alias("request_id"), fact)
    returned = own.union(line.select((F.col("l_orderkey") - 1).alias("request_id"), fact)).distinct()
    bad = facts.reconcile(line, ["l_orderkey", "l_linenumber"], ["l_returnflag"]).where("status = 'CONFLICT'").select(fact)
    return facts.revoked(returned, bad)


def queries() -> dict:
    found = (
        collection_states, trace_membership, collection_gaps, collection_limits, collection_kept, collection_status, collection_invalidated, admission_rows,
        fact_components, identity_binding, graph_faults, fact_enrichment, conflicts_touching, revoked_results,
    )
    return {f.__name__: f for f in found}


_REGISTRY = """reg AS (SELECT DISTINCT user_id AS account, CASE user_id % 10 WHEN 3 THEN 'SERVICE' WHEN 7 THEN 'BRIDGE_BOUNDARY' WHEN 5 THEN 'CONFLICTED_IDENTITY' ELSE 'UNKNOWN' END AS class,
  CASE WHEN user_id % 10 = 1 THEN 'LOOKUP_FAILED' WHEN user_id % 20 = 2 THEN 'BUDGET_BLOCKED' WHEN user_id % 10 = 5 THEN 'LABEL_CONFLICT' ELSE 'FROZEN_LOCAL_OBSERVATION' END AS lookup FROM events WHERE user_id % 10 <> 9)"""
_STATES = f"""WITH RECURSIVE {TRANSFERS_SQL}, {_REGISTRY},
r AS (SELECT 0 AS level, event_id AS query_id, event_id FROM transfers WHERE event_id % 50 = 0 AND success AND sender <> recipient AND amount_raw > 0
  UNION SELECT r.level + 1, r.query_id, e.event_id FROM r JOIN transfers a ON a.event_id = r.event_id JOIN transfers e ON e.sender = a.recipient AND e.asset = a.asset
  WHERE r.level < {DEPTH} AND a.recipient % 10 NOT IN (3, 7) AND e.tsec BETWEEN a.tsec AND least(a.tsec + {WINDOW}, {SCOPE_END}) AND e.block >= a.block AND e.success AND e.amount_raw > 0 AND e.recipient <> a.recipient AND ({_AFTER}) IS TRUE),
st AS (SELECT query_id, level, t.*, CASE class WHEN 'SERVICE' THEN 'SERVICE' WHEN 'BRIDGE_BOUNDARY' THEN 'BRIDGE' ELSE 'UNKNOWN' END AS identity, coalesce(lookup, 'UNQUERIED') AS lookup,
  CASE WHEN class = 'SERVICE' THEN 'FIRST_IDENTIFIED_SERVICE' WHEN class = 'BRIDGE_BOUNDARY' THEN 'PROTOCOL_BOUNDARY' WHEN level >= {DEPTH} THEN 'DECLARED_DEPTH_BOUNDARY' ELSE 'FOLLOWED' END AS stop
  FROM r JOIN transfers t USING (event_id) LEFT JOIN reg ON account = recipient),
nw AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, recipient ORDER BY level, block, coalesce(tx_index, -1), tsec, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM st),
ct AS (SELECT *, count(*) OVER w >= {MOST_EVENTS} OR coalesce(sum(fresh) OVER w, 0) >= {MOST_ACCOUNTS} AS cut FROM nw WINDOW w AS (PARTITION BY query_id ORDER BY level, block, coalesce(tx_index, -1), tsec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def oracle_sql() -> dict[str, str]:
    return {
        "collection_states": f"{_STATES} SELECT query_id, level, event_id, recipient, identity, lookup, stop FROM st",
        "trace_membership": f"""{_STATES} SELECT DISTINCT s.level + 1 AS level, query_id, e.event_id, s.event_id AS arrival_id FROM st s JOIN transfers a ON a.event_id = s.event_id JOIN transfers e ON e.sender = a.recipient AND e.asset = a.asset
WHERE stop = 'FOLLOWED' AND e.tsec BETWEEN a.tsec AND least(a.tsec + {WINDOW}, {SCOPE_END}) AND e.block >= a.block AND e.success AND e.amount_raw > 0 AND e.recipient <> a.recipient AND ({_AFTER}) IS TRUE""",
        "collection_gaps": f"{_STATES} SELECT query_id, lookup AS reason, count(DISTINCT recipient) AS accounts FROM st WHERE lookup <> 'FROZEN_LOCAL_OBSERVATION' GROUP BY ALL",
        "collection_limits": f"{_STATES} SELECT query_id, count(*) AS states, count(*) FILTER (WHERE cut) AS cut, CAST(sum(event_id) FILTER (WHERE NOT cut) AS BIGINT) AS kept_ids FROM ct GROUP BY query_id",
        "collection_kept": f"{_STATES} SELECT query_id, level, event_id FROM ct WHERE NOT cut",
        "collection_status": f"""{_STATES} SELECT query_id, CASE WHEN bool_or(cut) THEN 'INTERRUPTED' WHEN bool_or(lookup = 'BUDGET_BLOCKED') THEN 'BUDGET_LIMIT' WHEN bool_or(stop = 'DECLARED_DEPTH_BOUNDARY') THEN 'PENDING_INTERVALS'
  WHEN bool_or(lookup <> 'FROZEN_LOCAL_OBSERVATION') THEN 'COMPLETE_WITH_UNRESOLVED' ELSE 'COMPLETE' END AS status FROM ct GROUP BY query_id""",
        "collection_invalidated": f"""{_STATES}, b AS (SELECT query_id, bool_or(event_id % 31 = 0) AS bad, count(*) AS n FROM st GROUP BY query_id)
SELECT query_id, CASE WHEN bad THEN 0 ELSE n END AS candidates, CASE WHEN bad THEN n ELSE 0 END AS invalidated, CASE WHEN bad THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS coverage FROM b""",
        "admission_rows": f"""WITH {TRANSFERS_SQL}, p AS (SELECT a.event_id AS a_event_id, e.event_id AS e_event_id, CASE WHEN NOT e.success THEN 'FAILED' WHEN e.amount_raw = 0 THEN 'ZERO' WHEN e.asset <> a.asset THEN 'OTHER_ASSET' WHEN e.recipient = a.recipient THEN 'SELF'
  WHEN e.tsec < a.tsec OR e.tsec > least(a.tsec + {WINDOW}, {SCOPE_END}) THEN 'OUTSIDE' WHEN ({_AFTER}) IS NULL THEN 'ORDER_UNRESOLVED' WHEN NOT ({_AFTER}) THEN 'NOT_AFTER' ELSE 'CANDIDATE' END AS reason
  FROM transfers e JOIN transfers a ON e.sender = a.recipient AND a.event_id % 50 = 0 AND abs(e.tsec - a.tsec) <= {WINDOW}) SELECT * FROM p WHERE reason IN ('CANDIDATE', 'ORDER_UNRESOLVED', 'ZERO')""",
        "fact_components": """WITH RECURSIVE f AS (SELECT l_orderkey * 8 + l_linenumber AS event_id, l_orderkey * 4 + l_partkey % 4 AS physical, l_orderkey, l_returnflag FROM lineitem),
e AS (SELECT DISTINCT l_orderkey, event_id, physical FROM f), n AS (SELECT DISTINCT a.event_id AS a, b.event_id AS b FROM e a JOIN e b USING (l_orderkey, physical)),
r AS (SELECT event_id AS node, event_id AS seen FROM e UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.seen), c AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT root AS first_id, count(*) AS versions, count(DISTINCT event_id) AS ids, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'CONFLICT' ELSE 'SOUND' END AS status FROM f JOIN c ON node = event_id GROUP BY root""",
        "identity_binding": "SELECT l_partkey % 17 = 0 OR l_partkey % 31 = 0 OR l_partkey % 23 = 0 OR l_partkey % 29 = 0 AS bad, count(*) AS n, CAST(sum(l_orderkey * 8 + l_linenumber) AS BIGINT) AS ids FROM lineitem GROUP BY 1",
        "graph_faults": "SELECT event_id, CASE WHEN event_id % 53 = 0 THEN 'UNKNOWN_FACT' WHEN event_id % 59 = 0 THEN 'CONFLICTED_FACT' ELSE 'amount_raw' END AS fault FROM events WHERE event_id % 53 = 0 OR event_id % 59 = 0 OR event_id % 61 = 0",
        "fact_enrichment": """WITH j AS (SELECT o_orderkey AS k, o_orderkey % 71 <> 0 AS old, o_orderkey % 73 <> 0 AS new FROM orders),
c AS (SELECT k, 'status' AS field, 'COMPATIBLE_FILL' AS change FROM j WHERE old AND new AND k % 5 = 0 UNION ALL SELECT k, 'customer', 'EXPLICIT_CHANGE' FROM j WHERE old AND new AND k % 13 = 0
  UNION ALL SELECT k, 'source', 'PROVENANCE_CHANGE' FROM j WHERE old AND new AND k % 11 = 0 UNION ALL SELECT k, '*', 'REMOVED' FROM j WHERE old AND NOT new UNION ALL SELECT k, '*', 'ADDED' FROM j WHERE new AND NOT old)
SELECT field, change, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM c GROUP BY ALL""",
        "revoked_results": """WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS f FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag) > 1),
r AS (SELECT l_orderkey AS request_id, l_orderkey * 8 + l_linenumber AS event_id FROM lineitem UNION SELECT l_orderkey - 1, l_orderkey * 8 + l_linenumber FROM lineitem)
SELECT request_id, event_id, CASE WHEN bool_or(event_id IN (SELECT f FROM c)) OVER (PARTITION BY request_id) THEN 'REVOKED' ELSE 'VALID' END AS state FROM r""",
        "conflicts_touching": """WITH c AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1)
SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INTEGER) AS id FROM orders WHERE (o_orderkey, o_orderkey % 7 + 1) IN (SELECT (l_orderkey, l_linenumber) FROM c)""",
    }
