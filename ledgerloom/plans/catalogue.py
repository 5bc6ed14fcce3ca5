"""The registered queries of the value-flow operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import counted, facts, frontier, labels, ledger, order
from ledgerloom.sources.derived import TRANSFERS_SQL, read, transfers
from ledgerloom.sources.shared import stored

WINDOW, DEPTH, SEEDS = 172_800, 3, 20
FACT_FIELDS = ["l_returnflag", "l_linestatus"]


def transfers_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("recipient", "amount_raw", "tsec", "block", "tx_index")]
    return transfers(spark, sf_dir).groupBy("kind", "success").agg(F.count("*").alias("n"), *sums)


def endpoint_or_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir)
    ends = t.select("event_id", F.explode(F.array_distinct(F.array("sender", "recipient"))).alias("account"))
    return ends.groupBy("account").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _pairs(spark: SparkSession, sf_dir: str, span: int, ends: tuple[str, ...]) -> DataFrame:
    """Arrivals (a_) with the transfers (e_) within `span` seconds that their recipient is an endpoint of: joined on the account and a slot of
    time, each transfer under its distinct endpoints, so that no pair comes twice."""
    t = transfers(spark, sf_dir)
    a = t.select(*[F.col(c).alias(f"a_{c}") for c in t.columns], F.col("recipient").alias("account"), F.explode(F.sequence(F.floor(F.col("tsec") / span) - 1, F.floor(F.col("tsec") / span) + 1)).alias("slot"))
    e = t.select(*[F.col(c).alias(f"e_{c}") for c in t.columns], F.explode(F.array_distinct(F.array(*ends))).alias("account"), F.floor(F.col("tsec") / span).alias("slot"))
    # Pairs outnumber the rows they come from by far, so both sides are dealt, however small.
    return e.join(a.hint("merge"), ["account", "slot"]).where(F.abs(F.col("e_tsec") - F.col("a_tsec")) <= span)


def _e(f):
    return F.col(f"e_{f}")


def _a(f):
    return F.col(f"a_{f}")


def strict_order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, 7200, ("sender",))
    verdict = F.coalesce(order.strictly_after(_e, _a).cast("string"), F.lit("unknown"))
    return pairs.groupBy(verdict.alias("after")).agg(F.count("*").alias("n"), F.sum("e_event_id").alias("ids"))


def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted.admissions(stored(transfers(spark, sf_dir), "transfers"), WINDOW)


def amount_status_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 5 WHEN 0 THEN cast(cast(value AS bigint) AS string) WHEN 1 THEN '-' || cast(event_id AS string) WHEN 2 THEN '000' WHEN 3 THEN element_at(array(' 5 ', '   ', '+7', '12x', '', '5 '), cast(event_id div 5 % 6 + 1 AS int)) END")
    return read(spark, sf_dir, "events").select(text.alias("v")).groupBy(order.amount_status(F.col("v")).alias("status")).agg(F.count("*").alias("n"))


def trace_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir)
    seeds = t.where(F.col("success") & (F.col("sender") != F.col("recipient")) & (F.col("amount_raw") > 0)).orderBy("event_id").limit(SEEDS)
    found = frontier.trace(t, seeds, DEPTH, WINDOW, lambda account: account % 10 == 3)
    return found.select("level", "event_id", "sender", "recipient", "amount_raw")


def ancestor_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir).where("kind = 'internal'")
    path = F.expr("slice(array(event_id % 4, event_id % 3, event_id % 2), 1, cast(event_id % 3 + 1 as int))")
    t = t.withColumn("path", path)
    failed = t.where("not success or amount_raw % 3 = 0").select("block", "tx_index", F.col("path").alias("prefix"))
    # Each trace meets its own prefixes: an anti-join on equal keys only.
    prefixes = t.select("event_id", "block", "tx_index", F.explode(F.expr("transform(sequence(1, size(path)), n -> slice(path, 1, n))")).alias("prefix"), F.size("path").alias("size"))
    hit = prefixes.where(F.size("prefix") < F.col("size")).join(failed, ["block", "tx_index", "prefix"], "left_semi").select("event_id")
    return t.join(hit, "event_id", "left_anti").select("event_id", "block", "tx_index", F.array_join(F.transform("path", lambda x: x.cast("string")), "_").alias("path"))


def coverage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir)
    jobs = t.groupBy("sender").agg(F.min("block").alias("start"), F.max("block").alias("end"))
    asked = t.select("event_id", "recipient", "block")
    inside = (F.col("start") <= F.col("block")) & (F.col("block") + 12 <= F.col("end"))
    found = asked.join(jobs, F.col("recipient") == F.col("sender"), "left")
    return found.groupBy(F.coalesce(inside, F.lit(False)).alias("covered")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def fact_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.reconcile(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], FACT_FIELDS)


def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_enriched(spark, sf_dir).groupBy("status", "conflicts").agg(F.count("*").alias("facts"), F.sum("versions").alias("versions"))


def fact_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = facts.quarantined(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], FACT_FIELDS)
    return bad.select("l_orderkey", "l_linenumber", *FACT_FIELDS, "l_partkey")


def registry_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.contradictions(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("address"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "PRIORITY").otherwise("OTHER").alias("platform"),
        F.concat(F.lit("A"), (F.col("o_orderkey") % 2).cast("string")).alias("actor"),
        F.when(F.col("o_orderstatus") == "F", "SERVICE").when(F.col("o_orderstatus") == "O", "BRIDGE_BOUNDARY").otherwise("UNKNOWN").alias("role"),
    )


def label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"))
    return labels.resolve(addresses, _observations(spark, sf_dir))


def label_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"))
    matches = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), F.col("o_orderstatus").alias("source"))
    return labels.opportunities(addresses, ["F", "O", "P"], matches)


def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = read(spark, sf_dir, "events").select(F.col("user_id").alias("attempt"), F.col("event_type").alias("state"), F.col("event_id").alias("n"))
    return ledger.journal_state(moves)


def ledger_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir).where("success")
    leg = lambda c, s: t.select(F.col(c).alias("account"), "asset", F.col("event_id").alias("ord"), F.lit(s).alias("sign"), F.col("amount_raw").alias("amount"))
    return ledger.running_balance(leg("sender", -1).union(leg("recipient", 1))).select("account", "asset", "ord", "sign", "balance")


def collection_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir).select("event_id", "sender", "recipient", "amount_raw")
    other = t.where("event_id % 97 <> 0").withColumn("amount_raw", F.expr("CASE WHEN event_id % 89 = 0 THEN amount_raw + 1 ELSE amount_raw END"))
    return t.exceptAll(other).withColumn("side", F.lit("left")).union(other.exceptAll(t).withColumn("side", F.lit("right")))


def queries() -> dict:
    found = (
        transfers_checksum, endpoint_or_match, strict_order_pairs, admission_reasons, amount_status_hist, trace_frontier, ancestor_anti, coverage_containment,
        fact_enriched, fact_conflicts, fact_quarantine, registry_contradictions, label_resolve, label_opportunities, journal_state, ledger_running_balance, collection_equality,
    )
    return {f.__name__: f for f in found}


_AFTER = """CASE WHEN e.event_id = a.event_id THEN false WHEN e.block <> a.block THEN e.block > a.block WHEN e.tx_hash <> a.tx_hash THEN e.tx_index > a.tx_index
  WHEN a.kind = 'top' AND e.kind IN ('internal', 'erc20') THEN true WHEN e.kind = 'top' THEN false
  WHEN e.kind = 'erc20' AND a.kind = 'erc20' THEN e.log_index > a.log_index END"""
_FACTS = """f AS (SELECT l_orderkey, l_linenumber, count(*) AS versions, min(l_returnflag) AS a, max(l_returnflag) AS b, min(l_linestatus) AS c, max(l_linestatus) AS d FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, l_linenumber, versions, CASE WHEN a <> b OR c <> d THEN 'CONFLICT' WHEN versions > 1 THEN 'MERGED' ELSE 'SINGLE' END AS status,
  concat_ws(',', CASE WHEN a <> b THEN 'l_returnflag' END, CASE WHEN c <> d THEN 'l_linestatus' END) AS conflicts,
  CASE WHEN a = b THEN a END AS l_returnflag, CASE WHEN c = d THEN c END AS l_linestatus FROM f)"""


def oracle_sql() -> dict[str, str]:
    t = f"WITH {TRANSFERS_SQL}"
    return {
        "transfers_checksum": f"{t} SELECT kind, success, count(*) AS n, CAST(sum(recipient) AS BIGINT) AS sum_recipient, CAST(sum(amount_raw) AS BIGINT) AS sum_amount_raw, CAST(sum(tsec) AS BIGINT) AS sum_tsec, CAST(sum(block) AS BIGINT) AS sum_block, CAST(sum(tx_index) AS BIGINT) AS sum_tx_index FROM transfers GROUP BY kind, success",
        "endpoint_or_match": f"{t}, u AS (SELECT DISTINCT sender AS account FROM transfers UNION SELECT recipient FROM transfers) SELECT account, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM u JOIN transfers ON sender = account OR recipient = account GROUP BY account",
        "strict_order_pairs": f"{t} SELECT coalesce(CAST({_AFTER} AS VARCHAR), 'unknown') AS after, count(*) AS n, CAST(sum(e.event_id) AS BIGINT) AS ids FROM transfers e JOIN transfers a ON e.sender = a.recipient AND abs(e.tsec - a.tsec) <= 7200 GROUP BY 1",
        "admission_reasons": f"""{t} SELECT CASE WHEN NOT e.success THEN 'FAILED' WHEN e.amount_raw = 0 THEN 'ZERO' WHEN e.asset <> a.asset THEN 'OTHER_ASSET' WHEN e.sender <> a.recipient THEN 'INFLOW'
  WHEN e.recipient = a.recipient THEN 'SELF' WHEN e.tsec < a.tsec OR e.tsec > a.tsec + {WINDOW} THEN 'OUTSIDE' WHEN ({_AFTER}) IS NULL THEN 'ORDER_UNRESOLVED' WHEN NOT ({_AFTER}) THEN 'NOT_AFTER' ELSE 'CANDIDATE' END AS reason,
  count(*) AS n, CAST(sum(e.event_id) AS BIGINT) AS ids FROM transfers e JOIN transfers a ON (e.sender = a.recipient OR e.recipient = a.recipient) AND abs(e.tsec - a.tsec) <= {WINDOW} GROUP BY 1""",
        "amount_status_hist": """WITH v AS (SELECT CASE event_id % 5 WHEN 0 THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) WHEN 1 THEN '-' || event_id WHEN 2 THEN '000' WHEN 3 THEN [' 5 ', '   ', '+7', '12x', '', '5 '][event_id // 5 % 6 + 1] END AS v FROM events)
SELECT CASE WHEN v IS NULL OR v = '' THEN 'MISSING' WHEN NOT regexp_full_match(v, '[+-]?[0-9]+') THEN 'INVALID' WHEN NOT regexp_matches(v, '[1-9]') THEN 'ZERO' WHEN v LIKE '-%' THEN 'NEGATIVE' ELSE 'POSITIVE' END AS status, count(*) AS n FROM v GROUP BY 1""",
        "trace_frontier": f"""WITH RECURSIVE {TRANSFERS_SQL}, s AS (SELECT * FROM transfers WHERE success AND sender <> recipient AND amount_raw > 0 ORDER BY event_id LIMIT {SEEDS}),
r AS (SELECT 0 AS level, event_id FROM s UNION SELECT r.level + 1, e.event_id FROM r JOIN transfers a ON a.event_id = r.event_id JOIN transfers e ON e.sender = a.recipient AND e.asset = a.asset
  WHERE r.level < {DEPTH} AND a.recipient % 10 <> 3 AND e.tsec BETWEEN a.tsec AND a.tsec + {WINDOW} AND e.block >= a.block AND e.success AND e.amount_raw > 0 AND e.recipient <> a.recipient AND ({_AFTER}) IS TRUE)
SELECT level, event_id, sender, recipient, amount_raw FROM r JOIN transfers USING (event_id)""",
        "ancestor_anti": f"""{t}, p AS (SELECT *, list_slice([event_id % 4, event_id % 3, event_id % 2], 1, event_id % 3 + 1) AS path FROM transfers WHERE kind = 'internal')
SELECT event_id, block, tx_index, array_to_string(path, '_') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM p a WHERE a.block = p.block AND a.tx_index = p.tx_index AND (NOT a.success OR a.amount_raw % 3 = 0) AND len(a.path) < len(p.path) AND list_slice(p.path, 1, len(a.path)) = a.path)""",
        "coverage_containment": f"""{t}, j AS (SELECT sender, min(block) AS s, max(block) AS e FROM transfers GROUP BY sender)
SELECT coalesce(s <= block AND block + 12 <= e, false) AS covered, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM transfers q LEFT JOIN j ON q.recipient = j.sender GROUP BY 1""",
        "fact_enriched": f"WITH {_FACTS} SELECT * FROM g",
        "fact_conflicts": f"WITH {_FACTS} SELECT status, conflicts, count(*) AS facts, CAST(sum(versions) AS BIGINT) AS versions FROM g GROUP BY ALL",
        "fact_quarantine": f"WITH {_FACTS} SELECT l_orderkey, l_linenumber, l.l_returnflag, l.l_linestatus, l_partkey FROM lineitem l JOIN g USING (l_orderkey, l_linenumber) WHERE status = 'CONFLICT'",
        "registry_contradictions": "SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS kinds FROM orders GROUP BY o_custkey HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1",
        "label_resolve": """WITH o AS (SELECT o_custkey AS address, o_orderpriority = '1-URGENT' AS first, 'A' || (o_orderkey % 2) AS actor, CASE o_orderstatus WHEN 'F' THEN 'SERVICE' WHEN 'O' THEN 'BRIDGE_BOUNDARY' ELSE 'UNKNOWN' END AS role FROM orders),
c AS (SELECT address, first, CASE WHEN count(DISTINCT actor) = 1 AND count(DISTINCT role) = 1 THEN min(actor) END AS actor, min(role) AS role FROM o GROUP BY address, first),
b AS (SELECT c_custkey AS address, coalesce(p.first, q.first) AS first, CASE WHEN p.first THEN p.actor ELSE q.actor END AS actor, CASE WHEN p.first THEN p.role ELSE q.role END AS role
  FROM customer LEFT JOIN c p ON p.address = c_custkey AND p.first LEFT JOIN c q ON q.address = c_custkey AND NOT q.first)
SELECT address, CASE WHEN first IS NULL THEN 'BASELINE' ELSE CASE WHEN first THEN 'PRIORITY' ELSE 'OTHER' END || CASE WHEN actor IS NULL THEN '_CONFLICT' ELSE '' END END AS rule, actor, CASE WHEN actor IS NULL THEN 'UNKNOWN' ELSE role END AS role FROM b""",
        "label_opportunities": "SELECT c_custkey AS address, source, count(o_orderkey) AS matches, CASE WHEN count(o_orderkey) > 0 THEN 'MATCH' ELSE 'NO_MATCH' END AS outcome FROM customer CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(source) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = source GROUP BY c_custkey, source",
        "journal_state": "SELECT user_id AS attempt, arg_max(event_type, event_id) AS state, count(*) AS changes FROM events GROUP BY user_id",
        "ledger_running_balance": f"""{t}, m AS (SELECT sender AS account, asset, event_id AS ord, -1 AS sign, amount_raw FROM transfers WHERE success UNION ALL SELECT recipient, asset, event_id, 1, amount_raw FROM transfers WHERE success)
SELECT account, asset, ord, sign, CAST(sum(sign * amount_raw) OVER (PARTITION BY account, asset ORDER BY ord, sign ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM m""",
        "collection_equality": f"""{t}, x AS (SELECT event_id, sender, recipient, amount_raw FROM transfers), y AS (SELECT event_id, sender, recipient, CASE WHEN event_id % 89 = 0 THEN amount_raw + 1 ELSE amount_raw END AS amount_raw FROM x WHERE event_id % 97 <> 0)
SELECT *, 'left' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)""",
    }
