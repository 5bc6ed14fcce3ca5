"""Registered queries of the reference audit: order, certificates, relations and their metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import audit, order
from ledgerloom.plans.collect_catalogue import registry
from ledgerloom.sources.derived import TRANSFERS_SQL, transfers
from ledgerloom.sources.shared import Run, digest_of, stored

#: A pool of events is this long; each wait of the windowed variant at most this.
POOL, WAIT = 172_800, 21_600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers as reference events in pools; some lack their block, place or log."""
    k = F.col("event_id")
    t = transfers(spark, sf_dir)
    return t.select(
        F.floor(F.col("tsec") / POOL).alias("query_id"), "event_id", "sender", "recipient", "asset",
        F.when(k % 97 != 0, F.col("block")).alias("block"), F.when(k % 41 != 0, F.col("tx_index")).alias("tx_index"), "tx_hash",
        F.when(F.col("kind") == "erc20", F.col("log_index")).alias("log_index"), "kind", "tsec",
        F.when(k % 83 == 0, 0).when(k % 79 == 0, -F.col("amount_raw")).otherwise(F.col("amount_raw")).alias("amount"), F.col("success").alias("ok"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id 40 divides, but for every fifth pool, which has none."""
    return events(spark, sf_dir).where("event_id % 40 = 0 and query_id % 5 <> 0").select("query_id", "event_id")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("account", F.col("identity_class").alias("role"))


def identities_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities after a change of a few labels."""
    return identities(spark, sf_dir).withColumn("role", F.when(F.col("account") % 500 == 7, "SERVICE").otherwise(F.col("role")))


def _certified(spark: SparkSession, sf_dir: str, variant: str, known: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Certificates of a variant, with other identities or for some queries only if asked."""
    if known is None and queries is None:  # queries over the same files share a run
        run = Run(spark, f"certified|{POOL}|{WAIT}|{digest_of(spark, f'{sf_dir}/events.parquet')}")

        def found() -> DataFrame:
            e = run.step("events", lambda: events(spark, sf_dir))  # derived once, as each variant reads them many times
            s = run.step("seeds", lambda: seeds(spark, sf_dir))
            return audit.certificates(e, s, None if variant == "causal" else identities(spark, sf_dir), WAIT if variant == "window" else None)

        return run.step(variant, found)
    e, s = events(spark, sf_dir), seeds(spark, sf_dir)
    if queries is not None:
        e, s = (x.join(queries, "query_id", "left_semi") for x in (e, s))
    return audit.certificates(e, s, None if variant == "causal" else known or identities(spark, sf_dir), WAIT if variant == "window" else None)


def strict_before_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain and uncertain order of events of a pool that one account and asset links."""
    e = events(spark, sf_dir)
    a, b = (e.select(*[F.col(c).alias(f"{p}_{c}") for c in e.columns]) for p in "ab")
    met = (F.col("a_query_id") == F.col("b_query_id")) & (F.col("a_recipient") == F.col("b_sender")) & (F.col("a_asset") == F.col("b_asset"))
    verdict = audit.strictly_before(lambda f: F.col(f"a_{f}"), lambda f: F.col(f"b_{f}"))
    return a.join(b, met).groupBy(F.coalesce(verdict.cast("string"), F.lit("unknown")).alias("before")).agg(F.count("*").alias("n"), F.sum("b_event_id").alias("ids"))


def event_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of events of a pool in the two orders of presentation."""
    e = events(spark, sf_dir)
    by = Window.partitionBy("query_id")
    return e.select(
        "query_id", "event_id", F.row_number().over(by.orderBy(audit.event_order(F.col))).alias("audit_place"),
        F.row_number().over(by.orderBy(F.col("block").asc_nulls_first(), F.coalesce("tx_index", F.lit(-1)), "tsec", "event_id")).alias("stable_place"),
    )


def reference_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a query's audit reads: those of its incident, and its seeds, from wherever they are."""
    e = events(spark, sf_dir)
    asked = seeds(spark, sf_dir).select(((F.col("query_id") + F.col("event_id")) % 7).alias("incident"), "event_id")
    members = e.select((F.col("query_id") % 7).alias("incident"), "event_id").join(asked.select("incident").distinct(), "incident", "left_semi")
    return members.union(asked).distinct().groupBy("incident").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def reference_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that chains reach: by order alone, not past stop roles, and with bounded waits."""
    found = [_certified(spark, sf_dir, v).select(F.lit(v).alias("variant"), "query_id", "event_id") for v in ("causal", "policy", "window")]
    return found[0].union(found[1]).union(found[2])


def reference_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates themselves. Beyond SQL, as each goes by its predecessors' own; tested against a sequential pass."""
    c = _certified(spark, sf_dir, "policy")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return c.select("query_id", "event_id", text("path").alias("path"), text("unknown").alias("unknown"), "depth", "max_wait")


def _relations(spark: SparkSession, sf_dir: str, known: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Entries (events whose id 3 divides with rest 1) with all that their status depends on."""
    e = events(spark, sf_dir)
    e = e if queries is None else e.join(queries, "query_id", "left_semi")
    s = seeds(spark, sf_dir).join(e, ["query_id", "event_id"])
    firsts = s.groupBy("query_id").agg(F.min("tsec").alias("first_seed_time"), (F.count_if(~(F.col("ok") & (F.col("amount") > 0))) == 0).alias("seeds_positive"), F.collect_set("asset").alias("assets"))  # two assets
    flag = lambda v, name, *more: _certified(spark, sf_dir, v, known, queries).select("query_id", "event_id", F.lit(True).alias(name), *more)
    df = e.where("event_id % 3 = 1").join(firsts, "query_id", "left").join(flag("policy", "certified", "depth"), ["query_id", "event_id"], "left")
    df = df.join(flag("causal", "reached"), ["query_id", "event_id"], "left").join(flag("window", "within"), ["query_id", "event_id"], "left")
    df = df.join(audit.boundaries(_certified(spark, sf_dir, "causal", known, queries), e, known or identities(spark, sf_dir)), ["query_id", "event_id"], "left")
    df = df.join((known or identities(spark, sf_dir)).withColumnRenamed("account", "recipient"), "recipient", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumns(
        {
            "seeds_known": F.col("first_seed_time").isNotNull(), "entry_known": F.col("event_id") % 67 != 0, "entry_time": F.col("tsec"), "amount_status": order.amount_status(F.col("amount").cast("string")),
            "role": F.coalesce("role", F.lit("UNKNOWN")), "actor": F.when(F.col("recipient") % 20 != 3, F.col("recipient")), "certified": no("certified"), "reached": no("reached"), "first_boundary": no("first_boundary"), "within": no("within"),
            "disjoint_rule": F.col("query_id") % 4 == 0, "asset_seeded": no(F.array_contains("assets", F.col("asset"))), "seeds_positive": no("seeds_positive"),
        }
    )
    return audit.relation_status(df)


def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).select("query_id", "event_id", "status", "reason", F.when(F.col("status") == "VERIFIED_TASK_REFERENCE", F.when(F.col("within"), "WITHIN").otherwise("OUTSIDE")).otherwise("NOT_APPLICABLE").alias("window"))


def _maintained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Relations after a change of labels, from those before it, and the queries that the change reaches."""
    columns = ["query_id", "event_id", "recipient", "status", "reason"]
    was, now = identities(spark, sf_dir), identities_after(spark, sf_dir)
    old = stored(_relations(spark, sf_dir).select(columns), "relations-before")
    changed = was.join(now.withColumnRenamed("role", "is"), "account").where("role <> is")
    reached = stored(audit.affected(events(spark, sf_dir), old, changed), "reached")
    return audit.maintained(old, reached, lambda queries: _relations(spark, sf_dir, now, queries).select(columns)), reached


def reference_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses after a change of labels: only the queries that it reaches are computed anew."""
    return _maintained(spark, sf_dir)[0].drop("recipient")


def reference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct units of verified relations, of those within the window too, and the count of each reason."""
    r = _relations(spark, sf_dir).where("status = 'VERIFIED_TASK_REFERENCE'")
    units = lambda df, name: df.agg(
        F.lit(name).alias("pool"), F.count("*").alias("relations"), F.count_distinct("query_id").alias("queries"), F.count_distinct("recipient").alias("addresses"),
        F.count_distinct("query_id", "recipient").alias("pairs"), F.count_distinct("event_id").alias("entries"), F.count_distinct("actor").alias("actors"),
    )
    return units(r, "B").union(units(r.where("within"), "C"))


def reference_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def queries() -> dict:
    found = (strict_before_pairs, event_sort, reference_pools, reference_reach, reference_certificates, reference_status, reference_maintained, reference_metrics, reference_reasons)
    return {f.__name__: f for f in found}


_EVENTS = f"""WITH RECURSIVE {TRANSFERS_SQL},
ev AS (SELECT tsec // {POOL} AS query_id, event_id, sender, recipient, asset, CASE WHEN event_id % 97 <> 0 THEN block END AS block, CASE WHEN event_id % 41 <> 0 THEN tx_index END AS tx_index, tx_hash,
  CASE WHEN kind = 'erc20' THEN log_index END AS log_index, kind, tsec, CASE WHEN event_id % 83 = 0 THEN 0 WHEN event_id % 79 = 0 THEN -amount_raw ELSE amount_raw END AS amount, success AS ok FROM transfers),
sd AS (SELECT query_id, event_id FROM ev WHERE event_id % 40 = 0 AND query_id % 5 <> 0),
rg AS (SELECT DISTINCT user_id AS account, CASE user_id % 10 WHEN 3 THEN 'SERVICE' WHEN 7 THEN 'BRIDGE_BOUNDARY' WHEN 5 THEN 'CONFLICTED_IDENTITY' ELSE 'UNKNOWN' END AS role FROM events WHERE user_id % 10 <> 9)"""
_AFTER_CHANGE = _EVENTS.replace("CASE user_id % 10", "CASE WHEN user_id % 500 = 7 THEN 'SERVICE' ELSE CASE user_id % 10").replace("ELSE 'UNKNOWN' END AS role", "ELSE 'UNKNOWN' END END AS role")
_BEFORE = """CASE WHEN a.event_id = b.event_id THEN false WHEN a.block <> b.block THEN a.block < b.block WHEN a.block IS NOT NULL AND b.block IS NOT NULL AND a.tx_hash <> b.tx_hash THEN a.tx_index < b.tx_index
  WHEN (a.block IS NULL OR b.block IS NULL) AND a.tsec <> b.tsec THEN a.tsec < b.tsec WHEN a.tx_hash <> b.tx_hash THEN NULL WHEN a.log_index IS NOT NULL AND b.log_index IS NOT NULL THEN a.log_index < b.log_index
  WHEN a.kind = 'top' AND b.kind <> 'top' THEN true WHEN b.kind = 'top' AND a.kind <> 'top' THEN false END"""


def _sort(t: str) -> str:
    return f"(coalesce({t}.block, 0), coalesce({t}.tx_index, 0), CASE WHEN {t}.kind = 'top' THEN 0 ELSE 1 END, coalesce({t}.log_index, 0), {t}.event_id)"


_REACH = f"""rl AS (SELECT ev.*, sd.event_id IS NOT NULL AS seed FROM ev LEFT JOIN sd ON sd.event_id = ev.event_id WHERE ok AND amount > 0),
ln AS (SELECT b.query_id, a.event_id AS p, b.event_id AS e, b.tsec - a.tsec AS wait, coalesce(role, 'UNKNOWN') IN ('SERVICE', 'BRIDGE_BOUNDARY', 'MIXER_BOUNDARY', 'DEX_OR_PROTOCOL', 'CONFLICTED_IDENTITY') AS stop
  FROM rl a JOIN rl b ON a.query_id = b.query_id AND a.recipient = b.sender AND a.asset = b.asset LEFT JOIN rg ON account = b.sender WHERE (a.seed OR a.sender <> a.recipient) AND NOT b.seed AND (a.seed OR {_sort("a")} < {_sort("b")}) AND ({_BEFORE}) IS TRUE),
rc AS (SELECT v AS variant, query_id, event_id FROM rl, (VALUES ('causal'), ('policy'), ('window')) t(v) WHERE seed
  UNION SELECT rc.variant, ln.query_id, e FROM rc JOIN ln ON rc.event_id = p WHERE (variant = 'causal' OR NOT stop) AND (variant <> 'window' OR wait <= {WAIT}))"""
_RELATIONS = f"""fs AS (SELECT query_id, min(tsec) AS first, bool_and(ok AND amount > 0) AS positive, bool_or(asset = 0) AS a0, bool_or(asset = 1) AS a1 FROM ev JOIN sd USING (query_id, event_id) GROUP BY query_id),
cp(event_id, path) USING KEY (event_id) AS (SELECT event_id, [event_id] FROM rl WHERE seed UNION SELECT c.event_id, c.path FROM
  (SELECT ln.e AS event_id, min(list_append(cp.path, ln.e)) AS path FROM cp JOIN ln ON ln.p = cp.event_id GROUP BY ln.e) c LEFT JOIN recurring.cp r ON r.event_id = c.event_id WHERE r.path IS NULL OR c.path < r.path),
bo AS (SELECT x.event_id, bool_and(role IN ('SERVICE', 'BRIDGE_BOUNDARY', 'MIXER_BOUNDARY')) AS firsts FROM (SELECT event_id, unnest(path[:-2]) AS at FROM cp) x JOIN ev ON ev.event_id = x.at JOIN rg ON account = ev.recipient
  WHERE role IN ('SERVICE', 'BRIDGE_BOUNDARY', 'MIXER_BOUNDARY', 'DEX_OR_PROTOCOL', 'CONFLICTED_IDENTITY') GROUP BY x.event_id),
wr AS (SELECT ev.*, first, coalesce((SELECT firsts FROM bo WHERE bo.event_id = ev.event_id), false) AS firsts, coalesce(positive, false) AS positive, CASE WHEN asset = 0 THEN coalesce(a0, false) ELSE coalesce(a1, false) END AS seeded, coalesce(role, 'UNKNOWN') AS role, CASE WHEN recipient % 20 <> 3 THEN recipient END AS actor,
  EXISTS (SELECT 1 FROM rc WHERE variant = 'causal' AND rc.event_id = ev.event_id) AS reached, EXISTS (SELECT 1 FROM rc WHERE variant = 'policy' AND rc.event_id = ev.event_id) AS certified, EXISTS (SELECT 1 FROM rc WHERE variant = 'window' AND rc.event_id = ev.event_id) AS within,
  EXISTS (SELECT 1 FROM sd WHERE sd.event_id = ev.event_id) AS seed FROM ev LEFT JOIN fs USING (query_id) LEFT JOIN rg ON account = recipient WHERE event_id % 3 = 1),
rr AS (SELECT *, CASE WHEN first IS NOT NULL AND event_id % 67 <> 0 AND tsec < first THEN 'ENTRY_BEFORE_EARLIEST_SEED' WHEN first IS NULL THEN 'EXACT_SEED_UNRESOLVED' WHEN event_id % 67 = 0 THEN 'EXACT_ENTRY_UNRESOLVED' WHEN NOT positive THEN 'SEED_POSITIVE_AMOUNT_UNRESOLVED'
  WHEN amount = 0 THEN 'ENTRY_AMOUNT_ZERO' WHEN amount < 0 THEN 'ENTRY_AMOUNT_NEGATIVE' WHEN role = 'BRIDGE_BOUNDARY' THEN role WHEN role = 'CONFLICTED_IDENTITY' THEN 'TARGET_IDENTITY_CONFLICT' WHEN role <> 'SERVICE' OR actor IS NULL THEN 'TARGET_SERVICE_IDENTITY_UNRESOLVED'
  WHEN certified AND query_id % 4 = 0 THEN 'S3_INJECTION_DISJOINTNESS_UNRESOLVED' WHEN certified THEN CASE WHEN seed THEN 'EXACT_ZERO_HOP_SERVICE_ENTRY' ELSE 'STRICT_POSITIVE_SAME_ASSET_FIRST_IDENTIFIED_SERVICE' END
  WHEN reached AND firsts THEN 'KNOWN_FIRST_SERVICE_OR_BOUNDARY_BLOCKS_AVAILABLE_CERTIFICATES' WHEN reached THEN 'KNOWN_PROTOCOL_OR_CONFLICT_BOUNDARY_ON_AVAILABLE_CERTIFICATE' WHEN NOT seeded THEN 'PROTOCOL_SEMANTICS_UNRESOLVED' ELSE 'NO_STRICT_SAME_ASSET_REFERENCE_CHAIN' END AS reason FROM wr),
ss AS (SELECT *, CASE WHEN reason = 'ENTRY_BEFORE_EARLIEST_SEED' THEN 'REJECTED_ASSOCIATION' WHEN reason = 'BRIDGE_BOUNDARY' THEN 'OUTSIDE_CURRENT_SERVICE_TARGET_SCOPE' WHEN reason IN ('EXACT_ZERO_HOP_SERVICE_ENTRY', 'STRICT_POSITIVE_SAME_ASSET_FIRST_IDENTIFIED_SERVICE') THEN 'VERIFIED_TASK_REFERENCE' ELSE 'UNRESOLVED' END AS status FROM rr)"""


def oracle_sql() -> dict[str, str]:
    units = "count(*) AS relations, count(DISTINCT query_id) AS queries, count(DISTINCT recipient) AS addresses, count(DISTINCT (query_id, recipient)) AS pairs, count(DISTINCT event_id) AS entries, count(DISTINCT actor) AS actors FROM ss WHERE status = 'VERIFIED_TASK_REFERENCE'"
    return {
        "strict_before_pairs": f"{_EVENTS} SELECT coalesce(CAST({_BEFORE} AS VARCHAR), 'unknown') AS before, count(*) AS n, CAST(sum(b.event_id) AS BIGINT) AS ids FROM ev a JOIN ev b ON a.query_id = b.query_id AND a.recipient = b.sender AND a.asset = b.asset GROUP BY 1",
        "event_sort": f"""{_EVENTS} SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(block, 0), coalesce(tx_index, 0), CASE WHEN kind = 'top' THEN 0 ELSE 1 END, coalesce(log_index, 0), event_id) AS audit_place,
  row_number() OVER (PARTITION BY query_id ORDER BY block NULLS FIRST, coalesce(tx_index, -1), tsec, event_id) AS stable_place FROM ev""",
        "reference_pools": f"""{_EVENTS}, q AS (SELECT (query_id + event_id) % 7 AS incident, event_id FROM sd), u AS (SELECT query_id % 7 AS incident, event_id FROM ev WHERE query_id % 7 IN (SELECT incident FROM q) UNION SELECT * FROM q)
SELECT incident, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM u GROUP BY incident""",
        "reference_reach": f"{_EVENTS}, {_REACH} SELECT * FROM rc",
        "reference_status": f"{_EVENTS}, {_REACH}, {_RELATIONS} SELECT query_id, event_id, status, reason, CASE WHEN status <> 'VERIFIED_TASK_REFERENCE' THEN 'NOT_APPLICABLE' WHEN within THEN 'WITHIN' ELSE 'OUTSIDE' END AS \"window\" FROM ss",
        "reference_maintained": f"{_AFTER_CHANGE}, {_REACH}, {_RELATIONS} SELECT query_id, event_id, status, reason FROM ss",
        "reference_metrics": f"{_EVENTS}, {_REACH}, {_RELATIONS} SELECT 'B' AS pool, {units} UNION ALL SELECT 'C', {units} AND within",
        "reference_reasons": f"{_EVENTS}, {_REACH}, {_RELATIONS} SELECT status, reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ss GROUP BY ALL",
    }
