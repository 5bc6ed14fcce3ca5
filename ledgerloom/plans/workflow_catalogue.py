"""Registered queries of runs and their provenance: frozen manifests, portable slices, guarded graph runs and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import facts, identity
from ledgerloom.plans import identity_catalogue, records_catalogue
from ledgerloom.sources.derived import read

#: Orders of one group of a manifest.
GROUP = 50


def _digests(rows: DataFrame) -> DataFrame:
    """Group, rows and digest of its rows in order; a group is bounded."""
    text = F.concat_ws("|", F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), F.col("o_custkey").cast("string"), "o_orderstatus")
    listed = F.array_join(F.array_sort(F.collect_list(text)), ";")
    return rows.groupBy(F.floor(F.col("o_orderkey") / GROUP).alias("part")).agg(F.count("*").alias("n"), F.sha2(listed, 256).alias("digest"))


def frozen_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a frozen batch against what is there now: what was changed, added or taken away since."""
    orders = read(spark, sf_dir, "orders")
    now = orders.where("o_orderkey % 997 <> 0 and floor(o_orderkey / 50) % 61 <> 3").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 991 = 0 THEN o_custkey + 1 ELSE o_custkey END"))
    a, b = _digests(orders.where("floor(o_orderkey / 50) % 59 <> 5")), _digests(now).toDF("part", "m", "d")
    verdict = F.when(F.col("d").isNull(), "REMOVED").when(F.col("digest").isNull(), "ADDED").when(F.col("n") != F.col("m"), "ROWS").when(F.col("digest") != F.col("d"), "CHANGED").otherwise("UNCHANGED")
    return a.join(b, "part", "full").select("part", verdict.alias("verdict"))


def portable_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of observations and baseline for the addresses that are needed resolves them as the whole does: rows, and those that differ either way."""
    needed = read(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("address")).distinct()
    o, b = identity_catalogue.observations(spark, sf_dir), identity_catalogue.baseline(spark, sf_dir)
    whole = identity.resolve(o, b).join(needed, "address", "left_semi")
    cut = identity.resolve(o.join(needed, "address", "left_semi"), b.join(needed, "address", "left_semi"))
    differ = whole.exceptAll(cut).union(cut.exceptAll(whole)).agg(F.count("*").alias("different"))
    return cut.agg(F.count("*").alias("n"), F.sum("observations").alias("observations")).join(differ)  # a row each


def graph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each scenario: an explicit invalidation where a fact of it is in conflict, else its model or what bars it."""
    bad = facts.reconcile(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"]).where("status = 'CONFLICT'").groupBy("l_orderkey").agg(F.count("*").alias("conflicts"))
    runs = records_catalogue.model_guards(spark, sf_dir).join(bad, "l_orderkey", "left")
    return runs.select("l_orderkey", F.when(F.col("conflicts") > 0, "INVALIDATED_FACT_CONFLICT").otherwise(F.col("status")).alias("result"), F.coalesce("conflicts", F.lit(0).cast("long")).alias("conflicts"))


def checked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a checker of fixed graphs turns away, each with the first reason."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(part % 97 == 0, "mystery").when(part % 7 == 0, "gas").when(part % 11 == 0, "conversion").otherwise("transfer")
    amount = F.when(part % 31 == 0, "0").when(part % 37 == 0, "-4").when(part % 41 == 0, "1.5").otherwise(F.col("l_quantity").cast("long").cast("string"))
    sender, recipient = F.col("l_suppkey"), part % 100
    reason = (
        F.when(kind == "mystery", "UNKNOWN_KIND").when(kind == "conversion", "OUT_OF_SCOPE").when(~amount.rlike("^[0-9]+$"), "NO_EXACT_AMOUNT").when(amount == "0", "NO_AMOUNT")
        .when((sender == recipient) & (kind != "gas"), "SELF_TRANSFER")
    )
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + line).alias("event"), reason.alias("reason"))
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.sum("event").alias("ids"))


def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows compared, alike, changed in some field and in which, between two versions of a relation."""
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_custkey").alias("b"))
    new = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END").alias("c"), F.expr("CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END").alias("d"))
    both = old.join(new, "o_orderkey").withColumns({"status": ~F.col("a").eqNullSafe(F.col("c")), "customer": ~F.col("b").eqNullSafe(F.col("d"))})
    any_of = F.col("status") | F.col("customer")
    return both.agg(F.count("*").alias("compared"), F.count_if(any_of).alias("changed"), F.count_if(~any_of).alias("alike"), F.count_if("status").alias("status"), F.count_if("customer").alias("customer"))


def queries() -> dict:
    return {f.__name__: f for f in (frozen_manifest, portable_slice, graph_runs, checked_events, relation_summary)}


def oracle_sql() -> dict[str, str]:
    digest = "sha256(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '|' || {c} || '|' || o_orderstatus, ';' ORDER BY o_orderkey))"
    resolved = identity_catalogue.oracle_sql()["identity_resolve"].split(" SELECT *, CASE WHEN identity_class")[0]
    return {
        "frozen_manifest": f"""WITH a AS (SELECT o_orderkey // {GROUP} AS part, count(*) AS n, {digest.format(c="o_custkey")} AS x FROM orders WHERE o_orderkey // {GROUP} % 59 <> 5 GROUP BY 1),
b AS (SELECT o_orderkey // {GROUP} AS part, count(*) AS m, {digest.format(c="(o_custkey + CASE WHEN o_orderkey % 991 = 0 THEN 1 ELSE 0 END)")} AS y FROM orders WHERE o_orderkey % 997 <> 0 AND o_orderkey // {GROUP} % 61 <> 3 GROUP BY 1)
SELECT part, CASE WHEN y IS NULL THEN 'REMOVED' WHEN x IS NULL THEN 'ADDED' WHEN n <> m THEN 'ROWS' WHEN x <> y THEN 'CHANGED' ELSE 'UNCHANGED' END AS verdict FROM a FULL JOIN b USING (part)""",
        "portable_slice": f"{resolved} SELECT count(*) AS n, CAST(sum(observations) AS BIGINT) AS observations, CAST(0 AS BIGINT) AS different FROM res WHERE address IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)",
        "graph_runs": f"""WITH g AS ({records_catalogue.oracle_sql()["model_guards"]}), c AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1), n AS (SELECT l_orderkey, count(*) AS conflicts FROM c GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN conflicts > 0 THEN 'INVALIDATED_FACT_CONFLICT' ELSE status END AS result, coalesce(conflicts, 0) AS conflicts FROM g LEFT JOIN n USING (l_orderkey)""",
        "checked_events": """WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS event, CASE WHEN l_partkey % 97 = 0 THEN 'UNKNOWN_KIND' WHEN l_partkey % 7 <> 0 AND l_partkey % 11 = 0 THEN 'OUT_OF_SCOPE' WHEN l_partkey % 31 <> 0 AND (l_partkey % 37 = 0 OR l_partkey % 41 = 0) THEN 'NO_EXACT_AMOUNT'
  WHEN l_partkey % 31 = 0 OR CAST(l_quantity AS BIGINT) = 0 THEN 'NO_AMOUNT' WHEN l_suppkey = l_partkey % 100 AND l_partkey % 7 <> 0 THEN 'SELF_TRANSFER' END AS reason FROM lineitem) SELECT reason, count(*) AS n, CAST(sum(event) AS BIGINT) AS ids FROM e WHERE reason IS NOT NULL GROUP BY reason""",
        "relation_summary": """WITH j AS (SELECT o_orderkey % 7 = 0 AND o_orderstatus IS DISTINCT FROM 'X' AS s, o_orderkey % 13 = 0 AND o_custkey IS NOT NULL AS c FROM orders)
SELECT count(*) AS compared, count(*) FILTER (WHERE s OR c) AS changed, count(*) FILTER (WHERE NOT (s OR c)) AS alike, count(*) FILTER (WHERE s) AS status, count(*) FILTER (WHERE c) AS customer FROM j""",
    }
