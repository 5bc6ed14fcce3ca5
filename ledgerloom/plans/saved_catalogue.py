"""Registered queries of saved results: written as pages with faults, read back by the data source, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import batch, normalise
from ledgerloom.plans.collect_catalogue import registry
from ledgerloom.sources import saved
from ledgerloom.sources.derived import TRANSFERS_SQL, read, transfers
from ledgerloom.sources.shared import shared_folder

#: Jobs per table, and rows of a page.
JOBS, PAGE = 48, 60


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of jobs, a job for each remainder of their customers."""
    o = read(spark, sf_dir, "orders")
    job = (F.col("o_custkey") % JOBS).alias("job")
    rows = o.select(job, F.col("o_orderkey").alias("key"), F.to_json(F.struct(F.col("o_custkey").alias("account"), F.floor(F.col("o_totalprice") * 100).cast("long").cast("string").alias("amount"), F.col("o_orderkey").alias("key"))).alias("row"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy("key")) - 1)
    totals = rows.groupBy("job").agg(F.count("*").alias("total"))
    pages = rows.groupBy("job", (F.floor(F.col("place") / PAGE) * PAGE).alias("offset")).agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))  # PAGE rows at most
    return pages.join(totals, "job")


def _files(pages: DataFrame) -> DataFrame:
    """Their files, with a fault in five of seven jobs."""
    fault, job, offset, n = F.col("job") % 7, F.col("job"), F.col("offset"), F.size("rows")
    last = offset + n == F.col("total")
    total = F.col("total") + F.when((fault == 3) & last, 1).otherwise(0)
    following = F.when(~last, F.concat(F.lit(',"next_offset":'), (offset + n).cast("string"))).otherwise(F.lit(""))
    execution = F.concat(F.lit("01X"), job.cast("string"))
    meta = F.concat(F.lit('{"total_row_count":'), total.cast("string"), F.lit(',"row_count":'), (n + F.when((fault == 5) & last, 1).otherwise(0)).cast("string"), F.lit("}"))
    body = F.concat(F.lit('{"execution_id":"'), execution, F.lit('","state":"QUERY_STATE_COMPLETED","result":{"rows":['), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit('],"metadata":'), meta, F.lit("}"), following, F.lit("}"))
    pages = pages.withColumns({"body": body, "folder": F.concat(F.lit("account="), (job * 3).cast("string"), F.lit("/job=j"), job.cast("string"))})
    receipt = F.to_json(F.struct(F.lit(200).alias("http_status"), F.sha2("body", 256).alias("sha256"), F.octet_length("body").alias("bytes"), execution.alias("execution_id"), offset.alias("offset")))
    served = F.when((fault == 1) & last, F.concat(F.col("body"), F.lit(" "))).otherwise(F.col("body"))  # changed after its receipt
    name = lambda kind: F.concat("folder", F.lit(f"/{kind}_"), offset.cast("string"), F.lit(".json"))
    parts = pages.where(~((fault == 2) & last)).select(name("page").alias("path"), served.alias("content"))
    receipts = pages.select(name("receipt").alias("path"), receipt.alias("content"))
    sql = F.concat(F.lit("SELECT * FROM t\nWHERE job = "), job.cast("string"))
    head = F.to_json(F.struct(sql.alias("sql"), F.sha2(sql, 256).alias("sql_sha256"), F.when(fault == 4, "QUERY_STATE_FAILED").otherwise("QUERY_STATE_COMPLETED").alias("state"), execution.alias("execution_id"), F.when(job % 2 == 0, F.col("total")).alias("total")))
    heads = pages.where("offset = 0").select(F.concat("folder", F.lit("/job.json")).alias("path"), head.alias("content"))
    return parts.unionAll(receipts).unionAll(heads)


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
    saved.write_files(_files(_pages(spark, sf_dir)).repartition(16), root)
    return saved.load(spark, root)


def saved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all jobs that verify, by place."""
    found = _loaded(spark, sf_dir).where("gap is null").withColumn("r", F.from_json("row", "account long, amount string, key long"))
    return found.select("job", "page", "place", F.col("r.key").alias("key"), F.col("r.account").alias("customer"), F.col("r.amount").alias("amount"))


def saved_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that don't verify, and why."""
    return _loaded(spark, sf_dir).where("gap is not null").select("account", "job", "gap")


def saved_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of two accounts only: folders of other ones aren't opened."""
    found = _loaded(spark, sf_dir).where(F.col("account").isin(0, 18))
    return found.groupBy("account", "job").agg(F.count("row").alias("n"), F.max("gap").alias("gap"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as rows of a batch whose intervals are orders; some rows name an interval that isn't asked, or lie outside of theirs."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    intervals = o.where(key % 11 != 0).select(key.alias("interval_id"), F.col("o_custkey").alias("account"), (key * 10).alias("start_block"), (key * 10 + 6).alias("end_block"), key.alias("start_time"), (key + 1000).alias("end_time"))
    line = read(spark, sf_dir, "lineitem").join(o.select(key.alias("l_orderkey"), "o_custkey"), "l_orderkey")
    part = F.col("l_partkey")
    rows = line.where("l_orderkey % 5 <> 0").select(
        F.col("l_orderkey").alias("interval_id"), F.col("l_linenumber").cast("long").alias("n"), F.when(part % 2 == 0, F.col("o_custkey")).otherwise(F.col("l_suppkey") + 10_000_000).alias("sender"),
        F.when((part % 2 == 1) & (part % 97 != 0), F.col("o_custkey")).otherwise(F.col("l_suppkey") + 10_000_000).alias("recipient"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block"), (F.col("l_orderkey") + part % 1010).alias("tsec"),
    )
    return rows, intervals


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, intervals = _batch(spark, sf_dir)
    return batch.demultiplexed(rows, intervals).select("interval_id", "n", "verdict")


def batch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, intervals = _batch(spark, sf_dir)
    return batch.accounted(batch.demultiplexed(rows, intervals), intervals)


#: Scopes of five probes; the first of them takes in few intervals, the second is for another query.
FROM_BLOCK, TO_BLOCK, FROM_S, TO_S = 236_650, 240_000, 1_703_900_000, 1_712_000_000


def interval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a frontier (transfers as arrivals) for the probes of a batch, in the order in which they are asked."""
    k, a = F.col("event_id"), F.col("recipient")
    t = transfers(spark, sf_dir)
    end = F.least(F.lit(TO_S), F.col("tsec") + batch.FOLLOWED) + F.when(k % 37 == 0, 1).otherwise(0)
    frontier = t.select(
        F.concat(F.lit("p"), (a % 7).cast("string")).alias("name"), F.when(k % 41 == 0, 99).otherwise(a % 7).cast("long").alias("query_id"), k.alias("arrival_event_id"), a.alias("account"), (k % 4).alias("depth"),
        F.col("block").alias("start_block"), F.lit(TO_BLOCK).cast("long").alias("end_block"), F.col("tsec").alias("start_time"), end.alias("end_time"), F.when(k % 5 == 0, "ALREADY_COMPLETE").otherwise("INTERVAL_INCOMPLETE").alias("state"),
    )
    frontier = frontier.union(frontier.where("arrival_event_id % 10 = 3"))
    scopes = spark.range(6).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.col("id").alias("query_id"), F.lit(FROM_BLOCK).alias("start_block"), F.lit(TO_BLOCK).alias("end_block"), F.lit(FROM_S).alias("start_time"), F.lit(TO_S).alias("end_time"), F.when(F.col("id") == 0, 1).otherwise(3).alias("max_depth"))
    return batch.selected(frontier, scopes, registry(spark, sf_dir)).select("name", "arrival_event_id", "account", "reason", "place")


def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and lists as texts of several forms, read leniently."""
    k = F.col("o_orderkey")
    one_of = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    df = read(spark, sf_dir, "orders").select(k.alias("id"), one_of("true", "True", "false", "", None, "1", "TRUE").alias("flag"), one_of('["a","b"]', "[]", "", None, "no", '{"x":1,"y":[2]}', '[1,{"k":2}]', "[1", "7").alias("list"))
    return df.select("id", normalise.truth(F.col("flag")).alias("flag"), F.array_join(normalise.items(F.col("list")), "|").alias("items"))


def queries() -> dict:
    return {f.__name__: f for f in (saved_rows, saved_gaps, saved_scope, batch_rows, batch_intervals, interval_batch, lenient_values)}


#: A fault of the last page; where that is the first one too, a changed total is only an incomplete end.
_JOBS = f"""o AS (SELECT o_custkey % {JOBS} AS j, o_orderkey, o_custkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS amount FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY o_orderkey) - 1 AS place FROM o), t AS (SELECT j, count(*) AS total FROM o GROUP BY j),
g AS (SELECT j, total, CASE j % 7 WHEN 1 THEN 'PAGE_DIGEST' WHEN 2 THEN 'MISSING_PAGE' WHEN 3 THEN CASE WHEN total <= {PAGE} THEN 'INCOMPLETE_END' ELSE 'TOTAL_CHANGED' END WHEN 4 THEN 'NOT_COMPLETED' WHEN 5 THEN 'ROW_COUNT' END AS gap FROM t)"""
_BATCH = """i AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, CASE WHEN i.k IS NULL THEN 'NOT_ASKED' WHEN l_linenumber > 6 OR l_partkey % 1010 > 1000 OR (l_partkey % 2 = 1 AND l_partkey % 97 = 0) THEN 'OUT_OF_SCOPE' ELSE 'OK' END AS verdict
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN i ON i.k = l_orderkey WHERE l_orderkey % 5 <> 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "saved_rows": f"WITH {_JOBS} SELECT 'j' || r.j AS job, place // {PAGE} * {PAGE} AS page, place, o_orderkey AS key, o_custkey AS customer, CAST(amount AS VARCHAR) AS amount FROM r JOIN g ON g.j = r.j WHERE gap IS NULL",
        "saved_gaps": f"WITH {_JOBS} SELECT j * 3 AS account, 'j' || j AS job, gap FROM g WHERE gap IS NOT NULL",
        "saved_scope": f"WITH {_JOBS} SELECT j * 3 AS account, 'j' || j AS job, CASE WHEN gap IS NULL THEN total ELSE 0 END AS n, gap FROM g WHERE j IN (0, 6)",
        "interval_batch": f"""WITH {TRANSFERS_SQL}, f AS (SELECT DISTINCT recipient % 7 AS p, CASE WHEN event_id % 41 = 0 THEN 99 ELSE recipient % 7 END AS q, event_id, recipient, event_id % 4 AS depth, block, tsec, least({TO_S}, tsec + {90 * 86400}) + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS until, event_id % 5 <> 0 AS open FROM transfers),
g AS (SELECT *, CASE WHEN p > 5 THEN 'NO_PROBE' WHEN q <> p THEN 'OTHER_QUERY' WHEN block < {FROM_BLOCK} OR block > {TO_BLOCK} OR tsec < {FROM_S} OR tsec > until OR until <> least({TO_S}, tsec + {90 * 86400}) THEN 'OUTSIDE_SCOPE'
  WHEN recipient % 10 IN (3, 5, 7) AND recipient IN (SELECT user_id FROM events) THEN 'FROZEN_LABEL_BOUNDARY' WHEN depth >= CASE WHEN p = 0 THEN 1 ELSE 3 END THEN 'ACQUISITION_DEPTH_BOUNDARY' WHEN NOT open THEN 'NOT_AN_UNFINISHED_PROVIDER_INTERVAL' ELSE 'SELECTED' END AS why FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY p, why ORDER BY depth, block, tsec, event_id) AS i, count(*) OVER (PARTITION BY p, why) AS n FROM g)
SELECT 'p' || p AS name, event_id AS arrival_event_id, recipient AS account, CASE WHEN why = 'SELECTED' AND n > 1000 THEN 'RESOURCE_LIMIT' ELSE why END AS reason, CASE WHEN why = 'SELECTED' AND n <= 1000 THEN i END AS place FROM h""",
        "lenient_values": """SELECT o_orderkey AS id, o_orderkey % 7 IN (0, 1, 6) AS flag, ['a|b', '', '', '', '', 'x|y', '1|{"k":2}', '', ''][o_orderkey % 9 + 1] AS items FROM orders""",
        "batch_rows": f"WITH {_BATCH} SELECT k AS interval_id, n, verdict FROM b",
        "batch_intervals": f"""WITH {_BATCH}, s AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE verdict <> 'OK') AS faults FROM b GROUP BY k)
SELECT i.k AS interval_id, coalesce(n, 0) AS n, coalesce(faults, 0) AS faults, CASE WHEN faults > 0 THEN 'REFUSED' WHEN n > 0 THEN 'COMPLETE' ELSE 'COMPLETE_EMPTY' END AS state FROM i LEFT JOIN s ON s.k = i.k""",
    }
