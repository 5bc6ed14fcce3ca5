"""Registered queries of receipts matched log by log and of walks through nested JSON, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import nested, receipts
from ledgerloom.sources.derived import read


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as rows of an index and as logs: equal ones in a transaction, rows without a log, logs without a row, repeated log indexes,
    receipts that failed or are missing, logs of other forms."""
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")
    hexed = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    sender, recipient, value, contract = part % 2, key % 5, F.floor(F.col("l_quantity")).cast("long") % 3, part % 2
    lines, place = read(spark, sf_dir, "lineitem"), line * 100_000_000_000 + part * 10_000 + F.col("l_suppkey") % 100 * 100 + F.floor("l_quantity")
    rows = lines.where("l_linenumber <> 3").select(place.alias("row_id"), key.alias("tx"), *(F.concat(F.lit("0x"), hexed(c, 40)).alias(n) for n, c in (("contract", contract), ("sender", sender), ("recipient", recipient))), value.cast("string").alias("value"))
    topics = F.array(F.when(part % 29 == 0, "0x00").otherwise(receipts.TRANSFER), F.concat(F.lit("0x"), hexed(sender, 64)), F.concat(F.lit("0x"), hexed(recipient, 64)))
    logs = lines.where("l_linenumber <> 5").select(
        key.alias("tx"), place.alias("place"), F.concat(F.lit("0x"), F.upper(hexed(contract, 40))).alias("address"), topics.alias("topics"),
        F.when(part % 31 == 0, F.concat(F.lit("0x"), F.repeat(F.lit("z"), 64))).otherwise(F.concat(F.lit("0x"), hexed(value, 64))).alias("data"), F.when(part % 23 == 0, F.lit(7)).otherwise(line).cast("long").alias("log_index"), (part % 37 == 0).alias("removed"),
    )
    status = read(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("tx"), F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(1).alias("status"))
    return receipts.token_events(rows, status, logs)


def receipt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each log that a row of the index tells of, with the row it stands for."""
    return _matched(spark, sf_dir)[0].select("tx", "log_index", "row_id", "value")


def receipt_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[1].groupBy("tx", "reason", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("logs"), F.lit(0)).alias("logs"))


def frame_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as logs of receipts and as logs of call frames, some of them on one side only, some equal."""
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")
    place = line * 100_000_000_000 + part * 10_000 + F.col("l_suppkey") % 100 * 100 + F.floor("l_quantity")
    log = lambda up: [key.alias("tx"), (F.upper if up else F.lower)(F.concat(F.lit("0xab"), (part % 3).cast("string"))).alias("address"), F.array(F.lit("0xT"), (key % 4).cast("string")).alias("topics"), F.concat(F.lit("0x"), (F.floor(F.col("l_quantity")).cast("long") % 2).cast("string")).alias("data")]
    lines = read(spark, sf_dir, "lineitem")
    found = receipts.bound_logs(lines.where(part % 5 != 0).select(*log(True), place.alias("log_index")), lines.where(part % 7 != 0).select(*log(False), place.alias("path")))
    return found.groupBy("tx", "bound").agg(F.count("*").alias("n"), F.coalesce(F.sum("log_index"), F.lit(0)).alias("logs"), F.coalesce(F.sum("path"), F.lit(0)).alias("paths"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested JSON of several depths; some are no JSON."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    address = F.concat(F.lit("0x"), F.when(k % 7 == 0, F.upper(F.lpad(F.hex(c), 40, "0"))).otherwise(F.lower(F.lpad(F.hex(c), F.when(k % 11 == 0, 39).otherwise(40), F.lit("0")))))
    deep = F.concat(F.lit('{"calls":[{"from_address":'), quoted(address), F.lit(',"n":'), text(k % 100), F.lit('},[[{"sender":'), quoted(address), F.lit(',"blockHash":"0xAB'), text(k % 9), F.lit('"}]]],"note":null,"ok":true}'))
    doc = F.concat(F.lit('{"id":'), text(k), F.lit(',"block_hash":"0xCd'), text(c % 5), F.lit('","result":'), F.when(k % 3 == 0, deep).otherwise(F.lit('[]')), F.lit(',"recipient":'), F.when(k % 4 == 0, text(k)).otherwise(quoted(address)), F.when(k % 17 == 0, F.lit("")).otherwise(F.lit("}")))
    return read(spark, sf_dir, "orders").select(k.alias("doc"), doc.alias("text"))


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of nested documents with their paths."""
    return nested.leaves(_documents(spark, sf_dir), "doc", "text").select("id", "path", F.coalesce("value", F.lit("null")).alias("value"))


def json_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.block_hashes(nested.leaves(_documents(spark, sf_dir), "doc", "text"))


def json_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.account_fields(nested.leaves(_documents(spark, sf_dir), "doc", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (receipt_events, receipt_gaps, frame_logs, json_leaves, json_hashes, json_accounts)}


_MATCHED = """l AS (SELECT l_orderkey AS tx, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 2 AS c, l_orderkey % 5 AS d, CAST(floor(l_quantity) AS BIGINT) % 3 AS v, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey % 100 * 100 + CAST(floor(l_quantity) AS BIGINT) AS place FROM lineitem),
st AS (SELECT o_orderkey AS tx, o_orderkey % 11 <> 0 AS ok FROM orders WHERE o_orderkey % 13 <> 0),
rw AS (SELECT l.*, place AS row_id, ok, row_number() OVER (PARTITION BY tx, c, d, v ORDER BY place) AS nth FROM l LEFT JOIN st USING (tx) WHERE line <> 3),
lg AS (SELECT l.*, CASE WHEN p % 23 = 0 THEN 7 ELSE line END AS log_index, p % 31 = 0 AS unread FROM l JOIN st USING (tx) WHERE ok AND line <> 5 AND p % 29 <> 0 AND p % 37 <> 0 AND tx IN (SELECT tx FROM rw)),
hl AS (SELECT *, row_number() OVER (PARTITION BY tx, log_index ORDER BY place) AS seen FROM lg WHERE NOT unread AND EXISTS (SELECT 1 FROM rw WHERE rw.tx = lg.tx AND rw.c = lg.c AND rw.d = lg.d AND rw.v = lg.v)),
nl AS (SELECT *, row_number() OVER (PARTITION BY tx, c, d, v ORDER BY log_index) AS nth FROM hl WHERE seen = 1)"""
_DOCS = """j AS (SELECT o_orderkey AS k, '0x' || CASE WHEN o_orderkey % 7 = 0 THEN upper(lpad(to_hex(o_custkey), 40, '0')) ELSE lower(lpad(to_hex(o_custkey), CASE WHEN o_orderkey % 11 = 0 THEN 39 ELSE 40 END, '0')) END AS a, o_custkey AS c FROM orders WHERE o_orderkey % 17 <> 0),
d AS (SELECT k, '{"id":' || k || ',"block_hash":"0xCd' || (c % 5) || '","result":' || CASE WHEN k % 3 = 0 THEN '{"calls":[{"from_address":"' || a || '","n":' || (k % 100) || '},[[{"sender":"' || a || '","blockHash":"0xAB' || (k % 9) || '"}]]],"note":null,"ok":true}' ELSE '[]' END
  || ',"recipient":' || CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR) ELSE '"' || a || '"' END || '}' AS doc FROM j),
w AS (SELECT k AS id, t.fullkey AS path, t.key, CASE WHEN t.type = 'NULL' THEN NULL ELSE json_extract_string(t.value, '$') END AS value FROM d, json_tree(CAST(d.doc AS JSON)) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "receipt_events": f"WITH {_MATCHED} SELECT nl.tx, nl.log_index, rw.row_id, CAST(nl.v AS VARCHAR) AS value FROM nl LEFT JOIN rw ON rw.ok AND rw.tx = nl.tx AND rw.c = nl.c AND rw.d = nl.d AND rw.v = nl.v AND rw.nth = nl.nth",
        "receipt_gaps": f"""WITH {_MATCHED}, g AS (SELECT DISTINCT tx, 'RECEIPT_DETAIL_UNAVAILABLE' AS reason, '' AS value, 0 AS rows, 0 AS logs FROM rw WHERE ok IS NULL UNION ALL SELECT DISTINCT tx, 'TOKEN_RECEIPT_NOT_SUCCESSFUL', '', 0, 0 FROM rw WHERE NOT ok
UNION ALL SELECT tx, 'DUPLICATE_RECEIPT_LOG_INDEX', '', 0, 0 FROM hl WHERE seen > 1 UNION ALL SELECT tx, 'RECEIPT_LOG_PARSE_FAILED', '', 0, 0 FROM lg WHERE unread
UNION ALL SELECT tx, 'INDEX_RECEIPT_TRANSFER_MULTIPLICITY_MISMATCH', CAST(v AS VARCHAR), n, m FROM (SELECT tx, c, d, v, count(*) AS n FROM rw WHERE ok GROUP BY ALL) LEFT JOIN (SELECT tx, c, d, v, count(*) AS k FROM nl GROUP BY ALL) USING (tx, c, d, v), LATERAL (SELECT coalesce(k, 0) AS m) WHERE n <> m)
SELECT tx, reason, value, count(*) AS n, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(logs) AS BIGINT) AS logs FROM g GROUP BY ALL""",
        "frame_logs": """WITH l AS (SELECT l_orderkey AS tx, l_partkey AS p, l_partkey % 3 AS a, CAST(floor(l_quantity) AS BIGINT) % 2 AS d, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey % 100 * 100 + CAST(floor(l_quantity) AS BIGINT) AS place FROM lineitem),
x AS (SELECT *, row_number() OVER (PARTITION BY tx, a, d ORDER BY place) AS nth, count(*) OVER (PARTITION BY tx, a, d) AS n FROM l WHERE p % 5 <> 0), y AS (SELECT *, row_number() OVER (PARTITION BY tx, a, d ORDER BY place) AS nth, count(*) OVER (PARTITION BY tx, a, d) AS m FROM l WHERE p % 7 <> 0)
SELECT tx, CASE WHEN y.place IS NULL THEN 'RECEIPT_ONLY' WHEN x.place IS NULL THEN 'FRAME_ONLY' WHEN n = 1 AND m = 1 THEN 'LOG' ELSE 'AMBIGUOUS' END AS bound, count(*) AS n, CAST(coalesce(sum(x.place), 0) AS BIGINT) AS logs, CAST(coalesce(sum(y.place), 0) AS BIGINT) AS paths FROM x FULL JOIN y USING (tx, a, d, nth) GROUP BY 1, 2""",
        "json_leaves": f"WITH {_DOCS} SELECT id, path, coalesce(value, 'null') AS value FROM w",
        "json_hashes": f"WITH {_DOCS} SELECT id, path, lower(value) AS hash FROM w WHERE key IN ('blockHash', 'block_hash') AND value IS NOT NULL",
        "json_accounts": f"WITH {_DOCS} SELECT id, path, lower(value) AS account FROM w WHERE key IN ('address', 'sender', 'recipient', 'from_address', 'to_address') AND regexp_full_match(value, '0x[0-9a-fA-F]{{40}}')",
    }
