"""Registered queries of interval scans, saved results and row normalisation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import normalise, scan, wide
from ledgerloom.sources import warehouse
from ledgerloom.sources.derived import read
from ledgerloom.sources.warehouse import GENESIS, STEP, WAREHOUSE_SQL

#: The one interval of the single scans: account, blocks.
ACCOUNT, FIRST, LAST = 7, 100, 9_000


def _events(spark: SparkSession, sf_dir: str, inside=None) -> DataFrame:
    raw = [f(spark, sf_dir) for f in (warehouse.transactions, warehouse.traces, warehouse.tokens)]
    return scan.events(*(t.where(inside) if inside is not None else t for t in raw))


def interval_scan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All value events of one account within bounds, in order of presentation."""
    inside = scan.bounds(FIRST, LAST, GENESIS + FIRST * STEP, GENESIS + LAST * STEP)
    found = scan.touching(_events(spark, sf_dir, inside)).where(F.col("account") == ACCOUNT)
    place = F.row_number().over(Window.partitionBy("account").orderBy(*scan.order_columns()))
    return found.select(place.alias("place"), *scan.COLUMNS)


def interval_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each date within bounds; the dates that follow from the seconds reach the scan, so a table partitioned by date skips others."""
    inside = scan.bounds(FIRST, LAST, GENESIS + FIRST * STEP, GENESIS + LAST * STEP)
    found = _events(spark, sf_dir, inside).withColumn("day", F.floor(F.col("tsec") / 86400))
    return found.groupBy("day", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all intervals; blocks outside all of them are left out where the tables are read."""
    intervals = warehouse.intervals(spark, sf_dir)
    return scan.tagged(intervals, _events(spark, sf_dir, scan.spanned(intervals, "block", "start_block", "end_block")))


def interval_batch_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)


def interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.accounted(warehouse.intervals(spark, sf_dir), _tagged(spark, sf_dir))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved jobs of an old and a later batch: every interval that is no multiple of three, and wider ones of each tenth account."""
    i = warehouse.intervals(spark, sf_dir)
    old = i.where("interval_id % 3 <> 0").select(F.col("interval_id").alias("job_id"), "account", "start_block", "end_block")
    wide = i.where("interval_id % 10 = 0").select((F.col("interval_id") + 1_000_000_000).alias("job_id"), "account", (F.col("start_block") - 50).alias("start_block"), (F.col("end_block") + 50).alias("end_block"))
    return old.unionByName(wide)


def served_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (the second half of each interval) answered from saved jobs that contain them, with the rows they get."""
    asked = warehouse.intervals(spark, sf_dir).select(F.col("interval_id").alias("request_id"), "account", (F.col("start_block") + 150).alias("start_block"), "end_block")
    hit = scan.served(asked, _jobs(spark, sf_dir))
    rows = scan.touching(_events(spark, sf_dir)).select("account", "block", "amount")
    got = scan.at_intervals(rows, hit.where("job_id is not null"), "account", "block", "start_block", "end_block").groupBy("request_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return hit.select("request_id", "job_id").join(got, "request_id", "left").select("request_id", "job_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("amount", F.lit(0).cast("long")).alias("amount"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw texts with faults."""
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    hexed = lambda c, n: F.concat(F.lit("0x"), F.lpad(F.hex(c), n, "0"))
    kind = F.when(part % 29 == 0, "other").when(line == 1, "top").when(line < 4, "internal").otherwise("erc20")
    return read(spark, sf_dir, "lineitem").select(
        (key * 100 + line).alias("row_id"),
        F.when(part % 37 == 0, F.lit("0x12")).otherwise(hexed(key, 64)).alias("tx_hash"),
        kind.alias("kind"),
        hexed(F.col("l_suppkey"), 40).alias("sender"),
        F.when(part % 41 == 0, F.lit("")).otherwise(hexed(part, 40)).alias("recipient"),
        F.when(part % 43 == 0, F.lit("-5")).when(part % 47 == 0, F.lit("1.5")).otherwise(F.concat(F.lit("00"), F.col("l_quantity").cast("long").cast("string"), F.repeat(F.lit("0"), (part % 60).cast("int")))).alias("amount_raw"),
        F.floor(key / 4).cast("string").alias("block"),
        F.when(part % 31 != 0, F.col("l_returnflag") != "R").alias("success"),
        F.when(part % 23 != 0, (line * 10).cast("string")).alias("log_index"),
        F.when(part % 19 == 0, F.lit("[]")).when(part % 2 == 0, F.concat(F.lit("[0, "), line.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("0_"), line.cast("string"))).alias("trace_address"),
        F.when(part % 17 == 0, "delegatecall").otherwise("call").alias("call_type"),
        F.when(part % 13 != 0, hexed(part % 3, 40)).alias("contract"),
        (F.lit(21_000) + key % 1000).cast("string").alias("gas_used"),
        (key % 50).cast("string").alias("gas_price"),
    )


def normalize_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise.normalised(_raw(spark, sf_dir))
    return found.groupBy("kind", F.coalesce("gap", F.lit("EVENT")).alias("gap")).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of normalised rows: ids, keys and exact amounts of any length as text, gas of top-level ones."""
    found = normalise.normalised(_raw(spark, sf_dir)).where("gap is null")
    return found.select("row_id", "event_id", "key", "asset", "amount", F.col("at_block").alias("block"), F.col("gas").cast("string").alias("gas"))


def _account_rows(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    """Line items as rows of one account list: amounts of up to 78 digits or 64 hexadecimal ones, and faults of every kind."""
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_numbered")
    text = lambda c: c.cast("string")
    hexed = lambda c, n: F.concat(F.lit("0x"), F.lpad(F.hex(c), n, "0"))
    rows = read(spark, sf_dir, "lineitem").withColumn("l_numbered", F.col("l_linenumber").cast("long"))
    value = (
        F.when(part % 19 == 0, F.element_at(F.array(*map(F.lit, ("x", "-3", "1.5", "", " 12 ", "+4", "0x"))), (key % 7 + 1).cast("int")))
        .when(part % 23 != 0, F.when(part % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(part)), F.repeat(F.lit("0"), (part % 58).cast("int")))).otherwise(F.concat(text(part), F.repeat(F.lit("0"), (part % 72).cast("int")))))
    )
    rows = rows.select(
        (key * 100 + line).alias("row_id"), F.when(part % 37 == 0, F.lit("0x12")).otherwise(hexed(key, 64)).alias("tx_hash"), F.when(part % 5 == 0, text(key % 4)).alias("tx_index"),
        F.when(part % 7 != 0, F.when(part % 5 == 0, "1").otherwise("0")).alias("is_error"), F.when(part % 3 != 0, F.when(part % 11 == 0, "0").otherwise("1")).alias("receipt_status"),
        F.when(part % 13 == 0, "").otherwise(F.concat(F.lit("0x"), F.hex(part))).alias("gas_used"), F.concat(text(line), F.repeat(F.lit("0"), (part % 40).cast("int"))).alias("gas_price"),
        F.when(part % 13 != 0, F.concat(F.lit("0_"), text(line))).alias("trace_id"), F.when(part % 17 != 0, F.concat(F.lit("0x"), F.hex(line * 10))).alias("log_index"),
        F.when(part % 29 == 0, F.lit("0x1")).otherwise(hexed(part % 3, 40)).alias("contract"), hexed(F.col("l_suppkey"), 40).alias("sender"), F.when(part % 31 != 0, hexed(part, 40)).alias("recipient"), value.alias("value"),
        F.when(part % 41 != 0, text(F.floor(key / 4))).alias("block"), text(key).alias("time"), "l_numbered",
    )
    return rows.where({"txlist": "l_numbered = 1", "txlistinternal": "l_numbered in (2, 3)", "tokentx": "l_numbered > 3"}[action])


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    positions = read(spark, sf_dir, "orders").where(key % 9 != 0).select(F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(key), 64, "0"))).alias("tx_hash"), (key % 4).alias("tx_index"))
    parts = [normalise.listed(a, _account_rows(spark, sf_dir, a), positions) for a in normalise.LISTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the three account lists, amounts and gas of any length as exact text."""
    return _listed(spark, sf_dir).where("gap is null").drop("gap")


def account_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lists of an account source by action, gap and success: rows, those with an index, and their exact total."""
    by = _listed(spark, sf_dir).groupBy("action", F.coalesce("gap", F.lit("EVENT")).alias("gap"), "success")
    return by.agg(F.count("*").alias("n"), F.count("tx_index").alias("placed"), wide.sum_of(F.col("amount")).alias("amount"))


def amount_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sender: exact sum, least and greatest amount, and dearest gas of its account rows."""
    found = _listed(spark, sf_dir).where("gap is null").select("sender", "amount", wide.key(F.col("amount")).alias("a"), wide.key(F.col("gas")).alias("g"))
    return found.groupBy("sender").agg(wide.sum_of(F.col("amount")).alias("total"), *(wide.of_key(x).alias(n) for x, n in ((F.min("a"), "least"), (F.max("a"), "most"), (F.max("g"), "gas"))))


def times_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text in four spellings, one of them no time, and ids whose case varies, as canonical values."""
    e = read(spark, sf_dir, "events")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(plain, F.lit(" UTC"))).when(F.col("event_id") % 4 == 1, F.concat(F.translate(plain, " ", "T"), F.lit("Z"))).when(F.col("event_id") % 4 == 2, plain).otherwise(F.concat(plain, F.lit(" CET")))
    raw = F.concat(F.lit("0x"), F.lpad(F.when(F.col("event_id") % 2 == 0, F.lower(F.hex("event_id"))).otherwise(F.hex("event_id")), 40, "0"))
    return e.select("event_id", normalise.seconds(text).alias("tsec"), normalise.exact_hex(raw, 20).alias("id"))


def queries() -> dict:
    found = (interval_scan_kinds, interval_by_date, interval_batch_tagged, interval_rows, served_intervals, normalize_gaps, normalize_events, account_lists, account_events, amount_extremes, times_and_ids)
    return {f.__name__: f for f in found}


_EVENTS = """below AS (SELECT DISTINCT t.tx_hash, t.block, t.path FROM {t} t JOIN {t} a ON a.tx_hash = t.tx_hash AND a.block = t.block AND NOT a.success AND a.path <> t.path
  AND (a.path = '' OR t.path LIKE replace(a.path, '_', '|_') || '|_%' ESCAPE '|')),
ev AS (SELECT 'top' AS kind, tx_hash, sender, recipient, amount, block, tx_index, tsec, NULL::BIGINT AS log_index, NULL::VARCHAR AS path, success, NULL::BIGINT AS contract FROM {x}
  UNION ALL SELECT 'internal', t.tx_hash, sender, CASE WHEN type = 'suicide' THEN refund_address ELSE coalesce(recipient, address) END, amount, t.block, tx_index, tsec, NULL, t.path, success AND tx_success AND b.path IS NULL, NULL
    FROM {t} t LEFT JOIN below b ON b.tx_hash = t.tx_hash AND b.block = t.block AND b.path = t.path WHERE t.path <> '' AND amount > 0 AND (call_type IS NULL OR call_type <> 'delegatecall')
  UNION ALL SELECT 'erc20', k.tx_hash, k.sender, k.recipient, k.amount, k.block, x.tx_index, k.tsec, log_index, NULL, x.success, contract FROM {k} k LEFT JOIN {x} x ON x.tx_hash = k.tx_hash AND x.block = k.block),
tc AS (SELECT sender AS account, * FROM ev WHERE sender IS NOT NULL UNION ALL SELECT recipient, * FROM ev WHERE recipient IS NOT NULL AND recipient IS DISTINCT FROM sender)"""


#: Hexadecimal amounts are doubled four times for each zero digit, as big integers have sums but no exact products.
_ACCOUNTS = """WITH r AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_linenumber = 1 THEN 'txlist' WHEN l_linenumber < 4 THEN 'txlistinternal' ELSE 'tokentx' END AS action FROM lineitem),
x AS (SELECT DISTINCT p, p % 58 AS k FROM r WHERE p % 2 = 0), h AS (SELECT p, CAST(list_reduce(list_prepend(CAST(p AS BIGNUM), list_transform(range(4 * k), lambda i: CAST(0 AS BIGNUM))), lambda a, b: a + a) AS VARCHAR) AS doubled FROM x),
q AS (SELECT r.*, CASE action WHEN 'txlist' THEN 'top' WHEN 'tokentx' THEN 'erc20' ELSE 'internal' END AS kind, r.p % 19 = 0 AND o % 7 IN (0, 1, 2, 6) AS bad_value, '0x' || lower(lpad(to_hex(o), 64, '0')) AS tx, '0x' || lower(lpad(to_hex(s), 40, '0')) AS sender,
  CASE WHEN r.p % 29 = 0 THEN '0x1' ELSE '0x' || lpad(to_hex(r.p % 3), 40, '0') END AS contract, doubled FROM r LEFT JOIN h ON h.p = r.p),
g AS (SELECT *, CASE WHEN p % 31 = 0 THEN contract ELSE '0x' || lower(lpad(to_hex(p), 40, '0')) END AS recipient,
  CASE WHEN p % 37 = 0 THEN 'NORMALIZATION_FAILED' WHEN kind = 'internal' AND p % 13 = 0 THEN 'EVENT_IDENTITY_UNRESOLVED' WHEN kind = 'internal' AND p % 7 = 0 THEN 'INTERNAL_STATUS_UNRESOLVED' WHEN kind = 'erc20' AND p % 17 = 0 THEN 'EVENT_IDENTITY_UNRESOLVED'
  WHEN kind = 'erc20' AND p % 29 = 0 THEN 'NORMALIZATION_FAILED' WHEN bad_value OR p % 41 = 0 OR (p % 31 = 0 AND p % 29 = 0) THEN 'NORMALIZATION_FAILED' ELSE 'EVENT' END AS gap FROM q),
v AS (SELECT action, kind, o * 100 + line AS row_id, o, p, line, CASE WHEN p % 37 = 0 THEN '0x12' ELSE tx END AS tx, sender, recipient, contract, gap,
  CASE WHEN p % 5 = 0 THEN o % 4 WHEN p % 37 <> 0 AND o % 9 <> 0 AND o IN (SELECT o_orderkey FROM orders) THEN o % 4 END AS tx_index, NOT ((p % 7 <> 0 AND p % 5 = 0) OR (p % 3 <> 0 AND p % 11 = 0)) AS success,
  CASE WHEN p % 19 = 0 THEN CASE o % 7 WHEN 4 THEN '12' WHEN 5 THEN '4' END WHEN p % 23 = 0 THEN '0' WHEN p % 2 = 0 THEN doubled ELSE p || repeat('0', p % 72) END AS amount,
  CASE WHEN kind = 'top' AND p % 13 <> 0 THEN CAST(p * line AS VARCHAR) || repeat('0', p % 40) END AS gas FROM g)"""


def oracle_sql() -> dict[str, str]:
    inside = f"block BETWEEN {FIRST} AND {LAST}"
    whole = f"WITH {WAREHOUSE_SQL}, {_EVENTS.format(x='transactions', t='traces', k='tokens')}"
    cut = f"WITH {WAREHOUSE_SQL}, xc AS (SELECT * FROM transactions WHERE {inside}), tr AS (SELECT * FROM traces WHERE {inside}), kc AS (SELECT * FROM tokens WHERE {inside}), {_EVENTS.format(x='xc', t='tr', k='kc')}"
    columns = ", ".join(scan.COLUMNS)
    order = ", ".join(f"{c} NULLS LAST" for c in ("block", "tx_index", "tx_hash", "kind", "log_index", "path", "sender", "recipient", "amount", "contract"))
    tagged = "tg AS (SELECT interval_id, tc.* FROM tc JOIN intervals i ON i.account = tc.account AND block BETWEEN start_block AND end_block AND tsec BETWEEN start_time AND end_time AND (i.contract IS NULL OR tc.contract IS NULL OR i.contract = tc.contract))"
    raw = """r AS (SELECT l_orderkey * 100 + l_linenumber AS row_id, l_partkey AS p, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS line,
  CASE WHEN l_partkey % 29 = 0 THEN 'other' WHEN l_linenumber = 1 THEN 'top' WHEN l_linenumber < 4 THEN 'internal' ELSE 'erc20' END AS kind, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
n AS (SELECT *, CASE WHEN p % 37 = 0 THEN 'TX_HASH' WHEN p % 31 = 0 THEN 'SUCCESS_UNRESOLVED' WHEN p % 41 = 0 THEN 'ADDRESS' WHEN kind = 'other' THEN 'UNKNOWN_KIND' WHEN kind = 'internal' AND p % 19 = 0 THEN 'TRACE_LOCATOR'
  WHEN kind = 'internal' AND p % 17 = 0 THEN 'NON_VALUE_TRACE' WHEN kind = 'erc20' AND p % 23 = 0 THEN 'LOG_INDEX' WHEN kind = 'erc20' AND p % 13 = 0 THEN 'CONTRACT' WHEN p % 43 = 0 OR p % 47 = 0 THEN 'INTEGER' END AS gap FROM r)"""
    return {
        "interval_scan_kinds": f"{cut} SELECT row_number() OVER (ORDER BY {order}) AS place, {columns} FROM tc WHERE account = {ACCOUNT}",
        "interval_by_date": f"{cut} SELECT tsec // 86400 AS day, kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM ev GROUP BY ALL",
        "interval_batch_tagged": f"{whole}, {tagged} SELECT interval_id, {columns} FROM tg",
        "interval_rows": f"{whole}, {tagged} SELECT interval_id, count(tg.kind) AS n, CASE WHEN count(tg.kind) > 0 THEN 'ROWS' ELSE 'COMPLETE_EMPTY' END AS status FROM intervals LEFT JOIN tg USING (interval_id) GROUP BY interval_id",
        "served_intervals": f"""{whole}, j AS (SELECT interval_id AS job_id, account, start_block AS f, end_block AS t FROM intervals WHERE interval_id % 3 <> 0 UNION ALL SELECT interval_id + 1000000000, account, start_block - 50, end_block + 50 FROM intervals WHERE interval_id % 10 = 0),
q AS (SELECT interval_id AS request_id, account, start_block + 150 AS s, end_block AS e FROM intervals), h AS (SELECT q.*, (SELECT min(job_id) FROM j WHERE j.account = q.account AND f <= s AND e <= t) AS job_id FROM q)
SELECT request_id, job_id, count(tc.kind) AS n, CAST(coalesce(sum(tc.amount), 0) AS BIGINT) AS amount FROM h LEFT JOIN tc ON job_id IS NOT NULL AND tc.account = h.account AND block BETWEEN s AND e GROUP BY request_id, job_id""",
        "normalize_gaps": f"WITH {raw} SELECT kind, coalesce(gap, 'EVENT') AS gap, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM n GROUP BY ALL",
        "normalize_events": f"""WITH {raw}, m AS (SELECT *, '0x' || lower(lpad(to_hex(o), 64, '0')) AS tx, CASE kind WHEN 'top' THEN 'top' WHEN 'erc20' THEN 'log:' || (line * 10) ELSE 'trace:0_' || line END AS pos FROM n WHERE gap IS NULL)
SELECT row_id, 'eip155:1:tx:' || tx || ':' || pos AS event_id, 'eip155:1|' || tx || '|' || pos AS key, CASE kind WHEN 'erc20' THEN 'erc20:eip155:1:0x' || lower(lpad(to_hex(p % 3), 40, '0')) ELSE 'native:eip155:1' END AS asset,
  CASE WHEN q = 0 THEN '0' ELSE q || repeat('0', p % 60) END AS amount, o // 4 AS block, CASE WHEN kind = 'top' THEN CAST((21000 + o % 1000) * (o % 50) AS VARCHAR) END AS gas FROM m""",
        "account_lists": f"""{_ACCOUNTS} SELECT action, gap, success, count(*) AS n, count(tx_index) AS placed, CAST(sum(CAST(coalesce(amount, '0') AS BIGNUM)) AS VARCHAR) AS amount FROM v GROUP BY ALL""",
        "account_events": f"""{_ACCOUNTS} SELECT action, row_id, 'eip155:1:tx:' || tx || ':' || CASE kind WHEN 'top' THEN 'top' WHEN 'internal' THEN 'trace:0_' || line ELSE 'log:' || (line * 10) END AS event_id, kind, tx, sender, recipient,
  CASE kind WHEN 'erc20' THEN 'erc20:eip155:1:' || contract ELSE 'native:eip155:1' END AS asset, amount, o // 4 AS block, tx_index, o AS tsec, CASE WHEN kind = 'erc20' THEN line * 10 END AS log, CASE WHEN kind = 'internal' THEN '0_' || line END AS trace, success, gas FROM v WHERE gap = 'EVENT'""",
        "amount_extremes": f"""{_ACCOUNTS}, w AS (SELECT sender, CAST(amount AS BIGNUM) AS a, CAST(gas AS BIGNUM) AS g FROM v WHERE gap = 'EVENT')
SELECT sender, coalesce(CAST(sum(a) AS VARCHAR), '0') AS total, CAST(min(a) AS VARCHAR) AS least, CAST(max(a) AS VARCHAR) AS most, CAST(max(g) AS VARCHAR) AS gas FROM w GROUP BY sender""",
        "times_and_ids": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS tsec, '0x' || lower(lpad(to_hex(event_id), 40, '0')) AS id FROM events",
    }
