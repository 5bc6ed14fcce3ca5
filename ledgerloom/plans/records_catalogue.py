"""Registered queries of pages, journals, ledgers, saved texts and evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import evidence, ledger
from ledgerloom.operators.order import amount_status
from ledgerloom.sources.derived import TRANSFERS_SQL, read, transfers

PAGE, RESULT, CAP = 50, 5000, 10_000_000_000
STATES = ("PLANNED", "DISPATCH_INTENT", "SUCCESS_VALIDATED", "UNKNOWN_TRANSPORT", "INVALID_RESPONSE")


def _cents() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("long")


def page_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of results, some with faults."""
    key = F.col("o_orderkey")
    held = read(spark, sf_dir, "orders").where(key % 1009 != 0)
    pages = held.groupBy(F.floor(key / RESULT).alias("result"), (F.floor(key / PAGE) * PAGE % RESULT).alias("offset")).agg(F.count("*").alias("n"))
    totals = pages.groupBy("result").agg(F.max(F.col("offset") + F.col("n")).alias("t"))
    p = F.col("result") * 100 + F.floor(F.col("offset") / PAGE)
    end = F.col("offset") + F.col("n")
    pages = pages.join(totals, "result").select(
        "result", "offset", "n", (F.col("n") + F.when(p % 37 == 36, 1).otherwise(0)).alias("row_count"), (F.col("t") + F.when(p % 23 == 22, 7).otherwise(0)).alias("total"),
        F.when(p % 29 == 28, "b").otherwise("a").alias("schema"), F.when(p % 31 == 30, "QUERY_STATE_PENDING").otherwise("QUERY_STATE_COMPLETED").alias("state"),
        F.when(p % 41 == 40, None).when(p % 17 == 16, end + 1).when(end < F.col("t"), end).alias("next_offset"), F.when(p % 43 == 42, 40).when(p % 47 == 46, 2000).otherwise(PAGE).alias("page_size"),
    )
    return ledger.page_contract(pages)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = ledger.link_verdict(F.col("url"), ".example.com", "^/[a-z]{2}/[0-9]+$", ("page",))
    return read(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, STATES)), (F.floor(F.col("event_id") / 1500) + F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)).cast("int") % 5 + 1)
    return read(spark, sf_dir, "events").select((F.col("event_id") % 1500).alias("attempt"), (F.col("event_id") % 10).alias("account"), kind.alias("state"), F.col("event_id").alias("n"))


def journal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.journal_steps(_moves(spark, sf_dir)).select("attempt", "n", "state", "legal")


def journal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that an unresolved attempt blocks, with how many they have."""
    last = ledger.journal_state(_moves(spark, sf_dir)).withColumn("account", F.col("attempt") % 10)
    return last.groupBy("account").agg(F.count_if(F.col("state").isin(*ledger.UNRESOLVED)).alias("unresolved"), F.count("*").alias("attempts"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: what they reserved, and for finished ones what they cost, at times more."""
    key = F.col("o_orderkey")
    actual = F.when(F.col("o_orderstatus") == "F", F.when(key % 501 == 7, _cents() + 1).otherwise(_cents() - F.col("o_custkey")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("unit"), key.alias("n"), F.col("o_custkey").alias("customer"), _cents().alias("reserved"), actual.alias("actual"))


def ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    caps = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("unit")).distinct()
    allowance = F.when(F.col("unit") == "5-LOW", None).when(F.col("unit") == "2-HIGH", 1_000).otherwise(10**15).cast("long")
    return ledger.snapshot(jobs, caps.select("unit", F.lit(50_000_000_000_000).cast("long").alias("cap"), allowance.alias("allowance")))


def ledger_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.settled(_jobs(spark, sf_dir)).select("unit", "n", "outcome")


def risk_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n")
    jobs = _jobs(spark, sf_dir).select(F.when(k % 4 == 0, "LEGACY").otherwise("NEW").alias("bucket"), "reserved", "actual", F.when(k % 3 == 0, k).alias("known"), F.when(k % 5 == 0, k).alias("upper"))
    return ledger.risk_buckets(jobs, 5 * 10**11)


def export_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as results: their orders are the rows, lines' prices observed sizes."""
    o = read(spark, sf_dir, "orders")
    results = o.groupBy(F.col("o_custkey").alias("result")).agg((F.count("*") * 37).alias("rows"), F.sum(_cents()).alias("bytes")).withColumn("columns", F.lit(6))
    observed = o.select(F.col("o_custkey").alias("result"), F.when(F.col("o_orderkey") % 2 == 0, _cents() * 3).alias("bytes"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 5).alias("datapoints"))
    return ledger.export_envelope(results, observed, PAGE)


def known_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of accounts whose opening one is known for some, unknown for others."""
    t = transfers(spark, sf_dir).where("success")
    leg = lambda c, s: t.select(F.col(c).alias("account"), "asset", F.col("event_id").alias("ord"), F.lit(s).alias("sign"), F.col("amount_raw").alias("amount"))
    moves = leg("sender", -1).union(leg("recipient", 1))
    openings = moves.select("account", "asset").distinct().where("account % 4 <> 0").withColumn("opening", F.expr("CASE WHEN account % 4 <> 1 THEN account * 100 END"))
    return ledger.known_balance(moves, openings)


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes recovered from the text of saved queries; one that isn't of the template has none."""
    c = F.col("c_custkey")
    text = F.concat(F.lit("SELECT *\n FROM t  WHERE account = "), c.cast("string"), F.lit(" AND block BETWEEN "), (c * 7).cast("string"), F.when(c % 13 == 0, F.lit(" OR ")).otherwise(F.lit(" AND ")), (c * 7 + 300).cast("string"), F.when(c % 17 == 0, F.lit(" LIMIT 5")).otherwise(F.lit("")))
    plain = F.regexp_replace(text, r"\s+", " ")
    template = "^SELECT [*] FROM t WHERE account = ([0-9]+) AND block BETWEEN ([0-9]+) AND ([0-9]+)$"
    part = lambda i: F.when(plain.rlike(template), F.regexp_extract(plain, template, i).cast("long"))
    return read(spark, sf_dir, "customer").select(c.alias("job_id"), part(1).alias("account"), part(2).alias("start_block"), part(3).alias("end_block"))


def interval_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished intervals of a frontier, in the order in which they are to be asked; others with why not. Equal ones come once."""
    e = transfers(spark, sf_dir)
    k = F.col("event_id")
    f = e.select(F.col("recipient").alias("account"), (k % 4).alias("depth"), F.col("block").alias("start_block"), F.when(k % 5 == 0, "ALREADY_COMPLETE").otherwise("INTERVAL_INCOMPLETE").alias("state")).distinct()
    reason = F.when(F.col("account") % 10 == 3, "FROZEN_LABEL_BOUNDARY").when(F.col("depth") >= 3, "ACQUISITION_DEPTH_BOUNDARY").when(F.col("state") != "INTERVAL_INCOMPLETE", "NOT_AN_UNFINISHED_PROVIDER_INTERVAL").otherwise("SELECTED")
    return f.select("account", "depth", "start_block", "state", reason.alias("reason"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a saved lookup job against what was asked: of each address, whether it is there once, was asked, and lists as many as it counts."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("address")).agg(F.to_json(F.collect_list("o_orderstatus")).alias("payload"), F.count("*").alias("n"))
    got = o.where("address % 19 <> 0").select("address", "payload", (F.col("n") + F.when(F.col("address") % 23 == 0, 1).otherwise(0)).alias("declared"))
    got = got.union(got.where("address % 29 = 0"))
    asked = read(spark, sf_dir, "customer").where("c_custkey % 31 <> 0").select(F.col("c_custkey").alias("address")).withColumn("asked", F.lit(True))
    rows = got.groupBy("address").agg(F.count("*").alias("times"), F.max("declared").alias("declared"), F.max(F.size(F.from_json("payload", "array<string>"))).alias("listed"))
    both = rows.join(asked, "address", "full")
    verdict = F.when(F.col("times").isNull(), "MISSING").when(F.col("asked").isNull(), "NOT_ASKED").when(F.col("times") > 1, "DUPLICATE").when(F.col("declared") != F.col("listed"), "COUNT_MISMATCH").otherwise("OK")
    return both.select("address", verdict.alias("verdict"))


def label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers (an order's lines as records) to observations: roles by keywords of categories, a failed answer to none."""
    line = read(spark, sf_dir, "lineitem")
    category = F.element_at(F.array(*map(F.lit, ("Exchange", "Bridge Protocol", "Coin Mixer", "DEX", "Miner"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    records = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("address"), F.upper(category).alias("category"), F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("E"), F.col("l_suppkey"))).alias("entity"))).alias("data"))
    code = F.when(F.col("l_orderkey") % 13 == 0, 500).otherwise(200000).alias("code")
    texts = records.select("l_orderkey", F.to_json(F.struct(code, "data")).alias("payload"))  # a saved response
    parsed = texts.withColumn("p", F.from_json("payload", "code int, data array<struct<address: long, category: string, entity: string>>"))
    rows = parsed.where("p.code = 200000").select("l_orderkey", F.explode("p.data").alias("r")).select("l_orderkey", "r.*")
    role = (
        F.when(F.col("category").contains("BRIDGE"), "BRIDGE_BOUNDARY").when(F.col("category").contains("MIXER"), "MIXER_BOUNDARY").when(F.col("category").contains("DEX"), "DEX_OR_PROTOCOL")
        .when(F.col("category").contains("EXCHANGE"), "SERVICE").otherwise("UNKNOWN")
    )
    kind = F.when(F.col("entity").isNotNull() & (role != "UNKNOWN"), "ATTRIBUTION").otherwise("CONTEXT")
    return rows.groupBy(role.alias("role"), kind.alias("semantic_kind")).agg(F.count("*").alias("n"), F.count_distinct("address").alias("addresses"), F.count_distinct("l_orderkey").alias("answers"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call trees as JSON, four calls each, out of orders."""
    k = F.col("o_orderkey")
    address = lambda n: F.concat(F.lit("0x"), F.lpad(F.hex(n), 40, "0"))
    call = lambda t, v, error, *inner: F.struct(F.lit(t).alias("type"), address(F.col("o_custkey")).alias("from"), address(v).alias("to"), F.hex(v).alias("value"), F.when(error, "reverted").alias("error"), *inner)
    deepest = call("STATICCALL", k + 3, F.lit(False))
    left = call("CALL", k + 1, k % 7 == 0, F.array(deepest).alias("calls"))
    right = call("DELEGATECALL", k + 2, k % 11 == 0, F.array(deepest).alias("calls"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(call("CALL", k, k % 13 == 0, F.array(left, right).alias("calls"))).alias("tree"))


def call_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.frames(_trees(spark, sf_dir), "o_orderkey", "tree").select("id", "path", "type", "value", "failed", "below_failed")


def json_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses in nested JSON, wherever they are, and how often they come up."""
    found = _trees(spark, sf_dir).select(F.explode(evidence.addresses(F.col("tree"))).alias("address"))
    return found.groupBy("address").agg(F.count("*").alias("trees"))


def evidence_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that contradict the identity of their transaction, field by field."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    expected = o.select(F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 100).alias("block"), F.col("o_custkey").alias("sender"))
    part = F.col("l_partkey")
    observed = l.join(o.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(
        F.col("l_orderkey").alias("tx"), F.concat(F.lit("line"), F.col("l_linenumber")).alias("location"), F.when(part % 3 != 0, F.col("l_orderkey") % 100 + F.when(part % 17 == 0, 1).otherwise(0)).alias("block"),
        (F.col("o_custkey") + F.when(part % 23 == 0, 5).otherwise(0)).alias("sender"),
    )
    return evidence.contradictions(expected, observed, "tx", ["block", "sender"])


def component_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions of a wrapping component: lines as calls and logs."""
    l, part, line = read(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")  # noqa: E741
    value = F.col("l_quantity").cast("long")
    calls = l.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("tx"), line.alias("path"), F.when(line == 1, "deposit").otherwise("call").alias("type"), value.alias("value"), (part % 19 != 0).alias("ok"))
    logs = l.where("l_linenumber <> 2").select(F.col("l_orderkey").alias("tx"), F.when(line == 1, "deposit").otherwise("other").alias("kind"), (value + F.when(part % 13 == 0, 1).otherwise(0)).alias("value"), line.alias("place"))
    counts = l.where("l_linenumber <> 2").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    o = read(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    receipts = o.select(F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 29 != 0).alias("ok"), (F.coalesce("c", F.lit(0)) + F.when(F.col("o_orderkey") % 31 == 0, 1).otherwise(0)).alias("n_logs"))
    return evidence.component_checks(calls, logs, receipts)


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a manifest of digests and sizes that some were changed after."""
    d = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    manifest = d.where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("digest"), F.octet_length(text).alias("size"))
    df = d.select("doc_id", F.sha2(text, 256).alias("now"), F.octet_length(text).alias("bytes")).join(manifest, "doc_id", "left")
    verdict = F.when(F.col("digest").isNull(), "NOT_LISTED").when(F.col("bytes") != F.col("size"), "SIZE").when(F.col("now") != F.col("digest"), "CHANGED").otherwise("OK")
    return df.select("doc_id", verdict.alias("verdict"))


def seed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query members against the event their seed names: exactly one, equal in what both say, real and within scope."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("amount"), (F.col("l_returnflag") != "R").alias("ok"))
    once = e.groupBy("event_id").agg(F.count("*").alias("n"), F.min("amount").alias("amount"), F.min("ok").alias("ok"), F.min("l_suppkey").alias("sender"))
    members = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") * 2).alias("event_id"), (F.col("o_orderkey") % 3 == 0).alias("asked_ok"))
    df = members.join(once, "event_id", "left")
    verdict = F.when(F.col("n").isNull(), "NO_EVENT").when(F.col("n") > 1, "SEVERAL_EVENTS").when(~F.col("ok"), "FAILED_EVENT").when(amount_status(F.col("amount").cast("string")) != "POSITIVE", "NO_AMOUNT").when(F.col("event_id") > 12_000, "OUT_OF_SCOPE").otherwise("EXACT_EVENT_MATCH")
    return df.select("query_id", "event_id", verdict.alias("verdict"))


def model_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a scenario (an order's lines as events of a graph) can't be modelled; the first reason counts."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(line == 1, "seed").when(part % 97 == 0, "mystery").when(part % 7 == 0, "gas").when(part % 11 == 0, "conversion").otherwise("transfer")
    e = read(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("ord"), kind.alias("kind"), (part % 5).alias("asset"), F.col("l_quantity").alias("net"), (F.col("l_tax") < 0.08).alias("ok"), (part % 3 != 0).alias("certified"))
    g = e.groupBy("l_orderkey").agg(
        F.count_if(F.col("kind") == "seed").alias("seeds"), F.count_distinct("ord").alias("orders"), F.count("*").alias("n"), F.count_if(F.col("kind") == "mystery").alias("mystery"),
        F.count_if(~F.col("ok") & (F.col("kind") != "gas")).alias("reverted"), F.count_if((F.col("kind") == "gas") & (F.col("asset") != 0)).alias("foreign_gas"),
        F.count_if((F.col("kind") == "conversion") & ~F.col("certified")).alias("uncertified"), F.count_if((F.col("kind") == "conversion") & (F.col("net") < 5)).alias("no_net"),
    )
    status = (
        F.when(F.col("seeds") != 1, "EXACTLY_ONE_SEED").when(F.col("orders") != F.col("n"), "DUPLICATE_ORDER").when(F.col("mystery") > 0, "UNKNOWN_KIND").when(F.col("reverted") > 0, "REVERTED_EVENT")
        .when(F.col("uncertified") > 0, "UNCERTIFIED_CONVERSION").when(F.col("no_net") > 0, "NON_POSITIVE_NET").when(F.col("foreign_gas") > 0, "GAS_ASSET").otherwise("MODEL")
    )
    return g.select("l_orderkey", status.alias("status"))


def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and addresses of saved jobs by batch, the rows of a job that answered several intervals once only."""
    o = read(spark, sf_dir, "orders")
    answers = o.select((F.col("o_orderkey") % 3).alias("batch"), F.floor(F.col("o_orderkey") / 5).alias("job"), F.col("o_custkey").alias("address"), (F.floor(F.col("o_orderkey") / 5) % 40).alias("rows"))
    jobs = answers.groupBy("batch", "job").agg(F.max("rows").alias("rows"), F.count("*").alias("intervals")).groupBy("batch").agg(F.count("*").alias("jobs"), F.sum("rows").alias("rows"), F.sum("intervals").alias("intervals"))
    return jobs.join(answers.groupBy("batch").agg(F.count_distinct("address").alias("addresses")), "batch")


def address_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that anything needs, with all the reasons."""
    t = transfers(spark, sf_dir)
    parts = [t.where("event_id % 9 = 0").select(F.col("sender").alias("address"), F.lit("SEED_SENDER").alias("reason")), t.where("amount_raw > 9000").select(F.col("recipient").alias("address"), F.lit("LARGE_ENTRY").alias("reason")), t.where("not success").select(F.col("sender").alias("address"), F.lit("FAILED_GAS").alias("reason"))]
    found = parts[0].union(parts[1]).union(parts[2])
    return found.groupBy("address").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def queries() -> dict:
    found = (
        page_contract, page_links, journal_steps, journal_blocks, ledger_snapshot, ledger_settled, risk_buckets, export_envelope, known_balances, interval_texts, interval_selection, result_rows,
        label_import, call_frames, json_addresses, evidence_bindings, component_checks, content_digests, seed_lookup, model_guards, replay_summary, address_requirements,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    t = f"WITH {TRANSFERS_SQL}"
    states = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
    moves = f"mv AS (SELECT event_id % 1500 AS attempt, {states}[(event_id // 1500 + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END) % 5 + 1] AS state, event_id AS n FROM events)"
    jobs = "jb AS (SELECT o_orderpriority AS unit, o_orderkey AS n, CAST(round(o_totalprice * 100) AS BIGINT) AS reserved, CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 501 = 7 THEN 1 ELSE -o_custkey END END AS actual FROM orders)"
    address = "'0x' || lpad(to_hex({}), 40, '0')"
    frames = " UNION ALL ".join(
        f"SELECT o_orderkey AS id, '{p}' AS path, '{k}' AS type, to_hex(o_orderkey + {v}) AS value, {f} AS failed, {b} AS below_failed FROM orders"
        for p, k, v, f, b in (
            ("", "CALL", 0, "o_orderkey % 13 = 0", "false"), ("0", "CALL", 1, "o_orderkey % 7 = 0", "o_orderkey % 13 = 0"), ("0_0", "STATICCALL", 3, "false", "o_orderkey % 13 = 0 OR o_orderkey % 7 = 0"),
            ("1", "DELEGATECALL", 2, "o_orderkey % 11 = 0", "o_orderkey % 13 = 0"), ("1_0", "STATICCALL", 3, "false", "o_orderkey % 13 = 0 OR o_orderkey % 11 = 0"),
        )
    )
    checks = "coalesce(ok, false) AS receipt_ok, coalesce(d, 0) = 1 AS one_deposit, coalesce(okd, 0) = coalesce(d, 0) AS deposit_ok, coalesce(g, 0) = n_logs AS log_count, coalesce(pl, 0) = coalesce(g, 0) AS places_distinct, coalesce(put, 0) = coalesce(minted, 0) AS value_kept, coalesce(odd, 0) = 0 AS logs_matched"
    return {
        "page_contract": f"""WITH p AS (SELECT o_orderkey // {RESULT} AS result, o_orderkey // {PAGE} * {PAGE} % {RESULT} AS "offset", count(*) AS n FROM orders WHERE o_orderkey % 1009 <> 0 GROUP BY ALL), q AS (SELECT *, max("offset" + n) OVER (PARTITION BY result) AS t, result * 100 + "offset" // {PAGE} AS p FROM p),
g AS (SELECT result, "offset", n, n + CASE WHEN p % 37 = 36 THEN 1 ELSE 0 END AS row_count, t + CASE WHEN p % 23 = 22 THEN 7 ELSE 0 END AS total, p % 29 = 28 AS other, p % 31 = 30 AS pending, CASE WHEN p % 41 = 40 THEN NULL WHEN p % 17 = 16 THEN "offset" + n + 1 WHEN "offset" + n < t THEN "offset" + n END AS nxt,
  CASE WHEN p % 43 = 42 THEN 40 WHEN p % 47 = 46 THEN 2000 ELSE {PAGE} END AS size FROM q),
w AS (SELECT *, "offset" + n AS fin, row_number() OVER b AS i, lag(nxt) OVER b AS pn, lag(size) OVER b AS ps, lag(total) OVER b AS pt, lag(other) OVER b AS po FROM g WINDOW b AS (PARTITION BY result ORDER BY "offset"))
SELECT result, "offset", CASE WHEN size > 1000 THEN 'PAGE_LIMIT' WHEN CASE WHEN i = 1 THEN "offset" <> 0 ELSE pn IS DISTINCT FROM "offset" END THEN 'NONCONTIGUOUS' WHEN i > 1 AND ps <> size THEN 'PAGE_SIZE_CHANGED' WHEN pending THEN 'INCOMPLETE_STATE' WHEN n > size THEN 'EXCEEDS_LIMIT' WHEN row_count <> n THEN 'ROW_COUNT'
  WHEN i > 1 AND pt <> total THEN 'TOTAL_CHANGED' WHEN i > 1 AND po <> other THEN 'SCHEMA_CHANGED' WHEN fin > total THEN 'EXCEEDS_TOTAL' WHEN nxt <> fin THEN 'CURSOR' WHEN fin = total AND nxt IS NOT NULL THEN 'TERMINAL_CONTINUES' WHEN fin < total AND nxt IS NULL THEN 'MISSING_CONTINUATION' ELSE 'OK' END AS verdict FROM w""",
        "page_links": r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, CASE WHEN url IS NULL THEN 'NONE' WHEN host NOT LIKE '%.example.com' THEN 'ORIGIN' WHEN NOT regexp_full_match(path, '/[a-z]{2}/[0-9]+') THEN 'PATH' WHEN q <> '' AND len(list_filter(string_split(q, '&'), lambda x: split_part(x, '=', 1) NOT IN ('', 'page'))) > 0 THEN 'PARAMETERS' ELSE 'OK' END AS verdict FROM u""",
        "journal_steps": f"""WITH {moves}, l AS (SELECT *, lag(state) OVER (PARTITION BY attempt ORDER BY n) AS b FROM mv)
SELECT attempt, n, state, CASE WHEN b IS NULL THEN state = 'PLANNED' WHEN b = 'PLANNED' THEN state = 'DISPATCH_INTENT' WHEN b = 'DISPATCH_INTENT' THEN state IN ('SUCCESS_VALIDATED', 'UNKNOWN_TRANSPORT', 'INVALID_RESPONSE') WHEN b IN ('UNKNOWN_TRANSPORT', 'INVALID_RESPONSE') THEN state = 'SUCCESS_VALIDATED' ELSE false END AS legal FROM l""",
        "journal_blocks": f"WITH {moves}, s AS (SELECT attempt, arg_max(state, n) AS state FROM mv GROUP BY attempt) SELECT attempt % 10 AS account, count(*) FILTER (WHERE state IN ('DISPATCH_INTENT', 'UNKNOWN_TRANSPORT', 'INVALID_RESPONSE')) AS unresolved, count(*) AS attempts FROM s GROUP BY 1",
        "ledger_snapshot": f"""WITH {jobs}, s AS (SELECT unit, CAST(coalesce(sum(actual), 0) AS BIGINT) AS spent, CAST(coalesce(sum(reserved) FILTER (WHERE actual IS NULL), 0) AS BIGINT) AS held, coalesce(bool_or(actual > reserved), false) AS exceeded, CASE unit WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN 1000 ELSE 50000000000000 END AS e FROM jb GROUP BY unit)
SELECT unit, spent, held, CASE WHEN e IS NOT NULL THEN greatest(e - spent - held, 0) END AS remaining, coalesce(e - spent - held < 0, false) AS overrun, exceeded FROM s""",
        "ledger_settled": f"""WITH {jobs}, h AS (SELECT min(n) AS halt FROM jb WHERE actual > reserved)
SELECT unit, n, CASE WHEN n > halt THEN 'REFUSED' WHEN n = halt THEN 'EXCEEDED' WHEN actual IS NULL THEN 'RESERVED' ELSE 'SETTLED' END AS outcome FROM jb, h""",
        "risk_buckets": f"""WITH {jobs} SELECT CASE WHEN n % 4 = 0 THEN 'LEGACY' ELSE 'NEW' END AS bucket, CAST(sum(coalesce(actual, reserved)) AS BIGINT) AS risk, CAST(coalesce(sum(n) FILTER (WHERE n % 3 = 0), 0) AS BIGINT) AS known_execution, CAST(coalesce(sum(actual), 0) AS BIGINT) AS final_actual,
  CAST(coalesce(sum(reserved) FILTER (WHERE actual IS NULL AND n % 5 = 0), 0) AS BIGINT) AS bounded_not_final, CAST(coalesce(sum(reserved) FILTER (WHERE actual IS NULL AND n % 5 <> 0), 0) AS BIGINT) AS unknown_reserved, CAST(greatest(500000000000 - sum(coalesce(actual, reserved)), 0) AS BIGINT) AS remaining FROM jb GROUP BY 1""",
        "export_envelope": f"""WITH r AS (SELECT o_custkey AS result, count(*) * 37 AS rows, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS b, max(CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) * 3 END) AS ob, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 5 END) AS od FROM orders GROUP BY o_custkey),
z AS (SELECT result, rows, greatest(b, coalesce(ob, 0)) AS bytes, coalesce(od, 0) AS od FROM r), p AS (SELECT *, greatest(rows * 6, od, (bytes + 99) // 100) AS datapoints, greatest(1, (rows + {PAGE - 1}) // {PAGE}) AS pages FROM z), q AS (SELECT *, greatest(1, (bytes * 20 + 999999) // 1000000, (datapoints + 999) // 1000) AS per_page FROM p)
SELECT result, bytes, datapoints, pages, per_page, per_page * pages AS credits FROM q""",
        "known_balances": f"""{t}, m AS (SELECT sender AS account, asset, event_id AS ord, -1 AS sign, amount_raw FROM transfers WHERE success UNION ALL SELECT recipient, asset, event_id, 1, amount_raw FROM transfers WHERE success),
b AS (SELECT account, asset, ord, sign, CAST(sum(sign * amount_raw) OVER (PARTITION BY account, asset ORDER BY ord, sign ROWS UNBOUNDED PRECEDING) AS BIGINT) + CASE WHEN account % 4 IN (2, 3) THEN account * 100 END AS actual FROM m) SELECT *, CASE WHEN actual IS NULL THEN 'UNKNOWN' WHEN actual < 0 THEN 'OVERSPENT' ELSE 'KNOWN' END AS state FROM b""",
        "interval_texts": "SELECT c_custkey AS job_id, CASE WHEN ok THEN c_custkey END AS account, CASE WHEN ok THEN c_custkey * 7 END AS start_block, CASE WHEN ok THEN c_custkey * 7 + 300 END AS end_block FROM (SELECT *, c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AS ok FROM customer)",
        "interval_selection": f"""{t}, f AS (SELECT DISTINCT recipient AS account, event_id % 4 AS depth, block AS start_block, CASE WHEN event_id % 5 = 0 THEN 'ALREADY_COMPLETE' ELSE 'INTERVAL_INCOMPLETE' END AS state FROM transfers)
SELECT *, CASE WHEN account % 10 = 3 THEN 'FROZEN_LABEL_BOUNDARY' WHEN depth >= 3 THEN 'ACQUISITION_DEPTH_BOUNDARY' WHEN state <> 'INTERVAL_INCOMPLETE' THEN 'NOT_AN_UNFINISHED_PROVIDER_INTERVAL' ELSE 'SELECTED' END AS reason FROM f""",
        "result_rows": """WITH o AS (SELECT DISTINCT o_custkey AS a FROM orders), c AS (SELECT c_custkey AS b FROM customer WHERE c_custkey % 31 <> 0), g AS (SELECT a FROM o WHERE a % 19 <> 0)
SELECT coalesce(a, b) AS address, CASE WHEN a IS NULL THEN 'MISSING' WHEN b IS NULL THEN 'NOT_ASKED' WHEN a % 29 = 0 THEN 'DUPLICATE' WHEN a % 23 = 0 THEN 'COUNT_MISMATCH' ELSE 'OK' END AS verdict FROM g FULL JOIN c ON a = b""",
        "label_import": """WITH r AS (SELECT l_orderkey, l_suppkey, ['SERVICE', 'BRIDGE_BOUNDARY', 'MIXER_BOUNDARY', 'DEX_OR_PROTOCOL', 'UNKNOWN'][l_partkey % 5 + 1] AS role, l_partkey % 7 <> 0 AS named FROM lineitem WHERE l_orderkey % 13 <> 0)
SELECT role, CASE WHEN named AND role <> 'UNKNOWN' THEN 'ATTRIBUTION' ELSE 'CONTEXT' END AS semantic_kind, count(*) AS n, count(DISTINCT l_suppkey) AS addresses, count(DISTINCT l_orderkey) AS answers FROM r GROUP BY ALL""",
        "call_frames": frames,
        "json_addresses": f"WITH a AS (SELECT o_orderkey AS k, lower({address.format('o_custkey')}) AS address FROM orders" + "".join(f" UNION SELECT o_orderkey, lower({address.format(f'o_orderkey + {i}')}) FROM orders" for i in range(4)) + ") SELECT address, count(DISTINCT k) AS trees FROM a GROUP BY address",
        "evidence_bindings": """WITH j AS (SELECT l_orderkey AS tx, 'line' || l_linenumber AS location, l_partkey AS p, o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT tx, location, 'block' AS field, CAST(tx % 100 AS VARCHAR) AS expected, CAST(tx % 100 + 1 AS VARCHAR) AS observed FROM j WHERE p % 3 <> 0 AND p % 17 = 0 UNION ALL SELECT tx, location, 'sender', CAST(c AS VARCHAR), CAST(c + 5 AS VARCHAR) FROM j WHERE p % 23 = 0""",
        "component_checks": f"""WITH l AS (SELECT l_orderkey AS tx, l_linenumber AS i, CAST(l_quantity AS BIGINT) AS v, l_partkey AS p FROM lineitem),
c AS (SELECT tx, count(*) AS d, count(*) FILTER (WHERE p % 19 <> 0) AS okd, CAST(sum(v) AS BIGINT) AS put FROM l WHERE i = 1 GROUP BY tx), g AS (SELECT tx, count(*) AS g, count(DISTINCT i) AS pl, CAST(sum(v + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END) FILTER (WHERE i = 1) AS BIGINT) AS minted FROM l WHERE i <> 2 GROUP BY tx),
a AS (SELECT tx, v, count(*) AS a FROM l WHERE i = 1 AND p % 19 <> 0 GROUP BY ALL), b AS (SELECT tx, v + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END AS v, count(*) AS b FROM l WHERE i = 1 GROUP BY ALL), m AS (SELECT tx, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS odd FROM a FULL JOIN b USING (tx, v) GROUP BY tx),
r AS (SELECT o_orderkey AS tx, o_orderkey % 29 <> 0 AS ok, coalesce(g, 0) + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS n_logs FROM orders LEFT JOIN g ON g.tx = o_orderkey),
x AS (SELECT r.tx, coalesce(g, 0) + coalesce(d, 0) = 0 AS none, {checks} FROM r LEFT JOIN c ON c.tx = r.tx LEFT JOIN g ON g.tx = r.tx LEFT JOIN m ON m.tx = r.tx), y AS (SELECT *, receipt_ok::INT + one_deposit::INT + deposit_ok::INT + log_count::INT + places_distinct::INT + value_kept::INT + logs_matched::INT AS passed FROM x)
SELECT * EXCLUDE (none), CASE WHEN none THEN 'NO_EVIDENCE' WHEN passed = 7 THEN 'CERTIFIED' WHEN NOT value_kept OR NOT logs_matched THEN 'CONTRADICTED' ELSE 'INCOMPLETE' END AS status FROM y""",
        "content_digests": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'NOT_LISTED' WHEN sha256(coalesce(text, '')) <> sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) THEN 'CHANGED' ELSE 'OK' END AS verdict FROM documents",
        "seed_lookup": """WITH e AS (SELECT l_orderkey AS event_id, count(*) AS n, min(CAST(l_quantity AS BIGINT)) AS amount, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS query_id, o_orderkey * 2 AS event_id, CASE WHEN n IS NULL THEN 'NO_EVENT' WHEN n > 1 THEN 'SEVERAL_EVENTS' WHEN NOT ok THEN 'FAILED_EVENT' WHEN amount <= 0 THEN 'NO_AMOUNT' WHEN o_orderkey * 2 > 12000 THEN 'OUT_OF_SCOPE' ELSE 'EXACT_EVENT_MATCH' END AS verdict FROM orders LEFT JOIN e ON e.event_id = o_orderkey * 2""",
        "model_guards": """WITH e AS (SELECT l_orderkey, l_linenumber AS i, CASE WHEN l_linenumber = 1 THEN 'seed' WHEN l_partkey % 97 = 0 THEN 'mystery' WHEN l_partkey % 7 = 0 THEN 'gas' WHEN l_partkey % 11 = 0 THEN 'conversion' ELSE 'transfer' END AS kind, l_partkey AS p, l_quantity AS q, l_tax < 0.08 AS ok FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE kind = 'seed') <> 1 THEN 'EXACTLY_ONE_SEED' WHEN count(DISTINCT i) <> count(*) THEN 'DUPLICATE_ORDER' WHEN bool_or(kind = 'mystery') THEN 'UNKNOWN_KIND' WHEN bool_or(NOT ok AND kind <> 'gas') THEN 'REVERTED_EVENT' WHEN bool_or(kind = 'conversion' AND p % 3 = 0) THEN 'UNCERTIFIED_CONVERSION'
  WHEN bool_or(kind = 'conversion' AND q < 5) THEN 'NON_POSITIVE_NET' WHEN bool_or(kind = 'gas' AND p % 5 <> 0) THEN 'GAS_ASSET' ELSE 'MODEL' END AS status FROM e GROUP BY l_orderkey""",
        "replay_summary": """WITH a AS (SELECT o_orderkey % 3 AS batch, o_orderkey // 5 AS job, o_custkey, o_orderkey // 5 % 40 AS rows FROM orders), j AS (SELECT batch, job, max(rows) AS rows, count(*) AS intervals FROM a GROUP BY ALL),
b AS (SELECT batch, count(*) AS jobs, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(intervals) AS BIGINT) AS intervals FROM j GROUP BY batch) SELECT b.*, (SELECT count(DISTINCT o_custkey) FROM a WHERE a.batch = b.batch) AS addresses FROM b""",
        "address_requirements": f"""{t}, r AS (SELECT sender AS address, 'SEED_SENDER' AS reason FROM transfers WHERE event_id % 9 = 0 UNION SELECT recipient, 'LARGE_ENTRY' FROM transfers WHERE amount_raw > 9000 UNION SELECT sender, 'FAILED_GAS' FROM transfers WHERE NOT success)
SELECT address, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY address""",
    }
