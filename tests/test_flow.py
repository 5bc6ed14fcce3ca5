"""Queries against their SQL at the smallest scale, and the cases that the tables don't hold."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import amounts, audit, closure, evidence, facts, graph, identity, ledger, normalise, order, prefix, wide
from ledgerloom.plans import audit_catalogue, catalogue, collect_catalogue, evidence_catalogue, graph_catalogue, identity_catalogue, records_catalogue, saved_catalogue, scan_catalogue, workflow_catalogue
from ledgerloom.sources import files

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "lineitem", "orders", "documents", "pages")
PLANS = (catalogue, graph_catalogue, scan_catalogue, collect_catalogue, identity_catalogue, audit_catalogue, records_catalogue, saved_catalogue, evidence_catalogue, workflow_catalogue)
QUERIES = {k: f for p in PLANS for k, f in p.queries().items()}
SQL = {k: s for p in PLANS for k, s in p.oracle_sql().items()}


def rows(records):
    return sorted(tuple(str(int(v)) if isinstance(v, bool) else str(v) for _, v in sorted(r.items())) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert rows(got) == rows(dict(zip(names, r, strict=True)) for r in cur.fetchall())


def test_order_is_unknown_without_an_index(spark):
    pairs = spark.sql("""SELECT 1 AS e_event_id, 2 AS a_event_id, 5 AS e_block, 5 AS a_block, 'x' AS e_tx_hash, 'y' AS a_tx_hash, cast(null AS int) AS e_tx_index, 1 AS a_tx_index,
      cast(null AS int) AS e_execution_index, cast(null AS int) AS a_execution_index, 'top' AS e_kind, 'top' AS a_kind, cast(null AS int) AS e_log_index, cast(null AS int) AS a_log_index""")
    after = order.strictly_after(lambda f: F.col(f"e_{f}"), lambda f: F.col(f"a_{f}"))
    assert pairs.select(after.alias("x")).first()["x"] is None


def test_conflicts_elect_no_winner_in_any_order(spark):
    data = [(1, "a", None), (1, None, "x"), (2, "a", "x"), (2, "b", "x"), (3, "c", None)]
    for versions in (data, data[::-1]):
        df = spark.createDataFrame(versions, "k int, f string, g string")
        got = {r["k"]: (r["status"], r["conflicts"], r["f"], r["g"]) for r in facts.reconcile(df, ["k"], ["f", "g"]).collect()}
        assert got == {1: ("MERGED", "", "a", "x"), 2: ("CONFLICT", "f", None, "x"), 3: ("SINGLE", "", "c", None)}


def shares(seed, transfers, balances, target):
    """Every amount of the seed that can enter the target, by trying all whole shares of all transfers."""
    account, amount = seed
    out = set()
    for part in itertools.product(*[range(n + 1 if a else 1) for a, _, n in transfers]):
        held, mine = dict(balances), {account: amount}
        held[account] = held.get(account, 0) + amount
        fits, got = True, 0
        for (a, b, n), x in zip(transfers, part, strict=True):
            if a:
                held[a], mine[a] = held.get(a, 0) - n, mine.get(a, 0) - x
                fits = fits and held[a] >= 0 <= mine[a] <= held[a]
            if b and b in target:
                got += x
            elif b:
                held[b], mine[b] = held.get(b, 0) + n, mine.get(b, 0) + x
        if fits:
            out.add(got)
    return out


def test_intervals_equal_enumeration():
    r = random.Random(3)
    solved = 0
    for _ in range(300):
        transfers = [(*r.sample("ABCT" if i else "ABC", 2), r.randrange(1, 4)) for i in range(5)]
        transfers = [t for t in transfers if t[0] != "T"]
        balances = {a: r.randrange(4) for a in "ABCT"}
        found = amounts.interval(("A", 3), transfers, balances, "T")
        tried = shares(("A", 3), transfers, balances, "T")
        assert (found is None) == (not tried)
        if tried:
            solved += 1
            assert found == (min(tried), max(tried))
    assert solved > 50


def test_intervals_of_groups_with_gas_and_money_from_outside():
    assert amounts.interval(("A", 50), [(None, "A", 100), ("A", "T", 120)], {"A": 0}, "T") == (20, 50)
    assert amounts.interval(("A", 50), [(None, "A", 100), ("A", None, 120), ("A", "T", 30)], {"A": 0}, "T") == (0, 30)
    r = random.Random(4)
    solved = 0
    for _ in range(400):
        transfers = [(a, b, r.randrange(1, 4)) for a, b in (r.choice([(x, y) for x in ("A", "B", None) for y in ("A", "B", "T", "U", None) if x != y]) for _ in range(5))]
        balances = {a: r.randrange(4) for a in "ABTU"}
        found = amounts.interval(("A", 3), transfers, balances, frozenset("TU"))
        tried = shares(("A", 3), transfers, balances, "TU")
        assert (found is None) == (not tried)
        if tried:
            solved += 1
            assert found == (min(tried), max(tried))
    assert solved > 50


def test_interval_rows(spark):
    big = str(10**40)
    data = [("s", "seed", -1, "X", "A", big), ("s", "transfer", 0, "A", "T", big), ("s", "balance", 0, None, "A", "0"), ("s", "target", 0, None, "T", None), ("n", "target", 0, None, "T", None)]
    data += [("g", "seed", -1, "X", "A", "5"), ("g", "incoming", 0, None, "A", "9"), ("g", "gas", 1, "A", None, "2"), ("g", "transfer", 2, "A", "T", "11"), ("g", "outflow", 3, "A", None, "1"), ("g", "balance", 0, None, "A", "0")]
    data += [("g", "group", 0, x, b, None) for x, b in (("both", "T"), ("both", "U"), ("none", "U"), ("payer", "A"))] + [("g", "target", 0, None, b, None) for b in "TU"]
    found = {tuple(r) for r in amounts.intervals(spark.createDataFrame(data, "scenario string, part string, ord long, sender string, recipient string, amount string")).collect()}
    wanted = {("s", "T", big, big, "OPTIMAL"), ("n", "T", None, None, "NO_SINGLE_SEED"), ("g", "both", "2", "5", "OPTIMAL"), ("g", "none", "0", "0", "OPTIMAL")}
    assert found == wanted | {("g", "payer", None, None, "TARGET_SPENDS"), ("g", "T", "2", "5", "OPTIMAL"), ("g", "U", "0", "0", "OPTIMAL")}
    groups = {r["scenario"]: (int(r["lower"]), int(r["upper"])) for r in graph_catalogue.amount_groups(spark, "/root/testdata/sf0.001").collect()}
    each = [r for r in graph_catalogue.amount_intervals(spark, "/root/testdata/sf0.001").collect()]
    assert {r["scenario"] for r in each} == set(groups) and all(int(r["upper"]) <= groups[r["scenario"]][1] for r in each)
    assert {r["status"] for r in graph_catalogue.amount_intervals(spark, "/root/testdata/sf0.01").collect()} <= {"OPTIMAL"}


def test_most_flow_equals_its_cut():
    r = random.Random(3)
    for _ in range(60):
        arcs = [(r.randrange(6), r.randrange(6), r.randrange(1, 9)) for _ in range(12)]
        net = amounts.Network()
        for a, b, n in [*arcs, (0, 5, 0)]:
            if a != b:
                net.arc(a, b, n)
        flow, cut = net.most(0, 5)
        least = min(sum(n for a, b, n in arcs if a in side and b not in side) for k in range(5) for x in itertools.combinations(range(1, 5), k) for side in [{0, *x}])
        assert flow == cut == least


def test_certificates_equal_a_sequential_pass(spark):
    """One event after another in their order, each taking the best of the certificates that reach its account."""
    events = [r.asDict() for r in audit_catalogue.events(spark, SF).collect()]
    seeds = {(r["query_id"], r["event_id"]) for r in audit_catalogue.seeds(spark, SF).collect()}
    roles = {r["account"]: r["role"] for r in audit_catalogue.identities(spark, SF).collect()}

    def before(a, b):
        both = a["block"] is not None and b["block"] is not None
        if a["event_id"] == b["event_id"]:
            return False
        if both and a["block"] != b["block"]:
            return a["block"] < b["block"]
        if both and a["tx_hash"] != b["tx_hash"]:
            return None if a["tx_index"] is None or b["tx_index"] is None else a["tx_index"] < b["tx_index"]
        if not both and a["tsec"] != b["tsec"]:
            return a["tsec"] < b["tsec"]
        if a["tx_hash"] != b["tx_hash"]:
            return None
        if a["log_index"] is not None and b["log_index"] is not None:
            return a["log_index"] < b["log_index"]
        return True if a["kind"] == "top" != b["kind"] else False if b["kind"] == "top" != a["kind"] else None

    place = lambda e: (e["block"] or 0, e["tx_index"] or 0, e["kind"] != "top", e["log_index"] or 0, e["event_id"])
    want = {}
    for q in {e["query_id"] for e in events}:
        pool = sorted((e for e in events if e["query_id"] == q and e["ok"] and e["amount"] > 0), key=place)
        cert = {e["event_id"]: ([e["event_id"]], set()) for e in pool if (q, e["event_id"]) in seeds}
        arrived = [e for e in pool if e["event_id"] in cert]
        for e in pool:
            if e["event_id"] in cert or roles.get(e["sender"], "UNKNOWN") in audit.STOP_ROLES:
                continue
            met = {e["sender"]} if roles.get(e["sender"], "UNKNOWN") == "UNKNOWN" else set()
            options = [(cert[p["event_id"]][0] + [e["event_id"]], cert[p["event_id"]][1] | met) for p in arrived if p["recipient"] == e["sender"] and p["asset"] == e["asset"] and before(p, e)]
            if options:
                cert[e["event_id"]] = min(options, key=lambda c: (len(c[1]), c[0]))
                if e["sender"] != e["recipient"]:
                    arrived.append(e)
        want |= {(q, k): (",".join(map(str, p)), ",".join(map(str, sorted(u)))) for k, (p, u) in cert.items()}
    got = {(r["query_id"], r["event_id"]): (r["path"], r["unknown"]) for r in audit_catalogue.reference_certificates(spark, SF).collect()}
    assert got == want and max(p.count(",") for p, _ in want.values()) >= 1


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).selectExpr("id % 2 as g", "id as n", "id * 3 as v")
    got = {r["n"]: r["t"] for r in prefix.running(df, ["g"], ["n"], "v", "t").collect()}
    assert all(got[n] == sum(3 * i for i in range(n % 2, n + 1, 2)) for n in range(1000))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in closure.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_unresolved_counts_equal_listed_pairs(spark):
    r = random.Random(9)
    place = {(b, t): r.choice([None, 0, 1, 2]) for b in range(4) for t in range(4)}  # two transactions may claim one place
    rows = [(i, b, place[b, t], t, r.choice([None, 1, 2]), r.choice(["top", "internal", "erc20"])) for i in range(120) for b, t in [(r.randrange(4), r.randrange(4))]]
    df = spark.createDataFrame(rows, "event_id long, block long, tx_index int, tx_hash long, log_index int, kind string").withColumn("execution_index", F.lit(None).cast("long"))
    listed = graph.unresolved(graph.ordinals(df, ["block"])).groupBy(F.col("a_block").alias("block")).agg(F.count("*").alias("pairs"), F.sum("b_event_id").alias("ids"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, graph.unresolved_counts(df).collect()))


def test_trees_of_any_depth_and_bad_texts(spark):
    deep = '{"type":"CALL","calls":[' * 40 + "{}" + "]}" * 40
    df = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, "[1]"), (5, '{"error":"x","calls":[{"type":"A"},{"logs":[1,2]}]}')], "k long, t string")
    got = [r.asDict() for r in evidence.frames(df, "k", "t").collect()]
    assert sum(r["id"] == 1 for r in got) == 41 and {r["id"] for r in got} == {1, 5}
    assert [(r["path"], r["below_failed"], r["logs"]) for r in got if r["id"] == 5] == [("", False, 0), ("0", True, 0), ("1", True, 2)]


def test_identity_rules_that_the_tables_lack(spark):
    names = "address string, observation_id int, platform string, actor string, role string, raw_label string, semantic_kind string, record_conflict boolean, collection_scope string, generation_mechanism string"
    zero, a, b, c = "0x" + "0" * 40, "a", "b", "c"
    rows = [
        (zero, 1, "Dune", "OKX", "SERVICE", "OKX", "ATTRIBUTION", False, "F", None),
        (a, 2, "Dune", "Kraken", "SERVICE", "Kraken", "ATTRIBUTION", True, "F", "R"),
        (b, 3, "Dune", None, "SERVICE", "Chainflip: Vault 1", "ATTRIBUTION", False, "F", None),
        (b, 4, "Dune", "Sushi Swap", "SERVICE", "x", "BEHAVIOR", False, "F", None),
        (c, 5, "Meta", "Kraken", "SERVICE", "Kraken user of", "ATTRIBUTION", False, "F", None),
    ]
    found = {r["address"]: r for r in identity.resolve(spark.createDataFrame(rows, names), spark.createDataFrame([("d", "SERVICE", "D"), (c, "SERVICE", "C")], "address string, identity_class string, actor string")).collect()}
    assert {k: r["identity_class"] for k, r in found.items()} == {zero: "NON_SERVICE_SENTINEL", a: "CONFLICTED_IDENTITY", b: "CONFLICTED_IDENTITY", c: "SERVICE", "d": "SERVICE"}
    assert found[b]["conflict_status"] == "DUNE_INTERNAL_CONFLICT" and found[c]["actor"] == "C" and found["d"]["rule"] == "EXISTING_OTHER_SOURCE_RESOLUTION_RETAINED"


def test_normalised_values(spark):
    df = spark.createDataFrame([("[0, 12]", "007", "0xfF"), ("1_02", "12a", "255"), ("x", None, "0x"), (None, "0", "")], "t string, n string, h string")
    got = [tuple(r) for r in df.select(normalise.trace_path(F.col("t")), normalise.exact_integer(F.col("n")), normalise.hex_or_decimal(F.col("h"))).collect()]
    assert got == [("0_12", "7", 255), ("1_2", None, 255), (None, None, None), (None, "0", None)]


def test_empty_tables(spark):
    jobs = spark.createDataFrame([], "unit string, n long, reserved long, actual long")
    assert ledger.settled(jobs).count() == 0 and ledger.snapshot(jobs, spark.createDataFrame([("u", 5, 3)], "unit string, cap long, allowance long")).first()["remaining"] == 3
    assert closure.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert facts.enrichment(jobs, jobs, "n", ["unit"]).count() == 0


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,\"x\"", [1, 2]), (1, None, [])], "k int, s string, a array<int>")
    path = f"{tmp_path}/out.csv.gz"
    files.write_csv(df, path, ["k", "s", "a", "gone"], ["k"])
    back = [r.asDict() for r in spark.read.csv(path, header=True, escape='"').orderBy("k").collect()]
    assert [r["k"] for r in back] == ["1", "2"] and back[1]["a"] == "[1,2]" and back[1]["gone"] is None
    (tmp_path / "x.csv").write_text("\ufeffid,v\n1,a\n", encoding="utf-8")
    (tmp_path / "x.json").write_text('[{"id": 1, "v": "a"}]')
    assert [files.read_rows(spark, f"{tmp_path}/x.{e}").collect()[0].asDict() for e in ("csv", "json")] == [{"id": "1", "v": "a"}] * 2
    manifest = files.contents(spark, f"{tmp_path}/x.*")
    (tmp_path / "x.json").write_text('[{"id": 2, "v": "a"}]')
    saved = spark.createDataFrame([(r["path"], r["size"], r["sha256"] if r["path"].endswith("csv") else "0") for r in manifest.collect()] + [("gone", 1, "x")], "path string, size long, sha256 string")
    assert sorted(r["verdict"] for r in files.verified(spark, f"{tmp_path}/x.*", saved).collect()) == ["CHANGED", "MISSING", "OK"]
    for v in ("1", "2", "2"):
        files.write_snapshot(df, f"{tmp_path}/snap", v)
    assert spark.read.parquet(f"{tmp_path}/snap").groupBy("snapshot_version").count().count() == 2
    assert files.content_id(df, ["k", "s"]) == files.content_id(df.repartition(3).orderBy("k"), ["k", "s"]) != files.content_id(df, ["k"])


def test_wide_numbers_equal_python(spark):
    """Numbers of up to 90 digits: text both ways, sums, products, order."""
    r = random.Random(11)
    pick = lambda: r.choice([0, 1, 10**9 - 1, 10**9, 2**256 - 1, r.randrange(10**r.randrange(1, 40)), r.randrange(10**r.randrange(1, 78))])
    pairs = [(i % 7, pick(), pick()) for i in range(300)]
    df = spark.createDataFrame([(k, "0" * (k % 3) + str(a), f"{b:x}") for k, a, b in pairs], "k int, a string, b string")
    df = df.select("k", wide.decimal(F.col("a")).alias("a"), wide.hexadecimal(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    got = df.select("k", wide.text(a).alias("x"), wide.text(b).alias("y"), wide.text(wide.add(a, b)).alias("sum"), wide.text(wide.multiply(a, b)).alias("product"), (wide.order(a) < wide.order(b)).alias("less"))
    assert sorted(map(tuple, got.collect())) == sorted((k, str(x), str(y), str(x + y), str(x * y), x < y) for k, x, y in pairs)
    sums = dict(df.groupBy("k").agg(wide.text(wide.total(a))).collect())
    assert sums == {k: str(sum(x for j, x, _ in pairs if j == k)) for k in range(7)}
    odd = spark.createDataFrame([("",), (None,), ("-1",), ("1.0",)], "t string")
    assert {r[0] for r in odd.select(wide.text(wide.decimal(F.col("t")))).collect()} == {None}
    long = spark.createDataFrame([("9" * 82,)], "t string").select(wide.decimal(F.col("t")).alias("x"))
    assert long.select(wide.text(F.col("x"))).first()[0] == "9" * 82 and long.agg(wide.text(wide.total(F.col("x")))).first()[0] is None


def test_whole_numbers_as_they_are_written(spark):
    cases = {"1000000000000000000": "1000000000000000000", "0x152d02c7e14af6800000": "100000000000000000000000", "0x" + "f" * 64: str(2**256 - 1), "9" * 78: "9" * 78, " 5 ": "5", "+5": "5", "-0": "0", "0007": "7", "-5": None, "": None, "0x": None, "x": None, "1e3": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", normalise.whole(F.col("t")).alias("x")).collect()} == cases


def greedy(jobs, caps):
    """The loop: a job that doesn't fit takes nothing."""
    left = {u: None if a is None else max(0, min(c, a)) for u, c, a in caps}
    out = []
    for u, n, x in sorted(jobs):
        fits = left[u] is not None and x <= left[u]
        left[u] = left[u] - x if fits else left[u]
        out.append((u, n, x, "RESERVED" if fits else "REFUSED"))
    return out


def test_admission_equals_a_plain_loop(spark):
    r = random.Random(8)
    caps = [("a", 1000, 10**6), ("b", 2**40 + 5, 2**41), ("c", 50, None), ("d", 0, 5), ("e", 7, -3), ("f", 64, 64), ("g", 2**62, 2**63 - 1)]
    size = {"a": 300, "b": 2**38, "c": 20, "d": 3, "e": 3, "f": 70, "g": 2**61}
    jobs = [(u, n, r.choice([0, 1, 2, r.randrange(size[u]), r.randrange(size[u] // 10 + 1)])) for u, _, _ in caps for n in range(60)]
    jobs += [("f", 100 + i, x) for i, x in enumerate([1, 63, 1, 62, 1, 61] * 3)]
    df = spark.createDataFrame(r.sample(jobs, len(jobs)), "unit string, n long, amount long").repartition(3)
    got = ledger.admitted(df, spark.createDataFrame(caps, "unit string, cap long, allowance long"))
    assert sorted(map(tuple, got.select("unit", "n", "amount", "outcome").collect())) == greedy(jobs, caps)


def test_an_overrun_halts_all_units(spark):
    jobs = spark.createDataFrame([("a", 1, 5, 5), ("b", 2, 5, 6), ("a", 3, 5, 1), ("b", 4, 5, None)], "unit string, n long, reserved long, actual long")
    assert [r["outcome"] for r in ledger.settled(jobs).orderBy("n").collect()] == ["SETTLED", "EXCEEDED", "REFUSED", "REFUSED"]


def test_a_claim_without_a_role_names_no_one(spark):
    """A claim of unknown role, or whose metadata tell of a deployer, doesn't beat one that names a service."""
    rows = [("x", 1, "Dune", "Kraken", "UNKNOWN", "Kraken", None), ("x", 2, "Meta", "Binance", "SERVICE", "Binance", None), ("y", 3, "Dune", "Kraken", "SERVICE", "Kraken", "deployed by them"), ("y", 4, "Meta", "OKX", "SERVICE", "OKX", "")]
    df = spark.createDataFrame(rows, "address string, observation_id long, platform string, actor string, role string, raw_label string, source_metadata string")
    df = df.withColumns({"semantic_kind": F.lit("ATTRIBUTION"), "record_conflict": F.lit(False), "collection_scope": F.lit("FRONTIER"), "generation_mechanism": F.lit("m")})
    got = identity.resolve(df, spark.createDataFrame([], "address string, identity_class string, actor string"))
    assert {r["address"]: (r["identity_class"], r["actor"]) for r in got.collect()} == {"x": ("SERVICE", "Binance"), "y": ("SERVICE", "OKX")}


def test_maintained_relations_equal_those_computed_anew(spark):
    found, reached = audit_catalogue._maintained(spark, SF)
    found = found.cache()
    anew = audit_catalogue._relations(spark, SF, audit_catalogue.identities_after(spark, SF)).select(found.columns).cache()
    assert found.exceptAll(anew).count() == anew.exceptAll(found).count() == 0
    pools = audit_catalogue.events(spark, SF).select("query_id").distinct().count()
    assert 0 < reached.count() <= pools


def test_a_change_reaches_only_its_queries(spark):
    """Rows of other queries are taken over, and recompute sees none but the reached ones."""
    events = spark.createDataFrame([(1, 10, 20), (2, 30, 40), (3, 50, 60)], "query_id long, sender long, recipient long")
    old = spark.createDataFrame([(1, 20, "a"), (2, 40, "b"), (3, 77, "c")], "query_id long, recipient long, status string")
    changed = spark.createDataFrame([(30,), (77,), (99,)], "account long")
    reached = audit.affected(events, old, changed)
    assert sorted(r[0] for r in reached.collect()) == [2, 3]
    asked = []
    anew = lambda q: asked.extend(r[0] for r in q.collect()) or q.select("query_id", F.lit(0).cast("long").alias("recipient"), F.lit("new").alias("status"))
    assert sorted(map(tuple, audit.maintained(old, reached, anew).collect())) == [(1, 20, "a"), (2, 0, "new"), (3, 0, "new")] and sorted(asked) == [2, 3]
    assert sorted(map(tuple, audit.maintained(old, reached.where("query_id < 0"), lambda q: old.where("false")).collect())) == sorted(map(tuple, old.collect()))


def test_a_late_conflict_revokes_whole_results(spark):
    returned = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (3, 7)], "request_id long, event_id long")
    got = facts.revoked(returned, spark.createDataFrame([(5,), (5,), (9,)], "event_id long")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, "REVOKED"), (1, 6, "REVOKED"), (2, 6, "VALID"), (3, 7, "VALID")]


def test_hubs_are_summed_and_numbered_over_ranges(spark):
    r = random.Random(12)
    rows = [(r.randrange(3), 0, i, s, r.randrange(1, 9)) for i in range(120) for s in (-1, 1)]
    moves = spark.createDataFrame(rows, "account long, asset long, ord long, sign int, amount long").repartition(4)
    plain = lambda df: sorted(map(tuple, df.select("account", "asset", "ord", "sign", "amount", "balance").collect()))
    assert plain(ledger.running_balance(moves)) == plain(ledger.running_balance(moves, most=70)) == plain(ledger.running_balance(moves, most=0))
    events = spark.createDataFrame([(i % 2, r.randrange(4), r.choice([None, 1, 2]), r.choice(["top", "erc20"]), r.choice([None, 1]), i) for i in range(80)], "asset long, block long, tx_index long, kind string, log_index long, event_id long")
    placed = lambda df: sorted((x.event_id, x.ord) for x in df.collect())
    assert placed(graph.ordinals(events, ["asset"])) == placed(graph.ordinals(events, ["asset"], most=0))


def test_owners_of_labels(spark):
    """Several owners are a conflict, an unmapped label names no one, a deployer's contract is behaviour."""
    rows = [
        (1, "labels.owner_addresses", None, None, "k", "OKEx", "Kraken", "casino", None), (2, "labels.owner_addresses", None, None, "k", "OKEx", "okx", "Sports Betting & Prediction Markets", None), (3, "labels.owner_addresses", None, None, "Hop_Protocol", None, "", None, None),
        (4, "labels.addresses", "Some Name", "other", None, None, None, None, None), (5, "labels.addresses", "Some Bridge", "bridge", None, None, None, None, "Deployer"), (6, "labels.owner_addresses", None, None, "x", "A mixer", None, None, None), (7, "other", "N", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "row_id int, source string, name string, category string, owner_key string, custody_owner string, account_owner string, primary string, contract string")
    rules = spark.createDataFrame([(1, "bridge", None, None, identity.BRIDGE)], "ordinal int, category string, label_type string, record_source string, class string")
    got = {r.row_id: (r.role, r.actor, r.actor_key, r.semantic_kind, r.record_conflict) for r in identity.classified(df, rules).collect()}
    assert got == {
        1: ("SERVICE", "Kraken | OKX", "krakenokx", "ATTRIBUTION", True), 2: ("SERVICE", "OKX", "okx", "ATTRIBUTION", False), 3: ("BRIDGE_BOUNDARY", "Hop_Protocol", "hopprotocol", "ATTRIBUTION", False), 4: ("UNKNOWN", None, None, "CONTEXT", False),
        5: ("UNKNOWN", None, None, "BEHAVIOR", False), 6: ("MIXER_BOUNDARY", "A mixer", "amixer", "ATTRIBUTION", False), 7: ("UNKNOWN", None, None, "CONTEXT", False),
    }


def test_digits_as_text_equal_python(spark):
    """The forms over text of what is done for every row; whole() goes by them, without functions over arrays."""
    r = random.Random(12)
    pairs = [(i % 5, r.choice([0, 1, 10**9, 2**256 - 1, r.randrange(10 ** r.randrange(1, 78))]), r.randrange(10 ** r.randrange(1, 78))) for i in range(200)]
    df = spark.createDataFrame([(k, str(a), f"{b:x}") for k, a, b in pairs], "k int, a string, b string").withColumn("y", wide.digits_of_hexadecimal(F.col("b")))
    got = df.select("k", "a", "y", wide.product(F.col("a"), F.col("y")).alias("product"), (wide.key(F.col("a")) < wide.key(F.col("y"))).alias("less"), wide.of_key(wide.key(F.col("a"))).alias("again"))
    assert sorted(map(tuple, got.collect())) == sorted((k, str(a), str(b), str(a * b), a < b, str(a)) for k, a, b in pairs)
    assert dict(df.groupBy("k").agg(wide.sum_of(F.col("a"))).collect()) == {k: str(sum(a for j, a, _ in pairs if j == k)) for k in range(5)}
    odd = spark.createDataFrame([("",), (None,), ("-1",), ("0x",), ("1\n",)], "t string")
    assert {tuple(x) for x in odd.select(wide.digits_of_hexadecimal(F.col("t")), wide.product(F.col("t"), F.lit("2"))).collect()} == {(None, None)}
    assert odd.where("t = ''").agg(wide.sum_of(F.when(F.lit(False), F.col("t")))).first()[0] == "0" and spark.createDataFrame([("9" * 82,)], "t string").agg(wide.sum_of(F.col("t"))).first()[0] is None
    assert "lambdafunction" not in odd.select(normalise.whole(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
