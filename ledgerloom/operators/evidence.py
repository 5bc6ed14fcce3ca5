"""Evidence in nested JSON: call trees, addresses, bindings between records, and checks of a component."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = "0x[0-9a-fA-F]{40}"
FRAME = "id long, path string, type string, sender string, recipient string, value string, failed boolean, below_failed boolean, logs int"


def _frames(batches):
    """Depth first; the tree of a row may be of any depth, so it is walked with a stack."""
    names = ["id", "path", "type", "sender", "recipient", "value", "failed", "below_failed", "logs"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.bool_(), pa.int32()]
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                root = json.loads(text) if text else None
            except ValueError:
                root = None
            stack = [("", root, False)] if isinstance(root, dict) else []
            while stack:
                path, call, below = stack.pop()
                failed = bool(call.get("error"))
                rows.append((key, path, call.get("type"), call.get("from"), call.get("to"), call.get("value"), failed, below, len(call.get("logs") or [])))
                inner = [c for c in call.get("calls") or [] if isinstance(c, dict)]
                stack += [(f"{path}_{i}" if path else str(i), c, below or failed) for i, c in reversed(list(enumerate(inner)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, types, strict=True)], names)


def frames(trees: DataFrame, id_col: str, tree_col: str) -> DataFrame:
    """A row per call of each tree (JSON objects with type, from, to, value, error, logs, calls): its path of places, and whether it or a call
    above it failed. A text that is no such object has none. SQL can't walk trees of any depth, so a small function does."""
    return trees.select(F.col(id_col).cast("long").alias("id"), F.col(tree_col).alias("tree")).mapInArrow(_frames, FRAME)


def addresses(text: Column) -> Column:
    """Distinct addresses anywhere in a JSON text, lower-cased and sorted; longer hexadecimal words are none."""
    words = F.regexp_extract_all(text, F.lit(r"0x[0-9a-fA-F]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) == 42), F.lower)))


def contradictions(expected: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """location, field, expected and observed value wherever a record (key, location, fields; null: not said) contradicts what its key has."""
    e = expected.select(key, *[F.col(f).cast("string").alias(f"e_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f).cast("string").alias("observed")) for f in fields])
    rows = observed.join(e, key).select(key, "location", F.explode(pairs).alias("p")).select(key, "location", "p.*")
    return rows.where("observed is not null and not (observed <=> expected)")


def component_checks(calls: DataFrame, logs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Of each transaction: the checks of a wrapping component, and its status. calls: tx, path, type, value, ok; logs: tx, kind, value, place; receipts: tx,
    ok, n_logs. Each log is matched to calls of equal value, counts against counts."""
    c = calls.where("type = 'deposit'").groupBy("tx").agg(F.count("*").alias("deposits"), F.count_if("ok").alias("ok_deposits"), F.sum("value").alias("put"))
    g = logs.groupBy("tx").agg(F.count("*").alias("logs"), F.count_if(F.col("kind") == "deposit").alias("deposit_logs"), F.sum(F.when(F.col("kind") == "deposit", F.col("value"))).alias("minted"), F.count_distinct("place").alias("places"))
    met = calls.where("type = 'deposit' and ok").groupBy("tx", "value").agg(F.count("*").alias("a")).join(logs.where("kind = 'deposit'").groupBy("tx", "value").agg(F.count("*").alias("b")), ["tx", "value"], "full")
    odd = met.groupBy("tx").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("odd"))
    df = receipts.join(c, "tx", "left").join(g, "tx", "left").join(odd, "tx", "left")
    n = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    checks = {
        "receipt_ok": F.col("ok"), "one_deposit": n("deposits") == 1, "deposit_ok": n("ok_deposits") == n("deposits"), "log_count": n("logs") == F.col("n_logs"),
        "places_distinct": n("places") == n("logs"), "value_kept": n("put") == n("minted"), "logs_matched": n("odd") == 0,
    }
    passed = sum((F.when(v, 1).otherwise(0) for v in checks.values()), F.lit(0))
    df = df.withColumns({**checks, "passed": passed})
    status = F.when(n("logs") + n("deposits") == 0, "NO_EVIDENCE").when(F.col("passed") == len(checks), "CERTIFIED").when(~F.col("value_kept") | ~F.col("logs_matched"), "CONTRADICTED").otherwise("INCOMPLETE")
    return df.select("tx", *checks, "passed", status.alias("status"))
