"""Saved results: every fault of a job, and what a filter on the account leaves out."""

import hashlib
import json

import pytest

from ledgerloom.sources import saved


def job(pages, **changes):
    """Files of a job whose pages hold these rows; changes by file name are functions of its object or bytes."""
    total, offset, files = sum(map(len, pages)), 0, {}
    for i, rows in enumerate(pages):
        page = {"execution_id": "x1", "state": "QUERY_STATE_COMPLETED", "result": {"rows": rows, "metadata": {"total_row_count": total, "row_count": len(rows)}}}
        if i < len(pages) - 1:
            page["next_offset"] = offset + len(rows)
        page = changes.get(f"page_{offset}", lambda p: p)(page)
        raw = json.dumps(page).encode() if page is not None else b"["
        receipt = {"http_status": 200, "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw), "execution_id": "x1", "offset": offset}
        files[f"page_{offset}.json"] = changes.get(f"raw_{offset}", lambda b: b)(raw)
        files[f"receipt_{offset}.json"] = json.dumps(changes.get(f"receipt_{offset}", lambda r: r)(receipt)).encode()
        offset += len(rows)
    head = {"sql": "SELECT 1\r\nFROM t", "sql_sha256": hashlib.sha256(b"SELECT 1\nFROM t").hexdigest(), "state": "QUERY_STATE_COMPLETED", "execution_id": "x1", "total": total}
    files["job.json"] = json.dumps(changes.get("job", lambda j: j)(head)).encode()
    return {k: v for k, v in files.items() if v is not None and k not in changes.get("missing", ())}


ROWS = [[{"a": 1}, {"a": 2}], [{"a": 3}, {"a": None}], [{"a": 5}]]


def put(**new):
    return lambda d: d | new


def meta(**new):
    return lambda p: p | {"result": p["result"] | {"metadata": p["result"]["metadata"] | new}}


CASES = {
    "sound": (job(ROWS), None), "empty": (job([[]]), None), "no_total": (job(ROWS, job=lambda j: {k: v for k, v in j.items() if k != "total"}), None), "digits": (job(ROWS, page_0=meta(row_count="2")), None),
    "no_job": (job(ROWS, missing=["job.json"]), "MISSING_JOB"), "sql": (job(ROWS, job=put(sql="SELECT 2")), "SQL_DIGEST"), "state": (job(ROWS, job=put(state="QUERY_STATE_FAILED")), "NOT_COMPLETED"),
    "no_execution": (job(ROWS, job=put(execution_id=None)), "NOT_COMPLETED"), "no_page": (job(ROWS, missing=["page_2.json"]), "MISSING_PAGE"), "no_receipt": (job(ROWS, missing=["receipt_4.json"]), "MISSING_RECEIPT"),
    "changed": (job(ROWS, raw_2=lambda b: b + b" "), "PAGE_DIGEST"), "http": (job(ROWS, receipt_0=put(http_status=402)), "PAGE_DIGEST"), "size": (job(ROWS, receipt_0=put(bytes=1)), "PAGE_SIZE"),
    "cursor_of_receipt": (job(ROWS, receipt_2=put(offset=0)), "RECEIPT_BINDING"), "other_execution": (job(ROWS, page_2=put(execution_id="x2")), "PAGE_BINDING"), "page_state": (job(ROWS, page_0=put(state="QUERY_STATE_PENDING")), "PAGE_BINDING"),
    "malformed": (job(ROWS, page_0=lambda p: None), "MALFORMED_PAGE"), "no_rows": (job(ROWS, page_0=put(result={})), "ROWS_MISSING"), "scalar_rows": (job(ROWS, page_0=lambda p: p | {"result": p["result"] | {"rows": [1]}}), "ROWS_MISSING"),
    "total": (job(ROWS, page_2=meta(total_row_count=9)), "TOTAL_CHANGED"), "count": (job(ROWS, page_4=meta(row_count=2)), "ROW_COUNT"), "negative": (job(ROWS, page_0=meta(total_row_count=-5)), "NOT_A_COUNT"),
    "end": (job(ROWS[:2], page_2=lambda p: meta(total_row_count=4)(p), page_0=lambda p: {k: v for k, v in p.items() if k != "next_offset"}), "INCOMPLETE_END"), "jump": (job(ROWS, page_0=put(next_offset=4)), "CURSOR"),
    "back": (job(ROWS, page_2=put(next_offset=0)), "CURSOR"), "status": (job(ROWS, job=put(total=4)), "STATUS_TOTAL"),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("saved")
    for i, (name, (files, _)) in enumerate(CASES.items()):
        folder = top / f"account={i % 3}" / f"job={name}"
        folder.mkdir(parents=True)
        for k, v in files.items():
            (folder / k).write_bytes(v)
    (top / "notes").mkdir()
    return str(top)


def test_every_fault_is_its_gap_and_no_row(spark, root):
    found = saved.load(spark, root).collect()
    assert {r.job: r.gap for r in found} == {k: gap for k, (_, gap) in CASES.items() if k != "empty"}
    rows = [(r.job, r.page, r.place, json.loads(r.row)["a"]) for r in found if r.gap is None]
    assert sorted(rows, key=str) == sorted([(k, p, i, a) for k in ("sound", "no_total", "digits") for p, i, a in ((0, 0, 1), (0, 1, 2), (2, 2, 3), (2, 3, None), (4, 4, 5))], key=str)


def test_filters_leave_out_folders(spark, root):
    df = saved.load(spark, root)
    assert df.rdd.getNumPartitions() == len(CASES)
    one = df.where("account = 1")
    assert one.rdd.getNumPartitions() == len([i for i in range(len(CASES)) if i % 3 == 1])
    assert {r.account for r in one.collect()} == {1} and df.where("account in (7, 8)").collect() == []


def test_a_root_without_jobs_is_empty(spark, tmp_path):
    assert saved.load(spark, str(tmp_path)).collect() == []
