"""Saved results of finished jobs as a data source: chains of JSON pages with receipts, verified as they are read.

A job is a folder `account=<n>/job=<name>` below a root: job.json (sql, sql_sha256, state, execution_id, perhaps total), and for each page
page_<offset>.json as it came and receipt_<offset>.json (http_status, sha256, bytes, execution_id, offset). A job is a partition: its chain of
pages is walked twice, first to verify it, then for its rows, so a job is read whole or not at all, in memory of one page. A job that
doesn't verify gives one row with its gap. Filters on the account leave out folders before anything of them is opened.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "account long, job string, page long, place long, row string, gap string"


def _store(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root) if "://" in root else FileSystem.from_uri(f"file://{root}")


class Gap(Exception):
    """Why a job isn't read."""


def _count(value) -> int:
    """A whole number that isn't below zero, as a number or as digits."""
    if isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, str) and value.isascii() and value.isdigit()) or int(value) < 0:
        raise Gap("NOT_A_COUNT")
    return int(value)


class _Job:
    def __init__(self, store, path: str):
        self.store, self.path = store, path

    def _bytes(self, name: str) -> bytes:
        try:
            with self.store.open_input_stream(f"{self.path}/{name}", compression=None) as f:
                return f.read()
        except FileNotFoundError:
            raise Gap(f"MISSING_{name.partition('_')[0].partition('.')[0].upper()}") from None

    def _json(self, raw: bytes, kind: str) -> dict:
        try:
            found = json.loads(raw)
        except ValueError:
            found = None
        if not isinstance(found, dict):
            raise Gap(f"MALFORMED_{kind}")
        return found

    def head(self) -> dict:
        job = self._json(self._bytes("job.json"), "JOB")
        text = str(job.get("sql", "")).replace("\r\n", "\n")
        if hashlib.sha256(text.encode()).hexdigest() != job.get("sql_sha256"):
            raise Gap("SQL_DIGEST")
        if job.get("state") != "QUERY_STATE_COMPLETED" or not job.get("execution_id"):
            raise Gap("NOT_COMPLETED")
        return job

    def page(self, offset: int, job: dict, total: int | None) -> tuple[list, int, int | None]:
        """Rows, the total and the next offset of a page that verifies."""
        raw = self._bytes(f"page_{offset}.json")
        receipt = self._json(self._bytes(f"receipt_{offset}.json"), "RECEIPT")
        if receipt.get("http_status") != 200 or receipt.get("sha256") != hashlib.sha256(raw).hexdigest():
            raise Gap("PAGE_DIGEST")
        if receipt.get("bytes") != len(raw):
            raise Gap("PAGE_SIZE")
        if receipt.get("execution_id") != job["execution_id"] or receipt.get("offset") != offset:
            raise Gap("RECEIPT_BINDING")
        page = self._json(raw, "PAGE")
        if page.get("execution_id") != job["execution_id"] or page.get("state") != "QUERY_STATE_COMPLETED":
            raise Gap("PAGE_BINDING")
        result = page.get("result") if isinstance(page.get("result"), dict) else {}
        rows, meta = result.get("rows"), result.get("metadata") if isinstance(result.get("metadata"), dict) else {}
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise Gap("ROWS_MISSING")
        now = _count(meta.get("total_row_count"))
        if total is not None and now != total:
            raise Gap("TOTAL_CHANGED")
        if _count(meta.get("row_count")) != len(rows):
            raise Gap("ROW_COUNT")
        following = page.get("next_offset")
        if following is None:
            if offset + len(rows) != now:
                raise Gap("INCOMPLETE_END")
            return rows, now, None
        if not rows or _count(following) != offset + len(rows):
            raise Gap("CURSOR")
        return rows, now, int(following)

    def pages(self):
        """(offset, rows) along the chain; offsets grow, so it ends."""
        job, offset, total = self.head(), 0, None
        while offset is not None:
            rows, total, following = self.page(offset, job, total)
            yield offset, rows
            offset = following
        if job.get("total") is not None and _count(job["total"]) != total:
            raise Gap("STATUS_TOTAL")


class _Chain(InputPartition):
    def __init__(self, account: int, job: str, path: str):
        self.account, self.job, self.path = account, job, path


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.accounts = root, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("account",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.accounts = wanted if self.accounts is None else self.accounts & wanted
            yield f  # Spark still applies it to the rows

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        store, path = _store(self.root)
        found = []
        for top in store.get_file_info(FileSelector(path)):
            name, _, account = top.base_name.partition("=")
            if top.type == FileType.Directory and name == "account" and account.lstrip("-").isdigit() and (self.accounts is None or int(account) in self.accounts):
                for job in store.get_file_info(FileSelector(top.path)):
                    if job.type == FileType.Directory and job.base_name.startswith("job="):
                        found.append(_Chain(int(account), job.base_name.removeprefix("job="), job.path))
        return sorted(found, key=lambda c: (c.account, c.job)) or [_Chain(0, "", "")]

    def read(self, partition):
        if not partition.path:
            return
        job = _Job(_store(self.root)[0], partition.path)
        try:
            for _ in job.pages():
                pass
        except Gap as gap:
            yield partition.account, partition.job, None, None, None, str(gap)
            return
        for offset, rows in job.pages():
            for i, row in enumerate(rows):
                yield partition.account, partition.job, offset, offset + i, json.dumps(row, sort_keys=True, separators=(",", ":")), None


class SavedResults(DataSource):
    """spark.read.format("saved_results").load(root), after `register`."""

    @classmethod
    def name(cls) -> str:
        return "saved_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedResults)


def load(spark: SparkSession, root: str) -> DataFrame:
    """account, job, page, place, row (JSON) of all jobs below root; a job that doesn't verify is one row with its gap."""
    register(spark)
    return spark.read.format("saved_results").load(root)


def write_files(files: DataFrame, root: str) -> None:
    """Writes (path below root, content) of every row as a file of its own, where it is dealt."""

    def put(rows):
        store, top = _store(root)
        for r in rows:
            path = f"{top}/{r['path']}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path, compression=None) as f:
                f.write(r["content"].encode())

    files.select("path", "content").foreachPartition(put)
