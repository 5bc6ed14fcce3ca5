"""Intermediate tables in the folder that the session shares between executors."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, but only if all runs in one local process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def digest_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files that each path (a file or a folder of files) holds."""
    seen = []
    for path in paths:
        store, at = _files(spark, path)
        seen += sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in store.listStatus(at))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


class Run:
    """Steps of a loop as tables in the shared folder, under a key that names its inputs and parameters. A step that an earlier run with this
    key has finished is read in place of being computed: Spark's commit marks it. Without a key, all steps are this run's own."""

    def __init__(self, spark: SparkSession, key: str | None = None):
        self.spark, self.seen = spark, {}
        self.folder = f"{shared_folder(spark).rstrip('/')}/run-{hashlib.sha256(key.encode()).hexdigest() if key else uuid.uuid4().hex}"

    def finished(self) -> list[str]:
        """The manifest: steps that are there, whole, with the time of each one's commit, oldest first."""
        store, at = _files(self.spark, self.folder)
        steps = [f.getPath() for f in store.listStatus(at)] if store.exists(at) else []
        marks = [(p.getName(), self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in steps]
        found = [(store.getFileStatus(m).getModificationTime(), n) for n, m in marks if store.exists(m)]
        return [n for _, n in sorted(found)]

    def step(self, name: str, make: Callable[[], DataFrame], watched: tuple[Column, ...] = ()) -> DataFrame:
        """The table of a step. watched: named aggregates of it, which then stand in `seen` under its name, gathered as it is written."""
        path = f"{self.folder}/{name}"
        done, schema = name in self.finished(), None
        if not done:
            df, watch = make(), Observation()
            schema = df.schema
            df = df.observe(watch, *watched) if watched else df
            df.write.mode("overwrite").parquet(path)  # over what a run that was cut off may have left
            self.seen[name] = watch.get if watched else {}
        out = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)
        if done and watched:
            self.seen[name] = out.agg(*watched).first().asDict()
        return out

    def drop(self, *names: str) -> None:
        """Deletes steps, or all of the run."""
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            store, at = _files(self.spark, path)
            store.delete(at, True)
