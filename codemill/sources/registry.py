"""The registry: file times, embeddings, query log, jobs, reports and projects as tables that are replaced as a whole.

Each mutation is a function of the old table and the change to the new table; write() puts it in place by one pointer.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codemill.settings import BACKGROUND_PRIORITY


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key by order, ties by all columns."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order, F.struct(*others))).alias("_r"))
    return best.select(*key, "_r.*").select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in the place of those with their key; of equal keys in new one remains, the greatest."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(latest(new, key, *[c for c in new.columns if c not in key]))


def removed(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.distinct(), keys.columns, "left_anti")


def file_times(cache: DataFrame) -> DataFrame:
    """index_name, file_path, mtime_ms: the newest of each file."""
    return cache.groupBy("index_name", "file_path").agg(F.max("mtime_ms").alias("mtime_ms"))


def kept_newest(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The most newest rows; none is kept track of (an empty table) for most below 1. A global sort whose limit runs in parts."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(most) if most >= 1 else rows.limit(0)


def inserted_ignoring(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key it has not."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).alias("bytes"))


def jobs_now(jobs: DataFrame) -> DataFrame:
    """The last state of each job: an id may have an earlier pending row."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    return latest(jobs.withColumn("_o", rank), ["id"], "_o", "created_at").drop("_o")


def interrupted(jobs: DataFrame) -> DataFrame:
    """jobs as after a restart: what ran has failed."""
    running = F.col("status") == "running"
    return jobs.withColumn("error", F.when(running, "interrupted by a restart").otherwise(F.col("error"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))


def restored(jobs: DataFrame) -> DataFrame:
    """Jobs to be queued again after a restart, in the background: those that ran or waited."""
    return jobs.where(F.col("status").isin("running", "pending")).withColumn("status", F.lit("pending")).withColumn("priority", F.lit(BACKGROUND_PRIORITY))


def claim_order(jobs: DataFrame) -> DataFrame:
    """Waiting jobs with place: the higher priority first, then the older, then by id."""
    waiting = jobs.where("status = 'pending'").orderBy(F.col("priority").desc(), "created_at", "id")
    return waiting.withColumn("place", F.row_number().over(Window.orderBy(F.col("priority").desc(), "created_at", "id")))


def job_project(payload: str = "payload"):
    """The project of a job's payload; null where it is null, empty or cut off."""
    return F.get_json_object(payload, "$.project")


def deep_removed(name: str, indexes: DataFrame, cache: DataFrame, reports: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All registry tables without a project; a job goes by the project field of its payload, not by its text."""
    return indexes.where(F.col("name") != name), cache.where(F.col("index_name") != name), reports.where(F.col("project") != name), jobs.where(~job_project().eqNullSafe(F.lit(name)))


def deleted_files(cache: DataFrame, present: DataFrame) -> DataFrame:
    """index_name, file_path of cached files that are not among the present ones."""
    return file_times(cache).select("index_name", "file_path").join(present.select("index_name", "file_path").distinct(), ["index_name", "file_path"], "left_anti")


def sync_plan(listed: DataFrame, cache: DataFrame) -> DataFrame:
    """index_name, file_path, change: new, changed (its time differs), unchanged or deleted. listed: index_name, file_path, mtime_ms."""
    key = ["index_name", "file_path"]
    rows = listed.groupBy(*key).agg(F.max("mtime_ms").alias("now")).join(file_times(cache).withColumnRenamed("mtime_ms", "then"), key, "full")
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed").otherwise("unchanged")
    return rows.select(*key, change.alias("change"))


class Store:
    """Tables in a folder. A write goes to a new folder; the pointer file then changes by one rename, so that readers see the
    old table or the new one, and a writer that dies leaves the old one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _pointer(self) -> str:
        return f"{self.folder}/tables.json"

    def tables(self) -> dict[str, str]:
        rows = self.spark.read.text(self._pointer(), wholetext=True).collect() if self._exists(self._pointer()) else []
        return json.loads(rows[0][0]) if rows else {}

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.tables()[name])

    def write(self, *partitions: str, **frames: DataFrame) -> None:
        """Replaces all named tables at once."""
        now, old = self.tables(), []
        for name, df in frames.items():
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.write.partitionBy(*partitions).parquet(path)
            old += [now[name]] if name in now else []
            now[name] = path
        self._swap(now)
        for path in old:
            self._delete(path)

    def drop(self, name: str) -> None:
        now = self.tables()
        path = now.pop(name)
        self._swap(now)
        self._delete(path)

    def _swap(self, now: dict[str, str]) -> None:
        fs, target = self._fs(self._pointer())
        temporary = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._pointer()}.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, target, options)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def orphans(self) -> list[str]:
        """Folders that no table points to, as a writer that died leaves them."""
        fs, p = self._fs(self.folder)
        held = {os.path.basename(x) for x in self.tables().values()}
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in held)
