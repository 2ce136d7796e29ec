"""Results as Parquet tables by run (SNK1-SNK9, SNK15, SNK16, SNK18, SNK19)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.learn import upserted

#: Tables that are replaced as a whole, and those to which each run adds a partition.
CURRENT = ("item", "driver", "standard_rate", "series", "observation", "series_context", "model_override", "mode_override", "accuracy_history")
PER_RUN = ("selection", "forecast", "validation", "validation_result", "warning", "condition", "flat", "winner", "point")
#: Of the latter, those that only the run itself reads, while it runs.
WORKING = ("condition", "flat", "winner", "point")
#: What reads are ordered by, where it matters.
ORDER = {"forecast": ("series_id", "period_start"), "observation": ("series_id", "period_start"), "accuracy_history": ("series_id", "period"), "selection": ("series_id",)}
#: Analyses that a cache keeps.
CACHED = 8


class Repository:
    """Below one folder on any file system that Spark writes.

    A replaced table gets a new version beside the old one, and a pointer file
    names the current one. A pointer is written under another name and renamed
    over the old one, so readers meet the old table or the new one; and the
    last version stays until the next replacement, so that plans which read it
    already can end.

    Runs are a log of numbered files, each of which is created only if no other
    has its number, whole or not at all; so runs that begin at once have numbers
    of their own, and none is lost. What a run adds lies under its own id.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        if not self._fs().exists(self._path(name)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())

    def _put(self, name: str, text: str, over: bool = True) -> bool:
        """The whole text or none of it: written beside, then renamed over what is there; or, without ``over``, only if nothing is there, else false."""
        part = self._path(f"{name}.{uuid.uuid4().hex}")
        out = self._fs().create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if over else kind.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(part, self._path(name), how)
        except Py4JJavaError as e:
            self._fs().delete(part, False)
            if not over and "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _versions(self, table: str) -> list[str]:
        """The current version and the last one before it."""
        return (self._text(f"{table}.current") or "").split()

    def replace(self, table: str, df: DataFrame) -> DataFrame:
        """The new version, as it was written, whatever is current by then."""
        version = f"{table}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{version}")
        was = self._versions(table)
        self._put(f"{table}.current", "\n".join([version, *was[:1]]))
        for old in was[1:]:
            self._fs().delete(self._path(old), True)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{version}")

    def read(self, table: str, run_id: str | None = None, series: list[str] | None = None, ordered: bool = False, backfill: dict[str, object] | None = None) -> DataFrame | None:
        """SNK8, SNK9, ORD7: partitions of the run, filters pushed to the files, in the table's order if asked; columns that older files lack are null, or what ``backfill`` says. None if there is no such table."""
        if table in PER_RUN:
            stored = self._text(f"{table}.schema")
            if stored is None:
                return None
            # The schema is the stored one, so no footers are read for it, and a run's rows are read from its own folder.
            schema = StructType.fromJson(json.loads(stored))
            where = self._path(table, f"run_id={run_id}") if run_id is not None else self._path(table, "run_id=*")
            if not self._fs().globStatus(where):  # no row so far
                return self.spark.createDataFrame([], schema)
            df = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}" if run_id is None else f"{self.root}/{table}/run_id={run_id}")
        else:
            versions = self._versions(table)
            if not versions:
                return None
            df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{versions[0]}")
        for name, value in (backfill or {}).items():
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
        df = df if series is None else df.where(F.col("series_id").isin(series))
        return df.orderBy(*ORDER[table]) if ordered and table in ORDER else df

    def append(self, table: str, run_id: str, df: DataFrame) -> DataFrame:
        """Adds rows to a run's; the run's rows."""
        rows = df.withColumn("run_id", F.lit(run_id))
        rows.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/{table}")
        self._learn(table, rows.schema)
        return self.read(table, run_id)

    def _learn(self, table: str, schema: StructType) -> None:
        """SNK9: columns that are new are added to the stored schema."""
        stored = self._text(f"{table}.schema")
        fields = {f.name: f for f in ([] if stored is None else StructType.fromJson(json.loads(stored)))}
        both = StructType(list((fields | {f.name: StructField(f.name, f.dataType, True) for f in schema}).values()))
        if stored is None or both.json() != stored:
            self._put(f"{table}.schema", both.json())

    def put_notes(self, table: str, run_id: str, code: str, df: DataFrame) -> None:
        """A run's rows of one ``code`` are these, in place of those there were."""
        rows = self.read(table, run_id)
        kept = df.withColumn("run_id", F.lit(run_id)) if rows is None else rows.where(F.col("code") != code).unionByName(df.withColumn("run_id", F.lit(run_id)), allowMissingColumns=True)
        fresh = f"{table}.{uuid.uuid4().hex}"
        kept.drop("run_id").write.parquet(f"{self.root}/{fresh}")
        self._fs().delete(self._path(table, f"run_id={run_id}"), True)
        self._fs().mkdirs(self._path(table))
        self._fs().rename(self._path(fresh), self._path(table, f"run_id={run_id}"))
        self._learn(table, kept.schema)

    def upsert_accuracy(self, rows: DataFrame) -> None:
        stored = self.read("accuracy_history")
        self.replace("accuracy_history", rows if stored is None else upserted(stored, rows))

    def set_override(self, table: str, key: str, value: str | None) -> None:
        """SNK6: None clears it."""
        name = "item_code" if table == "mode_override" else "series_id"
        what = "mode" if table == "mode_override" else "model"
        stored = self.read(table)
        rows = {} if stored is None else {r[0]: r[1] for r in stored.select(name, what).collect()}  # what planners typed
        rows.pop(key, None)
        if value is not None:
            rows[key] = value
        self.replace(table, self.spark.createDataFrame(list(rows.items()), f"{name} string, {what} string"))

    def _log(self) -> dict[int, str]:
        """Numbers of runs, and the files that tell of them."""
        found = self._fs().globStatus(self._path("runs", "*.json")) or []
        return {int(f.getPath().getName()[:-5]): f.getPath().getName() for f in found}

    def runs(self) -> list[dict]:
        """ORD6: the latest first."""
        if not self._log():
            return []
        texts = self.spark.read.text(f"{self.root}/runs/*.json", wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in texts), key=lambda r: -r["number"])

    def create_run(self, config: dict, source: str = "") -> str:
        """A run with the next number that no other has taken."""
        run = {"run_id": uuid.uuid4().hex, "status": "running", "config": config, "source": source, "started": datetime.now(timezone.utc).isoformat()}
        number = max([0, *self._log()]) + 1
        self._fs().mkdirs(self._path("runs"))
        while not self._put(f"runs/{number:010d}.json", json.dumps(run | {"number": number}), over=False):
            number += 1
        return run["run_id"]

    def finish_run(self, run_id: str, status: str = "complete") -> None:
        """Writes the run's own file anew; what only the run itself read goes."""
        for r in self.runs():
            if r["run_id"] == run_id:
                self._put(f"runs/{r['number']:010d}.json", json.dumps(r | {"status": status, "finished": datetime.now(timezone.utc).isoformat()}))
        self._delete_rows(run_id, WORKING)

    def latest_complete(self) -> dict | None:
        return next((r for r in self.runs() if r["status"] == "complete"), None)

    def _delete_rows(self, run_id: str, tables: tuple[str, ...]) -> None:
        for t in tables:
            self._fs().delete(self._path(t, f"run_id={run_id}"), True)

    def delete_run_rows(self, run_id: str) -> None:
        self._delete_rows(run_id, PER_RUN)

    def delete_run(self, run_id: str) -> None:
        """SNK18: its partitions go, then its entry."""
        self.delete_run_rows(run_id)
        for r in self.runs():
            if r["run_id"] == run_id:
                self._fs().delete(self._path("runs", f"{r['number']:010d}.json"), False)

    def delete_all(self) -> None:
        for r in self.runs():
            self.delete_run(r["run_id"])


def settings_key(source: str, config: dict, overrides: dict | None = None) -> str:
    """SNK16: what an analysis depends on, all settings included."""
    return hashlib.sha256(json.dumps([source, config, overrides or {}], sort_keys=True).encode()).hexdigest()[:16]


def cached(store: Repository, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """SNK16: the table computed for a key before, or now; the ``CACHED`` latest are kept."""
    known: list[list[str]] = json.loads(store._text("cache.json") or "[]")
    at = dict(known).get(key)
    if at is None or not store._fs().exists(store._path(at)):
        at = f"cache/{key}-{uuid.uuid4().hex}"
        compute().write.parquet(f"{store.root}/{at}")
    entries = [[k, v] for k, v in known if k != key] + [[key, at]]
    store._put("cache.json", json.dumps(entries[-CACHED:]))
    for _, old in entries[:-CACHED]:
        store._fs().delete(store._path(old), True)
    return store.spark.read.parquet(f"{store.root}/{at}")


def sample(frames: dict[str, DataFrame], n: int = 10) -> dict[str, DataFrame]:
    """SNK15."""
    return {k: v.limit(n) for k, v in frames.items()}
