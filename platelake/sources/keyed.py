"""Keyed parquet tables: upserts that rewrite only the buckets they touch, and a change log folded into them.

Rows are dealt into a fixed number of buckets by a hash of their key, or by the first characters of a key column, such as the
month of a day, and a read can then choose some.  A commit names the folder of every bucket; an upsert
reads and rewrites the buckets of its rows and takes the other folders over unchanged.  Choose the number of buckets so that
one is a convenient file (some hundred megabytes); a bucket is merged in one task of that size, keys being unique.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelake.operators.silver import latest
from platelake.sources.commits import Files, Versions
from platelake.sources.workspace import stored

BUCKET = "_bucket"
GONE = "_gone"


class KeyedTable:
    """``read``, ``upsert`` and ``replace``; readers of the last ``keep`` versions find their files."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 16, keep: int = 2,
                 by: str | None = None, chars: int = 10):
        self.spark, self.root, self.keys, self.keep = spark, root.rstrip("/"), list(keys), keep
        self.by, self.chars = by, chars
        self.files = Files(spark, root)
        self.versions = Versions(self.files)
        _, state = self.versions.newest()
        self.buckets = state["buckets"] if state else buckets

    def _bucket(self) -> Column:
        if self.by is not None:
            return F.coalesce(F.substring(F.col(self.by).cast("string"), 1, self.chars), F.lit("none"))
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def _load(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        chosen = sorted(state["folders"]) if buckets is None else [b for b in buckets if b in state["folders"]]
        paths = [f"{self.root}/{state['folders'][b]}" for b in chosen]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The newest version; None before the first one."""
        _, state = self.versions.newest()
        return self._load(state) if state else None

    def read_between(self, first: str, last: str) -> DataFrame | None:
        """Rows whose ``by`` column lies between two texts, from the folders that can hold them alone."""
        _, state = self.versions.newest()
        if not state:
            return None
        near = sorted(b for b in state["folders"] if first[:self.chars] <= b <= last[:self.chars])
        return self._load(state, near).filter(F.col(self.by).cast("string").between(first, last))

    def upsert(self, updates: DataFrame, version: str | None = None) -> DataFrame:
        """Overlay the rows by key: the update wins, then the higher ``version``.  Columns new to the table are added."""
        number, state = self.versions.newest()
        new = stored(updates.withColumn(BUCKET, self._bucket()), "upsert")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most one row for each bucket
        rows = new.drop(BUCKET).withColumn("_new", F.lit(1))
        if state:
            old = self._load(state, touched).withColumn("_new", F.lit(0))
            rows = old.unionByName(rows, allowMissingColumns=True)
        merged = latest(rows, self.keys, *["_new", version] if version else ["_new"]).drop("_new")
        return self._put(number, state, merged, touched)

    def replace(self, rows: DataFrame) -> DataFrame:
        """Other rows in place of all; readers see the old ones until the new ones are complete."""
        number, _ = self.versions.newest()
        return self._put(number, None, rows, [])

    def _put(self, number: int, state: dict | None, rows: DataFrame, touched: list[str], **more) -> DataFrame:
        folder = f"data/{uuid.uuid4().hex}"
        (rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET)
         .parquet(f"{self.root}/{folder}"))
        made = {n.split("=")[1] for n in self.files.names(folder) if n.startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in (state["folders"] if state else {}).items() if b not in touched}
        folders |= {b: f"{folder}/{BUCKET}={b}" for b in made}
        content = {"buckets": self.buckets, "folders": folders, "schema": rows.schema.jsonValue()}
        self.versions.commit(number, content | {k: v for k, v in (state or {}).items() if k not in content} | more)
        self.sweep()
        return self._load(content)

    def sweep(self) -> None:
        """Remove folders that no kept version names.  Files of a running upsert are named by none yet: one writer at a time."""
        named = set()
        for content in self.versions.forget(self.keep):
            named |= {*content["folders"].values(), *content.get("deltas", {}).values()}
        for run in self.files.names("data"):
            for part in self.files.names(f"data/{run}"):
                if part.startswith(f"{BUCKET}=") and f"data/{run}/{part}" not in named:
                    self.files.remove(f"data/{run}/{part}")
            if not any(f.startswith(f"data/{run}/") for f in named):
                self.files.remove(f"data/{run}")
        for run in self.files.names("deltas"):
            if f"deltas/{run}" not in named:
                self.files.remove(f"deltas/{run}")


class ChangeLog(KeyedTable):
    """Newest row per key of a change feed: batches are appended as deltas and folded into the buckets from time to time.

    ``version`` orders the changes of a key; a late change loses wherever it meets the newer one.  ``gone`` is a condition on
    a change that erases its key: such a row stays as a tombstone, with nothing but key and version, so that late changes still
    lose, and readers do not see it.  A batch that is delivered again replaces its own delta, or loses against the rows it
    already gave.  After ``compact`` a read costs the live keys and their tombstones, however long the history.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], version: str, gone: str = "false",
                 buckets: int = 16, keep: int = 2):
        super().__init__(spark, root, keys, buckets, keep)
        self.version, self.gone = version, gone

    def _marked(self, changes: DataFrame) -> DataFrame:
        gone = F.coalesce(F.expr(self.gone), F.lit(False))
        kept = {*self.keys, self.version}
        return changes.withColumn(GONE, gone).select(
            *[F.col(c) if c in kept else F.when(~F.col(GONE), F.col(c)).alias(c) for c in changes.columns], GONE)

    def append(self, changes: DataFrame, batch: int) -> None:
        """Commit a batch of changes, of which the newest per key are kept."""
        folder = f"deltas/{batch}-{uuid.uuid4().hex}"
        rows = latest(self._marked(changes), self.keys, self.version)
        rows.write.parquet(f"{self.root}/{folder}")
        number, state = self.versions.newest()
        state = state or {"buckets": self.buckets, "folders": {}, "schema": rows.schema.jsonValue()}
        self.versions.commit(number, state | {"deltas": state.get("deltas", {}) | {str(batch): folder}})
        self.sweep()

    def _deltas(self, state: dict) -> DataFrame | None:
        paths = [f"{self.root}/{f}" for f in state.get("deltas", {}).values()]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def _everything(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        rows, deltas = self._load(state, buckets), self._deltas(state)
        return rows if deltas is None else rows.unionByName(deltas, allowMissingColumns=True)

    def read(self) -> DataFrame | None:
        _, state = self.versions.newest()
        if not state:
            return None
        rows = self._everything(state)
        if state.get("deltas"):
            rows = latest(rows, self.keys, self.version)
        return rows.filter(~F.col(GONE)).drop(GONE)

    def compact(self) -> None:
        """Fold the deltas into the buckets they touch."""
        number, state = self.versions.newest()
        deltas = self._deltas(state) if state else None
        if deltas is None:
            return
        touched = [r[0] for r in deltas.select(self._bucket()).distinct().collect()]
        rows = self._load(state, touched).unionByName(deltas, allowMissingColumns=True)
        self._put(number, state, latest(rows, self.keys, self.version), touched, deltas={})

    def pending(self) -> int:
        _, state = self.versions.newest()
        return len(state.get("deltas", {})) if state else 0
