"""Tables whose rows can be changed: files by bucket of the key, and a manifest that names those that count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketeer.sources.shared import delete

BUCKET = "__bucket"
KEPT_BATCHES = 1000  # batches of which a manifest remembers that they have taken effect


@dataclass(frozen=True)
class Upsert:
    """Rows that replace those of the same key, or come in anew. Of rows with the same key in one batch the greatest counts."""

    table: str
    rows: DataFrame


@dataclass(frozen=True)
class InsertIgnore:
    """Rows that come in if their key isn't there yet."""

    table: str
    rows: DataFrame


@dataclass(frozen=True)
class Delete:
    """The rows that fulfil a condition go."""

    table: str
    condition: Column


class Conflict(Exception):
    """Another writer has changed the store meanwhile."""


class Store:
    """A folder of such tables. All changes of one call are seen at once, or none.

    A change writes new files for the buckets that it touches, and then a manifest with the next number, which must not exist yet. Readers
    take the newest manifest, so what a killed task or driver leaves behind is never read; ``vacuum`` removes it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests ----

    def _manifest(self, number: int) -> object:
        return self._paths(f"{self.path}/manifests/{number:012d}.json")

    def state(self) -> dict:
        """The newest manifest that was written whole."""
        folder = self._paths(f"{self.path}/manifests")
        names = sorted((f.getPath().getName() for f in self._files.listStatus(folder)), reverse=True) if self._files.exists(folder) else []
        for name in names:
            text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).collect())
            try:
                return json.loads(text)
            except ValueError:  # its writer died
                continue
        return {"number": 0, "tables": {}, "batches": []}

    def _commit(self, state: dict) -> None:
        at = self._manifest(state["number"])
        try:
            out = self._files.create(at, False)
        except Exception as e:
            raise Conflict(str(state["number"])) from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    # ---- tables ----

    def create(self, table: str, schema: StructType, key: list[str], buckets: int = 16) -> None:
        """An empty table; one that is there stays as it is."""
        state = self.state()
        if table not in state["tables"]:
            state["tables"][table] = {"schema": schema.jsonValue(), "key": key, "buckets": buckets, "folders": {}}
            self._commit(state | {"number": state["number"] + 1})

    def tables(self) -> list[str]:
        return sorted(self.state()["tables"])

    def read(self, table: str) -> DataFrame:
        """The table as it is now; later changes don't alter what is read."""
        known = self.state()["tables"][table]
        return self._rows(known, known["folders"]).drop(BUCKET)

    def _rows(self, known: dict, folders: dict[str, list[str]]) -> DataFrame:
        schema = StructType.fromJson(known["schema"])
        paths = [f"{self.path}/{f}" for held in folders.values() for f in held]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn(BUCKET, self._bucket(known))

    def _bucket(self, known: dict) -> Column:
        return F.pmod(F.xxhash64(*known["key"]), F.lit(known["buckets"])).cast("int")

    def _write(self, known: dict, table: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket; the folder of each bucket that has any."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.repartitionByRange(BUCKET, *known["key"]).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        top = self._paths(f"{self.path}/{folder}")
        found = [f.getPath().getName() for f in self._files.listStatus(top)]  # one for each bucket at most
        return {n.partition("=")[2]: f"{folder}/{n}" for n in found if n.startswith(BUCKET)}

    # ---- changes ----

    def apply(self, changes: list[Upsert | InsertIgnore | Delete], batch: str | None = None, attempts: int = 3) -> bool:
        """Makes the changes, one after the other, and shows them together. False if the batch of that name has taken effect before.

        If another writer was faster, they are made anew on what it has left.
        """
        for left in reversed(range(attempts)):
            state = self.state()
            if batch is not None and batch in state["batches"]:
                return False
            for change in changes:
                self._change(state["tables"][change.table], change)
            state["number"] += 1
            state["batches"] = (state["batches"] + [batch] * (batch is not None))[-KEPT_BATCHES:]
            try:
                self._commit(state)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def _change(self, known: dict, change: Upsert | InsertIgnore | Delete) -> None:
        key = known["key"]
        if isinstance(change, Delete):
            held = self._rows(known, known["folders"])
            gone = F.coalesce(change.condition, F.lit(False))
            touched = self._touched(held.where(gone))
            self._replace(known, change.table, touched, lambda rows: rows.where(~gone))
            return
        schema = StructType.fromJson(known["schema"])
        others = [c for c in schema.names if c not in key]
        rows = change.rows.select(*[F.col(c).cast(schema[c].dataType) for c in schema.names])
        single = rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("v")).select(*key, "v.*").select(*schema.names) if others else rows.distinct()
        single = single.withColumn(BUCKET, self._bucket(known))
        touched = self._touched(single)
        here = self._rows(known, {b: known["folders"][b] for b in touched if b in known["folders"]})
        same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in key]
        if isinstance(change, InsertIgnore):
            new = single.alias("new").join(here.alias("old"), same, "left_anti")
            for b, folder in self._write(known, change.table, new).items():
                known["folders"].setdefault(b, []).append(folder)
        else:
            self._replace(known, change.table, touched, lambda rows: rows.alias("old").join(single.alias("new"), same, "left_anti").unionByName(single))

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r[0]) for r in rows.select(BUCKET).distinct().collect()]  # there are few buckets

    def _replace(self, known: dict, table: str, touched: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
        rows = self._rows(known, {b: known["folders"][b] for b in touched if b in known["folders"]})
        written = self._write(known, table, change(rows))
        for b in touched:
            known["folders"].pop(b, None)
        known["folders"].update({b: [f] for b, f in written.items()})

    def vacuum(self) -> int:
        """Deletes the folders that the newest manifest doesn't name, and older manifests. No reader or writer may be at work. Returns how many went."""
        state, n = self.state(), 0
        for table, known in state["tables"].items():
            named = {f.rpartition("/")[0] for held in known["folders"].values() for f in held}
            top = self._paths(f"{self.path}/{table}")
            for entry in self._files.listStatus(top) if self._files.exists(top) else []:
                if f"{table}/{entry.getPath().getName()}" not in named:
                    delete(self.spark, str(entry.getPath()))
                    n += 1
        for entry in self._files.listStatus(self._paths(f"{self.path}/manifests")):
            if entry.getPath().getName() < f"{state['number']:012d}.json":
                delete(self.spark, str(entry.getPath()))
        return n
