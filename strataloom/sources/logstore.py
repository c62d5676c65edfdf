"""A log-structured store: tables whose writes add delta files only, under one log of versions.

Each write adds a folder of Parquet files per table, dealt into buckets by the hash of the key, and then one log entry,
which is made under another name and renamed, so that readers see all of a write's tables or none, and a writer that
fails half-way leaves the version before it in force. An entry holds the whole state: for each table the folder that
has each bucket's base rows (one per key) and the deltas since, in order. Reading lets the newest row of a key win: the
newest of the deltas, and the base rows whose keys are in no delta. When deltas are many, the buckets that they
touch are rewritten into a new base; others stay where they are.

A write may carry a writer's name and epoch: one that is not newer than the writer's last epoch changes nothing, so
replayed micro-batches are harmless.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, GONE = "_bucket", "_gone"


@dataclass(frozen=True)
class Keyed:
    """A table's schema (DDL) and key columns; of a write's equal keys the one with the largest `order` wins."""

    schema: str
    key: tuple[str, ...]


class Conflict(RuntimeError):
    """Another writer took the version that this one was to become."""


class LogStore:
    """Tables under one log. `buckets` is fixed when the store is made; `most_deltas` are read before they are merged."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Keyed], buckets: int = 32, most_deltas: int = 8) -> None:
        self.spark, self.path, self.tables, self.most_deltas = spark, path.rstrip("/"), tables, most_deltas
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self.state()
        self.buckets = found["buckets"] if found else buckets

    # --- the log ---------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def state(self, version: int | None = None) -> dict | None:
        n = self.version() if version is None else version
        if not n:
            return None
        stream = self._fs.open(self._path(f"{self.path}/_log/{n:020d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _empty(self) -> dict:
        return {"version": 0, "buckets": self.buckets, "writers": {}, "tables": {t: {"base": {}, "deltas": [], "changed": 0} for t in self.tables}}

    def _commit(self, state: dict) -> int:
        """Make state the next version; raises Conflict where that number is taken."""
        state["version"] += 1
        jvm = self.spark.sparkContext._jvm
        self._fs.mkdirs(self._path(f"{self.path}/_log"))
        made, final = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_log/{state['version']:020d}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # a rename that never replaces
            files.rename(made, final, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {state['version']} of {self.path}") from None
            raise
        return state["version"]

    # --- writing ---------------------------------------------------------------------------------------------

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table].key), F.lit(self.buckets)).cast("int")

    def _segment(self, table: str, rows: DataFrame, folder: str) -> list[int]:
        """Write rows (with GONE) into a folder of bucket folders; the buckets that have rows."""
        dealt = rows.withColumn(BUCKET, self.bucket(table))
        dealt.repartition(BUCKET, F.pmod(F.xxhash64(*self.tables[table].key, F.lit(1)), F.lit(8))).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(BUCKET + "="))

    def _newest(self, table: str, rows: DataFrame, order: Column) -> DataFrame:
        key = self.tables[table].key
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")

    def seen(self, writer: str, epoch: int) -> bool:
        state = self.state()
        return state is not None and state["writers"].get(writer, -1) >= epoch

    def write(self, rows: dict[str, DataFrame], order: dict[str, str] | None = None, gone: dict[str, DataFrame] | None = None, clear: tuple[str, ...] = (), writer: str | None = None, epoch: int | None = None) -> int:
        """Upsert rows into tables, delete keys (`gone`), empty tables first (`clear`): all in one version, whose number is returned.

        order: by table, the column that decides among a write's equal keys (it need not be a column of the table); without
        one the keys of a write must be distinct. With a writer and an epoch that the writer has passed, nothing changes.
        Two writers at once: the later one raises Conflict and may try again; its files are left to vacuum.
        """
        state = self.state() or self._empty()
        if writer is not None and epoch is not None:
            if state["writers"].get(writer, -1) >= epoch:
                return state["version"]
            state["writers"][writer] = epoch
        changed = state["version"] + 1
        for table in clear:
            state["tables"][table] = {"base": {}, "deltas": [], "changed": changed}
        for table in sorted({*rows, *(gone or {})}):
            spec, own = self.tables[table], []
            kinds = dict(c.split(None, 1) for c in _fields(spec.schema))
            if table in rows:
                new = rows[table]
                if order and table in order:
                    new = self._newest(table, new, F.col(order[table]))
                own.append(new.select(*[F.col(c).cast(t) for c, t in kinds.items()]).withColumn(GONE, F.lit(False)))
            if gone and table in gone:
                keys = gone[table].select(*spec.key).distinct()
                own.append(keys.select(*[(F.col(c) if c in spec.key else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).withColumn(GONE, F.lit(True)))
            folder = f"data/{table}-{uuid.uuid4().hex}"
            buckets = self._segment(table, reduce(DataFrame.unionByName, own), folder)
            if buckets:
                state["tables"][table]["deltas"].append({"folder": folder, "buckets": buckets})
                state["tables"][table]["changed"] = changed
        done = self._commit(state)
        if max(len(t["deltas"]) for t in state["tables"].values()) > self.most_deltas:
            try:
                self.compact()
            except Conflict:  # someone else writes: the next writer will merge
                return done
        return done

    # --- reading ---------------------------------------------------------------------------------------------

    def _scan(self, table: str, folders: dict[str, list[int]]) -> DataFrame:
        """Rows of some buckets of some folders, with GONE."""
        schema = f"{self.tables[table].schema}, {GONE} boolean"
        paths = [f"{self.path}/{f}/{BUCKET}={b}" for f, buckets in folders.items() for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _deltas(self, table: str, state: dict, only: set[int] | None = None) -> DataFrame | None:
        """The newest row of each key in the deltas."""
        parts = []
        for n, delta in enumerate(state["tables"][table]["deltas"]):
            buckets = [b for b in delta["buckets"] if only is None or b in only]
            if buckets:
                parts.append(self._scan(table, {delta["folder"]: buckets}).withColumn("_n", F.lit(n)))
        if not parts:
            return None
        return parts[0].drop("_n") if len(parts) == 1 else self._newest(table, reduce(DataFrame.unionByName, parts), F.col("_n")).drop("_n")

    def _merged(self, table: str, state: dict, only: set[int] | None = None) -> DataFrame:
        base: dict[str, list[int]] = {}
        for b, folder in state["tables"][table]["base"].items():
            if only is None or int(b) in only:
                base.setdefault(folder, []).append(int(b))
        rows, new = self._scan(table, base), self._deltas(table, state, only)
        if new is not None:
            key = list(self.tables[table].key)
            old = rows.join(new.select(*key), key, "left_anti").select(*rows.columns) if base else rows
            rows = old.unionByName(new)
        return rows.where(~F.col(GONE)).drop(GONE)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default); a table that was never written is empty.

        Only the deltas are grouped; base rows lose those whose keys the deltas have, in an anti join whose small side is the
        deltas' keys, so that the base is shuffled only where the deltas are large.
        """
        state = self.state(version)
        if state is None:
            return self.spark.createDataFrame([], self.tables[table].schema)
        return self._merged(table, state)

    def lookup(self, table: str, *key) -> DataFrame:
        """The row of one key: only its bucket is read."""
        state, spec = self.state(), self.tables[table]
        schema = self.spark.createDataFrame([], spec.schema).schema
        own = self.spark.createDataFrame([tuple(key)], ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in spec.key))
        if state is None:
            return self.read(table)
        bucket = own.select(self.bucket(table)).first()[0]
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(spec.key, key, strict=True)])
        return self._merged(table, state, {bucket}).where(same)

    # --- upkeep ----------------------------------------------------------------------------------------------

    def compact(self) -> int:
        """Merge each table's deltas into new base rows of the buckets that they touch; what readers see stays the same."""
        state = self.state()
        if state is None:
            return 0
        for table, own in state["tables"].items():
            touched = {b for d in own["deltas"] for b in d["buckets"]}
            if not touched:
                continue
            folder = f"data/{table}-{uuid.uuid4().hex}"
            kept = self._segment(table, self._merged(table, state, touched).withColumn(GONE, F.lit(False)), folder)
            own["base"] = {b: f for b, f in own["base"].items() if int(b) not in touched} | {str(b): folder for b in kept}
            own["deltas"] = []
        return self._commit(state)

    def vacuum(self, keep: int = 1) -> int:
        """Delete log entries before the newest `keep`, and files that none of the rest names; the number of folders deleted.

        Not while others write: files that a write has not yet named would go too.
        """
        last = self.version()
        kept = [s for n in range(max(1, last - keep + 1), last + 1) if (s := self.state(n))]
        live = {f for s in kept for t in s["tables"].values() for f in [*t["base"].values(), *(d["folder"] for d in t["deltas"])]}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.path}/data")) if f"data/{s.getPath().getName()}" not in live] if kept else []
        for path in gone:
            self._fs.delete(path, True)
        for s in self._fs.listStatus(self._path(f"{self.path}/_log")) if kept else []:
            name = s.getPath().getName()
            if name.isdigit() and int(name) <= last - keep:
                self._fs.delete(s.getPath(), False)
        return len(gone)

    def changed(self, table: str) -> int:
        """The version in which the table was last written (0: never); merging deltas is no change."""
        state = self.state()
        return state["tables"][table]["changed"] if state else 0


def _fields(schema: str) -> list[str]:
    """The fields of a DDL schema: commas within brackets do not part them."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]
