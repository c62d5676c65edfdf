"""P4. Results kept by the versions of the tables that they came from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .logstore import LogStore


def versions(store: LogStore, *tables: str) -> dict[str, int]:
    """By table the version of its last change; merging deltas is none."""
    return {t: store.changed(t) for t in tables}


class ResultCache:
    """Results under name, parameters and source versions. A result of other versions is never served, and goes when a new one comes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str, sources: Mapping[str, int], parameters: Mapping) -> str:
        told = json.dumps([name, dict(sources), dict(parameters)], sort_keys=True, default=str)
        return f"{self.path}/{name}/{hashlib.sha256(told.encode()).hexdigest()}"

    def get(self, name: str, sources: Mapping[str, int], compute: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The kept result, or a new one, which is kept under a name of its own until it is whole.

        sources: by table the version that compute reads (see versions): take them before reading.
        """
        place = self._place(name, sources, parameters)
        if not self._fs.exists(self._path(f"{place}/_SUCCESS")):
            made = f"{self.path}/{name}/.{uuid.uuid4().hex}"
            compute().write.parquet(made)
            if not self._fs.rename(self._path(made), self._path(place)):
                self._fs.delete(self._path(made), True)  # another run was faster
            self._sweep(name, place, sources)
        return self.spark.read.parquet(place)

    def _sweep(self, name: str, kept: str, sources: Mapping[str, int]) -> None:
        """Delete the name's results of other versions."""
        note = self._path(f"{self.path}/{name}/_versions-{hashlib.sha256(json.dumps(dict(sources), sort_keys=True).encode()).hexdigest()[:16]}")
        if self._fs.exists(note):
            return  # results with other parameters of the same versions stay
        for s in self._fs.listStatus(self._path(f"{self.path}/{name}")):
            if s.getPath().getName() != kept.rpartition("/")[2]:
                self._fs.delete(s.getPath(), True)
        self._fs.create(note, True).close()

    def clear(self, name: str | None = None) -> None:
        """Forget a name's results, or all."""
        self._fs.delete(self._path(f"{self.path}/{name}" if name else self.path), True)
