"""Artifacts: tables and reports by kind, which become visible together by a manifest that is written last."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp() -> str:
    """Names sort by time, and two of the same microsecond differ."""
    return f"{datetime.now(UTC).strftime('%Y%m%d_%H%M%S_%f')}_{secrets.token_hex(4)}"


class Release:
    """Tables and reports of one training, under one time stamp. Nobody reads them before the manifest names them."""

    def __init__(self, registry: Registry, trained_at: str):
        self.registry, self.trained_at = registry, trained_at
        self.named: dict[str, dict[str, str]] = {"models": {}, "reports": {}}

    def _path(self, folder: str, kind: str) -> str:
        self.named[folder][kind] = f"{self.registry.folders[folder]}/kind={kind}/trained_at={self.trained_at}"
        return self.named[folder][kind]

    def save(self, kind: str, table: DataFrame) -> DataFrame:
        """Write the table; the result is what was written."""
        path = self._path("models", kind)
        table.write.mode("errorifexists").parquet(path)
        return self.registry.spark.read.schema(table.schema).parquet(path)

    def report(self, kind: str, **values: Any) -> None:
        self.registry.spark.createDataFrame([values]).coalesce(1).write.mode("errorifexists").json(self._path("reports", kind))


class Registry:
    """A folder with models/kind=K/trained_at=T (Parquet), reports/kind=K/trained_at=T (JSON) and manifests/T.json, which
    names what belongs to the release T. The latest of a kind is that of the greatest T whose manifest names it; a training
    that was cut off has no manifest, so its files are never read. What was loaded is kept until a later one exists."""

    def __init__(self, spark: SparkSession, root: str, models: str | None = None, reports: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.folders = {"models": models or f"{self.root}/models", "reports": reports or f"{self.root}/reports"}
        self.manifests: dict[str, dict[str, dict[str, str]]] = {}
        self.held: dict[str, tuple[str, DataFrame]] = {}
        self.loaded: dict[str, tuple[str, Broadcast]] = {}

    @contextmanager
    def release(self, trained_at: str | None = None) -> Iterator[Release]:
        """What is saved inside becomes visible at the end of the block, all at once, or not at all if the block fails."""
        out = Release(self, trained_at or stamp())
        yield out
        fs, path = self._at(f"manifests/.{out.trained_at}.part")
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(json.dumps(out.named).encode()))
        finally:
            stream.close()
        if not fs.rename(path, self._at(f"manifests/{out.trained_at}.json")[1]):
            raise FileExistsError(f"a release {out.trained_at} exists in {self.root}")

    def save(self, kind: str, table: DataFrame, trained_at: str | None = None) -> str:
        """A release of one table; its path."""
        with self.release(trained_at) as out:
            out.save(kind, table)
        return out.named["models"][kind]

    def _at(self, name: str) -> tuple[Any, Any]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _newest(self, folder: str, kind: str) -> str | None:
        """Path of the latest release's table or report. A manifest never changes, so each is read once."""
        fs, path = self._at("manifests")
        names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
        for name in (n for n in names if n.endswith(".json") and not n.startswith(".")):
            if name not in self.manifests:
                stream = self._at(f"manifests/{name}")[0].open(self._at(f"manifests/{name}")[1])
                try:
                    self.manifests[name] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
            if kind in self.manifests[name][folder]:
                return self.manifests[name][folder][kind]
        return None

    def _known(self, folder: str, kind: str) -> str:
        path = self._newest(folder, kind)
        if path is None:
            raise FileNotFoundError(f"no {folder[:-1]} of kind {kind} in {self.root}")
        return path

    def latest(self, kind: str) -> DataFrame:
        path = self._known("models", kind)
        old, frame = self.held.get(kind, (None, None))
        if old != path:
            if frame is not None:
                frame.unpersist()
            self.held[kind] = path, self.spark.read.parquet(path).cache()
        return self.held[kind][1]

    def load(self, kind: str, make: Callable[[DataFrame], Any]) -> Broadcast:
        """What `make` builds from the latest table of a kind, broadcast once for each release: later calls run no job for it.
        The one before is taken off the executors."""
        path = self._known("models", kind)
        old, shared = self.loaded.get(kind, (None, None))
        if old != path:
            self.loaded[kind] = path, self.spark.sparkContext.broadcast(make(self.spark.read.parquet(path)))
            if shared is not None:
                shared.unpersist()
        return self.loaded[kind][1]

    def latest_report(self, kind: str) -> dict:
        return self.spark.read.json(self._known("reports", kind)).first().asDict(recursive=True)

    def has(self, kind: str) -> bool:
        return self._newest("models", kind) is not None


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of the tables that a training report lists."""
    parts = [tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("products", "sales", "competitor_prices")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
