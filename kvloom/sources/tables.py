"""Sources and sinks: the supplied tables, and stores kept as versioned snapshots.

A store is a folder of Parquet snapshots with names of their own, and of claims, ``_commits/<n>``,
that name the snapshot of a version.  A commit writes its snapshot and then creates the next claim,
which fails if another writer made it; the highest whole claim is current.  So readers see all of a
commit or nothing, a crash leaves at most an unnamed snapshot or an empty claim, which is passed
over, and a reader that pinned a version keeps it.  Files go through Hadoop's file system API, so any store
that Spark reads will do.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from kvloom.errors import Conflict, NotFound

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


class Store:
    """A versioned table in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _claim(self, version: int):
        return self._path(f"{self.path}/_commits/{version}")

    def _claims(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n.isdigit())

    def _snapshot(self, version: int) -> str | None:
        """The folder that a claim names; None if its writer did not get that far."""
        stream = self._fs.open(self._claim(version))
        try:
            return stream.readUTF()
        except Py4JJavaError:  # the end of the file
            return None
        finally:
            stream.close()

    def version(self) -> int:
        """The current version, 0 if nothing was committed."""
        return next((v for v in reversed(self._claims()) if self._snapshot(v)), 0)

    def versions(self) -> list[int]:
        return [v for v in self._claims() if self._snapshot(v)]

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        name = self._snapshot(at) if at in self._claims() else None
        if name is None:
            raise NotFound(f"no version {at}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def commit(self, rows: DataFrame, base: int | None = None) -> int:
        """Writes the next version.  ``base``, the version that ``rows`` were made from, must still
        be the current one."""
        now = self.version()
        if base is not None and base != now:
            raise Conflict(f"version {now} was committed meanwhile")
        following = max(self._claims(), default=0) + 1
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        try:
            stream = self._fs.create(self._claim(following), False)
        except Py4JJavaError as error:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
            raise Conflict(f"version {following} was committed meanwhile") from error
        stream.writeUTF(name)
        stream.close()
        return following

    def transaction(self) -> Transaction:
        return Transaction(self)

    def export(self, path: str, version: int | None = None) -> None:
        """A backup: one plain Parquet folder."""
        self.read(version).write.mode("errorifexists").parquet(path)

    def restore(self, path: str) -> int:
        """The contents of a backup become the next version."""
        return self.commit(self.spark.read.parquet(path))

    def vacuum(self, keep: int) -> None:
        for v in self.versions()[:-keep]:
            name = self._snapshot(v)
            self._fs.delete(self._claim(v), False)
            self._fs.delete(self._path(f"{self.path}/{name}"), True)


class Transaction:
    """Changes staged on one version: committed together, or dropped."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.rows = store.read() if self.base else None

    def apply(self, change) -> None:
        self.rows = change(self.rows)

    def commit(self) -> int:
        return self.store.commit(self.rows, self.base)

    def rollback(self) -> None:
        self.rows = self.store.read(self.base) if self.base else None
