"""Several day-partitioned tables that change together.

Every update writes its days as a new version, ``<table>/version=<v>/
event_date=<day>``, and then one manifest, which names the live version of each
day. The manifest's file is written under another name and renamed, so readers
see the old days in all tables or the new ones in all, never a mix, and a failed
update leaves only folders that no manifest names. All paths go through Hadoop's
file system, so the tables may lie on any store Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from milepost.storage import Folder

ATTEMPTS = 20


class VersionedTables:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self.files = Folder(spark, self.base)

    def new_version(self) -> str:
        return uuid.uuid4().hex[:16]

    def folder(self, table: str, version: str) -> str:
        return f"{self.base}/{table}/version={version}"

    def partitions(self, table: str, version: str) -> list[str]:
        """The days that a version has of a table, as text."""
        prefix = "event_date="
        names = self.files.names(f"{table}/version={version}")
        return [n[len(prefix) :] for n in names if n.startswith(prefix)]

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _load(self, name: str) -> dict[str, str]:
        return json.loads(self.files.read(f"manifests/{name}"))

    def live(self) -> dict[str, str]:
        """Version of each day in the last committed manifest."""
        names = self._manifests()
        return self._load(names[-1]) if names else {}

    def commit(self, version: str, days: Iterable[str]) -> None:
        """Make ``version`` the live one for ``days``, in all tables at once. If
        another update commits in between, this one follows on it."""
        days = list(days)
        for _ in range(ATTEMPTS):
            names = self._manifests()
            following = int(names[-1].split(".")[0]) + 1 if names else 0
            content = (self._load(names[-1]) if names else {}) | {d: version for d in days}
            if self.files.write_new(f"manifests/{following:012d}.json", json.dumps(content, sort_keys=True)):
                return
        raise RuntimeError(f"{self.base}: other updates kept committing")

    def read(self, table: str, schema: StructType, live: dict[str, str]) -> DataFrame:
        """A table's rows of the live days; only their folders are listed."""
        if not live:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder(table, v)}/event_date={d}" for d, v in sorted(live.items())]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.base}/{table}").parquet(*paths)
        return rows.select(*schema.names)

    def remove_old(self, tables: Iterable[str], keep: int = 2) -> list[str]:
        """Delete manifests but the last ``keep``, and the versions that these
        don't name: old ones and those of failed updates. Call it while no
        update runs; readers that opened an older manifest lose their files."""
        names = self._manifests()
        named = {v for n in names[-keep:] for v in self._load(n).values()}
        for n in names[:-keep]:
            self.files.delete(f"manifests/{n}")
        gone = []
        for table in tables:
            for folder in self.files.names(table):
                if folder.startswith("version=") and folder.split("=", 1)[1] not in named:
                    self.files.delete(f"{table}/{folder}")
                    gone.append(f"{table}/{folder}")
        return gone
