"""The store: versioned Parquet snapshots of tables behind a manifest.

A write makes a new snapshot folder and then replaces the manifest, so readers see one version or the
next; a lost writer leaves the old one. Tables are partitioned by project_id where they have it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.operators.digest import table_digest

SCHEMA_VERSION = 3
#: Migrations by the version they lead to: functions from the tables' frames to frames.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {
    2: lambda tables: {n: (t if "superseded_by" in t.columns or n != "facts" else t.withColumn("superseded_by", F.lit(None).cast("long"))) for n, t in tables.items()},
    3: lambda tables: {n: (t if "kind" in t.columns or n != "facts" else t.withColumn("kind", F.lit(None).cast("string"))) for n, t in tables.items()},
}


class StoreError(Exception):
    """A store that can't be used as asked."""


@dataclass
class Manifest:
    """What a store holds: schema version, snapshot folder per table, a running version."""

    schema_version: int = SCHEMA_VERSION
    version: int = 0
    tables: dict[str, str] = field(default_factory=dict)


class Store:
    """A store in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        self.manifest = self._load()
        if self.manifest.schema_version > SCHEMA_VERSION:
            raise StoreError(f"the store has schema {self.manifest.schema_version}, this engine knows {SCHEMA_VERSION}")
        if self.manifest.schema_version < SCHEMA_VERSION:
            self._migrate()

    @classmethod
    def discover(cls, spark: SparkSession, start: str, name: str = ".store") -> Store:
        """The nearest store at or above a folder."""
        at = Path(start).resolve()
        for folder in (at, *at.parents):
            if (folder / name / "manifest.json").exists():
                return cls(spark, str(folder / name))
        raise StoreError(f"no store at or above {start}")

    @classmethod
    def open_if_exists(cls, spark: SparkSession, root: str) -> Store | None:
        """The machine-wide store, if there is one."""
        return cls(spark, root) if (Path(root) / "manifest.json").exists() else None

    def _load(self) -> Manifest:
        path = self.root / "manifest.json"
        return Manifest(**json.loads(path.read_text())) if path.exists() else Manifest()

    def _publish(self, manifest: Manifest) -> None:
        current = self._load()
        if current.version != self.manifest.version:
            raise StoreError("another writer published a version in between")
        manifest.version = current.version + 1
        staged = self.root / f"manifest-{uuid.uuid4().hex}.json"
        staged.write_text(json.dumps(manifest.__dict__, indent=1, sort_keys=True))
        os.replace(staged, self.root / "manifest.json")
        self.manifest = manifest

    def _migrate(self) -> None:
        tables = {n: self.table(n) for n in self.manifest.tables}
        for version in range(self.manifest.schema_version + 1, SCHEMA_VERSION + 1):
            tables = MIGRATIONS[version](tables) if version in MIGRATIONS else tables
        written = {n: self._write(n, t) for n, t in tables.items()}
        self._publish(Manifest(SCHEMA_VERSION, self.manifest.version, written))

    def table(self, name: str) -> DataFrame:
        """A table as of the manifest."""
        if name not in self.manifest.tables:
            raise StoreError(f"no table {name}")
        return self.spark.read.parquet(str(self.root / self.manifest.tables[name]))

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(str(self.root / folder))
        return folder

    def save(self, tables: dict[str, DataFrame]) -> None:
        """Publishes new contents of some tables at once; the others stay."""
        written = {n: self._write(n, df) for n, df in tables.items()}
        self._publish(Manifest(self.manifest.schema_version, self.manifest.version, {**self.manifest.tables, **written}))

    def digests(self) -> dict[str, str]:
        """A digest per table, equal for equal rows."""
        return {n: table_digest(self.table(n), n, self.table(n).columns[:1], self.table(n).columns).first()["digest"] for n in sorted(self.manifest.tables)}

    def collect_garbage(self) -> int:
        """Removes snapshot folders that the manifest doesn't name; how many."""
        kept, gone = set(self.manifest.tables.values()), 0
        for folder in self.root.glob("*/*"):
            if folder.is_dir() and str(folder.relative_to(self.root)) not in kept:
                shutil.rmtree(folder)
                gone += 1
        return gone

    def remove(self) -> None:
        """Deletes the store; only a folder with a manifest is one."""
        if not (self.root / "manifest.json").exists():
            raise StoreError(f"{self.root} is no store")
        shutil.rmtree(self.root)


def snapshot(store: Store, target: str) -> str:
    """Copies a store's tables to `target` under a name made of their digests; the manifest comes last."""
    digests = store.digests()
    name = hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()[:12]
    folder = Path(target) / name
    for table in store.manifest.tables:
        store.table(table).write.mode("overwrite").parquet(str(folder / table))
    staged = folder / "staged.json"
    staged.write_text(json.dumps({"schema_version": store.manifest.schema_version, "digests": digests}))
    os.replace(staged, folder / "snapshot.json")
    return name


def adopt(store: Store, source: str) -> None:
    """Replaces a store's tables by a snapshot's, after its digests were found to be right."""
    folder = Path(source)
    note = json.loads((folder / "snapshot.json").read_text())
    if note["schema_version"] > SCHEMA_VERSION:
        raise StoreError("the snapshot is newer than this engine")
    tables = {n: store.spark.read.parquet(str(folder / n)) for n in note["digests"]}
    for name, df in tables.items():
        if table_digest(df, name, df.columns[:1], df.columns).first()["digest"] != note["digests"][name]:
            raise StoreError(f"the snapshot's {name} isn't what was written")
    store.save(tables)


def validate(actor: str | None = None, status: str | None = None, limit: int | None = None) -> None:
    """Raises ValueError for an actor, status or limit that the store doesn't take."""
    if actor is not None and not re.fullmatch(r"user|agent:[\w.\-]+|user\+agent:[\w.\-]+", actor):
        raise ValueError(f"unknown actor {actor!r}")
    if status is not None and status not in ("open", "blocked", "done", "pending", "accepted", "rejected", "expired"):
        raise ValueError(f"unknown status {status!r}")
    if limit is not None and limit <= 0:
        raise ValueError("a limit must be above 0")
