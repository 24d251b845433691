"""A target database of Parquet folders, and bundles that carry one elsewhere."""

from __future__ import annotations

import json
import threading
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from ..plans.plan import Plan, PlanError
from . import files
from .catalog import Catalog, TableMeta, meta_from_json, meta_json

#: Of bundles.
VERSION = 1


class Target:
    """Tables in versions: a write makes a new folder and then changes the list of current ones.

    So no folder that a plan may still read is overwritten, and a failed write leaves the old
    table. superseded() tells the old folders, which vacuum() deletes.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.lock = spark, folder.rstrip("/"), threading.Lock()
        self.list = f"{self.folder}/_state/tables.json"
        found = json.loads(files.read_text(spark, self.list)) if files.exists(spark, self.list) else {"tables": {}, "old": []}
        self.paths: dict[str, str] = found["tables"]
        self.old: list[str] = found["old"]
        meta = f"{self.folder}/_state/meta.json"
        self.meta: dict[str, TableMeta] = meta_from_json(files.read_text(spark, meta)) if files.exists(spark, meta) else {}

    def __contains__(self, table: str) -> bool:
        return table in self.paths

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.paths:
            raise PlanError(f"no table {table!r} in {self.folder}")
        return self.spark.read.parquet(self.paths[table])

    def tables(self) -> list[str]:
        return sorted(self.paths)

    def write(self, table: str, df: DataFrame, meta: TableMeta | None = None, relaxed: set[str] = frozenset()) -> int:
        """Replace the table; returns its rows. Several threads may write different tables.

        Parquet columns may all be null, so that relaxed ones need nothing."""
        path = f"{self.folder}/{table}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        with self.lock:
            if table in self.paths:
                self.old.append(self.paths[table])
            self.paths[table] = path
            self._save()
            if meta is not None and self.meta.get(table) != meta:
                self.meta[table] = meta
                files.write_text(self.spark, f"{self.folder}/_state/meta.json", meta_json(self.meta))
        return self.spark.read.parquet(path).count()

    def backup(self, table: str, df: DataFrame) -> str:
        path = f"{self.folder}/_state/preserved/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _save(self) -> None:
        files.write_text(self.spark, self.list, json.dumps({"tables": self.paths, "old": self.old}))

    def bytes_of(self, table: str) -> int:
        return files.size(self.spark, self.paths[table])

    def superseded(self) -> list[str]:
        return list(self.old)

    def vacuum(self) -> None:
        """Delete the folders of replaced tables; no plan may read them any more."""
        for path in self.old:
            files.delete(self.spark, path)
        self.old = []
        self._save()

    def catalog(self) -> Catalog:
        return Catalog(self.spark, {t: self[t] for t in self.tables()}, self.meta)


def write_jdbc(frames: dict[str, DataFrame], url: str, properties: dict[str, str], batch: int = 10_000) -> None:
    """Load tables into a database by batches of rows, one connection for each task; old tables are replaced.

    The tables are as Spark makes them; DatabaseTarget makes them of a table's metadata.
    """
    for t, df in frames.items():
        df.write.option("batchsize", batch).jdbc(url, t, mode="overwrite", properties=properties)


def export_bundle(spark: SparkSession, folder: str, frames: dict[str, DataFrame], meta: dict[str, TableMeta], plan: Plan) -> None:
    """Tables as zstd Parquet, metadata and the plan's later steps. manifest.json comes last and ends it."""
    folder = folder.rstrip("/")
    if files.exists(spark, f"{folder}/manifest.json"):
        raise PlanError(f"{folder} holds a bundle already")
    rows, parts = {}, {}
    for t, df in frames.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/tables/{t}")
        rows[t] = spark.read.parquet(f"{folder}/tables/{t}").count()
        parts[t] = [n for n in files.names(spark, f"{folder}/tables/{t}") if not n.startswith(("_", "."))]
    files.write_text(spark, f"{folder}/meta.json", meta_json({t: meta.get(t, TableMeta(t)) for t in frames}))
    files.write_text(spark, f"{folder}/plan.json", plan.to_json())
    files.write_text(spark, f"{folder}/manifest.json", json.dumps({"version": VERSION, "tables": rows, "files": parts}))


def _downloaded(spark: SparkSession, url: str) -> str:
    folder = files.new_folder(spark, "bundle")
    files.fetch(spark, f"{url}/manifest.json", f"{folder}/manifest.json")
    manifest = json.loads(files.read_text(spark, f"{folder}/manifest.json"))
    for t, names in manifest.get("files", {}).items():
        for name in names:
            if "/" in name or "/" in t:
                raise PlanError(f"the bundle names a file outside itself: {t}/{name}")
            files.fetch(spark, f"{url}/tables/{quote(t)}/{quote(name)}", f"{folder}/tables/{t}/{name}")
    for name in ("meta.json", "plan.json"):
        files.fetch(spark, f"{url}/{name}", f"{folder}/{name}")
    return folder


def open_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, TableMeta], Plan]:
    """Frames, metadata and plan of a bundle; one without its end, or short of rows, is refused.

    One behind an http(s) URL is copied to the shared folder first, as its manifest lists it.
    """
    folder = folder.rstrip("/")
    if folder.startswith(("http://", "https://")):
        folder = _downloaded(spark, folder)
    if not files.exists(spark, f"{folder}/manifest.json"):
        raise PlanError(f"{folder} is not a complete bundle: it has no manifest")
    manifest = json.loads(files.read_text(spark, f"{folder}/manifest.json"))
    if manifest.get("version") != VERSION:
        raise PlanError(f"bundle version {manifest.get('version')!r} is not {VERSION}")
    frames = {}
    for t, n in manifest["tables"].items():
        if not files.exists(spark, f"{folder}/tables/{t}"):
            raise PlanError(f"the bundle lacks table {t}")
        frames[t] = spark.read.parquet(f"{folder}/tables/{t}")
        if frames[t].count() != n:
            raise PlanError(f"table {t} of the bundle is truncated")
    return frames, meta_from_json(files.read_text(spark, f"{folder}/meta.json")), Plan.from_json(files.read_text(spark, f"{folder}/plan.json"))
