"""The state of a run: which tables are complete, and which preserved rows wait."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..plans.plan import PlanError
from ..sources import files


class Interrupted(Exception):
    """A run was stopped between tables; its state stays."""


@dataclass
class RunState:
    """Kept as one small file in the target, written after each completed table.

    backups: preserved rows of each table, by path, taken before its first overwrite.
    foreign_keys: those that the target had, dropped for the load and put back at its end.
    stop_after: for tests, so many tables after which a run is interrupted.
    """

    spark: SparkSession
    path: str
    done: dict[str, int] = field(default_factory=dict)
    backups: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[dict] = field(default_factory=list)
    stop_after: int | None = None
    stopping: bool = False
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    @classmethod
    def begin(cls, spark: SparkSession, folder: str, resume: bool = False, clean: bool = False, stop_after: int | None = None) -> "RunState":
        """Refuses to run over the state of an interrupted run unless told to resume or to clean."""
        path = f"{folder}/_state/run.json"
        out = cls(spark, path, stop_after=stop_after)
        if files.exists(spark, path):
            if clean:
                out.finish()
            elif resume:
                found = json.loads(files.read_text(spark, path))
                out.done, out.backups, out.foreign_keys = found["done"], found["backups"], found.get("foreign_keys", [])
            else:
                raise PlanError("an interrupted run left its state: resume it, or clean it (preserved rows are lost then)")
        return out

    def save(self) -> None:
        files.write_text(self.spark, self.path, json.dumps({"done": self.done, "backups": self.backups, "foreign_keys": self.foreign_keys}))

    def keeps(self, table: str, path: str) -> None:
        with self.lock:
            self.backups[table] = path
            self.save()

    def drops(self, keys: list[dict]) -> None:
        """Told before the target's foreign keys are dropped, so that a resumed run knows them."""
        with self.lock:
            self.foreign_keys += [k for k in keys if k not in self.foreign_keys]
            self.save()

    def completed(self, table: str, rows: int) -> None:
        with self.lock:
            self.done[table] = rows
            self.save()
        if self.stopping or (self.stop_after is not None and len(self.done) >= self.stop_after):
            raise Interrupted(f"stopped after {len(self.done)} tables")

    def stop(self) -> None:
        """Stop after the table that is being written, and cancel its jobs."""
        self.stopping = True
        self.spark.sparkContext.cancelJobGroup("subsetry")

    def finish(self) -> None:
        files.delete(self.spark, self.path)
