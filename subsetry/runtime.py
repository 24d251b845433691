"""The commands: import, get, export, load, dry run, check, plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .lang import LanguageError
from .operators import merge, report
from .operators.anonymize import mask_tables, relaxed_columns
from .operators.traverse import subset
from .plans.plan import Plan, PlanError
from .plans.resolve import load_plan, with_gets
from .sources import files
from .sources.catalog import Catalog, ForeignKey, TableMeta
from .sources.database import Database, DatabaseTarget
from .sources.target import Target, export_bundle, open_bundle
from .streaming.state import Interrupted, RunState


@dataclass
class Outcome:
    """Rows written of each table, what was left out or worth a word, and how long steps took.

    preserved: rows of the target that were kept for each table.
    """

    rows: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    times: list[tuple] = field(default_factory=list)
    preserved: dict[str, int] = field(default_factory=dict)

    def timings(self, spark: SparkSession) -> DataFrame:
        return report.timings(spark, self.times)

    def timed(self, target: Target | DatabaseTarget, table: str, step: str, began: float, rows: int) -> None:
        size = target.bytes_of(table) if isinstance(target, Target) else None
        self.times.append((table, step, rows, int((time.monotonic() - began) * 1000), size))


def masked(frames: dict[str, DataFrame], plan: Plan, catalog: Catalog, seed: int | None) -> dict[str, DataFrame]:
    return mask_tables(frames, plan, {t: catalog.key(t) for t in frames}, seed)


def subset_frames(catalog: Catalog, plan: Plan, untouched: str = "full", ignore_case: bool = False, seed: int | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """Every table of the subset, masked, and warnings. Keys are followed before masking."""
    frames, closure = subset(catalog, plan, untouched, ignore_case)
    return masked(frames, plan, catalog, seed), closure.selection.warnings


#: Tables that are written at the same time; their stages share the cluster.
PARALLEL = 4
GROUP = "subsetry"


def _write(target: Target | DatabaseTarget, frames: dict[str, DataFrame], meta: dict[str, TableMeta], plan: Plan, state: RunState, out: Outcome, ignore_case: bool, mask_one=lambda t, df: df) -> None:
    spark = target.spark
    keep: dict[str, list[str]] = {}
    for t, where in plan.preserves:
        keep.setdefault(t, []).append(where)
    database = target.database if isinstance(target, DatabaseTarget) else None
    if database is not None:
        found = database.foreign_keys()
        state.drops([asdict(k) for k in found])
        database.drop_foreign_keys(found)

    def one(t: str, df: DataFrame) -> None:
        spark.sparkContext.setJobGroup(GROUP, "writing tables", interruptOnCancel=True)
        began = time.monotonic()
        if t in keep and t in target and t not in state.backups:
            rows = merge.preserved(target[t], keep[t], ignore_case)
            if not rows.isEmpty():
                state.keeps(t, target.backup(t, rows))
                out.preserved[t] = spark.read.parquet(state.backups[t]).count()
                out.timed(target, t, "preserve", began, out.preserved[t])
        began, df = time.monotonic(), mask_one(t, df)
        own, relaxed = meta.get(t, TableMeta(t)), relaxed_columns(plan, t)
        masked_columns = {c for c, _ in plan.anonymize.get(t, [])}
        unique = [k for k in own.unique_keys() if masked_columns & set(k)]
        if unique:  # masking may have made equal values of different ones
            seen = Observation()
            df = merge.without_collisions(df.observe(seen, F.count(F.lit(1)).alias("n")), unique)
            out.rows[t] = target.write(t, df, own, relaxed)
            if seen.get["n"] > out.rows[t]:
                out.warnings.append(f"{t}: {seen.get['n'] - out.rows[t]} rows dropped, as masked values of a unique key are equal")
        else:
            out.rows[t] = target.write(t, df, own, relaxed)
        out.timed(target, t, "write", began, out.rows[t])
        state.completed(t, out.rows[t])

    for t in frames:
        if t in state.done:
            out.skipped.append(t)
            out.rows[t] = state.done[t]
    with ThreadPoolExecutor(PARALLEL) as pool:
        running = [pool.submit(one, t, df) for t, df in frames.items() if t not in state.done]
        try:
            for r in running:
                r.result()
        except BaseException as e:
            pool.shutdown(wait=True, cancel_futures=True)
            if state.stopping and not isinstance(e, Interrupted):  # its jobs were cancelled
                raise Interrupted(f"stopped after {len(state.done)} tables") from e
            raise
    _finish(target, meta, plan, state, out, ignore_case)


def _finish(target: Target | DatabaseTarget, meta: dict[str, TableMeta], plan: Plan, state: RunState, out: Outcome, ignore_case: bool) -> None:
    """Preserved rows back, then set rules, then statements, then foreign keys; the state goes last."""
    spark = target.spark
    frames = {t: target[t] for t in target.tables()}
    keys = {t: target.meta.get(t, TableMeta(t)).unique_keys() for t in frames}
    changed: set[str] = set()
    for t, path in state.backups.items():
        if t in frames:
            frames[t] = merge.replace_rows(frames[t], spark.read.parquet(path), keys[t])
            changed.add(t)
    for rule in plan.sets:
        if rule.table not in frames:
            raise PlanError(f"set: no table {rule.table!r}")
        frames[rule.table] = merge.upsert(frames[rule.table], rule)
        changed.add(rule.table)
    for sql in plan.after:
        now = merge.execute(spark, frames, sql, ignore_case, keys)
        changed |= {t for t in now if now[t] is not frames[t]}
        frames = now
    if isinstance(target, DatabaseTarget):  # a table that is replaced may be read for the next one
        frames = frames | {t: files.staged(frames[t], "finish") for t in sorted(changed)}
    for t in sorted(changed):
        began = time.monotonic()
        out.rows[t] = target.write(t, frames[t], target.meta.get(t), relaxed_columns(plan, t))
        out.timed(target, t, "finish", began, out.rows[t])
    if isinstance(target, DatabaseTarget):
        own = [k for t in frames for k in meta.get(t, TableMeta(t)).foreign_keys]
        out.warnings += target.database.add_foreign_keys([*own, *(ForeignKey(**k) for k in state.foreign_keys)])
    state.finish()


def _target(spark: SparkSession, to: str | Database, state: str | None) -> tuple[Target | DatabaseTarget, str]:
    """The target, and the shared folder of a run's state: that of the target, or for a database state."""
    if isinstance(to, str):
        return Target(spark, to), to.rstrip("/")
    if not state:
        raise PlanError("a database target needs a shared folder for the state of a run")
    return DatabaseTarget(to, state), state.rstrip("/")


def run_import(
    catalog: Catalog, plan: Plan, to: str | Database, resume: bool = False, clean: bool = False, untouched: str = "full", ignore_case: bool = False, seed: int | None = None,
    stop_after: int | None = None, state: str | None = None, started: Callable[[RunState], None] = lambda state: None,
) -> Outcome:
    """Write the subset to a target folder or a database, keeping its preserved rows.

    started is given the run's state, whose stop() ends the run after what is complete.
    """
    target, folder = _target(catalog.spark, to, state)
    run = RunState.begin(catalog.spark, folder, resume, clean, stop_after)
    started(run)
    with files.scratch(catalog.spark):
        began = time.monotonic()
        frames, closure = subset(catalog, plan, untouched, ignore_case)
        out = Outcome(warnings=list(closure.selection.warnings))
        out.times.append(("", "select", 0, int((time.monotonic() - began) * 1000), None))
        # a table that is skipped is not masked either, as numbering its rows would write it
        _write(target, frames, catalog.meta, plan, run, out, ignore_case, lambda t, df: masked({t: df}, plan, catalog, seed)[t])
    return out


def run_get(catalog: Catalog, plan: Plan, calls: list[tuple[str, dict[str, object]]], to: str | Database, clean: bool = False, ignore_case: bool = False, seed: int | None = None, state: str | None = None) -> Outcome:
    """Fetch what the called functions name, with all that belongs to it, into the target."""
    return run_import(catalog, with_gets(plan, calls), to, clean=clean, ignore_case=ignore_case, seed=seed, state=state)


def run_export(catalog: Catalog, plan: Plan, folder: str, untouched: str = "full", ignore_case: bool = False, seed: int | None = None) -> Outcome:
    """Write the masked subset as a bundle."""
    with files.scratch(catalog.spark):
        frames, warnings = subset_frames(catalog, plan, untouched, ignore_case, seed)
        export_bundle(catalog.spark, folder, frames, catalog.meta, plan)
    return Outcome(warnings=list(warnings))


def run_load(spark: SparkSession, bundle: str, to: str | Database, resume: bool = False, clean: bool = False, ignore_case: bool = False, state: str | None = None) -> Outcome:
    """Write a bundle's tables to a target and carry out the later steps of its plan. The bundle may be behind http(s)."""
    out = Outcome()
    target, folder = _target(spark, to, state)
    with files.scratch(spark):
        frames, meta, plan = open_bundle(spark, bundle)
        _write(target, frames, meta, plan, RunState.begin(spark, folder, resume, clean), out, ignore_case)
    return out


def dry_run(catalog: Catalog, plan: Plan, ignore_case: bool = False) -> DataFrame:
    """What each aggregate's root would match."""
    return report.dry_run(catalog, plan, ignore_case)


def check(path: str, variables: dict[str, object] | None = None) -> list[str]:
    """Problems of a configuration file; none if it can be planned."""
    try:
        load_plan(path, variables, lenient=True)
    except LanguageError as e:
        return [p.render(e.source, e.name) for p in e.problems]
    except PlanError as e:
        return [str(e)]
    return []


def plan_json(path: str, variables: dict[str, object] | None = None) -> str:
    return load_plan(path, variables).to_json()
