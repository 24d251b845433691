"""Reports over tables, relations and runs, as small frames."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.plan import Edge, Plan
from ..sources.catalog import Catalog
from .graph import select_tables
from .merge import filtered
from .predicate import translate

_EMPTY = "table_name string, row_count long"


def _union(spark: SparkSession, parts: list[DataFrame], ddl: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)


def table_counts(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count: one plan for all tables."""
    return _union(spark, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in frames.items()], _EMPTY)


def dry_run(catalog: Catalog, plan: Plan, ignore_case: bool = False) -> DataFrame:
    """aggregate, root_table, matching_rows (before a limit), row_limit; by the plan's order."""
    parts = []
    for a in plan.aggregates:
        df = catalog[a.table]
        if a.where is not None:
            df = filtered(catalog.spark, catalog.frames, df, translate(a.where, ignore_case))
        parts.append(df.agg(F.count(F.lit(1)).alias("matching_rows")).select(F.lit(a.name).alias("aggregate"), F.lit(a.table).alias("root_table"), "matching_rows", F.lit(a.limit).cast("long").alias("row_limit")))
    return _union(catalog.spark, parts, "aggregate string, root_table string, matching_rows long, row_limit long")


def planned(catalog: Catalog, plan: Plan, untouched: str = "full") -> DataFrame:
    """table_name, class and estimated_rows of every table, without reading rows; by class and name.

    Classes: Aggregate (what aggregates may reach), Full, Excluded, Ignored. Estimates are of
    whole tables; an excluded or ignored one counts nothing.
    """
    s = select_tables(plan, catalog)
    kinds = [(s.ignored, "Ignored"), (s.excluded, "Excluded"), (s.whole, "Full"), (s.potential, "Aggregate")]
    kind = {t: k for found, k in kinds for t in found}
    estimates = catalog.estimates()
    rows = [(t, kind[t], estimates[t] if kind[t] in ("Full", "Aggregate") else 0) for t in catalog.frames if t in kind]
    return catalog.spark.createDataFrame(rows, "table_name string, class string, estimated_rows long").orderBy("class", "table_name")


def planned_total(tables: DataFrame) -> DataFrame:
    """class, tables and estimated_rows of each class of planned."""
    return tables.groupBy("class").agg(F.count(F.lit(1)).alias("tables"), F.sum("estimated_rows").alias("estimated_rows")).orderBy("class")


def dispositions(catalog: Catalog, frames: dict[str, DataFrame], excluded: set[str], touched: set[str]) -> DataFrame:
    """table_name, disposition, row_count: Excluded, Aggregate (touched), Full (rows) or Empty."""
    counts = table_counts(catalog.spark, frames)
    name = F.col("table_name")
    kind = (
        F.when(name.isin(*excluded) if excluded else F.lit(False), "Excluded")
        .when(name.isin(*touched) if touched else F.lit(False), "Aggregate")
        .when(F.col("row_count") > 0, "Full").otherwise("Empty")
    )
    return counts.select("table_name", kind.alias("disposition"), "row_count")


def dropped_rows(spark: SparkSession, sent: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """table_name, dropped: rows that a unique key leaves out, most first; tables that lose none are left out."""
    parts = [
        sent[t].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped")).select(F.lit(t).alias("table_name"), "dropped")
        for t, key in keys.items()
    ]
    return _union(spark, parts, "table_name string, dropped long").where("dropped > 0").orderBy(F.desc("dropped"), "table_name")


def _edges(spark: SparkSession, edges: Iterable[Edge]) -> DataFrame:
    return spark.createDataFrame([(e.child, e.child_col, e.parent, e.parent_col) for e in edges], "child string, child_col string, parent string, parent_col string")


def relation_degree(spark: SparkSession, edges: Iterable[Edge]) -> DataFrame:
    """table_name, outgoing (as child), incoming (as parent)."""
    e = _edges(spark, edges)
    both = e.select(F.col("child").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("parent").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("table_name").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def unrelated(spark: SparkSession, tables: Iterable[str], edges: Iterable[Edge]) -> DataFrame:
    """table_name of tables that no relation names."""
    e = _edges(spark, edges)
    named = e.select(F.col("child").alias("table_name")).union(e.select("parent"))
    return spark.createDataFrame([(t,) for t in tables], "table_name string").join(named, "table_name", "left_anti")


def orphans(frames: dict[str, DataFrame], edges: list[Edge], spark: SparkSession) -> DataFrame:
    """child, child_col, parent, orphan_count: non-null references without a referenced row."""
    parts = []
    for e in edges:
        if e.child in frames and e.parent in frames:
            values = frames[e.child].select(F.col(f"`{e.child_col}`").alias("v")).dropna()
            known = frames[e.parent].select(F.col(f"`{e.parent_col}`").alias("v")).distinct()
            lost = values.join(known, "v", "left_anti").agg(F.count(F.lit(1)).alias("orphan_count"))
            parts.append(lost.select(F.lit(e.child).alias("child"), F.lit(e.child_col).alias("child_col"), F.lit(e.parent).alias("parent"), "orphan_count"))
    return _union(spark, parts, "child string, child_col string, parent string, orphan_count long")


def uniqueness(df: DataFrame, key: list[str]) -> DataFrame:
    """key and row_count of each value of key that more rows than one have; nulls are left out."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


# of runs -------------------------------------------------------------------


def timings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A frame of (table_name, step, row_count, millis, bytes), one row for each timed step; bytes: null where not known."""
    return spark.createDataFrame([(*r, None) if len(r) == 4 else r for r in rows], "table_name string, step string, row_count long, millis long, bytes long")


def by_step(times: DataFrame) -> DataFrame:
    """step, tables, row_count, millis and bytes of each phase of a run, the longest first."""
    sums = [F.sum(c).alias(c) for c in ("row_count", "millis", "bytes")]
    return times.groupBy("step").agg(F.countDistinct("table_name").alias("tables"), *sums).orderBy(F.desc("millis"), "step")


def by_table(times: DataFrame, top: int = 20) -> DataFrame:
    """table_name, steps, row_count, millis: the tables that took longest."""
    return times.groupBy("table_name").agg(F.count(F.lit(1)).alias("steps"), F.sum("row_count").alias("row_count"), F.sum("millis").alias("millis")).orderBy(F.desc("millis"), "table_name").limit(top)


def slowest(times: DataFrame, top: int = 20) -> DataFrame:
    """The steps that took longest, with rows a second."""
    rate = F.when(F.col("millis") > 0, F.col("row_count") * 1000.0 / F.col("millis"))
    return times.withColumn("rows_per_second", rate).orderBy(F.desc("millis"), "table_name", "step").limit(top)
