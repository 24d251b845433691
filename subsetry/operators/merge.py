"""Merging into existing rows: preserved rows, upserts, statements, unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.plan import PlanError, SetRule
from ..plans.values import as_text
from ..sources.catalog import views
from .predicate import Delete, Select, Update, from_views, has_subquery, statements, translate


def preserved(old: DataFrame, wheres: list[str], ignore_case: bool = False) -> DataFrame:
    """Rows of old that any of the predicates keeps."""
    return old.where(F.expr(" OR ".join(f"({translate(w, ignore_case)})" for w in wheres)))


def replace_rows(rows: DataFrame, kept: DataFrame, keys: list[list[str]]) -> DataFrame:
    """rows with those of kept written over them: a row with an equal key, any of keys, goes.

    Without keys the kept rows are added. A null in a key equals nothing.
    """
    out = rows
    for n, key in enumerate(k for k in keys if k):
        names = [f"__kept_{n}_{j}" for j in range(len(key))]
        taken = kept.select(*[f"`{c}`" for c in key]).dropna().distinct().toDF(*names)
        out = out.join(taken, reduce(lambda a, b: a & b, [out[c] == taken[x] for c, x in zip(key, names)]), "left_anti")
    return out.unionByName(kept, allowMissingColumns=True).select(*[f"`{c}`" for c in rows.columns])


def _literal(value: object) -> Column:
    """The value as SQL has it: booleans are 1 and 0, the items of a list are joined by commas."""
    if isinstance(value, list):
        value = ",".join(as_text(int(v) if isinstance(v, bool) else v) for v in value)
    return F.lit(int(value) if isinstance(value, bool) else value)


def _match(df: DataFrame, rule: SetRule) -> Column:
    """Equal in every matched column; a null matches nothing."""
    tests = [F.col(f"`{c}`") == _literal(v).cast(df.schema[c].dataType) for c, v in rule.match]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def upsert(df: DataFrame, rule: SetRule) -> DataFrame:
    """All matching rows get the assigned values; where none matches, one row is added."""
    for c, _ in (*rule.match, *rule.assign):
        if c not in df.columns:
            raise PlanError(f"set {rule.table}: no column {c!r}")
    hit, values = _match(df, rule), dict(rule.assign)
    if df.where(hit).limit(1).isEmpty():
        values = dict(rule.match) | values
        row = [(_literal(values[c]).cast(df.schema[c].dataType) if c in values else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns]
        return df.unionByName(df.sparkSession.range(1).select(*row))
    return df.select(*[F.when(hit, _literal(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def filtered(spark: SparkSession, frames: dict[str, DataFrame], df: DataFrame, where: str, negate: bool = False) -> DataFrame:
    """Rows of df for which where, in Spark SQL, is true; with negate the others. Subqueries read frames."""
    if not has_subquery(where):
        hit = F.expr(where)
        return df.where(~F.coalesce(hit, F.lit(False)) if negate else hit)
    with views(spark, frames) as names:
        hit = F.expr(from_views(where, names))
        return df.where(~F.coalesce(hit, F.lit(False)) if negate else hit)


def _updated(df: DataFrame, s: Update, where: str | None) -> DataFrame:
    """Assignments from left to right: a later one sees the values of those before it."""
    unknown = {c for c, _ in s.assign} - set(df.columns)
    if unknown:
        raise PlanError(f"no column {sorted(unknown)[0]!r} in {s.table}")
    hit = "__subsetry_hit"
    out = df.withColumn(hit, F.lit(True) if where is None else F.coalesce(F.expr(where).cast("boolean"), F.lit(False)))
    for c, value in s.assign:
        out = out.withColumn(c, F.when(F.col(hit), F.expr(value).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")))
    return out.select(*[f"`{c}`" for c in df.columns])


def _last_of(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Of rows with an equal key, the last one; a key with a null equals none."""
    out = rows.withColumn("__row", F.monotonically_increasing_id())
    for key in keys:
        columns = [F.col(f"`{c}`") for c in key]
        best = out.dropna(subset=key).groupBy(*columns).agg(F.max("__row").alias("__last")).select("__last")
        null = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
        out = out.where(~null).join(best, F.col("__row") == F.col("__last"), "left_semi").unionByName(out.where(null))
    return out.drop("__row")


def execute(spark: SparkSession, frames: dict[str, DataFrame], sql: str, ignore_case: bool = False, keys: dict[str, list[list[str]]] | None = None) -> dict[str, DataFrame]:
    """frames after the statements of sql, in order: UPDATE, DELETE, TRUNCATE, INSERT, REPLACE, SELECT.

    Nothing is written in place: each statement makes a new frame of its table. keys: the unique keys
    of tables. REPLACE takes away the rows with an equal key, and an INSERT of a key that is there is
    an error. A SELECT is run over all its rows for its errors, and they are left.
    """
    out = dict(frames)

    def table(name: str) -> DataFrame:
        if name not in out:
            raise PlanError(f"no table {name!r} for: {sql.strip()}")
        return out[name]

    for s in statements(sql, ignore_case):
        if isinstance(s, Select):
            with views(spark, out) as names:
                spark.sql(from_views(s.sql, names)).write.format("noop").mode("overwrite").save()
            continue
        df = table(s.table)
        if isinstance(s, Delete):
            out[s.table] = df.limit(0) if s.where is None else filtered(spark, out, df, s.where, negate=True)
        elif isinstance(s, Update):
            if any(has_subquery(x) for x in (s.where or "", *(v for _, v in s.assign))):
                with views(spark, out) as names:
                    own = Update(s.table, [(c, from_views(v, names)) for c, v in s.assign], None)
                    out[s.table] = _updated(df, own, s.where and from_views(s.where, names))
            else:
                out[s.table] = _updated(df, s, s.where)
        else:
            columns, own_keys = s.columns or df.columns, [k for k in (keys or {}).get(s.table, []) if k]
            with views(spark, out) as names:
                rest = from_views(s.rest, names)
                rows = spark.sql(rest if rest.upper().startswith("SELECT") else f"SELECT * FROM {rest}").toDF(*columns)
            given = {c: F.col(f"`{c}`").cast(df.schema[c].dataType) for c in columns}
            rows = rows.select(*[given.get(c, F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns])
            if s.replace:
                out[s.table] = replace_rows(df, _last_of(rows, own_keys), own_keys)
                continue
            for key in own_keys:
                again = df.select(*key).unionByName(rows.select(*key)) if set(key) & set(columns) else None
                if again is not None and not again.join(rows.select(*key).distinct(), key, "left_semi").groupBy(*key).count().where("count > 1").isEmpty():
                    raise PlanError(f"a key of {s.table} that is there already: {sql.strip()}")
            out[s.table] = df.unionByName(rows)
    return out


def without_collisions(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """One row of each value of each unique key; a key with a null collides with nothing."""
    out = df
    for key in keys:
        null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in key])
        apart = F.when(null, F.monotonically_increasing_id()).otherwise(F.lit(-1))  # rows with a null do not meet
        out = out.withColumn("__apart", apart).dropDuplicates([*key, "__apart"]).drop("__apart")
    return out
