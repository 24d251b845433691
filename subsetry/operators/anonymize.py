"""Masking of columns: NULL, values of a pool, or generated values that differ in every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

from ..plans.plan import Plan
from ..plans.values import UNIQUE
from ..sources.files import staged


def numbered(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, 2 … by ascending key (null first), without bringing rows to one task.

    Rows are sorted by ranges of the key and written once; each range's numbers begin at the
    sum of the sizes of those before it, one number for each range.
    """
    part, own = f"{name}_part", f"{name}_own"
    order = [F.col(f"`{c}`").asc_nulls_first() for c in key]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn(own, F.monotonically_increasing_id())  # the range's number and a count
    placed = staged(placed.withColumn(part, F.shiftright(own, 33).cast("int")).withColumn(own, F.col(own).bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = sorted((r[part], r["n"]) for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = [], 0
    for p, n in sizes:
        bases.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(bases or [(0, 0)], f"{part} int, {name}_base long")  # one row for each range
    return placed.join(F.broadcast(table), part).withColumn(name, F.col(f"{name}_base") + F.col(own)).drop(part, own, f"{name}_base")


def _typed(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return value
    if isinstance(kind, BinaryType):
        return value.cast("binary")
    return value.try_cast(kind)


def mask(df: DataFrame, rules: list[tuple[str, str | None]], pools: dict[str, list[str]], key: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """df with each rule's column replaced; the column's own value, null or not, is never read.

    A rule without a pool, or with an empty one, gives NULL; a pool gives a random value for
    each row. If any value of a pool holds the token of unique(), values are taken in turn and
    the token becomes a counter: for row n of the key's order and the i-th of k such columns,
    n * k + i. The first rule of a column counts. Columns that df lacks are left out.
    """
    first: dict[str, str | None] = {}
    for column, pool in rules:
        if column in df.columns:
            first.setdefault(column, pool)
    schema = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in df.columns if c in first]  # counters follow the order of the columns
    unique = [c for c in columns if first[c] is not None and any(UNIQUE in v for v in pools.get(first[c], []))]
    out, counter = df, "__row_number"
    if unique:
        out = numbered(df, key or df.columns, counter)
    for i, c in enumerate(columns):
        pool = pools.get(first[c], []) if first[c] is not None else []
        if not pool:
            value = F.lit(None).cast(schema[c])
        elif c in unique:
            n = F.col(counter) * len(unique) + unique.index(c)
            picked = F.element_at(F.array(*map(F.lit, pool)), (n % len(pool) + 1).cast("int"))
            value = _typed(F.replace(picked, F.lit(UNIQUE), n.cast("string")), schema[c])
        else:
            at = F.floor(F.rand(None if seed is None else seed + i) * len(pool)) + 1
            value = _typed(F.element_at(F.array(*map(F.lit, pool)), at.cast("int")), schema[c])
        out = out.withColumn(c, value)
    return out.select(*[f"`{c}`" for c in df.columns])


def mask_tables(frames: dict[str, DataFrame], plan: Plan, keys: dict[str, list[str]], seed: int | None = None) -> dict[str, DataFrame]:
    """Every table of frames, masked after its rows and keys have been chosen."""
    return {t: mask(df, plan.anonymize[t], plan.fakers, keys.get(t), seed) if plan.anonymize.get(t) else df for t, df in frames.items()}


def relaxed_columns(plan: Plan, table: str) -> set[str]:
    """Columns that masking may set to NULL, so that a NOT NULL of theirs no longer holds."""
    return {c for c, pool in plan.anonymize.get(table, []) if pool is None or not plan.fakers.get(pool)}
