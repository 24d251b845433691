"""The closure of root rows under relations, as semi-joins planned from the relation graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Plan, Root
from ..sources.catalog import Catalog
from ..sources.files import staged
from .graph import Reach, Selection, Step, components, select_tables
from .merge import filtered
from .predicate import translate

#: Rounds of a cyclic component after which its rows are written to one place again.
RESTAGE = 8


@dataclass
class Wanted:
    """Rows of a table: those whose columns are among keys. rows: the rows themselves, if known."""

    columns: list[str]
    keys: DataFrame
    rows: DataFrame | None = None
    null_safe: bool = False


@dataclass
class Closure:
    """rows: the selected rows of each reached table; asked: what was looked up in it."""

    selection: Selection
    rows: dict[str, DataFrame] = field(default_factory=dict)
    asked: dict[str, list[DataFrame]] = field(default_factory=dict)

    def touched(self) -> set[str]:
        """Tables that received a key, and roots: one job over the first key of each lookup."""
        roots = {r.root.table for r in self.selection.reaches}
        ask = [(t, k) for t, keys in self.asked.items() if t not in roots for k in keys]
        if not ask:
            return roots
        tagged = reduce(DataFrame.unionAll, [k.limit(1).select(F.lit(t).alias("t")) for t, k in ask])
        return roots | {r["t"] for r in tagged.distinct().collect()}


def root_rows(catalog: Catalog, root: Root, ignore_case: bool = False) -> DataFrame:
    """The root's rows: predicate, then order, then limit. Null sorts lowest."""
    df = catalog[root.table]
    if root.where is not None:
        df = filtered(catalog.spark, catalog.frames, df, translate(root.where, ignore_case))
    if root.order is not None:
        by = F.col(f"`{root.order}`")
        df = df.orderBy(by.desc_nulls_last() if root.descending else by.asc_nulls_first())
    return df if root.limit is None else df.limit(root.limit)


def _pooled(wanted: list[Wanted]) -> list[Wanted]:
    """One lookup for each set of columns: their keys together."""
    out: dict[tuple, Wanted] = {}
    for w in wanted:
        at = (*w.columns, w.null_safe)
        out[at] = Wanted(w.columns, out[at].keys.union(w.keys), None, w.null_safe) if at in out else w
    return list(out.values())


def _matching(w: Wanted, names: list[str]) -> Column:
    pairs = [(F.col(f"`{c}`"), F.col(n)) for c, n in zip(w.columns, names)]
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) if w.null_safe else x == y for x, y in pairs])


#: Partitions over which rows with a null in a looked-up column are spread.
NULL_SALTS = 64


def _without(rows: DataFrame, w: Wanted, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows that w does not ask for. Those with a null, which match nothing, do not meet in one task."""
    if w.null_safe:
        return rows.join(keys, _matching(w, names), "left_anti")
    null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in w.columns])
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(NULL_SALTS)).cast("int")
    salted = rows.withColumn("__salt", F.when(null, spread).otherwise(F.lit(0)))
    return salted.join(keys.withColumn("__zero", F.lit(0)), _matching(w, names) & (F.col("__salt") == F.col("__zero")), "left_anti").drop("__salt")


def lookup(base: DataFrame, wanted: list[Wanted], key: list[str] | None = None) -> DataFrame:
    """Rows of base that any of wanted asks for; each row comes out once.

    Only semi-joins, so that keys, or their Bloom filters, thin rows out before a shuffle. With a
    primary key the lookups find keys of rows, and one more semi-join reads the rows. Without one
    each lookup gives the rows that those before it do not ask for.
    """
    if len(wanted) == 1 and wanted[0].rows is not None:
        return wanted[0].rows
    prepared = []
    for i, w in enumerate(_pooled(wanted)):
        names = [f"__key_{i}_{j}" for j in range(len(w.columns))]
        keys = w.keys.toDF(*names)
        prepared.append((w, (keys if w.null_safe else keys.dropna()).distinct(), names))
    if len(prepared) > 1 and key:
        own = [f"__row_{j}" for j in range(len(key))]
        found = [base.join(keys, _matching(w, names), "left_semi").select(*[f"`{c}`" for c in key]) for w, keys, names in prepared]
        rows = Wanted(key, reduce(DataFrame.unionAll, found).distinct().toDF(*own))
        return base.join(rows.keys, _matching(rows, own), "left_semi")
    parts = []
    for i, (w, keys, names) in enumerate(prepared):
        part = base.join(keys, _matching(w, names), "left_semi")
        for earlier in prepared[:i]:
            part = _without(part, *earlier)
        parts.append(part)
    return reduce(DataFrame.unionAll, parts)


class Traversal:
    """Result = forward closure of the backward closure of the roots, each table a few semi-joins.

    Tables outside cycles are lazy plans; the key columns of a table from which several steps
    go on are written to the shared folder, so it is scanned once for them. A cyclic component is
    iterated: keys of new rows find further rows, less those known, until there are none;
    rounds are written to the shared folder, so lineage stays short.
    """

    def __init__(self, catalog: Catalog, plan: Plan, selection: Selection | None = None, ignore_case: bool = False):
        self.catalog, self.plan, self.ignore_case = catalog, plan, ignore_case
        self.selection = selection or select_tables(plan, catalog)
        self.written: list[DataFrame] = []  # frames that cost a scan of their own rows only

    def run(self) -> Closure:
        out = Closure(self.selection)
        wanted: dict[str, list[Wanted]] = {}
        for r in self.selection.reaches:
            for t, own in self._aggregate(r, out).items():
                wanted.setdefault(t, []).extend(own)
        for t, own in wanted.items():
            if len(own) > 1:
                own = [Wanted(w.columns, w.keys, None, w.null_safe) for w in own]
            rows = self._lookup(t, own)
            out.rows[t] = rows if self.catalog.meta[t].primary_key else rows.dropDuplicates()
        return out

    def _aggregate(self, r: Reach, out: Closure) -> dict[str, list[Wanted]]:
        root = root_rows(self.catalog, r.root, self.ignore_case)
        if r.root.limit is not None and (r.down or r.up):
            root = staged(root, "root")  # else every table's plan would sort and cut again
            self.written.append(root)
        seeds = {r.root.table: [self._exactly(r.root.table, root)]}
        back = self._close(seeds, r.backward, r.down, out)
        return self._close(back, r.tables, r.up, out)

    def _lookup(self, table: str, wanted: list[Wanted]) -> DataFrame:
        return lookup(self.catalog[table], wanted, self.catalog.meta[table].primary_key)

    def _exactly(self, table: str, rows: DataFrame) -> Wanted:
        key = self.catalog.key(table)
        return Wanted(key, rows.select(*[f"`{c}`" for c in key]), rows, not self.catalog.meta[table].primary_key)

    def _close(self, seeds: dict[str, list[Wanted]], tables: set[str], steps: list[Step], out: Closure) -> dict[str, list[Wanted]]:
        """Everything that steps reach from seeds, as lookups in each table."""
        wanted = {t: list(w) for t, w in seeds.items()}
        rows: dict[str, DataFrame] = {}
        sources: dict[str, DataFrame] = {}

        def ask(s: Step, source: DataFrame) -> Wanted:
            keys = source.select(f"`{s.src_col}`").dropna()
            out.asked.setdefault(s.dst, []).append(keys)
            return Wanted([s.dst_col], keys)

        for group in components(tables, steps):
            inside = [s for s in steps if s.src in group and s.dst in group]
            for s in steps:
                if s.dst in group and s not in inside and s.src in sources:
                    wanted.setdefault(s.dst, []).append(ask(s, sources[s.src]))
            for t in group:
                if t in wanted:
                    rows[t] = self._lookup(t, wanted[t])
            if inside and any(t in rows for t in group):
                for t, found in self._iterate({t: rows[t] for t in group if t in rows}, inside, ask).items():
                    rows[t] = found
                    wanted[t] = [self._exactly(t, found)]
                    self.written.append(found)
            for t in group:
                if t in rows:
                    sources[t] = self._keys(rows[t], [s for s in steps if s.src == t and s.dst not in group])
        return wanted

    def _keys(self, rows: DataFrame, steps: list[Step]) -> DataFrame:
        """What later steps read of a table: where several do, its key columns, written once.

        Else each of them would scan and join the table's rows again.
        """
        columns = sorted({s.src_col for s in steps})
        if len(steps) < 2 or any(rows is w for w in self.written):
            return rows
        return staged(rows.select(*[f"`{c}`" for c in columns]), "keys")

    def _iterate(self, begun: dict[str, DataFrame], steps: list[Step], ask) -> dict[str, DataFrame]:
        known = {t: staged(df, "cycle") for t, df in begun.items()}
        new, rounds = dict(known), 0
        while new:
            rounds += 1
            found: dict[str, list[Wanted]] = {}
            for s in steps:
                if s.src in new:
                    found.setdefault(s.dst, []).append(ask(s, new[s.src]))
            new = {}
            for t, wanted in found.items():
                rows = self._lookup(t, wanted)
                if t in known:
                    w = self._exactly(t, known[t])
                    names = [f"__seen_{j}" for j in range(len(w.columns))]
                    seen = w.keys.toDF(*names)
                    rows = rows.join(seen, _matching(w, names), "left_anti")
                rows = staged(rows, "cycle")
                if not rows.isEmpty():
                    new[t] = rows
            for t, rows in new.items():
                known[t] = known[t].unionByName(rows) if t in known else rows
            if rounds % RESTAGE == 0:
                known = {t: staged(df, "cycle") for t, df in known.items()}
        return known


def subset(catalog: Catalog, plan: Plan, untouched: str = "full", ignore_case: bool = False) -> tuple[dict[str, DataFrame], Closure]:
    """Every table's rows under the plan, before masking, and the closure.

    untouched: what becomes of reachable tables that no key reached, "full" or "empty".
    """
    closure = Traversal(catalog, plan, ignore_case=ignore_case).run()
    s = closure.selection
    out = {t: catalog[t] for t in s.whole}
    if not plan.aggregates_only:
        out |= {t: catalog[t].limit(0) for t in s.excluded}
    touched = closure.touched() if not plan.aggregates_only and untouched == "full" else s.potential
    for t in s.potential:
        out[t] = closure.rows[t] if t in touched and t in closure.rows else catalog[t] if untouched == "full" and not plan.aggregates_only else catalog[t].limit(0)
    return dict(sorted(out.items())), closure
