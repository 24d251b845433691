"""Which tables a plan touches, from the relations alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from ..plans.plan import Edge, Plan, PlanError, Root
from ..sources.catalog import Catalog


def merged_relations(plan: Plan, discovered: Iterable[Edge], tables: Iterable[str]) -> list[Edge]:
    """Declared relations and discovered ones not among them, without ignored ones.

    A relation with an unknown or ignored table at either end is dropped.
    """
    known = {t for t in tables if not plan.ignore_tables.matches(t)}
    out = []
    for e in (*plan.relations, *discovered):
        if e not in out and e not in plan.ignored_relations and e.child in known and e.parent in known:
            out.append(e)
    return out


@dataclass(frozen=True)
class Step:
    """Rows of dst are reached whose dst_col is among the values of src_col in reached rows of src."""

    src: str
    src_col: str
    dst: str
    dst_col: str


@dataclass
class Reach:
    """Of one aggregate: tables reached backward and forward, and the steps between them."""

    root: Root
    backward: set[str] = field(default_factory=set)
    forward: set[str] = field(default_factory=set)
    down: list[Step] = field(default_factory=list)
    up: list[Step] = field(default_factory=list)

    @property
    def tables(self) -> set[str]:
        return self.backward | self.forward


def reach(root: Root, edges: list[Edge], blocked: set[str]) -> Reach:
    """Parents of every reached table, and children of those reached from the root backward.

    Blocked tables are dead ends; the root itself is never blocked.
    """
    out = Reach(root, {root.table})
    if root.root_only:
        return out
    todo = [root.table]
    while todo:
        t = todo.pop()
        for e in edges:
            if e.parent == t and (e.child not in blocked or e.child == root.table):
                step = Step(t, e.parent_col, e.child, e.child_col)
                if step not in out.down:
                    out.down.append(step)
                if e.child not in out.backward:
                    out.backward.add(e.child)
                    todo.append(e.child)
    todo, seen = list(out.backward), set(out.backward)
    while todo:
        t = todo.pop()
        for e in edges:
            if e.child == t and (e.parent not in blocked or e.parent == root.table):
                step = Step(t, e.child_col, e.parent, e.parent_col)
                if step not in out.up:
                    out.up.append(step)
                out.forward.add(e.parent)
                if e.parent not in seen:
                    seen.add(e.parent)
                    todo.append(e.parent)
    return out


@dataclass
class Selection:
    """The plan's decision on each table of the catalog."""

    ignored: set[str]
    excluded: set[str]
    whole: set[str]
    reaches: list[Reach]
    edges: list[Edge]
    warnings: list[str]

    @property
    def potential(self) -> set[str]:
        return {t for r in self.reaches for t in r.tables}


def select_tables(plan: Plan, catalog: Catalog) -> Selection:
    """ignored: absent. excluded: empty. whole: copied. Others: what the aggregates reach."""
    tables = list(catalog.frames)
    ignored = {t for t in tables if plan.ignore_tables.matches(t)}
    excluded = {t for t in tables if plan.exclude_data.matches(t)} - ignored
    full = {t for t in tables if plan.full.matches(t)} - ignored
    edges = merged_relations(plan, catalog.discovered(), tables)
    warnings, reaches = [], []
    for a in plan.aggregates:
        if a.table not in catalog:
            raise PlanError(f"aggregate {a.name}: no table {a.table!r}")
        if a.table in ignored or a.table in excluded:
            raise PlanError(f"aggregate {a.name}: its root {a.table!r} is ignored or excluded")
        if a.table in full:
            warnings.append(f"{a.table} is full and the root of {a.name}: only matching rows are taken")
        own = {t for t in tables if a.exclude.matches(t)}
        reaches.append(reach(a, edges, full | excluded | ignored | own))
    potential = {t for r in reaches for t in r.tables}
    cut = {t for a, r in zip(plan.aggregates, reaches) for t in reach(Root(a.name, a.table), edges, full | excluded | ignored).tables - potential}
    if cut and not plan.aggregates_only:
        warnings.append("cut off from their aggregates, so copied whole: " + ", ".join(sorted(cut)))
    whole = set() if plan.aggregates_only else set(tables) - ignored - excluded - potential
    return Selection(ignored, excluded, whole, reaches, edges, warnings)


def components(nodes: Iterable[str], steps: list[Step]) -> list[list[str]]:
    """Strongly connected components of the step graph, sources first."""
    nodes = sorted(nodes)
    after: dict[str, list[str]] = {n: [] for n in nodes}
    before: dict[str, list[str]] = {n: [] for n in nodes}
    for s in steps:
        after[s.src].append(s.dst)
        before[s.dst].append(s.src)
    order: list[str] = []
    seen: set[str] = set()
    for n in nodes:
        stack = [(n, iter(after[n]))] if n not in seen else []
        seen.add(n)
        while stack:
            node, rest = stack[-1]
            follow = next((x for x in rest if x not in seen), None)
            if follow is None:
                order.append(stack.pop()[0])
            else:
                seen.add(follow)
                stack.append((follow, iter(after[follow])))
    out, placed = [], set()
    for n in reversed(order):
        if n in placed:
            continue
        group, todo = [], [n]
        placed.add(n)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in before[x]:
                if y not in placed:
                    placed.add(y)
                    todo.append(y)
        out.append(sorted(group))
    return out
