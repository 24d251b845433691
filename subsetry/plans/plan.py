"""The plan: everything a run needs, without a session; it converts to and from JSON."""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass, field

from ..lang.syntax import Pattern


@dataclass(frozen=True)
class Edge:
    """A single-column relation: child's column refers to parent's column."""

    child: str
    child_col: str
    parent: str
    parent_col: str


@dataclass
class TableSet:
    """Names and regular expressions; the latter are searched for in names."""

    names: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)

    def add(self, patterns: list[Pattern]) -> None:
        for p in patterns:
            into = self.regexes if p.regex else self.names
            if p.text not in into:
                into.append(p.text)

    def matches(self, table: str) -> bool:
        return table in self.names or any(re.search(r, table) for r in self.regexes)

    def check(self) -> None:
        for r in self.regexes:
            try:
                re.compile(r)
            except re.error as e:
                raise PlanError(f"bad pattern /{r}/: {e}") from e


@dataclass
class Root:
    """A resolved aggregate."""

    name: str
    table: str
    where: str | None = None
    order: str | None = None
    descending: bool | None = None
    limit: int | None = None
    exclude: TableSet = field(default_factory=TableSet)
    root_only: bool = False


@dataclass
class Param:
    name: str
    type: str
    default: object = None
    has_default: bool = False


@dataclass
class GetFunction:
    """Overrides of an aggregate. where holds {param} for each use of a parameter."""

    name: str
    params: list[Param]
    aggregate: str
    where: list | None = None  # texts, and {"param": name}
    order: str | None = None
    descending: bool | None = None
    limit: int | None = None
    limit_param: str | None = None
    exclude: TableSet = field(default_factory=TableSet)
    root_only: bool = False


@dataclass
class SetRule:
    table: str
    match: list[tuple[str, object]]
    assign: list[tuple[str, object]]


@dataclass
class Plan:
    relations: list[Edge] = field(default_factory=list)
    ignored_relations: list[Edge] = field(default_factory=list)
    ignore_tables: TableSet = field(default_factory=TableSet)
    exclude_data: TableSet = field(default_factory=TableSet)
    full: TableSet = field(default_factory=TableSet)
    fakers: dict[str, list[str]] = field(default_factory=dict)
    anonymize: dict[str, list[tuple[str, str | None]]] = field(default_factory=dict)
    aggregates: list[Root] = field(default_factory=list)
    gets: dict[str, GetFunction] = field(default_factory=dict)
    preserves: list[tuple[str, str]] = field(default_factory=list)
    sets: list[SetRule] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    variables: dict[str, object] = field(default_factory=dict)
    aggregates_only: bool = False

    def check(self) -> None:
        """Raise PlanError for an undefined pool, a bad pattern, or a rooted table without rows."""
        for s in (self.ignore_tables, self.exclude_data, self.full, *(a.exclude for a in self.aggregates), *(g.exclude for g in self.gets.values())):
            s.check()
        for table, rules in self.anonymize.items():
            for column, pool in rules:
                if pool is not None and pool not in self.fakers:
                    raise PlanError(f"{table}.{column}: pool {pool!r} is not defined")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Plan":
        d = json.loads(text)
        table_set = lambda x: TableSet(**x)
        pairs = lambda rows: [tuple(r) for r in rows]
        return cls(
            relations=[Edge(**e) for e in d["relations"]],
            ignored_relations=[Edge(**e) for e in d["ignored_relations"]],
            **{k: table_set(d[k]) for k in ("ignore_tables", "exclude_data", "full")},
            fakers=d["fakers"],
            anonymize={t: pairs(r) for t, r in d["anonymize"].items()},
            aggregates=[Root(**a | {"exclude": table_set(a["exclude"])}) for a in d["aggregates"]],
            gets={n: GetFunction(**g | {"params": [Param(**p) for p in g["params"]], "exclude": table_set(g["exclude"])}) for n, g in d["gets"].items()},
            preserves=pairs(d["preserves"]),
            sets=[SetRule(s["table"], pairs(s["match"]), pairs(s["assign"])) for s in d["sets"]],
            after=d["after"],
            variables=d["variables"],
            aggregates_only=d["aggregates_only"],
        )


class PlanError(Exception):
    """The configuration is well-formed but cannot be carried out."""
