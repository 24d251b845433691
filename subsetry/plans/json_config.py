"""The JSON form of a configuration."""

from __future__ import annotations

import json
import os
import re
from typing import TYPE_CHECKING

from .plan import Edge, PlanError, Root, SetRule
from .values import as_text, checked, coerce

if TYPE_CHECKING:
    from .resolve import Resolver

_SECTIONS = ("variable", "import", "faker", "relation", "exclude", "ignore", "ignore_relation", "anonymize", "aggregate", "include", "preserve", "set", "after")
_REFERENCE = re.compile(r"\{\$([^}]*)\}?|\$(\w+)")


class JsonResolver:
    """Adds a JSON configuration to a resolver's plan; sections are taken in a fixed order."""

    def __init__(self, into: "Resolver"):
        self.into, self.plan, self.names = into, into.plan, into.names

    def text(self, source: str, folder: str) -> None:
        try:
            config = json.loads(source)
        except ValueError as e:
            raise PlanError(f"not JSON: {e}") from e
        if not isinstance(config, dict):
            raise PlanError("a JSON configuration is an object")
        self.folder = folder
        # conditions of imports see variables given from outside and those of earlier files
        for section in ("import", *(x for x in _SECTIONS if x != "import")):
            if section in config:
                getattr(self, "_" + section)(self._wanted(config[section], section))

    def _wanted(self, rows: object, section: str) -> object:
        if isinstance(rows, dict):
            return rows
        names = {**self.into.given, **self.names} if section == "import" else self.names
        return [r for r in rows if not isinstance(r, dict) or r.get("when") is None or self._when(r["when"], names)]

    @staticmethod
    def _when(condition: str, names: dict[str, object]) -> bool:
        """$name, !$name, true or false."""
        text = condition.strip()
        m = re.fullmatch(r"(!?)\$(.+)", text)
        if m is None:
            if text.lower() in ("true", "false"):
                return text.lower() == "true"
            raise PlanError(f"bad condition {condition!r}")
        if m[2] not in names:
            raise PlanError(f"undefined variable ${m[2]}")
        value = names[m[2]]
        if value is not None and not isinstance(value, bool):
            raise PlanError(f"condition {condition!r} must be a bool")
        return bool(value) != bool(m[1])

    def _filled(self, text: str) -> str:
        """{$name} must be defined; a bare $name that is not stays as it is."""

        def value(m: re.Match) -> str:
            name = m[1] if m[1] is not None else m[2]
            if name in self.names:
                return as_text(self.names[name])
            if m[1] is not None:
                raise PlanError(f"undefined variable ${name}")
            return m[0]

        return _REFERENCE.sub(value, text)

    def _value(self, value: object) -> object:
        return self._filled(value) if isinstance(value, str) else value

    def _import(self, rows: list) -> None:
        for r in rows:
            self.into._file(os.path.join(self.folder, r["path"] if isinstance(r, dict) else r))

    def _variable(self, rows: list) -> None:
        for r in rows:
            name, kind = r["name"], r["type"]
            if name in self.into.given:
                value = coerce(self.into.given[name], kind)
            elif "default" in r:
                value = r["default"]
                value = [self._value(v) for v in value] if isinstance(value, list) else coerce(self._value(value), kind)
            elif self.into.lenient:
                value = None
            else:
                raise PlanError(f"variable ${name} has no value")
            self.names[name] = checked(value, kind, name)

    def _faker(self, rows: object) -> None:
        pairs = rows.items() if isinstance(rows, dict) else [(r["name"], r["values"]) for r in rows]
        for name, values in pairs:
            self.plan.fakers[name] = [self._filled(v) for v in values]

    def _edge(self, r: dict) -> Edge:
        ends = []
        for key in ("from", "to"):
            table, dot, column = r[key].rpartition(".")
            if not dot or not table or not column or "." in table:
                raise PlanError(f"{r[key]!r} is not table.column")
            ends += [table, column]
        return Edge(*ends)

    def _relation(self, rows: list) -> None:
        self.plan.relations += map(self._edge, rows)

    def _ignore_relation(self, rows: list) -> None:
        self.plan.ignored_relations += map(self._edge, rows)

    def _exclude(self, rows: list) -> None:
        self.plan.exclude_data.names += [r["table"] for r in rows]

    def _ignore(self, rows: list) -> None:
        self.plan.ignore_tables.names += [r["table"] for r in rows]

    def _anonymize(self, rows: object) -> None:
        pairs = rows.items() if isinstance(rows, dict) else [(r["table"], r.get("rules", [])) for r in rows]
        for table, rules in pairs:
            own = self.plan.anonymize.setdefault(table, [])  # unlike a block of the language, this adds to earlier rules
            for r in rules:
                if not r.get("null") and r.get("faker") is None:
                    raise PlanError(f"{table}.{r['column']}: a rule needs a faker or null")
                own.append((r["column"], None if r.get("null") else r["faker"]))

    def _aggregate(self, rows: list) -> None:
        for r in rows:
            order = r.get("order_by")
            column, way = (order, None) if order is None or isinstance(order, str) else (order["column"], order.get("direction"))
            limit = r.get("limit")
            if isinstance(limit, str):
                name = limit.removeprefix("$")
                if name not in self.names:
                    raise PlanError(f"undefined variable ${name}")
                limit = self.names[name]
            if limit is not None and type(limit) is not int:
                raise PlanError(f"aggregate {r['name']}: the limit must be an int")
            where = r.get("where")
            descending = None if way is None else way.lower() == "desc"
            self.plan.aggregates.append(Root(r["name"], r["root"], None if where is None else self._filled(where), column, descending, limit))

    def _include(self, rows: list) -> None:
        for r in rows:
            base = next((a for a in self.plan.aggregates if a.name == r["aggregate"]), None)
            if base is not None:
                where = base.where if r.get("where") is None else self._filled(r["where"])
                name = f"{base.name}_include_{len(self.plan.aggregates)}"
                self.plan.aggregates.append(Root(name, base.table, where, base.order, base.descending, base.limit, base.exclude, base.root_only))

    def _preserve(self, rows: list) -> None:
        self.plan.preserves += [(r["table"], self._filled(r["where"])) for r in rows]

    def _set(self, rows: list) -> None:
        of = lambda d: [(c, self._value(v)) for c, v in d.items()]
        self.plan.sets += [SetRule(r["table"], of(r["match"]), of(r.get("value", {}))) for r in rows]

    def _after(self, rows: list) -> None:
        self.plan.after += [self._filled(r["sql"]) for r in rows]
