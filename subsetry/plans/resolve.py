"""Statements to a plan: imports, variables, conditions, interpolation."""

from __future__ import annotations

import os
from collections.abc import Callable

from ..lang import parse
from ..lang import syntax as s
from .plan import Edge, GetFunction, Param, Plan, PlanError, Root, SetRule, TableSet
from .values import as_text, checked, coerce, evaluate, interpolate, truth


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Resolver:
    """Collects files depth first, each once, into one plan.

    given: variables from outside, which win over declared defaults. lenient: a variable
    without a value gets a placeholder instead of an error (for checks of a file alone).
    """

    def __init__(self, given: dict[str, object] | None = None, lenient: bool = False, read: Callable[[str], str] = read_text):
        self.given, self.lenient, self.read = dict(given or {}), lenient, read
        self.plan, self.names, self.seen = Plan(), {}, set()

    def file(self, path: str) -> Plan:
        self._file(path)
        return self._finished()

    def source(self, text: str, name: str = "config", folder: str = ".") -> Plan:
        self._statements(parse(text, name), folder)
        return self._finished()

    def _finished(self) -> Plan:
        self.plan.variables = dict(self.names)
        self.plan.check()
        return self.plan

    def _file(self, path: str) -> None:
        real = os.path.realpath(path)
        if real in self.seen:
            return
        self.seen.add(real)
        if path.endswith(".json"):
            from .json_config import JsonResolver

            JsonResolver(self).text(self.read(path), os.path.dirname(real))
        else:
            self._statements(parse(self.read(path), path), os.path.dirname(real))

    def _statements(self, statements: list[s.Statement], folder: str) -> None:
        early = {**self.given, **self.names}
        for x in statements:
            if isinstance(x, s.Import) and (x.when is None or truth(evaluate(x.when, early))):
                self._file(os.path.join(folder, x.path))
                early = {**self.given, **self.names}
        # defaults see what imported files declared, not each other
        imported = dict(self.names)
        for x in statements:
            if isinstance(x, s.VarDecl):
                self.names[x.name] = self._value(x, imported)
        for x in statements:
            if isinstance(x, (s.Import, s.VarDecl)) or (x.when is not None and not truth(evaluate(x.when, self.names))):
                continue
            getattr(self, "_" + type(x).__name__.lower())(x)

    def _value(self, x: s.VarDecl, names: dict[str, object]) -> object:
        if x.name in self.given:
            return checked(coerce(self.given[x.name], x.type), x.type, x.name)
        if x.has_default:
            return checked(evaluate(x.default, names), x.type, x.name)
        if self.lenient:
            return {"string": f"<{x.name}>", "int": 0, "float": 0.0, "bool": False}.get(x.type, [])
        raise PlanError(f"variable ${x.name} has no value")

    # statements

    def _faker(self, x: s.Faker) -> None:
        pool: list[str] = []
        for item in x.items:
            if isinstance(item, s.Var):
                value = evaluate(item, self.names)
                if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                    raise PlanError(f"faker {x.name}: ${item.name} must be string[]")
                pool += value
            else:
                pool.append(interpolate(item, self.names, unique=True))
        self.plan.fakers[x.name] = pool

    def _relation(self, x: s.Relation) -> None:
        into = self.plan.ignored_relations if x.ignore else self.plan.relations
        into.append(Edge(*x.child, *x.parent))

    def _anonymize(self, x: s.Anonymize) -> None:
        self.plan.anonymize[x.table] = list(x.rules)

    def _tables(self, x: s.Tables) -> None:
        {"exclude_data": self.plan.exclude_data, "ignore_table": self.plan.ignore_tables, "full": self.plan.full}[x.kind].add(x.patterns)

    def _limit(self, limit: int | s.Var | None, names: dict[str, object]) -> int | None:
        if isinstance(limit, s.Var):
            value = evaluate(limit, names)
            if type(value) is not int:
                raise PlanError(f"limit ${limit.name} must be an int")
            limit = value
        if limit is not None and limit < 0:
            raise PlanError("a limit is not negative")
        return limit

    def _aggregate(self, x: s.Aggregate) -> None:
        q, exclude = x.query, TableSet()
        exclude.add(q.exclude)
        where = None if q.where is None else interpolate(q.where, self.names)
        self.plan.aggregates.append(Root(x.name, x.root, where, q.order, q.descending, self._limit(q.limit, self.names), exclude, q.root_only))

    def _get(self, x: s.Get) -> None:
        if not any(a.name == x.aggregate for a in self.plan.aggregates):
            raise PlanError(f"get {x.name}: aggregate {x.aggregate!r} is not declared before it")
        params = [Param(p.name, p.type, checked(evaluate(p.default, self.names), p.type, p.name) if p.has_default else None, p.has_default) for p in x.params]
        own, q, exclude = {p.name for p in params}, x.query, TableSet()
        exclude.add(q.exclude)
        where: list | None = None
        if q.where is not None:
            where = []
            for part in q.where.parts:
                if isinstance(part, s.Var) and part.name in own:
                    where.append({"param": part.name})
                elif isinstance(part, str):
                    where.append(part)
                else:
                    where.append(as_text(evaluate(part, self.names)))
        by_param = isinstance(q.limit, s.Var) and q.limit.name in own
        self.plan.gets[x.name] = GetFunction(
            x.name, params, x.aggregate, where, q.order, q.descending, None if by_param else self._limit(q.limit, self.names),
            q.limit.name if by_param else None, exclude, q.root_only,
        )

    def _preserve(self, x: s.Preserve) -> None:
        self.plan.preserves.append((x.table, interpolate(x.where, self.names)))

    def _setrow(self, x: s.SetRow) -> None:
        of = lambda rows: [(c, evaluate(v, self.names)) for c, v in rows]
        self.plan.sets.append(SetRule(x.table, of(x.match), of(x.assign)))

    def _after(self, x: s.After) -> None:
        self.plan.after += x.statements


def load_plan(path: str | None = None, variables: dict[str, object] | None = None, lenient: bool = False, text: str | None = None) -> Plan:
    """The plan of a file (.json, or else the language), of text, or of nothing: import everything."""
    if path is None and text is None:
        return Plan()
    resolver = Resolver(variables, lenient)
    return resolver.file(path) if path is not None else resolver.source(text)


def with_gets(plan: Plan, calls: list[tuple[str, dict[str, object]]]) -> Plan:
    """A plan that fetches only the called functions' aggregates.

    Later steps on the target (preserve, set, after) are left out, and masking stays. A
    function's clauses replace those of its aggregate where it has them; an order without a
    direction keeps the aggregate's.
    """
    out = Plan(**{**plan.__dict__, "aggregates": [], "aggregates_only": True, "preserves": [], "sets": [], "after": []})
    for n, (name, args) in enumerate(calls):
        if name not in plan.gets:
            raise PlanError(f"no get function {name!r}")
        g = plan.gets[name]
        unknown = set(args) - {p.name for p in g.params}
        if unknown:
            raise PlanError(f"{name}: unknown parameter {sorted(unknown)[0]!r}")
        values = {}
        for p in g.params:
            if p.name not in args and not p.has_default:
                raise PlanError(f"{name}: parameter {p.name!r} is missing")
            values[p.name] = checked(coerce(args[p.name], p.type), p.type, p.name) if p.name in args else p.default
        base = next(a for a in plan.aggregates if a.name == g.aggregate)
        where = base.where if g.where is None else "".join(as_text(values[w["param"]]) if isinstance(w, dict) else w for w in g.where)
        limit = base.limit
        if g.limit_param is not None:
            limit = values[g.limit_param]
            if type(limit) is not int or limit < 0:
                raise PlanError(f"{name}: the limit must be an int")
        elif g.limit is not None:
            limit = g.limit
        out.aggregates.append(
            Root(
                f"{name}_{n}", base.table, where, g.order or base.order, base.descending if g.descending is None else g.descending, limit,
                TableSet(g.exclude.names or base.exclude.names, g.exclude.regexes or base.exclude.regexes), g.root_only or base.root_only,
            )
        )
    return out
