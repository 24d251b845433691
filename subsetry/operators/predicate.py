"""Predicates and statements written for a MySQL source, as Spark SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..plans.plan import PlanError

_PART = re.compile(r"""(?P<str>'(?:\\[\s\S]|''|[^'\\])*'|"(?:\\[\s\S]|""|[^"\\])*")|(?P<tick>`[^`]*`)|(?P<num>\d+(?:\.\d+)?)|(?P<word>[^\W\d][\w$]*)|(?P<space>\s+|(?:--(?=\s|$)|\#)[^\n]*\n?|/\*[\s\S]*?\*/)|(?P<op><=>|<>|!=|<=|>=|\|\||&&|[\s\S])""")


@dataclass
class Piece:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind in ("word", "op") else ""


def pieces(sql: str) -> list[Piece]:
    return [Piece(m.lastgroup, m[0]) for m in _PART.finditer(sql)]


def _closing(ps: list[Piece], start: int) -> int:
    """Index of the parenthesis that closes the one at start."""
    depth = 0
    for i in range(start, len(ps)):
        depth += (ps[i].text == "(") - (ps[i].text == ")") if ps[i].kind == "op" else 0
        if depth == 0:
            return i
    raise PlanError("unbalanced parentheses in SQL: " + "".join(p.text for p in ps))


def _split(ps: list[Piece], separator: str) -> list[list[Piece]]:
    """Parts between top-level separators."""
    out, depth = [[]], 0
    for p in ps:
        if p.kind == "op":
            depth += (p.text == "(") - (p.text == ")")
        if depth == 0 and p.kind == "op" and p.text == separator:
            out.append([])
        else:
            out[-1].append(p)
    return out


def translate(sql: str, ignore_case: bool = False) -> str:
    """sql as Spark SQL: interval arithmetic, double-quoted strings, and the operators ||, &&, XOR and MOD.

    ignore_case compares with text literals as MySQL's usual collations do.
    """
    return _joined(pieces(sql), ignore_case)


_DATES = {"DATE_SUB": "-", "SUBDATE": "-", "DATE_ADD": "+", "ADDDATE": "+"}


def _operands(ps: list[Piece], words: tuple[str, ...]) -> list[list[Piece]]:
    """Parts between any of the operators at the top level, outside parentheses and CASE."""
    out, depth = [[]], 0
    for p in ps:
        if p.kind in ("op", "word"):
            depth += (p.text == "(") + (p.upper == "CASE") - (p.text == ")") - (p.upper == "END")
        if depth == 0 and p.upper in words:
            out.append([])
        else:
            out[-1].append(p)
    return out


def _either(ps: list[Piece], ignore_case: bool) -> str:
    """ps, which has an XOR at its top level: XOR binds less than AND and more than OR."""
    parts = []
    for part in _operands(ps, ("OR", "||")):
        sides = [_joined(x, ignore_case).strip() for x in _operands(part, ("XOR",))]
        if not all(sides):
            raise PlanError("XOR without an operand in SQL: " + "".join(p.text for p in ps))
        out = sides[0]
        for other in sides[1:]:
            out = f"(CAST(({out}) AS BOOLEAN) <> CAST(({other}) AS BOOLEAN))"
        parts.append(out)
    return " OR ".join(parts)


#: Words that end a condition's expression at the top level of a query.
_CLAUSES = ("SELECT", "FROM", "WHERE", "HAVING", "ON", "GROUP", "ORDER", "LIMIT", "UNION", "JOIN", "SET", "VALUES", "AS", ",")


def _joined(ps: list[Piece], ignore_case: bool) -> str:
    if len(_operands(ps, ("XOR",))) > 1:
        if any(len(_operands(ps, (c,))) > 1 for c in _CLAUSES):
            raise PlanError("XOR stands only in a condition or in parentheses: " + "".join(p.text for p in ps))
        return _either(ps, ignore_case)
    out, i, last = [], 0, ""
    while i < len(ps):
        p = ps[i]
        if p.upper in _DATES:
            k = i + 1
            while k < len(ps) and ps[k].kind == "space":
                k += 1
            if k < len(ps) and ps[k].text == "(":
                end = _closing(ps, k)
                args = _split(ps[k + 1 : end], ",")
                if len(args) == 2 and next((x.upper for x in args[1] if x.kind != "space"), "") == "INTERVAL":
                    first = _joined(args[0], ignore_case).strip()
                    if all(x.kind in ("str", "space") for x in args[0]):
                        first = f"CAST({first} AS TIMESTAMP)"
                    out.append(f"(({first}) {_DATES[p.upper]} {_joined(args[1], ignore_case).strip()})")
                    i, last = end + 1, ""
                    continue
        if p.kind == "str":
            text = p.text
            if text[0] == '"':
                text = "'" + text[1:-1].replace('""', '"').replace("'", "\\'") + "'"
            elif "''" in text[1:-1]:
                text = "'" + text[1:-1].replace("''", "\\'") + "'"
            out.append(text + (" COLLATE UTF8_LCASE" if ignore_case and last in ("=", "<>", "!=", "LIKE") else ""))
        elif p.text in ("&&", "||"):
            out.append(" AND " if p.text == "&&" else " OR ")
        elif p.text == "(":
            end = _closing(ps, i)
            out.append(f"({_joined(ps[i + 1 : end], ignore_case)})")
            i, last = end + 1, ""
            continue
        elif p.upper == "MOD" and not (i + 1 < len(ps) and ps[i + 1].text == "("):
            out.append("%")
        elif p.text == "-" and i and ps[i - 1].text == "-":
            out.append(" -")  # two of them would begin a comment
        elif p.kind == "space":
            out.append(" ")
        else:
            out.append(p.text)
        if p.kind != "space":
            last = p.upper
        i += 1
    return "".join(out)


def has_subquery(sql: str) -> bool:
    return any(p.upper == "SELECT" for p in pieces(sql))


#: What may follow a table's name and is no alias of it.
_NO_ALIAS = {"WHERE", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "AND", "OR", "SET"}


def from_views(sql: str, names: dict[str, str]) -> str:
    """sql with the views of names in place of the tables that it reads; aliases keep their names."""
    ps, out, at_table = pieces(sql), [], [False]
    for i, p in enumerate(ps):
        text = p.text
        if p.kind == "op" and text == "(":
            at_table.append(False)
        elif p.kind == "op" and text == ")" and len(at_table) > 1:
            at_table.pop()
        elif p.upper in ("FROM", "JOIN"):
            at_table[-1] = True
        elif p.upper in ("WHERE", "ON", "GROUP", "ORDER", "HAVING", "LIMIT", "SELECT", "UNION"):
            at_table[-1] = False
        elif at_table[-1] and p.kind in ("word", "tick") and text.strip("`") in names:
            before = next((x for x in reversed(ps[:i]) if x.kind != "space"), None)
            after = next((x for x in ps[i + 1 :] if x.kind != "space"), None)
            if before is not None and (before.upper in ("FROM", "JOIN") or before.text == ","):
                named = after is not None and (after.kind == "tick" or after.upper == "AS" or (after.kind == "word" and after.upper not in _NO_ALIAS))
                text = f"`{names[text.strip('`')]}`" + ("" if named else f" `{text.strip('`')}`")
        out.append(text)
    return "".join(out)


# statements ----------------------------------------------------------------


@dataclass
class Update:
    table: str
    assign: list[tuple[str, str]]
    where: str | None


@dataclass
class Delete:
    table: str
    where: str | None


@dataclass
class Insert:
    table: str
    columns: list[str]
    rest: str  # VALUES ... or SELECT ...
    replace: bool = False


@dataclass
class Select:
    sql: str


def statements(sql: str, ignore_case: bool = False) -> list:
    """The statements of a text, separated by semicolons, translated."""
    out = []
    for part in _split(pieces(sql), ";"):
        ps = [p for p in part]
        while ps and ps[0].kind == "space":
            ps.pop(0)
        while ps and ps[-1].kind == "space":
            ps.pop()
        if ps:
            out.append(_statement(ps, ignore_case))
    return out


def _name(p: Piece) -> str:
    if p.kind not in ("word", "tick"):
        raise PlanError(f"expected a name in SQL, found {p.text!r}")
    return p.text.strip("`")


def _where(ps: list[Piece], ignore_case: bool) -> tuple[list[Piece], str | None]:
    depth = 0
    for i, p in enumerate(ps):
        depth += (p.text == "(") - (p.text == ")") if p.kind == "op" else 0
        if depth == 0 and p.upper == "WHERE":
            return ps[:i], _joined(ps[i + 1 :], ignore_case).strip()
    return ps, None


def _statement(ps: list[Piece], ignore_case: bool) -> object:
    solid = [p for p in ps if p.kind != "space"]
    verb = solid[0].upper
    if verb == "SELECT":
        return Select(_joined(ps, ignore_case))
    if verb == "TRUNCATE":
        return Delete(_name(solid[2] if solid[1].upper == "TABLE" else solid[1]), None)
    if verb == "DELETE" and solid[1].upper == "FROM":
        rest = ps[ps.index(solid[2]) + 1 :]
        head, where = _where(rest, ignore_case)
        if any(p.kind != "space" for p in head):
            raise PlanError(f"unsupported SQL: {''.join(p.text for p in ps)}")
        return Delete(_name(solid[2]), where)
    if verb == "UPDATE" and len(solid) > 3 and solid[2].upper == "SET":
        head, where = _where(ps[ps.index(solid[2]) + 1 :], ignore_case)
        assign = []
        for a in _split(head, ","):
            body = [p for p in a if p.kind != "space"]
            if len(body) < 3 or body[1].text != "=":
                raise PlanError(f"bad assignment in SQL: {''.join(p.text for p in a).strip()}")
            assign.append((_name(body[0]), _joined(a[a.index(body[1]) + 1 :], ignore_case).strip()))
        return Update(_name(solid[1]), assign, where)
    if verb in ("INSERT", "REPLACE") and solid[1].upper == "INTO":
        at = ps.index(solid[2]) + 1
        columns: list[str] = []
        if solid[3].text == "(":
            start = ps.index(solid[3])
            end = _closing(ps, start)
            columns = [_name(p) for p in ps[start + 1 : end] if p.kind in ("word", "tick")]
            at = end + 1
        return Insert(_name(solid[2]), columns, _joined(ps[at:], ignore_case).strip(), verb == "REPLACE")
    raise PlanError(f"unsupported SQL: {''.join(p.text for p in ps)}")
