"""Statements and expressions of the configuration language, and its errors."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Problem:
    """One error at an offset of the source."""

    message: str
    offset: int
    hint: str = ""

    def place(self, source: str) -> tuple[int, int]:
        """Line and column, from 1."""
        before = source[: self.offset]
        return before.count("\n") + 1, self.offset - (before.rfind("\n") + 1) + 1

    def render(self, source: str, name: str = "config") -> str:
        line, col = self.place(source)
        rows = source.splitlines() or [""]
        text = rows[line - 1] if line <= len(rows) else ""
        out = f"{name}:{line}:{col}: {self.message}\n{line:>5} | {text}\n      | {' ' * (col - 1)}^"
        return out + (f"\n      = {self.hint}" if self.hint else "")


class LanguageError(Exception):
    """All problems of one source."""

    def __init__(self, problems: list[Problem], source: str = "", name: str = "config"):
        self.problems, self.source, self.name = problems, source, name
        super().__init__("\n".join(p.render(source, name) for p in problems))


# expressions ---------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Unique:
    """unique(): the counter of a written cell."""


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Text:
    """A string: pieces of text and interpolated expressions."""

    parts: tuple

    @property
    def plain(self) -> str | None:
        """The text, if nothing is interpolated."""
        return "".join(self.parts) if all(isinstance(p, str) for p in self.parts) else None


# statements ----------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A table name, or a regular expression that is searched for in names."""

    text: str
    regex: bool = False


@dataclass
class Query:
    where: Text | None = None
    order: str | None = None
    descending: bool | None = None
    limit: int | Var | None = None
    exclude: list[Pattern] = field(default_factory=list)
    root_only: bool = False


@dataclass
class Statement:
    when: object = field(default=None, kw_only=True)
    offset: int = field(default=0, kw_only=True)


@dataclass
class Import(Statement):
    path: str


@dataclass
class VarDecl(Statement):
    name: str
    type: str
    default: object = None
    has_default: bool = False


@dataclass
class Faker(Statement):
    """items: texts, and Var for a spread array."""

    name: str
    items: list


@dataclass
class Relation(Statement):
    child: tuple[str, str]
    parent: tuple[str, str]
    ignore: bool = False


@dataclass
class Anonymize(Statement):
    """rules: column and pool, or None for NULL."""

    table: str
    rules: list[tuple[str, str | None]]


@dataclass
class Tables(Statement):
    """kind: exclude_data, ignore_table or full."""

    kind: str
    patterns: list[Pattern]


@dataclass
class Aggregate(Statement):
    name: str
    root: str
    query: Query


@dataclass
class Get(Statement):
    name: str
    params: list[VarDecl]
    aggregate: str
    query: Query


@dataclass
class Preserve(Statement):
    table: str
    where: Text


@dataclass
class SetRow(Statement):
    table: str
    match: list[tuple[str, object]]
    assign: list[tuple[str, object]]


@dataclass
class After(Statement):
    statements: list[str]
