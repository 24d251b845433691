"""Recursive descent over tokens; a failed statement is skipped, so that all errors are told."""

from __future__ import annotations

from .lexer import KEYWORDS, STATEMENTS, Token, lex
from .syntax import (
    After, Aggregate, Anonymize, Binary, Faker, Get, Import, LanguageError, Lit, Pattern, Preserve, Problem, Query,
    Relation, SetRow, Statement, Tables, Text, Unary, Unique, Var, VarDecl,
)

_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))
_ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "t": "\t", "{": "{"}
_TYPES = ("string", "int", "float", "bool")


class _Failed(Exception):
    def __init__(self, problem: Problem):
        self.problem = problem


def parse(source: str, name: str = "config") -> list[Statement]:
    """The statements of source; raises LanguageError with all of its problems."""
    problems: list[Problem] = []
    p = _Parser(source, lex(source, problems), problems)
    out = p.program()
    if problems:
        raise LanguageError(sorted(set(problems), key=lambda x: x.offset), source, name)
    return out


class _Parser:
    def __init__(self, source: str, tokens: list[Token], problems: list[Problem], inner: bool = False):
        self.source, self.tokens, self.problems, self.inner, self.at = source, tokens, problems, inner, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, token: Token | None = None, hint: str = "") -> _Failed:
        return _Failed(Problem(message, (token or self.now).start, hint))

    def take(self) -> Token:
        t = self.now
        if t.kind != "end":
            self.at += 1
        return t

    def accept(self, *texts: str) -> Token | None:
        if self.now.kind in ("op", "word") and self.now.text in texts:
            return self.take()
        return None

    def expect(self, text: str) -> Token:
        t = self.accept(text)
        if t is None:
            raise self.fail(f"expected {text!r}, found {self.now.text or 'the end'!r}")
        return t

    def name(self, what: str = "a name") -> str:
        if self.now.kind == "name":
            return self.take().text
        hint = f"`{self.now.text}` in backticks is a name" if self.now.text in KEYWORDS else ""
        raise self.fail(f"expected {what}, found {self.now.text or 'the end'!r}", hint=hint)

    # program

    def program(self) -> list[Statement]:
        out = []
        while self.now.kind != "end":
            began = self.at
            try:
                out.append(self.statement())
            except _Failed as e:
                self.problems.append(e.problem)
                self.at = max(self.at, began + 1)
                while self.now.kind != "end" and not (self.now.kind == "word" and self.now.text in STATEMENTS) and self.now.text != "#":
                    self.at += 1
        return out

    def statement(self) -> Statement:
        when, offset = None, self.now.start
        if self.accept("#"):
            self.expect("[")
            self.expect("when")
            self.expect("(")
            when = self.expression()
            self.expect(")")
            self.expect("]")
        t = self.now
        if t.kind != "word" or t.text not in STATEMENTS:
            raise self.fail(f"expected a statement, found {t.text or 'the end'!r}")
        self.take()
        out = getattr(self, "_" + t.text)()
        out.when, out.offset = when, offset
        return out

    def _import(self) -> Statement:
        return Import(self.raw("a path"))

    def _var(self) -> Statement:
        return self.declaration()

    def declaration(self) -> VarDecl:
        name = self.name()
        self.expect(":")
        kind = self.accept(*_TYPES)
        if kind is None:
            raise self.fail(f"expected a type, found {self.now.text or 'the end'!r}")
        full = kind.text
        if self.accept("["):
            self.expect("]")
            full += "[]"
        out = VarDecl(name, full)
        if self.accept("="):
            out.default, out.has_default = self.literal(True), True
        return out

    def literal(self, arrays: bool = False, null: bool = True) -> object:
        """A Lit, a Text or a list of them."""
        t = self.now
        if t.kind == "string":
            return self.text()
        if arrays and self.accept("["):
            out: list = []
            while not self.accept("]"):
                item = self.literal(null=False)
                kinds = {self._kind(x) for x in (*out, item)}
                if len(kinds) > 1:
                    raise self.fail("the elements of an array have one type", t)
                out.append(item)
                if not self.accept(","):
                    self.expect("]")
                    break
            return out
        if word := self.accept("true", "false"):
            return Lit(word.text == "true")
        if null and self.accept("null"):
            return Lit(None)
        sign = -1 if self.accept("-") else 1
        if self.now.kind == "int":
            return Lit(sign * int(self.take().text))
        if self.now.kind == "float":
            return Lit(sign * float(self.take().text))
        raise self.fail(f"expected a value, found {self.now.text or 'the end'!r}")

    @staticmethod
    def _kind(item: object) -> type:
        return str if isinstance(item, Text) else type(item.value)

    def _faker(self) -> Statement:
        name = self.name()
        if self.accept("$"):
            return Faker(name, [Var(self.name())])
        self.expect("[")
        items: list = []
        while not self.accept("]"):
            if self.accept("..."):
                self.expect("$")
                items.append(Var(self.name()))
            else:
                items.append(self.text())
            if not self.accept(","):
                self.expect("]")
                break
        return Faker(name, items)

    def column(self) -> tuple[str, str]:
        table = self.name("a table")
        self.expect(".")
        return table, self.name("a column")

    def _relation(self, ignore: bool = False) -> Statement:
        child = self.column()
        self.expect("->")
        return Relation(child, self.column(), ignore)

    def _ignore_relation(self) -> Statement:
        return self._relation(True)

    def _anonymize(self) -> Statement:
        table, rules = self.name("a table"), []
        self.expect("{")
        while not self.accept("}"):
            column = self.name("a column")
            self.expect("->")
            rules.append((column, None if self.accept("null") else self.name("a pool or null")))
        return Anonymize(table, rules)

    def pattern(self) -> Pattern:
        if self.now.kind == "regex":
            return Pattern(self.take().text[1:-1], True)
        return Pattern(self.name("a table or /pattern/"))

    def patterns(self) -> list[Pattern]:
        out = [self.pattern()]
        while self.accept(","):
            out.append(self.pattern())
        return out

    def _exclude_data(self) -> Statement:
        return Tables("exclude_data", [self.pattern()])

    def _ignore_table(self) -> Statement:
        return Tables("ignore_table", [self.pattern()])

    def _full(self) -> Statement:
        return Tables("full", self.patterns())

    def query(self) -> Query:
        """Clauses in their fixed order, each at most once."""
        q = Query()
        if self.accept("where"):
            q.where = self.text()
        if self.accept("order"):
            self.expect("by")
            q.order = self.name("a column")
            if way := self.accept("asc", "desc"):
                q.descending = way.text == "desc"
        if self.accept("limit"):
            if self.accept("$"):
                q.limit = Var(self.variable())
            elif self.now.kind == "int":
                q.limit = int(self.take().text)
            else:
                raise self.fail("expected a number or $variable after limit")
        if self.accept("exclude"):
            q.exclude = self.patterns()
        q.root_only = self.accept("root_only") is not None
        self.expect("}")
        return q

    def _aggregate(self) -> Statement:
        name = self.name()
        self.expect("{")
        self.expect("root")
        return Aggregate(name, self.name("a table"), self.query())

    def _get(self) -> Statement:
        name, params = self.name(), []
        self.expect("(")
        while not self.accept(")"):
            params.append(self.declaration())
            if not self.accept(","):
                self.expect(")")
                break
        self.expect("{")
        return Get(name, params, self.name("an aggregate"), self.query())

    def _preserve(self) -> Statement:
        table = self.name("a table")
        self.expect("where")
        return Preserve(table, self.text())

    def assignment(self) -> tuple[str, object]:
        column = self.name("a column")
        self.expect("=")
        if self.accept("$"):
            return column, Var(self.variable())
        return column, self.literal(null=False)

    def _set(self) -> Statement:
        table, assign = self.name("a table"), []
        self.expect("{")
        self.expect("match")
        match = [self.assignment()]
        while self.accept(","):
            match.append(self.assignment())
        while not self.accept("}"):
            assign.append(self.assignment())
        return SetRow(table, match, assign)

    def _after(self) -> Statement:
        self.expect("{")
        out = []
        while not self.accept("}"):
            if self.now.kind == "multi":
                out.append(self.take().text[3:-3])
            else:
                out.append(self.raw("a SQL string"))
        return After(out)

    # strings

    def raw(self, what: str) -> str:
        if self.now.kind != "string":
            raise self.fail(f"expected {what} in quotes, found {self.now.text or 'the end'!r}")
        return self.take().text[1:-1]

    def text(self) -> Text:
        """A string with its escapes decoded and its interpolations parsed."""
        if self.now.kind != "string":
            raise self.fail(f"expected a string, found {self.now.text or 'the end'!r}")
        t = self.take()
        parts: list = []
        buffer: list[str] = []
        at, end = t.start + 1, t.end - 1
        while at < end:
            c = self.source[at]
            if c == "\\" and at + 1 < end:
                follow = self.source[at + 1]
                buffer.append(_ESCAPES.get(follow, c + follow))
                at += 2
            elif c == "{":
                found: list[Problem] = []
                sub = _Parser(self.source[:end], lex(self.source[:end], found, at + 1, True), found, True)
                hint = "did you mean {$name}?" if buffer and buffer[-1] == "$" else "write \\{ for a brace"
                try:
                    value = sub.expression()
                    close = sub.expect("}")
                except _Failed as e:
                    self.problems.append(Problem(f"bad interpolation: {e.problem.message}", at, hint))
                    return Text(tuple(parts))
                if buffer:
                    parts.append("".join(buffer))
                    buffer = []
                parts.append(value)
                at = close.end
            else:
                buffer.append(c)
                at += 1
        if buffer:
            parts.append("".join(buffer))
        return Text(tuple(parts))

    # expressions

    def variable(self) -> str:
        t = self.now
        if self.inner and t.kind in ("name", "word"):
            return self.take().text
        return self.name("a variable")

    def expression(self, level: int = 0) -> object:
        if level == len(_LEVELS):
            return self.unary()
        out = self.expression(level + 1)
        while op := self.accept(*_LEVELS[level]):
            out = Binary(op.text, out, self.expression(level + 1))
        return out

    def unary(self) -> object:
        if op := self.accept("!", "-"):
            return Unary(op.text, self.unary())
        return self.primary()

    def primary(self) -> object:
        if self.accept("("):
            out = self.expression()
            self.expect(")")
            return out
        if self.accept("$"):
            return Var(self.variable())
        if self.inner and self.now.kind == "name" and self.now.text == "unique":
            self.take()
            self.expect("(")
            self.expect(")")
            return Unique()
        t = self.now
        if t.kind == "string":
            return self.text()
        if t.kind in ("int", "float"):
            self.take()
            return Lit(int(t.text) if t.kind == "int" else float(t.text))
        if word := self.accept("true", "false"):
            return Lit(word.text == "true")
        raise self.fail(f"expected an expression, found {t.text or 'the end'!r}")
