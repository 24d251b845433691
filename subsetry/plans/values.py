"""Values of the configuration language and its operators."""

from __future__ import annotations

import math
from decimal import Decimal

from ..lang.syntax import Binary, Lit, Text, Unary, Unique, Var
from .plan import PlanError

#: Stands in pool values for the counter of a written cell.
UNIQUE = "{unique()}"
_LIMIT = 1 << 63


def as_text(value: object) -> str:
    """The text that an interpolation puts in: floats without exponent or needless fraction."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if not math.isfinite(value):
            return {"inf": "inf", "-inf": "-inf"}.get(str(value), "NaN")
        out = format(Decimal(repr(value)), "f")
        return out.rstrip("0").rstrip(".") if "." in out else out
    if isinstance(value, list):
        return "[" + ", ".join(map(as_text, value)) + "]"
    return str(value)


def _number(value: object, op: str) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise PlanError(f"{op} needs numbers, not {as_text(value)!r}")


def _whole(value: int) -> int:
    if not -_LIMIT <= value < _LIMIT:
        raise PlanError("integer overflow")
    return value


def _arithmetic(op: str, a: object, b: object) -> object:
    _number(a, op)
    _number(b, op)
    if isinstance(a, int) and isinstance(b, int):
        if op in "/%":
            if b == 0:
                raise PlanError("division by zero")
            quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return _whole(quotient if op == "/" else a - b * quotient)
        return _whole({"+": a + b, "-": a - b, "*": a * b}[op])
    x, y = float(a), float(b)
    if op in "/%" and y == 0:
        return math.nan if op == "%" or x == 0 or math.isnan(x) else math.copysign(math.inf, x) * math.copysign(1, y)
    return {"+": x + y, "-": x - y, "*": x * y}[op] if op in "+-*" else x / y if op == "/" else math.fmod(x, y)


def truth(value: object) -> bool:
    """Null is false; values other than booleans are an error."""
    if value is None:
        return False
    if isinstance(value, bool):
        return value
    raise PlanError(f"a condition must be a bool, not {as_text(value)!r}")


def same(a: object, b: object) -> bool:
    """Equal in type and value: 1 and 1.0 differ."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def evaluate(e: object, names: dict[str, object], unique: bool = False) -> object:
    """The value of an expression; && and || evaluate both sides."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Var):
        if e.name not in names:
            raise PlanError(f"undefined variable ${e.name}")
        return names[e.name]
    if isinstance(e, Text):
        return interpolate(e, names, unique)
    if isinstance(e, list):
        return [evaluate(x, names, unique) for x in e]
    if isinstance(e, Unique):
        raise PlanError("unique() is for the values of a faker pool, alone in its braces")
    if isinstance(e, Unary):
        value = evaluate(e.of, names)
        if e.op == "!":
            return not truth(value)
        _number(value, "-")
        return _whole(-value) if isinstance(value, int) else -value
    assert isinstance(e, Binary)
    a, b = evaluate(e.left, names), evaluate(e.right, names)
    if e.op == "==":
        return same(a, b)
    if e.op == "!=":
        return not same(a, b)
    if e.op in ("&&", "||"):
        x, y = truth(a), truth(b)
        return x and y if e.op == "&&" else x or y
    if e.op in ("<", ">", "<=", ">="):
        _number(a, e.op)
        _number(b, e.op)
        x, y = float(a), float(b)
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op]
    return _arithmetic(e.op, a, b)


def interpolate(t: Text, names: dict[str, object], unique: bool = False) -> str:
    out = []
    for p in t.parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, Unique) and unique:
            out.append(UNIQUE)
        else:
            out.append(as_text(evaluate(p, names)))
    return "".join(out)


_YES, _NO = ("true", "1", "yes"), ("false", "0", "no")


def coerce(value: object, kind: str) -> object:
    """A text from the command line as the declared type; other values as they are."""
    if not isinstance(value, str) or kind == "string":
        return value
    try:
        if kind == "int":
            return _whole(int(value))
        if kind == "float":
            return float(value)
    except ValueError:
        raise PlanError(f"cannot read {value!r} as {kind}") from None
    if kind == "bool":
        if value.lower() in _YES + _NO:
            return value.lower() in _YES
        raise PlanError(f"cannot read {value!r} as bool")
    return value


_KINDS = {"string": str, "int": int, "float": float, "bool": bool}


def checked(value: object, kind: str, name: str) -> object:
    """value, if it is of the kind (null is of any; an int widens to a float), or PlanError."""
    if value is None:
        return None
    if kind.endswith("[]"):
        if isinstance(value, list):
            return [checked(x, kind[:-2], name) for x in value]
    elif type(value) is _KINDS[kind]:
        return value
    elif kind == "float" and type(value) is int:
        return float(value)
    raise PlanError(f"${name} is declared {kind}, but is {as_text(value)!r}")
