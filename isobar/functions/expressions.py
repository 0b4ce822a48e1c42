"""Infix expressions as Columns.

The grammar is that of a shunting-yard parser whose precedence is: `!` and `**` above `* / %` above `+ -`
above all of `&& || == != < <= > >=` (one level) above the ternary `c ? a b` (no colon); all are
left-associative. Spark SQL would read the same strings differently, so they are parsed here. Numbers
take a type suffix (d f L l i s c, optionally with u); without one they are floats. Comparisons and
logical operators give 1 or 0 in the type of their operands; any non-zero number is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = [(500, ["!", "**"]), (400, ["*", "/", "%"]), (300, ["+", "-"]), (200, ["&&", "||", "==", "!=", "<", "<=", ">", ">="]), (100, ["?"])]
PRECEDENCE = {op: level for level, ops in LEVELS for op in ops}
ARITY = {"!": 1, "?": 3}
SUFFIX = {"d": "double", "f": "float", "L": "bigint", "l": "bigint", "i": "int", "s": "smallint", "c": "tinyint", "uL": "decimal(20,0)", "ul": "decimal(20,0)", "ui": "bigint", "us": "int", "uc": "smallint"}
#: The lattice of numeric types, widest first.
WIDTH = ["double", "float", "decimal(20,0)", "bigint", "int", "smallint", "tinyint"]
FLOATS = {"double", "float"}

TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?P<suffix>u?[dfLlisc])?(?![\w.])
    |(?P<op>\*\*|&&|\|\||==|!=|<=|>=|[-+*/%<>!?~()])
    |`(?P<quoted>[^`]+)`|"(?P<string>[^"]+)"
    |(?P<name>\w[\w.]*))""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # num, name, op
    text: str
    type: str = ""


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m["num"]:
            out.append(Token("num", m["num"], SUFFIX[m["suffix"]] if m["suffix"] else "float"))
        elif m["op"]:
            before = out[-1] if out else None
            unary = before is None or before.kind == "op" and before.text != ")"
            if m["op"] in "+-" and unary:
                nxt = TOKEN.match(text, at)
                if nxt and nxt["num"]:  # a sign belongs to its number
                    at = nxt.end()
                    out.append(Token("num", m["op"] + nxt["num"], SUFFIX[nxt["suffix"]] if nxt["suffix"] else "float"))
                    continue
                raise ExpressionError(f"sign without a number at {text[m.start() :]!r}")
            if m["op"] == "~":
                raise ExpressionError("operator ~ has no meaning")
            out.append(Token("op", m["op"]))
        else:
            out.append(Token("name", m["quoted"] or m["string"] or m["name"]))
    return out


def postfix(text: str) -> list[Token]:
    """The expression in postfix order."""
    out: list[Token] = []
    stack: list[Token] = []
    for t in tokens(text):
        if t.kind != "op":
            out.append(t)
        elif t.text == "(":
            stack.append(t)
        elif t.text == ")":
            while stack and stack[-1].text != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError("unbalanced )")
            stack.pop()
        else:
            while t.text != "!" and stack and stack[-1].text != "(" and PRECEDENCE[stack[-1].text] >= PRECEDENCE[t.text]:
                out.append(stack.pop())
            stack.append(t)
    while stack:
        if stack[-1].text == "(":
            raise ExpressionError("unbalanced (")
        out.append(stack.pop())
    depth = 0
    for t in out:
        depth += 1 - (ARITY.get(t.text, 2) if t.kind == "op" else 0)
        if depth < 1:
            raise ExpressionError(f"missing operand of {t.text}")
    if depth != 1:
        raise ExpressionError(f"{depth} values left")
    return out


def variables(text: str) -> list[str]:
    """The columns that an expression reads, in order of first use."""
    return list(dict.fromkeys(t.text for t in postfix(text) if t.kind == "name"))


def _wider(a: str, b: str) -> str:
    return min(a, b, key=WIDTH.index)


def _named(kind: T.DataType) -> str:
    name = kind.simpleString()
    if isinstance(kind, T.DecimalType):
        return "decimal(20,0)" if kind.scale == 0 else "double"
    return {"boolean": "tinyint"}.get(name, name)


def to_column(text: str, schema: T.StructType) -> tuple[Column, str]:
    """The expression as a Column over a schema, and its type.

    Floating division by zero gives an infinity or NaN, integer division truncates and is null by zero, and null
    operands give null.
    """
    kinds = {f.name: _named(f.dataType) for f in schema.fields}
    stack: list[tuple[Column, str]] = []
    for t in postfix(text):
        if t.kind == "num":
            stack.append((F.lit(t.text).cast(t.type), t.type))
        elif t.kind == "name":
            if t.text not in kinds:
                raise ExpressionError(f"no column {t.text}")
            if kinds[t.text] not in WIDTH:
                raise ExpressionError(f"column {t.text} is not numeric")
            stack.append((F.col(f"`{t.text}`").cast(kinds[t.text]), kinds[t.text]))
        elif t.text == "!":
            c, k = stack.pop()
            stack.append(((c == 0).cast(k), k))
        elif t.text == "?":
            (b, kb), (a, ka), (c, _) = stack.pop(), stack.pop(), stack.pop()
            k = _wider(ka, kb)
            stack.append((F.when(c != 0, a.cast(k)).when(c == 0, b.cast(k)), k))
        else:
            (b, kb), (a, ka) = stack.pop(), stack.pop()
            k = _wider(ka, kb)
            stack.append((_binary(t.text, a.cast(k), b.cast(k), k).cast(k), k))
    return stack.pop()


def _binary(op: str, a: Column, b: Column, k: str) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        if k in FLOATS:  # IEEE: x / 0 is an infinity of x's sign, 0 / 0 and NaN / 0 are NaN
            by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
            return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(F.try_divide(a, b))
        return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b))
    if op == "%":
        if k in FLOATS:
            raise ExpressionError("% takes integers")
        return F.try_mod(a, b)
    if op == "**":
        return F.pow(a, b)
    if op == "&&":
        return ((a != 0) & (b != 0)).cast("int")
    if op == "||":
        return ((a != 0) | (b != 0)).cast("int")
    compare = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    return compare[op].cast("int")


def truth(df: DataFrame, text: str) -> Column:
    """The expression as a condition; null where an operand is null."""
    return to_column(text, df.schema)[0] != 0
