"""The numeric expression language: a text compiled to one Column of doubles.

Comparisons and logic give 1 or 0; a null or missing value makes the result null, and so does NaN. `f[n]` is the value
of f n rows before, in the window that the caller gives.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][\w.]*)|(&&|\|\||<<|>>|<=|>=|==|!=|<>|[-+*/%^&|~!<>=?:(),\[\]]))")
#: Binary operators by falling looseness.
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "=", "!=", "<>"), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
CONSTANTS = {"pi": math.pi, "PI": math.pi, "e": math.e, "E": math.e}

Node = tuple


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
        out.append(next((k, v) for k, v in zip(("num", "name", "op"), m.groups(), strict=True) if v is not None))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at = text, tokens(text), 0

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) and self.toks[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops:
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ExpressionError(f"expected {op!r} in {self.text!r}")

    def parse(self) -> Node:
        out = self.ternary()
        if self.at < len(self.toks):
            raise ExpressionError(f"unexpected {self.toks[self.at][1]!r} in {self.text!r}")
        return out

    def ternary(self) -> Node:
        cond = self.binary(0)
        if self.take("?"):
            yes = self.ternary()
            self.need(":")
            return ("call", "if", [cond, yes, self.ternary()])
        return cond

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*LEVELS[level]):
            left = ("op", op, left, self.binary(level + 1))
        return left

    def unary(self) -> Node:
        if op := self.take("-", "+", "!", "~"):
            return ("unary", op, self.unary())
        return self.atom()

    def atom(self) -> Node:
        if self.take("("):
            out = self.ternary()
            self.need(")")
            return out
        if self.at >= len(self.toks) or self.toks[self.at][0] == "op":
            raise ExpressionError(f"incomplete expression {self.text!r}")
        kind, value = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return ("num", float(value))
        if self.take("("):
            args = []
            if not self.take(")"):
                args.append(self.ternary())
                while self.take(","):
                    args.append(self.ternary())
                self.need(")")
            return ("call", value, args)
        if self.take("["):
            n = self.atom()
            self.need("]")
            if n[0] != "num":
                raise ExpressionError(f"a lag must be a number in {self.text!r}")
            return ("field", value, int(n[1]))
        if value in CONSTANTS:
            return ("num", CONSTANTS[value])
        return ("field", value, 0)


def truth(c: Column) -> Column:
    return c != 0


def number(c: Column) -> Column:
    return c.cast("double")


def whole(c: Column) -> Column:
    return c.cast("bigint")


def switch(args: list[Column]) -> Column:
    """switchN(c1, v1, c2, v2, ...): the value of the first true condition; 0 without one, or a last odd argument."""
    out = args[-1] if len(args) % 2 else F.lit(0.0)
    for i in range(len(args) // 2 * 2 - 2, -1, -2):
        out = F.when(truth(args[i]), args[i + 1]).otherwise(out)
    return out


def _micros_per(unit: float) -> Callable[..., Column]:
    return lambda a, b: F.floor((a - b) / F.lit(unit)).cast("double")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{n: getattr(F, n) for n in ("abs", "ceil", "floor", "sqrt", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "cbrt", "signum", "log10", "log2")},
    "ln": F.log, "log": F.log, "logn": lambda x, b: F.log(x) / F.log(b), "pow": F.pow, "atan2": F.atan2, "min": F.least, "max": F.greatest,
    "if": lambda c, a, b: F.when(truth(c), a).otherwise(b),
    **{f"switch{n}": lambda *a: switch(list(a)) for n in range(3, 9)},
    "timestamp_to_date": lambda us, tz=None: F.floor((us + (tz if tz is not None else F.lit(0.0)) * 3.6e9) / 86_400e6),
    **{f"timestamp_diff_{k}": _micros_per(v) for k, v in (("millisecond", 1e3), ("second", 1e6), ("minute", 60e6), ("hour", 3.6e9), ("day", 86.4e9))},
}

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b == 0, F.when(a == 0, float("nan")).otherwise(F.signum(a) * float("inf"))).otherwise(F.try_divide(a, b)),
    "%": lambda a, b: F.when(b == 0, float("nan")).otherwise(F.try_mod(a, b)),
    "==": lambda a, b: number(a == b), "=": lambda a, b: number(a == b), "!=": lambda a, b: number(a != b), "<>": lambda a, b: number(a != b),
    "<": lambda a, b: number(a < b), "<=": lambda a, b: number(a <= b), ">": lambda a, b: number(a > b), ">=": lambda a, b: number(a >= b),
    "&&": lambda a, b: number(truth(a) & truth(b)), "||": lambda a, b: number(truth(a) | truth(b)),
    "&": lambda a, b: number(whole(a).bitwiseAND(whole(b))), "|": lambda a, b: number(whole(a).bitwiseOR(whole(b))), "^": lambda a, b: number(whole(a).bitwiseXOR(whole(b))),
    "<<": lambda a, b: number(F.call_function("shiftleft", whole(a), b.cast("int"))), ">>": lambda a, b: number(F.call_function("shiftright", whole(a), b.cast("int"))),
}


def fields(node: Node) -> set[str]:
    """The variables of an expression."""
    if node[0] == "field":
        return {node[1]}
    return set().union(*(fields(x) for x in (node[2] if node[0] == "call" else node[2:]) if isinstance(x, tuple)), set())


def compile_node(node: Node, variable: Callable[[str, int], Column]) -> Column:
    kind = node[0]
    if kind == "num":
        return F.lit(node[1])
    if kind == "field":
        return variable(node[1], node[2])
    if kind == "unary":
        c = compile_node(node[2], variable)
        return {"-": lambda: -c, "+": lambda: c, "!": lambda: number(~truth(c)), "~": lambda: number(F.bitwise_not(whole(c)))}[node[1]]()
    if kind == "op":
        return OPERATORS[node[1]](compile_node(node[2], variable), compile_node(node[3], variable))
    if node[1] not in FUNCTIONS:
        raise ExpressionError(f"unknown function {node[1]!r}")
    return number(FUNCTIONS[node[1]](*(compile_node(x, variable) for x in node[2])))


def as_double(field: str, kind: str | None) -> Column:
    """A field as the language sees it: booleans are 1 and 0, timestamps microseconds, dates days since 1970."""
    c = F.col(field)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return F.expr(f"try_cast(`{field.replace('.', '`.`')}` as double)") if kind == "string" else number(c)


def compile_expression(text: str, types: dict[str, str], lag: Callable[[Column, int], Column] | None = None) -> Column:
    """types: the fields' simple type names; unknown variables are an error."""
    node = Parser(text).parse()
    if unknown := sorted(f for f in fields(node) if f.split(".")[0] not in types):
        raise ExpressionError(f"unknown variables {unknown} in {text!r}")

    def variable(name: str, n: int) -> Column:
        c = as_double(name, types.get(name))
        if n and lag is None:
            raise ExpressionError(f"{name}[{n}] needs an ordered select")
        return lag(c, n) if n else c

    out = compile_node(node, variable)
    return F.when(~F.isnan(out), out)
