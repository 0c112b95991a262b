"""Predicates: a JSON tree or SQL text compiled to one Boolean Column that is never null.

Null rules: a null value and a null literal are equal; a null value matches nothing else; a null literal matches by !=
only. NaN and infinities match no comparison. NOT is pushed to the leaves.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr

COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
NEGATED = {"=": "!=", "!=": "=", ">": "<=", ">=": "<", "<": ">=", "<=": ">", "in": "not in", "not in": "in", "match": "not match", "not match": "match"}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


class FilterError(ValueError):
    pass


def is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def literal(value: object, kind: str) -> Column:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return F.lit(value).cast(kind)
    if isinstance(value, bool) and kind != "boolean":
        value = str(value).lower()
    return F.expr(f"try_cast({sql_text(str(value))} as {kind})") if kind not in ("string",) else F.lit(str(value).lower() if isinstance(value, bool) else str(value))


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def surely(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def finite(c: Column, kind: str) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf")) if kind in ("float", "double") else F.lit(True)


class Compiler:
    def __init__(self, types: dict[str, str]):
        self.types = types

    def kind(self, key: str) -> str:
        if key not in self.types and key.split(".")[0] not in self.types:
            raise FilterError(f"unknown field {key!r}")
        return self.types.get(key, "string")

    def leaf(self, key: str, op: str, value: object) -> Column:
        c, kind = F.col(key), self.kind(key)
        op = {"==": "=", "<>": "!="}.get(op, op)
        if op in ("true", "false"):
            return c.isNotNull() if op == "true" else F.lit(False)
        if op in ("in", "not in"):
            hit = c.cast("string").isin([v if isinstance(v, str) else str(v) for v in value])
            return surely(hit if op == "in" else ~hit)
        if op in ("match", "not match"):
            hit = c.cast("string").rlike(str(value))
            return surely(hit if op == "match" else ~hit)
        if op not in COMPARE:
            raise FilterError(f"unknown op {op!r}")
        if value is None:
            return c.isNull() if op == "=" else c.isNotNull() if op == "!=" else F.lit(False)
        return surely(COMPARE[op](c, literal(value, kind)) & finite(c, kind))

    def between_fields(self, key: str, op: str, other: str) -> Column:
        op = {"==": "=", "<>": "!="}.get(op, op)
        if op not in COMPARE:
            raise FilterError(f"{op!r} can't compare two fields")
        a, b, ka, kb = F.col(key), F.col(other), self.kind(key), self.kind(other)
        if is_number(ka) and is_number(kb):
            ok = finite(a, ka) & finite(b, kb)
        elif ka == kb:
            ok = F.lit(True)
        else:
            a, b, ok = a.cast("string"), b.cast("string"), F.lit(True)
        both = a.isNull() & b.isNull() if op == "=" else F.lit(False)
        return both | surely(COMPARE[op](a, b) & ok)

    def tree(self, f: object) -> Column:
        if f is None or f is True:
            return F.lit(True)
        if f is False:
            return F.lit(False)
        if isinstance(f, str):
            return Sql(f, self).parse()
        if isinstance(f, list):
            return reduce(lambda a, b: a & b, map(self.tree, f)) if f else F.lit(False)
        if "and" in f or "or" in f:
            parts = [self.tree(x) for x in f.get("and", f.get("or"))]
            return reduce((lambda a, b: a & b) if "and" in f else (lambda a, b: a | b), parts) if parts else F.lit(False)
        op = f.get("op", "=")
        if "expression" in f:
            c = expr.compile_expression(f["expression"], self.types)
            return surely(COMPARE[{"==": "="}.get(op, op)](c, F.lit(float(f["value"]))) & finite(c, "double"))
        if "valueKey" in f:
            return self.between_fields(f["key"], op, f["valueKey"])
        return self.leaf(f["key"], op, f.get("value"))


WORDS = re.compile(r"\s*(?:('(?:[^']|'')*')|(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_`][\w.`]*)|(<=|>=|<>|!=|[-+*/%=<>(),]))")


class Sql:
    """SQL text; operands are fields, literals and arithmetic."""

    def __init__(self, text: str, compiler: Compiler):
        self.text, self.c, self.toks, self.at = text, compiler, [], 0
        at, text = 0, text.rstrip()
        while at < len(text):
            m = WORDS.match(text, at)
            if not m:
                raise FilterError(f"unexpected {text[at:][:10]!r} in {text!r}")
            s, n, w, o = m.groups()
            self.toks.append(("str", s[1:-1].replace("''", "'")) if s is not None else ("num", n) if n else ("word", w.replace("`", "")) if w else ("op", o))
            at = m.end()

    def word(self, *words: str) -> str | None:
        if self.at < len(self.toks) and self.toks[self.at][0] in ("word", "op") and self.toks[self.at][1].upper() in words:
            self.at += 1
            return self.toks[self.at - 1][1].upper()
        return None

    def need(self, word: str) -> None:
        if not self.word(word):
            raise FilterError(f"expected {word} in {self.text!r}")

    def parse(self) -> Column:
        out = self.disjunction(False)
        if self.at < len(self.toks):
            raise FilterError(f"unexpected {self.toks[self.at][1]!r} in {self.text!r}")
        return out

    def disjunction(self, negate: bool) -> Column:
        out = self.conjunction(negate)
        while self.word("OR"):
            right = self.conjunction(negate)
            out = out & right if negate else out | right
        return out

    def conjunction(self, negate: bool) -> Column:
        out = self.negation(negate)
        while self.word("AND"):
            right = self.negation(negate)
            out = out | right if negate else out & right
        return out

    def negation(self, negate: bool) -> Column:
        if self.word("NOT"):
            return self.negation(not negate)
        start = self.at
        if self.word("("):
            try:
                out = self.disjunction(negate)
                self.need(")")
                if self.at >= len(self.toks) or self.toks[self.at][0] == "word" and self.toks[self.at][1].upper() in ("AND", "OR") or self.toks[self.at][1] == ")":
                    return out
            except FilterError:
                pass
            self.at = start
        return self.predicate(negate)

    def predicate(self, negate: bool) -> Column:
        left = self.operand()
        if op := self.word("=", "!=", "<>", "<", "<=", ">", ">="):
            op = "!=" if op == "<>" else op
            return self.compare(left, NEGATED[op] if negate else op, self.operand())
        if self.word("IS"):
            no = bool(self.word("NOT"))
            what = self.word("NULL", "TRUE", "FALSE")
            c = self.column(left)
            if what == "NULL":
                return c.isNotNull() if no != negate else c.isNull()
            if what is None or negate:
                raise FilterError(f"unsupported IS in {self.text!r}")
            hit = surely(c == F.lit(what == "TRUE"))
            return ~hit if no else hit
        no = bool(self.word("NOT")) != negate
        if self.word("IN"):
            self.need("(")
            items = [self.operand()]
            while self.word(","):
                items.append(self.operand())
            self.need(")")
            c = self.column(left)
            hits = [c.cast("string") == self.column(x).cast("string") for x in items]
            hit = reduce(lambda a, b: a | b, [surely(h) for h in hits])
            return c.isNotNull() & (~hit if no else hit)
        if self.word("LIKE"):
            pattern = self.operand()
            if pattern[0] != "lit" or self.word("ESCAPE"):
                raise FilterError(f"unsupported LIKE in {self.text!r}")
            regex = "^" + "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern[1]) + "$"
            hit = self.column(left).cast("string").rlike(regex)
            return surely(~hit if no else hit)
        if self.word("BETWEEN"):
            lo = self.operand()
            self.need("AND")
            hi = self.operand()
            if no:
                return self.compare(left, "<", lo) | self.compare(left, ">", hi)
            return self.compare(left, ">=", lo) & self.compare(left, "<=", hi)
        if left[0] == "field" and self.c.kind(left[1]) == "boolean":
            return surely(~F.col(left[1]) if negate else F.col(left[1]))
        raise FilterError(f"incomplete predicate in {self.text!r}")

    def compare(self, left: tuple, op: str, right: tuple) -> Column:
        if left[0] == right[0] == "lit":
            raise FilterError(f"a comparison of constants in {self.text!r}")
        if left[0] == "lit":
            return self.compare(right, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), left)
        if left[0] == "field" and right[0] == "lit":
            return self.c.leaf(left[1], op, right[1])
        if left[0] == right[0] == "field":
            return self.c.between_fields(left[1], op, right[1])
        a, b = self.column(left).cast("double"), self.column(right).cast("double")
        return surely(COMPARE[op](a, b) & finite(a, "double") & finite(b, "double"))

    def column(self, x: tuple) -> Column:
        return F.lit(x[1]) if x[0] == "lit" else F.col(x[1]) if x[0] == "field" else x[1]

    def operand(self) -> tuple:
        left = self.term()
        while op := self.word("+", "-"):
            a, b = self.column(left).cast("double"), self.column(self.term()).cast("double")
            left = ("col", a + b if op == "+" else a - b)
        return left

    def term(self) -> tuple:
        left = self.factor()
        while op := self.word("*", "/", "%"):
            left = ("col", expr.OPERATORS[op](self.column(left).cast("double"), self.column(self.factor()).cast("double")))
        return left

    def factor(self) -> tuple:
        if self.word("-"):
            x = self.factor()
            return ("lit", -x[1]) if x[0] == "lit" else ("col", -self.column(x).cast("double"))
        if self.word("("):
            out = self.operand()
            self.need(")")
            return out
        if self.at >= len(self.toks):
            raise FilterError(f"incomplete filter {self.text!r}")
        kind, v = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return ("lit", float(v) if re.search(r"[.eE]", v) else int(v))
        if kind == "str":
            return ("lit", v)
        if kind == "word":
            if v.upper() in ("TRUE", "FALSE", "NULL"):
                return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[v.upper()])
            self.c.kind(v)
            return ("field", v)
        raise FilterError(f"unexpected {v!r} in {self.text!r}")


def compile_filter(f: object, types: dict[str, str]) -> Column:
    return Compiler(types).tree(f)
