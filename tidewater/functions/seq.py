"""Sequences held in arrays of structs: matching by row patterns, folds, sessions, funnels, drift and smoothing."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("longest", "shortest", "all", "overlap")


class PatternError(ValueError):
    pass


# --- patterns over rows: a small backtracking-free matcher on sets of automaton states ---------------------------


class Pattern:
    """Symbols in sequence, |, ( ), and the quantifiers ? * + {n} {n,} {n,m}, compiled to an epsilon automaton."""

    TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\{\s*\d+\s*(?:,\s*\d*\s*)?\})|([()|?*+]))")

    def __init__(self, text: str):
        self.toks, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m:
                raise PatternError(f"unexpected {text[at:][:10]!r} in pattern {text!r}")
            self.toks.append(m.group(1) or m.group(2) or m.group(3))
            at = m.end()
        self.text, self.at = text, 0
        self.steps: list[tuple[int, str, int]] = []
        self.free: list[tuple[int, int]] = []
        self.n = 0
        tree = self.choice()
        if self.at < len(self.toks):
            raise PatternError(f"unexpected {self.toks[self.at]!r} in pattern {text!r}")
        self.start, self.end = self.build(tree)
        self.closure = self.closures()

    def next(self) -> str | None:
        return self.toks[self.at] if self.at < len(self.toks) else None

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.next() == "|":
            self.at += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        parts = []
        while self.next() not in (None, "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self) -> tuple:
        tok = self.next()
        self.at += 1
        if tok == "(":
            item = self.choice()
            if self.next() != ")":
                raise PatternError(f"missing ) in pattern {self.text!r}")
            self.at += 1
        elif re.match(r"[A-Za-z_]", tok):
            item = ("sym", tok)
        else:
            raise PatternError(f"unexpected {tok!r} in pattern {self.text!r}")
        while (q := self.next()) and q[0] in "?*+{":
            self.at += 1
            if q[0] == "{":
                lo, comma, hi = q.strip("{} ").replace(" ", "").partition(",")
                low, high = int(lo), int(hi) if hi else None if comma else int(lo)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[q]
            if high is not None and high < low:
                raise PatternError(f"bad quantifier {q} in pattern {self.text!r}")
            item = ("rep", item, low, high)
        return item

    def state(self) -> int:
        self.n += 1
        return self.n - 1

    def build(self, t: tuple) -> tuple[int, int]:
        a, b = self.state(), self.state()
        if t[0] == "sym":
            self.steps.append((a, t[1], b))
        elif t[0] == "or":
            for x in t[1]:
                c, d = self.build(x)
                self.free += [(a, c), (d, b)]
        elif t[0] == "seq":
            at = a
            for x in t[1]:
                c, d = self.build(x)
                self.free.append((at, c))
                at = d
            self.free.append((at, b))
        else:
            _, x, low, high = t
            at = a
            for _ in range(low):
                c, d = self.build(x)
                self.free.append((at, c))
                at = d
            if high is None:
                c, d = self.build(x)
                self.free += [(at, c), (d, c), (at, b), (d, b)]
            else:
                for _ in range(high - low):
                    c, d = self.build(x)
                    self.free += [(at, c), (at, b)]
                    at = d
                self.free.append((at, b))
        return a, b

    def closures(self) -> list[list[int]]:
        out = []
        for s in range(self.n):
            seen, todo = {s}, [s]
            while todo:
                x = todo.pop()
                for a, b in self.free:
                    if a == x and b not in seen:
                        seen.add(b)
                        todo.append(b)
            out.append(sorted(seen))
        return out

    def ends(self, test: Callable[[str, int], bool], i: int, n: int) -> dict[int, list[str]]:
        """For each end (exclusive) of a match that starts at row i, the symbols of one such match."""
        states: dict[int, tuple] = {s: () for s in self.closure[self.start]}
        out: dict[int, list[str]] = {}
        moves: dict[int, list[tuple[str, int]]] = {}
        for a, sym, b in self.steps:
            moves.setdefault(a, []).append((sym, b))
        for j in range(i, n):
            new: dict[int, tuple] = {}
            for s, path in states.items():
                for sym, b in moves.get(s, ()):
                    if test(sym, j):
                        for x in self.closure[b]:
                            new.setdefault(x, (path, sym))
            if not new:
                break
            states = new
            if self.end in states:
                path, symbols = states[self.end], []
                while path:
                    path, sym = path
                    symbols.append(sym)
                out[j + 1] = symbols[::-1]
        return out

    def matches(self, test: Callable[[str, int], bool], n: int, mode: str = "longest") -> list[tuple[int, int, list[str]]]:
        """(first row, end, symbols); longest and shortest don't overlap, overlap gives the longest from each start."""
        out, i = [], 0
        while i < n:
            found = self.ends(test, i, n)
            if not found:
                i += 1
                continue
            if mode == "all":
                out += [(i, e, found[e]) for e in sorted(found)]
            else:
                e = min(found) if mode == "shortest" else max(found)
                out.append((i, e, found[e]))
            i = e if mode in ("longest", "shortest") else i + 1
        return out


PRED = re.compile(r"\s*(?:('(?:[^']|'')*')|(\d+\.?\d*)|(PREV)\b|(\$\w+)|(AND|OR|NOT|NULL|IS)\b|(<=|>=|<>|!=|==|[-+*/<>=(),]))", re.IGNORECASE)


class Predicate:
    """A condition on a row: $field, PREV($field[, n]), numbers, strings, arithmetic, comparisons, AND OR NOT, IS NULL.
    A comparison with null is false."""

    def __init__(self, text: str, names: list[str] | None):
        self.toks, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = PRED.match(text, at)
            if not m:
                raise PatternError(f"unexpected {text[at:][:10]!r} in {text!r}")
            kind = m.lastindex
            self.toks.append((kind, m.group(kind)))
            at = m.end()
        self.names, self.at, self.text = names, 0, text
        self.run = self.disjunction()
        if self.at < len(self.toks):
            raise PatternError(f"unexpected {self.toks[self.at][1]!r} in {text!r}")

    def take(self, *words: str) -> str | None:
        if self.at < len(self.toks) and self.toks[self.at][1].upper() in words and self.toks[self.at][0] >= 5:
            self.at += 1
            return self.toks[self.at - 1][1].upper()
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise PatternError(f"expected {word} in {self.text!r}")

    def disjunction(self):
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else lambda rows, i: any(p(rows, i) for p in parts)

    def conjunction(self):
        parts = [self.negation()]
        while self.take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else lambda rows, i: all(p(rows, i) for p in parts)

    def negation(self):
        if self.take("NOT"):
            inner = self.negation()
            return lambda rows, i: not inner(rows, i)
        return self.comparison()

    def comparison(self):
        left = self.sum()
        if self.take("IS"):
            no = bool(self.take("NOT"))
            self.need("NULL")
            return lambda rows, i: (left(rows, i) is None) != no
        op = self.take("<", "<=", ">", ">=", "=", "==", "!=", "<>")
        if not op:
            return lambda rows, i: bool(left(rows, i))
        right = self.sum()
        test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "==": lambda a, b: a == b}.get(op, lambda a, b: a != b)

        def run(rows, i):
            a, b = left(rows, i), right(rows, i)
            return a is not None and b is not None and test(a, b)

        return run

    def arithmetic(self, below, ops: dict):
        left = below()
        while op := self.take(*ops):
            a, b, f = left, below(), ops[op]
            left = lambda rows, i, a=a, b=b, f=f: None if (x := a(rows, i)) is None or (y := b(rows, i)) is None else f(x, y)
        return left

    def sum(self):
        return self.arithmetic(self.product, {"+": lambda x, y: x + y, "-": lambda x, y: x - y})

    def product(self):
        return self.arithmetic(self.atom, {"*": lambda x, y: x * y, "/": lambda x, y: x / y if y else None})

    def field(self, tok: str):
        name = tok[1:]
        if name.isdigit():
            at = int(name)
            return lambda row: list(row.values())[at] if isinstance(row, dict) else row
        if self.names is not None and name not in self.names:
            raise PatternError(f"unknown field {name!r} in {self.text!r}")
        return lambda row: row[name]

    def atom(self):
        if self.take("("):
            out = self.disjunction()
            self.need(")")
            return out
        if self.take("-"):
            inner = self.atom()
            return lambda rows, i: None if (x := inner(rows, i)) is None else -x
        if self.at >= len(self.toks):
            raise PatternError(f"incomplete condition {self.text!r}")
        kind, tok = self.toks[self.at]
        self.at += 1
        if kind == 1:
            text = tok[1:-1].replace("''", "'")
            return lambda rows, i: text
        if kind == 2:
            number = float(tok)
            return lambda rows, i: number
        if kind == 4:
            get = self.field(tok)
            return lambda rows, i: get(rows[i])
        if kind == 3:
            self.need("(")
            get = self.field(self.toks[self.at][1])
            self.at += 1
            back = 1
            if self.take(","):
                back = int(self.toks[self.at][1])
                self.at += 1
            self.need(")")
            return lambda rows, i: get(rows[i - back]) if i >= back else None
        raise PatternError(f"unexpected {tok!r} in {self.text!r}")


def matcher(pattern: str, define: dict[str, str], names: list[str] | None, mode: str = "longest") -> Callable[[list], list]:
    """rows -> [(first, end, symbols)], 0-based and end exclusive; symbols without a definition match any row."""
    if mode not in MODES:
        raise PatternError(f"mode must be one of {MODES}")
    automaton = Pattern(pattern)
    tests = {k: Predicate(v, names).run for k, v in define.items()}
    return lambda rows: automaton.matches(lambda sym, i: sym not in tests or tests[sym](rows, i), len(rows), mode)


def plain(rows) -> list:
    return [] if rows is None else [dict(r.asDict()) if hasattr(r, "asDict") else r for r in rows]


def seq_match(pattern: str, define: dict[str, str], names: list[str] | None, mode: str = "longest"):
    """A function of an array column: array<struct<matchNo, startIdx, endIdx>>, 1-based and inclusive."""
    run = matcher(pattern, define, names, mode)

    @F.pandas_udf("array<struct<matchNo:int,startIdx:int,endIdx:int>>")
    def udf(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: [{"matchNo": k + 1, "startIdx": a + 1, "endIdx": b} for k, (a, b, _) in enumerate(run(plain(r)))])

    return udf


def seq_match_steps(pattern: str, define: dict[str, str], names: list[str] | None, mode: str = "longest"):
    """One struct<matchNo, idx, symbol> for each matched element."""
    run = matcher(pattern, define, names, mode)

    @F.pandas_udf("array<struct<matchNo:int,idx:int,symbol:string>>")
    def udf(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: [{"matchNo": k + 1, "idx": a + j + 1, "symbol": s} for k, (a, _, symbols) in enumerate(run(plain(r))) for j, s in enumerate(symbols)])

    return udf


# --- folds and states over arrays, as higher-order functions ------------------------------------------------------


def seq_fold(rows: Column, start: Column | int, end: Column | int, field: str, op: str) -> Column:
    """sum, min, max, count or avg of a field over elements start to end, 1-based, inclusive and clamped."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    a, b = F.greatest(F.lit(1), start), F.least(F.size(rows), end)
    xs = F.filter(F.transform(F.slice(rows, a, F.greatest(F.lit(0), b - a + 1)), lambda r: r[field].cast("double") if field else r.cast("double")), lambda x: x.isNotNull())
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    some = F.size(xs) > 0
    ops = {"sum": F.when(some, total), "min": F.array_min(xs), "max": F.array_max(xs), "count": F.size(xs).cast("double"), "avg": F.when(some, total / F.size(xs))}
    if op not in ops:
        raise ValueError(f"unknown fold {op!r}")
    return ops[op]


def seq_split(rows: Column, field: str, gap: float) -> Column:
    """Sessions: a new one where the field or its predecessor is null, or they differ by more than the gap."""
    value = lambda i: F.get(rows, i)[field].cast("double")
    n = F.size(rows)
    breaks = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | ~F.coalesce(value(i) - value(i - 1) <= gap, F.lit(False)))
    return F.when(n > 0, F.transform(F.slice(breaks, 1, F.size(breaks) - 1), lambda b, k: F.slice(rows, b + 1, F.get(breaks, k + 1) - b))).otherwise(F.slice(F.array(rows), 1, 0))


def seq_funnel(rows: Column, time_field: str, window: float, steps: list[Callable[[Column], Column]]) -> Column:
    """The furthest step reached within the window from an anchor of the first step; the latest anchor of each step
    counts, rows without time are skipped."""
    n = len(steps)
    unset = F.lit(None).cast("double")
    zero = F.struct(F.array(*[unset] * n).alias("anchor"), F.lit(0).alias("best"))

    def step(acc: Column, row: Column) -> Column:
        ts = row[time_field].cast("double")
        anchors, best = [F.get(acc["anchor"], F.lit(k)) for k in range(n)], acc["best"]
        new = list(anchors)
        for k in range(n - 1, 0, -1):
            hit = F.coalesce(anchors[k - 1].isNotNull() & (ts - anchors[k - 1] <= window) & steps[k](row), F.lit(False))
            new[k] = F.when(hit, F.greatest(anchors[k], anchors[k - 1])).otherwise(anchors[k])
            best = F.when(hit, F.greatest(best, F.lit(k + 1))).otherwise(best)
        hit = F.coalesce(steps[0](row), F.lit(False))
        new[0] = F.when(hit, F.greatest(anchors[0], ts)).otherwise(anchors[0])
        best = F.when(hit, F.greatest(best, F.lit(1))).otherwise(best)
        out = F.struct(F.array(*new).alias("anchor"), best.alias("best"))
        return F.when(ts.isNull(), acc).otherwise(out)

    return F.aggregate(rows, zero, step, lambda acc: acc["best"])


def seq_retention(rows: Column, conditions: list[Callable[[Column], Column]]) -> Column:
    """The first condition is the anchor; the others hold only with it."""
    met = [F.exists(rows, _test(c)) for c in conditions]
    return F.array(met[0], *[met[0] & m for m in met[1:]])


def _test(c: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: F.coalesce(c(r), F.lit(False))


def _drift(values: Column, zero: Column, move: Callable, fired: Callable) -> Column:
    """1-based index of the first element after whose update `fired` holds, or 0; nulls only count."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), zero.alias("s"))

    def step(acc: Column, x: Column) -> Column:
        i, x = acc["i"] + 1, x.cast("double")
        s = F.when(x.isNull(), acc["s"]).otherwise(move(acc["s"], x))
        hit = (acc["at"] == 0) & x.isNotNull() & fired(s)
        return F.struct(i.alias("i"), F.when(hit, i).otherwise(acc["at"]).alias("at"), s.alias("s"))

    return F.aggregate(values, start, step, lambda acc: acc["at"])


def seq_page_hinkley(values: Column, delta: float, threshold: float) -> Column:
    names = ("n", "mean", "cum", "low", "high")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def move(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        cum = s["cum"] + x - mean - delta
        return F.struct(n.alias("n"), mean.alias("mean"), cum.alias("cum"), F.least(s["low"], cum).alias("low"), F.greatest(s["high"], cum).alias("high"))

    return _drift(values, zero, move, lambda s: (s["cum"] - s["low"] > threshold) | (s["high"] - s["cum"] > threshold))


def seq_cusum(values: Column, target: float, slack: float, threshold: float) -> Column:
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def move(s: Column, x: Column) -> Column:
        up, down = s["up"] + x - target - slack, s["down"] + target - x - slack
        return F.struct(F.greatest(F.lit(0.0), up).alias("up"), F.greatest(F.lit(0.0), down).alias("down"))

    return _drift(values, zero, move, lambda s: (s["up"] > threshold) | (s["down"] > threshold))


def seq_exp_smooth(values: Column, alpha: float) -> Column:
    xs = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull())
    return F.aggregate(xs, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))


def seq_holt(values: Column, alpha: float, beta: float, ahead: int) -> Column:
    xs = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull())
    none = F.lit(None).cast("double")
    zero = F.struct(F.lit(0).alias("n"), none.alias("l"), none.alias("t"))

    def step(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s["l"] + s["t"])
        trend = beta * (level - s["l"]) + (1 - beta) * s["t"]
        new_l = F.when(s["n"] <= 1, x).otherwise(level)
        new_t = F.when(s["n"] == 0, none).when(s["n"] == 1, x - s["l"]).otherwise(trend)
        return F.struct((s["n"] + 1).alias("n"), new_l.alias("l"), new_t.alias("t"))

    return F.aggregate(xs, zero, step, lambda s: s["l"] + ahead * F.coalesce(s["t"], F.lit(0.0)))
