"""Boolean trigram queries from regular expressions: which trigrams must any match hold?

A query is True (no trigram is mandatory) or ("and" | "or", parts) over trigrams, all in lower case: the index is
built over folded texts, so an expression's case doesn't matter and a query can only become weaker, never wrong.

The expressions are Java's, as far as rules use them: literals, escapes, classes without set operations, groups, look
around, alternatives and greedy, lazy or possessive repeats; anything else raises ValueError.
"""

from __future__ import annotations

import itertools

Query = bool | str | tuple
#: Sets of exact strings (products of classes and alternatives) up to this size are followed; beyond, what is known so
#: far becomes a condition and a new set begins.
MOST_EXACT = 24
#: A condition that would make a query have more alternatives is left out, which makes the query weaker.
MOST_CLAUSES = 256
_SPACES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "e": "\x1b"}
_OPEN, _EMPTY = "dDwWsShHvVRX", "bBAzZG"
Found = tuple[set[str] | None, Query]


def both(a: Query, b: Query) -> Query:
    parts = list(dict.fromkeys(x for q in (a, b) if q is not True for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(queries: list[Query]) -> Query:
    if not queries or any(q is True for q in queries):
        return True
    parts = list(dict.fromkeys(x for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else (q,))))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_string(s: str) -> Query:
    """Trigrams that cover the string: one at each third character, and the last one."""
    out: Query = True
    for i in [*range(0, len(s) - 2, 3), len(s) - 3] if len(s) >= 3 else []:
        out = both(out, s[i : i + 3])
    return out


def of_strings(strings: set[str]) -> Query:
    """One of the strings; those that hold another one say no more than it does."""
    return either([of_string(s) for s in sorted(strings) if not any(o != s and o in s for o in strings)])


class Reader:
    """Reads an expression; each part gives its exact strings, or None, and a query that holds for any match of it."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def next(self, some: str) -> bool:
        """Steps over some, if it is there."""
        if self.pattern.startswith(some, self.at):
            self.at += len(some)
            return True
        return False

    def take(self) -> str:
        if self.at >= len(self.pattern):
            raise ValueError(f"the expression ends too early: {self.pattern}")
        self.at += 1
        return self.pattern[self.at - 1]

    def alternatives(self) -> Found:
        parts = [self.sequence()]
        while self.next("|"):
            parts.append(self.sequence())
        if all(s is not None for s, _ in parts) and len(joined := set().union(*(s for s, _ in parts))) <= MOST_EXACT:
            return joined, of_strings(joined)
        return None, either([q if s is None else of_strings(s) for s, q in parts])

    def sequence(self) -> Found:
        whole, query, run = True, True, {""}
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            strings, own = self.repeated(self.atom())
            if strings is not None and len(run) * len(strings) <= MOST_EXACT:
                run = {a + b for a, b in itertools.product(run, strings)}
                continue
            query = both(query, of_strings(run))
            whole, run = False, {""}
            if strings is not None and len(strings) <= MOST_EXACT:
                run = strings
            else:
                query = both(query, own if strings is None else of_strings(strings))
        return (run, of_strings(run)) if whole else (None, both(query, of_strings(run)))

    def repeated(self, found: Found) -> Found:
        strings, query = found
        if self.next("*"):
            low, high = 0, None
        elif self.next("+"):
            low, high = 1, None
        elif self.next("?"):
            low, high = 0, 1
        elif self.next("{"):
            end = self.pattern.index("}", self.at)
            least, comma, most = self.pattern[self.at : end].partition(",")
            self.at = end + 1
            low, high = int(least), int(most) if most else None if comma else int(least)
        else:
            return found
        if not self.next("+"):
            self.next("?")
        if low == 0:
            return (strings | {""}, True) if strings is not None and high == 1 else (None, True)
        if strings is not None and low == high and len(strings) == 1 and len(next(iter(strings))) * low <= 64:
            return {next(iter(strings)) * low}, True
        return None, of_strings(strings) if strings is not None else query

    def atom(self) -> Found:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.members(), True
        if c == "\\":
            one = self.escape()
            return ({one.lower()} if one else {""} if one == "" else None), True
        if c == ".":
            return None, True
        if c in "^$":
            return {""}, True
        if c in "*+?{":
            raise ValueError(f"nothing to repeat: {self.pattern}")
        return {c.lower()}, True

    def group(self) -> Found:
        around = False
        if self.next("?"):
            if any(self.next(x) for x in ("<=", "<!", "=", "!")):
                around = True
            elif self.next("<"):
                self.at = self.pattern.index(">", self.at) + 1
            elif not self.next(">"):
                flags = self.pattern[self.at : self.pattern.index(":", self.at)]
                if flags.strip("imsu-"):
                    raise ValueError(f"unknown group (?{flags}: in {self.pattern}")
                self.at += len(flags) + 1
        found = self.alternatives()
        if not self.next(")"):
            raise ValueError(f"a group isn't closed: {self.pattern}")
        return ({""}, True) if around else found

    def escape(self) -> str | None:
        """The character, None for a class of characters, nothing for a place."""
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        if c in _OPEN:
            return None
        if c in _EMPTY:
            return ""
        if c in _SPACES:
            return _SPACES[c]
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c} in {self.pattern}")
        return c

    def members(self) -> set[str] | None:
        """The characters of a class, or None if there are too many."""
        out: set[str] | None = set()
        negated, first = self.next("^"), True
        while first or self.pattern[self.at] != "]":
            first = False
            c = self.take()
            if c == "[" or c == "&" and self.next("&"):
                raise ValueError(f"set operations aren't read: {self.pattern}")
            low = self.escape() if c == "\\" else c
            high = low
            if low and self.pattern[self.at] == "-" and self.pattern[self.at + 1] != "]":
                self.at += 1
                high = self.escape() if self.next("\\") else self.take()
            if low is None or high is None:
                out = None
            elif out is not None:
                out |= {chr(x).lower() for x in range(ord(low), ord(high) + 1)} if ord(high) - ord(low) < 256 else set()
                out = None if ord(high) - ord(low) >= 256 else out
        self.at += 1
        return None if negated or out is None or len(out) > MOST_EXACT else out


def query(pattern: str) -> Query:
    """The trigram query of a regular expression; True if no trigram is mandatory."""
    reader = Reader(pattern)
    strings, out = reader.alternatives()
    if reader.at < len(pattern):
        raise ValueError(f"a group is closed that isn't open: {pattern}")
    return reduced(of_strings(strings) if strings is not None else out)


def clauses(q: Query) -> list[list[str]]:
    """The query as alternatives, each a list of trigrams that must all be there, none implied by another."""
    if isinstance(q, str):
        return [[q]]
    if q[0] == "or":
        out = [c for x in q[1] for c in clauses(x)]
    else:
        out = [[]]
        for own in sorted((clauses(x) for x in q[1]), key=len):
            if len(out) * len(own) <= MOST_CLAUSES:
                out = [list(dict.fromkeys([*a, *b])) for a in out for b in own]
    out.sort(key=len)
    kept: list[list[str]] = []
    for c in out:
        if not any(set(k) <= set(c) for k in kept):
            kept.append(c)
    return kept


def reduced(q: Query) -> Query:
    """The query in the form of its alternatives."""
    return True if q is True else either([c[0] if len(c) == 1 else ("and", tuple(c)) for c in clauses(q)])


def trigrams(q: Query) -> list[str]:
    return [] if q is True else [q] if isinstance(q, str) else list(dict.fromkeys(t for x in q[1] for t in trigrams(x)))
