"""Plain versions of the operators' contracts."""

import itertools
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", s))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text, rules):
    out = []
    for k, (kind, pattern, test) in enumerate(rules):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if test(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def n_digits(s):
    return len(re.sub("[^0-9]", "", s))


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group(0).split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= n_digits(m.group(0)) <= 19 and luhn(m.group(0))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m.group(0)) <= 15),
]
SECRETS = [
    ("assign", r"(?:(?i:password|passwd|token|api_?key)|[sS][eE][cC][rR][eE][tT])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(1)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group(0)) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group(0)) >= 24),
]


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_classes(docs, threshold=0.8):
    """docs: (id, text) with distinct ids -> {id: (class id, links)}."""
    sets = {d: shingles(t) for d, t in docs}
    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    common = Counter(p for ds in having.values() for p in itertools.combinations(sorted(ds), 2))
    parent, links = {d: d for d in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (root(d), links[d]) for d in sets}


TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*")
GROUPS = re.compile(r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][-._/@])\(?[0-9]++(?![A-Za-z])(?:[\x20()-]{1,3}+[0-9]++(?![A-Za-z]))++")
BLANK = "\x20\t\n\x0b\x0c\r"


def masked(s):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "9", s.lower()))


def contexts(text, start, end):
    left = [(m.start(), m.group()) for m in WORDS.finditer(text[:start])]
    right = re.match(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", text[end:])
    if len(left) < 2:
        return []
    out = [masked(text[left[-2][0] : start].rstrip(BLANK)) + " _"]
    return out + [masked(left[-1][1]) + " _ " + masked(right.group(1))] if right else out


def discovered(docs, support=4, confidence=0.8, certainty=0.8):
    """docs: texts -> for each the spans (start, kind, end) that bootstrapping adds to the base spans."""
    names = [k for k, _, _ in PII]
    found, pairs, candidates = [], {}, []
    for i, text in enumerate(docs):
        text = text or ""
        base = [(a, b, names.index(k)) for k, a, b in spans(text, PII)]
        cores = []
        for m in TOKEN.finditer(text):
            core = re.sub(r"^[^A-Za-z0-9]+", "", m.group())
            a = m.end() - len(core)
            core = re.sub(r"[^A-Za-z0-9]+$", "", core)
            cores.append((a, a + len(core)))
        private = lambda a, b: n_digits(text[a:b]) >= 5 or "@" in text[a:b]  # noqa: E731, B023
        cores = {x for x in cores if private(*x)}
        groups = {m.span() for m in GROUPS.finditer(text) if private(*m.span())} - cores
        own = [(a, b, None, False) for a, b in cores] + [(a, b, None, any(a <= c and d <= b for c, d in cores)) for a, b in groups]
        own = [x for x in own if not any(a < x[1] and x[0] < b for a, b, _ in base)]
        for a, b, k, wide in [(a, b, k, False) for a, b, k in base] + own:
            for p in contexts(text, a, b):
                old = pairs.get((p, text[a:b]), (None, True))
                pairs[p, text[a:b]] = (min((x for x in (old[0], k) if x is not None), default=None), old[1] and wide)
        candidates += [(i, a, b, text[a:b]) for a, b, _, _ in own]
    known = {}
    for (_, v), (k, _) in pairs.items():
        if k is not None:
            known[v] = min(known.get(v, k), k)
    while True:
        by_pattern = defaultdict(list)
        for (p, v), (_, wide) in pairs.items():
            if not wide or v in known:
                by_pattern[p].append(known.get(v))
        sure = {}
        for p, kinds in by_pattern.items():
            best, k = max((kinds.count(k), -k) for k in range(len(names)))
            if best >= support and best / len(kinds) >= confidence:
                sure[p] = (-k, best / len(kinds))
        doubt = defaultdict(lambda: 1.0)
        for p, v in pairs:
            if v not in known and p in sure:
                doubt[v, sure[p][0]] *= 1 - min(sure[p][1], 0.999)
        new = {}
        for (v, k), d in doubt.items():
            if 1 - d >= certainty:
                new[v] = max(new.get(v, (0, -9)), (1 - d, -k))
        if not new:
            break
        known |= {v: -k for v, (_, k) in new.items()}
    out = [[] for _ in docs]
    for i, a, b, v in candidates:
        if v in known:
            out[i].append((a, known[v], b))
    return [sorted(x) for x in out]
