"""Plain definitions of what the operators return, one text at a time."""

import collections
import hashlib
import math
import re

import regex

from pricelens.llm import licenses, secrets
from pricelens.llm.license_rules import rules

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAPLESS = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def leaks(text, items, size=10):
    ws, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        for i in range(max(1, len(own) - size + 1) if own else 0):
            w = own[i:i + size]
            for at in range(len(ws) - len(w) + 1):
                if ws[at:at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def quality(text):
    text = text or ""
    w, lines = GAPLESS.findall(text), [x for x in text.split("\n") if GAPLESS.search(x)]
    n, repeated = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if n[tuple(w[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def fixed_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for no, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), no, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in collections.Counter(s).values())


def spans(text):
    """(fixed spans, all spans) by whole recounts of every window."""
    text = text or ""
    base = fixed_spans(text)
    inside = lambda a, b: any(x <= a and y >= b for x, _, y in base)
    out = list(base)
    for k, (_, chars, _, size, least) in enumerate(secrets.CLASSES):
        for m in re.finditer(f"[{chars}]+", text):
            s = m[0]
            if len(s) < size or inside(m.start(), m.end()):
                continue
            if re.search(secrets.ALLOWED, s) or re.search(secrets.PUBLIC_BEFORE, text[max(0, m.start() - secrets.BEFORE):m.start()]):
                continue
            hot = [i for i in range(len(s) - size + 1) if entropy(s[i:i + size]) >= least - 1e-9]
            if hot and not inside(m.start() + hot[0], m.start() + hot[-1] + size):
                out.append((m.start() + hot[0], len(base_kinds()) + k, m.start() + hot[-1] + size))
    return base, sorted(set(out))


def base_kinds():
    return [n for n, *_ in secrets.BASE]


def joined(found):
    names = [n for n, *_ in [*secrets.BASE, *secrets.CLASSES]]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)


def masked(text):
    out, at, merged = "", 0, []
    for a, _, b in spans(text)[1]:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out, at = out + text[at:a] + "[REDACTED]", b
    return out + text[at:]


RULES = [(label, p, word, regex.compile(pattern)) for label, p, word, pattern in rules()]
GATE = re.compile("(?<![a-z])(?:" + "|".join(re.escape(w) for _, _, w, _ in RULES) + ")")


def license_row(text):
    t = lower(text)
    ws, starts, base = WORD.findall(t), [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        for i in range(len(ws) - len(own) + 1):
            if ws[i:i + len(own)] == own:
                starts.append(i)
                base.add(label)
    found = [(m.start(), m.end(), p, label) for label, p, word, x in RULES if word in t for m in x.finditer(t)] if GATE.search(t) else []

    def outer(ds):
        kept = []
        for d in sorted(ds, key=lambda d: (d[0], -d[1], -d[2], d[3])):
            if not any(k[0] <= d[0] and k[1] >= d[1] for k in kept):
                kept.append(d)
        return kept

    exact = outer([d for d in found if d[2] == 3])
    named = exact + [d for d in outer([d for d in found if d[2] == 2]) if not any(k[0] <= d[0] and k[1] >= d[1] for k in exact)]
    every = named + [d for d in outer([d for d in found if d[2] == 1]) if not any(k[0] < d[1] and k[1] > d[0] for k in named)]
    score = max([licenses.SCORES[d[2]] for d in every] + [licenses.SCORES[0]] * bool(starts) + [0.0])
    return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d[3] for d in every})), score)


def shingles(text):
    w = GAPLESS.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, threshold=85):
    """id -> (size of the set, smallest id reachable) by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}
