"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if often[run] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def fingerprint(text: str | None) -> int:
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components(edges: list[tuple], nodes: list) -> dict:
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def base_pii(text: str | None) -> list[tuple]:
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def repeated(texts: dict, minimum: int = 50) -> dict:
    """Per id the stretches of words whose runs of ``minimum`` words occur in another text."""
    owners: dict = {}
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - minimum + 1):
            owners.setdefault(tuple(w[k : k + minimum]), set()).add(i)
    out = {}
    for i, w in words.items():
        spans: list[list[int]] = []
        for k in range(len(w) - minimum + 1):
            if len(owners[tuple(w[k : k + minimum])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + minimum
                else:
                    spans.append([k, k + minimum])
        out[i] = [tuple(s) for s in spans]
    return out
