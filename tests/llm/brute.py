"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def low(text: str | None) -> list[str]:
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def repeated(items: list[tuple[int, list]], window: int) -> dict[int, list[bool]]:
    """Which tokens of each document a window covers that also starts in a smaller id."""
    first: dict = {}
    for d, s in items:
        for i in range(len(s) - window + 1):
            w = tuple(s[i : i + window])
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, s in items:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if first[tuple(s[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = gone
    return out


def near(docs: list[tuple[int, str]], least: float = 0.8) -> dict[int, int]:
    """Smallest id of each document's class by weighted similarity of five-word shingles."""
    sets, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t in docs:
        w = SPACE_WORDS.findall(t or "")
        sets[d] = (w, Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter())
        parent[d] = d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            (wa, x), (wb, y) = sets[a], sets[b]
            same = wa == wb or (x and y and sum((x & y).values()) >= least * sum((x | y).values()))
            if same and root(a) != root(b):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in ids}
