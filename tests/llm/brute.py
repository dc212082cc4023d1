"""Plain versions of the operators, for small inputs. Each takes {doc_id: text or None}."""

from __future__ import annotations

import hashlib
from collections import Counter


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def substring(docs: dict, window: int = 50) -> dict:
    first: dict[tuple, int] = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def suffix(docs: dict, length: int = 400) -> dict:
    data = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(d[k : k + length] for d in data.values() for k in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d) + 1)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(d), sum(gone[: len(d)]), spans, sha(bytes(x for k, x in enumerate(d) if not gone[k])))
    return out


def shingles(text: str | None, n: int = 5) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near(docs: dict, percent: int = 75) -> dict:
    sets = {i: shingles(t) for i, t in docs.items()}
    up = {i: i for i in docs}

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in docs}


def measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = [x.decode() for x in words(t)]
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path
