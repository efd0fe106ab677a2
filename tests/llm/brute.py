"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = ["an", "be", "cor", "dun", "eth", "fi", "gro", "hes", "ina", "jo", "ka", "lu", "mor", "né", "ost"]


def make_text(rng: random.Random, words: int, per_line: int = 8) -> str:
    w = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return "\n".join(" ".join(w[i:i + per_line]) for i in range(0, len(w), per_line))


def roots(nodes, edges) -> dict:
    """Smallest node of each node's component."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def fingerprint(text: str | None, k: int = 3) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(docs: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component) per row."""
    fps = [fingerprint(t) for _, t in docs]
    at = roots(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least: dict = {}
    for (doc_id, _), r in zip(docs, (at[i] for i in range(len(docs))), strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, f"{fps[i]:016x}", least.get(at[i])) for i, (d, _) in enumerate(docs)]


def measures(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
            "n_stutter": sum(a == b for a, b in zip(words, words[1:]))}


def kept_by_rules(text: str | None) -> bool:
    m = measures(text)
    n = m["n_words"]
    return not (n < 10 or 100 * m["n_repeat_words"] > 20 * n or 100 * m["n_symbols"] > 10 * n
                or 2 * m["n_upper"] > m["n_letters"] or 100 * m["n_stutter"] > 30 * n
                or m["word_chars"] < 2 * n or m["word_chars"] > 40 * n)


def line_chunks(text: str) -> list[tuple[int, str]]:
    """(lines, body) of the content-defined chunks."""
    lines = text.split("\n")
    v = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (v[i] + 31 * (v[i - 1] if i else 0)) % 1_000_003 % 3 == 0:
            out.append((i + 1 - start, "\n".join(lines[start:i + 1])))
            start = i + 1
    return out


def dedup_lines(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text, removed lines), for ids that don't repeat: repeated
    chunks go, and every two neighbouring lines that occur earlier."""
    def runs(t):
        at = 0
        for n, body in line_chunks(t):
            yield "chunk", at, n, body
            at += n
        lines = t.split("\n")
        for i in range(len(lines) - 1):
            yield "pair", i, 2, "\n".join(lines[i:i + 2])

    first: dict = {}
    for d, t in sorted((x for x in docs if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        for kind, at, n, body in runs(t):
            if n >= 2 and WORD.search(body):
                first.setdefault((kind, body), (d, at))
    out = []
    for d, t in docs:
        if d is None or t is None:
            out.append((d, t, 0))
            continue
        gone = {i for kind, at, n, body in runs(t) if n >= 2 and WORD.search(body) and first[kind, body] != (d, at) for i in range(at, at + n)}
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone)))
    return out


def water_fill(budget: float, kids: dict) -> dict:
    """Shares of {name: (weight, cap)} by rounds of proportional filling."""
    share, open_ = {}, dict(kids)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if budget * w / total >= c}
        if not full:
            return share | {k: budget * w / total for k, (w, _) in open_.items()}
        for k, c in full.items():
            share[k] = c
            budget -= c
            del open_[k]
    return share


def mix(docs: list[tuple], percent: int, epochs: int, seed: int, weights: dict) -> dict:
    """doc_id -> copies, for (doc_id, text, lang, source) with single ids."""
    leaf = defaultdict(list)
    for d, t, lang, source in docs:
        if d is not None:
            m = re.fullmatch("src([0-9]{1,9})", source or "")
            domain = f"d{int(m[1]) % 4}" if m else "unknown"
            leaf[(domain, lang or "unknown", source or "unknown")].append((d, len(WORD.findall(t or ""))))
    size = {k: sum(n for _, n in v) for k, v in leaf.items()}

    def spread(path: tuple, budget: float) -> dict:
        if len(path) == 3:
            return {path: budget}
        kids = sorted({k[len(path)] for k in leaf if k[:len(path)] == path})
        level = weights[("domain", "lang", "source")[len(path)]]
        cap = {c: epochs * sum(n for k, n in size.items() if k[:len(path) + 1] == (*path, c)) for c in kids}
        share = water_fill(budget, {c: (level.get(c, 1), cap[c]) for c in kids})
        return {k: v for c in kids for k, v in spread((*path, c), share[c]).items()}

    out = {}
    for k, share in spread((), float(sum(size.values()) * percent // 100)).items():
        share, n = int(share), size[k]
        whole = share // n if n else epochs
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{d}".encode()).hexdigest()  # noqa: B023, E731
        upto = 0
        for d, tokens in sorted(leaf[k], key=lambda x: (key(x[0]), x[0])):
            upto += tokens
            out[d] = whole + (whole < epochs and upto <= share - whole * n)
    return out
