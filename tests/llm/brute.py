"""Plain versions of the operators' definitions, for small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for d in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def substring(texts: list[str | None], width: int) -> list[list[str]]:
    """Words that stay of each text."""
    count: Counter = Counter()
    split = [words(t) for t in texts]
    for w in split:
        count.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    kept = []
    for w in split:
        gone = {i + d for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for d in range(width)}
        kept.append([x for i, x in enumerate(w) if i not in gone])
    return kept


def shingles(text: str | None) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs: dict[int, str | None], percent: int = 85) -> dict[int, tuple[int, int]]:
    """n_shingles and component of each document."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = Counter((a, b) for ds in where.values() for a in ds for b in ds if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def entities(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return found


def shown(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def contamination(texts: list[str | None], items: list[tuple[int | None, str | None]], width: int) -> list[tuple[int, int, list[str]]]:
    """n_words, n_hit and named items of each text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = defaultdict(set)
    for i, text in items:
        w = split(text)
        m = min(width, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            owners[tuple(w[at:at + m])].add(i)
    out = []
    for text in texts:
        w = split(text)
        hit, named = set(), set()
        for m in {len(x) for x in owners}:
            for at in range(len(w) - m + 1):
                if own := owners.get(tuple(w[at:at + m])):
                    hit.update(range(at, at + m))
                    named |= own
        out.append((len(w), len(hit), sorted(str(i) for i in named if i is not None)))
    return out


def manifest(rows: list[tuple], fan: int = 16) -> list[tuple]:
    """Sorted (doc_id, leaf, subroot, root, proof, root) of (doc_id, source, lang, n_chars, text)."""
    digest = lambda *parts: sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
        """The root, and for each node its siblings, level by level."""
        proofs, places = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(places):
                first = p // fan * fan
                proofs[i] += [x for j, x in enumerate(nodes[first:first + fan]) if first + j != p]
                places[i] = p // fan
            nodes = [digest(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        return nodes[0], proofs

    if not rows:
        return []
    groups = defaultdict(list)
    for row in rows:
        groups[b"" if row[1] is None else b"=" + row[1].encode()].append((row[0], digest(*map(field, row))))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    trees = {g: tree([leaf for _, leaf in groups[g]]) for g in sorted(groups)}
    root, above = tree([trees[g][0] for g in trees])
    out = []
    for (g, (subroot, proofs)), upper in zip(trees.items(), above):
        for (doc_id, leaf), own in zip(groups[g], proofs):
            out.append(("-" if doc_id is None else str(doc_id), leaf, subroot, root, digest(*own, *upper), root))
    return sorted(out)


def clusters(vectors: list[tuple[int, list[float]]], k: int, rounds: int, dims: int) -> tuple[list[tuple], list[list[int]]]:
    """Sorted (vec_id, cluster, distance), and the centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors]
    centroids = [v for _, v in sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)][:k]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        near = [f.index(min(f)) for f in far]
        if r < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), n in zip(kept, near) if n == c]
                centroids[c] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[c]
    return sorted((i, n, f[n]) for (i, _), n, f in zip(kept, near, far)), centroids
