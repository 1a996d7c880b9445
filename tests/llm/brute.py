"""Plain versions of the corpus operators, row by row, for comparison."""

import itertools
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text or ""))


def fold(doc_id, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def fingerprint(text: str | None, size: int = 3) -> str:
    own = words(text)
    cut = [own] if len(own) < size else [own[i : i + size] for i in range(len(own) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(c).encode(), 42) for c in cut if c]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return f"{bits:016x}"


def groups(nodes: list, linked) -> dict:
    """Of each node the smallest one that is reachable."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if root(a) != root(b) and linked(a, b):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {n: root(n) for n in nodes}


def shingles(text: str | None, size: int = 5) -> set:
    own = words(text)
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def base_scores(texts: dict, training: set) -> dict:
    counts: Counter = Counter()
    for k in training:
        counts.update([*words(texts[k]), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for k, t in texts.items():
        own = [*words(t), None]
        out[k] = (len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    return out


def interpolated_scores(texts: list) -> list[float]:
    """Witten-Bell bigrams with exact counts, all texts as training; a text follows the end of another."""
    tokens = [[*words(t), None] for t in texts]
    one, pairs, followers = Counter(w for t in tokens for w in t), Counter(), Counter()
    for t in tokens:
        pairs.update(zip([None, *t], t))
    for v, _ in pairs:
        followers[v] += 1
    n, d = sum(one.values()), len(one)
    base = lambda w: (one[w] + 0.5) / (n + 0.5 * (d + 1))
    p = lambda v, w: (pairs[v, w] + followers[v] * base(w)) / (one[v] + followers[v])
    return [sum(math.log10(p(v, w)) for v, w in zip([None, *t], t)) for t in tokens]
