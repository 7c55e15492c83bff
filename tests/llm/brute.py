"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def components(rows, size=5, least=75):
    """doc_id -> size of its set and smallest doc_id reachable, by comparing every pair."""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= least * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    repeated = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def without_longest_runs(rows, least=50):
    """doc_id -> text: from every place, the longest common prefix with any earlier place goes if it has ``least`` words."""
    docs, places, gone = {}, [], defaultdict(set)
    white = " \t\n\r\x0b\x0c"
    for i, text in rows:
        docs[i] = [(n, x.strip(white)) for n, x in enumerate((text or "").split("\n")) if x.strip(white)]
    for i in sorted(docs):
        lines = [x for _, x in docs[i]]
        for p in range(len(lines)):
            longest = 0
            for other, q in places:
                k = 0
                while p + k < len(lines) and q + k < len(other) and lines[p + k] == other[q + k]:
                    k += 1
                longest = max(longest, k)
            if sum(len(WORD.findall(x)) for x in lines[p : p + longest]) >= least:
                gone[i] |= {n for n, _ in docs[i][p : p + longest]}
            places.append((lines, p))
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]) if gone[i] else t for i, t in rows}


def hard_negatives(rows, every=50):
    """Sorted (anchor, positive, rank, negative, positive score, negative score) from rows of id, vector and label."""
    table = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        table[i] = min(table.get(i, (label, [math.inf])), (label, [math.floor(256 * c) for c in v]))
    out = []
    for a, (label, x) in table.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in table.items() if i != a and len(y) == len(x))
        for score, i, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(a, i, k + 1, j, -score, -s) for k, (s, j, _) in enumerate(inside)]
    return sorted(out)
