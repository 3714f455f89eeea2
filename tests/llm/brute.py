"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def groups(nodes, pairs):
    """The smallest node that each node reaches."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def simhash(text, size=3):
    tokens = words(text)
    if not tokens:
        return 0
    size = min(size, len(tokens))
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + size]), 42) for i in range(len(tokens) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, size=5):
    tokens = words(text)
    size = min(size, len(tokens))
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if tokens else set()


def similar(a, b, least=0.8):
    return not (a or b) or len(a & b) >= least * len(a | b)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dropped_lines(rows, most=2, shortest=20):
    """Dropped line numbers of each (doc_id, text), in order of documents that the caller gives."""
    split = [(t.split("\n") if t is not None else []) for _, t in rows]
    lines = sorted({x for xs in split for x in xs if len(x) >= shortest})
    near = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= most and edits(a, b) <= most]
    of, seen, out = groups(lines, near), set(), []
    for xs in split:
        gone = []
        for i, x in enumerate(xs):
            if x in of:
                if of[x] in seen:
                    gone.append(i)
                seen.add(of[x])
        out.append(gone)
    return out


def repeated(texts, length):
    """(bytes, removed, runs, kept) of each text: bytes covered by a string of so many that begins elsewhere too."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """(start, kind number, end, kind) of base spans."""
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), number, m.end(), kind))
    return sorted(found)


def listed(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


def counted_words(rows, shortest=5, least=3, one_in=97):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def spelling_variants(counts):
    near = {w: [x for x in counts if abs(len(w) - len(x)) <= 1 and edits(w, x) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def clusters(rows, k, rounds, dims, salt="2"):
    kept = [(key, [math.floor(256 * float(x)) for x in v]) for key, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda r: (hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=digest)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == i]
            if own:
                centroids[i] = [sum(column) // len(own) for column in zip(*own)]
    found = [(key, *nearest(v)[::-1]) for key, v in kept]
    own = Counter()
    for _, c, d in found:
        own[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(key, c, d, own[c], sum(own.values()), name[c]) for key, c, d in found]


def leaked(rows, items, size=10):
    """(n_words, n_hit, items, spans of hit words) of every text, by looking for each window at each place."""
    spoken = lambda t: [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))]
    lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = []
    for item, text in items:
        own = [lowered(text)[a:b] for a, b in spoken(text)]
        for at in range(max(1, len(own) - size + 1) if own else 0):
            windows.append((item, own[at : at + size]))
    out = []
    for _, text in rows:
        at = spoken(text)
        own, hit, found = [lowered(text)[a:b] for a, b in at], set(), set()
        for item, window in windows:
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.update([] if item is None else [str(item)])
        spans = [(at[i][0], at[next(j for j in range(i, len(own) + 1) if j not in hit) - 1][1]) for i in sorted(hit) if i - 1 not in hit]
        out.append((len(own), len(hit), sorted(found), spans))
    return out
