"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def ascii_lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring(rows, window=13):
    first, out = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def repeated_bytes(rows, length=200):
    count, out = Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        x = int(x) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(t):
    found, t = [], t or ""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and luhn(d) or kind == 3 and 10 <= len(d) <= 15:
                found.append((m.start(), kind, m.end()))
    names = ("email", "ip", "card", "phone")
    return tuple(sum(x[1] == k for x in found) for k in range(4)) + (sha(",".join(f"{names[k]}:{a}:{e}" for a, k, e in sorted(found)).encode()),)


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t))


def contamination(rows, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, ids = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return sorted(out)


def base_lm(rows, folds=7, held=2):
    count, words = Counter(), []
    for d, t in rows:
        w = [*ascii_lower(t).encode().split(), None]
        words.append((d, w, zlib.crc32(str(d).encode()) % folds == held))
        if not words[-1][2]:
            count.update(w)
    room = sum(count.values()) + len(count) + 1
    return sorted((d, h, len(w), sum(count[x] > 0 for x in w), sum(count.values()), round(sum(math.log10((count[x] + 1) / room) for x in w), 5)) for d, w, h in words)


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t, size=5):
    w = ascii_lower(t).encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
             if sets[a] and (k := len(sets[a] & sets[b])) and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    root = roots(ids, links)
    return sorted((d, len(sets[d]), root[d], root[d] == d) for d, _ in rows)
