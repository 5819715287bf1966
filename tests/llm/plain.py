"""The operators of lodegraph.llm written plainly, row by row, as their contracts say."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    """(kind, start, end) of base spans, by start, then kind."""
    text = text or ""
    kinds = ("email", "ip", "card", "phone")
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(kinds[k], s, e) for s, k, e in sorted(found)]


def substring(docs, width=20):
    """(doc_id, n_words, n_removed, kept text) of docs in order of id."""
    seen, out = set(), []
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone[i : i + width] = [True] * width
            seen.add(g)
        out.append((key, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return out


def quality(text):
    w = words(text)
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + o for s in spots.values() if len(s) > 1 for i in s for o in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def line_cuts(docs, least=1):
    """Per document, the set of line numbers that line dedup deletes: those of every run of `least` lines with a word
    that also begins earlier, and the blank ones between two neighbours of such a run of two lines or more."""
    place = lambda key, text, i: (key is not None, key or 0, text, i)
    lines = [[(n, x) for n, x in enumerate((text or "").split("\n")) if words(x)] for _, text in docs]
    cuts = [set() for _ in docs]
    for size in {least, max(least, 2)}:
        first = {}
        runs = [(tuple(x for _, x in own[i : i + size]), d, i) for d, own in enumerate(lines) for i in range(len(own) - size + 1)]
        for body, d, i in runs:
            first[body] = min(first.get(body, place(*docs[d], i)), place(*docs[d], i))
        for body, d, i in runs:
            if place(*docs[d], i) != first[body]:
                numbers = [n for n, _ in lines[d][i : i + size]]
                cuts[d] |= set(numbers) if size == 1 else set(range(numbers[0], numbers[-1] + 1))
    return cuts




def fingerprint(text, width=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    """Least key reachable of each (key, fingerprint)."""
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(prints))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def top_k(vectors, every=20, k=20, scale=64):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            rank = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(rank)}
    return out
