"""Small documents with every awkward case, and plain re-computations of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def say(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random prose with copies, near copies, nulls in each column, empty, odd and very long texts, and repeated rows."""
    r = random.Random(seed)
    rows: list[tuple] = [(i, say(r, r.randint(40, 160)), r.choice(["en", "de"]), f"src{r.randint(0, 3)}", 1) for i in range(n)]
    rows += [(n + i, rows[i % 3][1], "en", "src0", 1) for i in range(12)]
    for i in range(8):
        words = rows[4][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((n + 20 + i, " ".join(words), "en", "src0", 1))
    rows += [(200, None, "en", "src1", None), (201, "", None, None, 0), (202, " \t\n ", "de", "src1", 3), (203, "one", "en", "src2", 3), (204, "One two", "en", None, 7), (205, "ÉÈ ñandú ßtraße K 日本語", "fr", "src3", 9)]
    rows += [(None, "a text without an id " * 12, "en", "src0", 5), (206, say(r, 30_000), "en", "src0", 9), rows[5], rows[5], (207, "12 34 !! ??", "en", "src0", 4), (208, "x\x0bcd\x0cef\rgh\x1cij", "en", "src0", 4)]
    return rows


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes: list, linked) -> dict:
    """Brute force: the least node reachable from each."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text: str | None, items: list[tuple]) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated) from the definition."""
    w = item_words(text)
    hit, found = set(), set()
    for item, body in items:
        b = item_words(body)
        if not b:
            continue
        n = min(13, len(b))
        for s in range(len(b) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit.update(range(p, p + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fold(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
