"""Small inputs with every edge case the operators must take, and brute-force models."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id long, _size long, shard int"
VOCAB = ["".join(random.Random(k).choices("abcdefghijklmnop", k=3 + k % 6)) for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") for _ in range(n)).capitalize()


def edited(text, seed, share):
    r, out = random.Random(seed), []
    for w in text.split(" "):
        out.append(r.choice(VOCAB) if r.random() < share else w)
    return " ".join(out)


def edge_rows():
    """Nulls in any column, empty, blank, one-word, very long, repeated and non-ASCII rows; clashing columns."""
    long = prose(5, 60_000)
    texts = [None, "", " \t\n", "one", "Two words", "ÄÖ ü ß  x", "a\nb\n\na", long, long + " tail", prose(1, 80), prose(1, 80), "line\n" * 30, "x " * 500]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t) if t else None, i, "k", -i, 7, None) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, "no id here at all", None, None, None, None, None, None, None, None)]


def corpus(n=150):
    """Prose with exact copies, near copies of many grades, shared lines and several sources."""
    out = []
    for i in range(n):
        base = prose(i % 60, 60 + i % 60)
        t = base if i % 5 == 0 else edited(base, i, [0.0, 0.005, 0.01, 0.03, 0.1][i % 5])
        if i % 4 == 0:
            t = "Shared line Here.\n" + t + "\n  shared LINE here. "
        out.append((i, t, "en", f"src{min(i % 7, 3)}", len(t), i, "k", i, 1, 0))
    return out


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def shingles(text, k):
    w = words(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(rows, k, percent):
    """Brute force: doc_id -> least doc_id reachable over links of the full sets."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}
