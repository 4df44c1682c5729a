"""Small documents that hold every edge case, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, rid int, shard string, _row int, label int"


def edge_rows(seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)] + ["Élan", "straße", "naïve", "日本語"]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = "This Line is shared by many of the documents here, word for word. " + prose(6)
    long_passage = prose(90)
    texts = [None, "", " \t\n ", "one", "a b c d", "a b c d e", "A B C D E"]
    base = prose(120)
    texts += [base, base, base.replace(" ", "  ", 3), base + " tail", prose(60) + "\n" + shared + "\n" + prose(20)]
    texts += [prose(40) + "\n  " + shared.upper() + "\t\n" + prose(10) for _ in range(7)]
    texts += [prose(30) + " " + long_passage + " " + prose(30) for _ in range(4)]
    texts += ["x" * 900, "ab" * 700, prose(20) * 3, "\n\n" + shared + "\n" + shared, prose(9000)]
    words = base.split()
    for k in range(8):
        some = list(words)
        for j in range(k):
            some[(13 * j + 7 * k) % len(some)] = f"edit{k}x{j}"
        texts.append(" ".join(some))
    texts += [prose(rnd.randint(1, 200)) for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"src{i % 4}", None if t is None else len(t), 1, "c", 2, "s", 3, None))
    rows.append(rows[8])
    rows.append((None, texts[30], "en", "src1", 3, 1, "c", 2, "s", 3, 4))
    rows.append((None, None, None, None, None, None, None, None, None, None, None))
    rows.append((rows[12][0], prose(50), "de", "src9", 3, 1, "c", 2, "s", 3, 4))
    return rows


def lower(t):
    return (t or "").encode().lower().decode()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return [groups[find(i)] for i in range(n)]


def brute_near(rows):
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    out = []
    for i, group in enumerate(components(len(rows), links)):
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(sets[i]), c, rows[i][0] == c))
    return out


def brute_repeats(rows, length=200):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))
