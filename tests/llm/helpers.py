"""Small inputs, and brute-force versions of the operators."""

import random
import re
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls long, key string, bucket long, c0 int"


def frame(spark, texts, first=0):
    """Documents with some columns whose names clash with the operators' own."""
    rows = [(first + i, t, None if i % 7 == 3 else "en", None, None, i, None, 5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n):
    return " ".join("".join(r.choices(string.ascii_lowercase[:9], k=r.randint(2, 8))) for _ in range(n))


def mutated(r, text, rate):
    return " ".join(w if r.random() > rate else prose(r, 1) for w in text.split(" "))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(docs, percent=75):
    """doc_id -> (set size, smallest reachable doc_id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    u = Union()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y:
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def deduped_lines(docs, least=40, often=5):
    """doc_id -> (lines, dropped, text)."""
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= often and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def seeded(n):
    return random.Random(n)
