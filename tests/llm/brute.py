"""Plain Python versions that the training-data operators are compared with."""

import re

WORD_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def word_shingles(text, n):
    w = WORD_SPACE.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def near_components(rows, n, percent):
    """{id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: word_shingles(t, n) for i, t in rows}
    lists, u = {}, Union()
    for i, s in sets.items():
        u.find(i)
        for x in s:
            lists.setdefault(x, []).append(i)
    both = {}
    for ids in lists.values():
        for a in ids:
            for b in ids:
                if a < b:
                    both[a, b] = both.get((a, b), 0) + 1
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def char_shingles(line, n=5):
    return {line} if len(line) < n else {line[i:i + n] for i in range(len(line) - n + 1)}


def kept_lines(rows, percent=80):
    """{(id, line number): kept} of all lines that are not blank; every pair is compared."""
    at = [(i, k, x.strip(" \t\r\f").lower()) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    at = sorted(x for x in at if x[2])
    distinct = sorted({x[2] for x in at})
    sets = {x: char_shingles(x) for x in distinct}
    u, lists = Union(), {}
    for x in distinct:
        u.find(x)
        for s in sets[x]:
            lists.setdefault(s, []).append(x)
    both = {}
    for xs in lists.values():
        for a in xs:
            for b in xs:
                if a < b:
                    both[a, b] = both.get((a, b), 0) + 1
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            u.join(a, b)
    seen, out = set(), {}
    for i, k, x in at:
        out[i, k] = u.find(x) not in seen
        seen.add(u.find(x))
    return out


def main_language(text, model):
    """(language, share of its letters) by plain loops: words of one script, hashed n-grams, the best path of labels."""
    import unicodedata

    import numpy as np

    from faultline.llm import langid

    def script(c):
        return next((langid.SCRIPT_NAMES.index(n) for n, a, b in reversed(langid.SCRIPTS) if a <= ord(c) <= b), 0)

    words, now = [], ""
    for c in [*(text or ""), " "]:
        letter = unicodedata.category(c)[0] in "LM"
        if now and (not letter or script(c) != script(now[-1])):
            words.append(now)
            now = ""
        now += c if letter else ""
    words = [w for w in words if any(unicodedata.category(c)[0] == "L" for c in w)]
    if not words or not model.langs:
        return "und", 0.0
    low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    mul, mask, shift = 0x9E3779B97F4A7C15, (1 << 64) - 1, 64 - langid.BUCKETS.bit_length() + 1
    cost = []
    for w in words:
        v = [0, *map(low, w), 0, 0]
        total = np.zeros(len(model.langs))
        for k in range(1, len(w) + 1):
            h3 = (((v[k - 1] * 0x1F3D5B79 + v[k]) * mul) + v[k + 1]) * mul & mask
            h4 = ((h3 >> 17) ^ (h3 + (v[k + 2] if v[k + 1] else 0) & mask)) * mul & mask
            total += model.logp[0][h3 >> shift] + model.logp[1][h4 >> shift]
        cost.append(np.where(model.written[script(w[0])], total, total + langid.NOT_WRITTEN_SO))
    best, back = cost[0], []
    for c in cost[1:]:
        stay, top = best, best.max() - model.penalty
        back.append(np.where(stay >= top, np.arange(len(best)), best.argmax()))
        best = np.maximum(stay, top) + c
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    letters = np.bincount(path[::-1], [len(w) for w in words], len(model.langs))
    return model.langs[int(letters.argmax())], float(letters.max() / letters.sum())
