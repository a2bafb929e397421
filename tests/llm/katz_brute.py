"""Katz backoff by dictionaries, for comparison."""

import math
import re
from collections import Counter, defaultdict

from probitas.llm.katz import CUT, Discounts


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]  # None: the end


class Brute:
    def __init__(self, texts):
        self.c, self.g, self.starts = Counter(), Counter(), len(texts)
        for t in texts:
            h = "<start>", 0
            for w in toks(t):
                self.c[w] += 1
                self.g[h, w] += 1
                h = w
        self.n, self.v = sum(self.c.values()), len(self.c)
        of = lambda counts: [0] + [sum(1 for x in counts.values() if x == r) for r in range(1, CUT + 2)]
        self.dw, self.dg = Discounts.fit(of(self.c)), Discounts.fit(of(self.g))
        take = lambda d, x: d.taken[min(x, CUT)]
        self.unseen = sum(take(self.dw, x) for x in self.c.values()) / self.n if self.n else 1.0
        self.uni = {w: (x - take(self.dw, x)) / self.n for w, x in self.c.items()}
        left, seen = defaultdict(float), defaultdict(float)
        for (h, w), x in self.g.items():
            left[h] += take(self.dg, x)
            seen[h] += self.uni[w]
        self.hc = lambda h: self.starts if h == ("<start>", 0) else self.c[h]
        self.alpha = {h: left[h] / self.hc(h) / (1 - seen[h]) for h in left}
        self.take = take

    def p(self, h, w):
        x = self.g.get((h, w), 0)
        if x:
            return (x - self.take(self.dg, x)) / self.hc(h)
        u = self.uni.get(w, self.unseen)
        return self.alpha[h] * u if h in self.alpha else u

    def score(self, text):
        out, h = 0.0, ("<start>", 0)
        for w in toks(text):
            out += math.log10(self.p(h, w))
            h = w
        return out

    def base(self, text):
        return sum(math.log10((self.c.get(w, 0) + 1) / (self.n + self.v + 1)) for w in toks(text))
