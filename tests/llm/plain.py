"""Plain versions that several tests compare with."""
import collections


def plain_kneser_ney(texts, order):
    """prob(history, word) by the formulas, on words; None is the end token."""
    def d_of(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw)]
    cut = lambda c, d: d[min(c, 3) - 1]
    top = collections.Counter()
    for t in texts:
        w = [None] * (order - 1) + t.lower().split() + [None]
        top.update(tuple(w[i:i + order]) for i in range(len(w) - order + 1))
    levels = [top]
    while len(levels) < order - 1:
        low = collections.Counter()
        for g, c in levels[-1].items():
            low[g[1:]] += c if g[1] is None else 1
        levels.append(low)
    before = collections.Counter(g[1] for g in levels[-1])
    d1, types = d_of(before.values()), sum(before.values())
    unseen = sum(cut(c, d1) for c in before.values()) / types / (len(before) + 1)
    tables = []
    for counts in reversed(levels):
        d, ctx = d_of(counts.values()), collections.defaultdict(dict)
        for g, c in counts.items():
            ctx[g[:-1]][g[-1]] = c
        tables.append({h: ({w: (c - cut(c, d)) / sum(own.values()) for w, c in own.items()},
                           sum(cut(c, d) for c in own.values()) / sum(own.values())) for h, own in ctx.items()})

    def prob(history, w):
        p = (before[w] - cut(before[w], d1)) / types + unseen if w in before else unseen
        for k, table in enumerate(tables, 1):
            high, back = table.get(tuple(history[len(history) - k:]), ({}, 1.0))
            p = high.get(w, 0.0) + back * p
        return p
    return prob, set(before)
