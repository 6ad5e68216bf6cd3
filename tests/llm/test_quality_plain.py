"""The quality model against plain versions of its features, its trees, its fit and its table sums."""

import bisect
import math

import numpy as np

from surgelens.llm import quality_gam as Q
from tests.llm import cases


def plain_features(text):
    raw = text.encode()
    words, word = [], b""
    for b in raw + b" ":
        if b in b" \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    if not words:
        return [0.0] * len(Q.FEATURES)
    count = lambda chars: sum(b in chars for b in raw)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    lines = [x for x in raw.split(b"\n") if any(b not in b" \t\n\x0b\x0c\r" for b in x)]
    n, size = len(words), len(raw)
    return [math.log(1 + n), sum(map(len, words)) / n, count(b"#*$%&|<>") / size, count(b"!") / n, upper / max(1, upper + lower), sum(48 <= b <= 57 for b in raw) / size,
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, len(lines) / n, 1 - len(set(lines)) / len(lines), count(b".,;:?-()\"'") / size, sum(b >= 128 for b in raw) / size]


def test_features_of_awkward_texts():
    for text in [*(t or "" for t in cases.TEXTS), "A! b? c.\n\nA! b? c.\n", "ÄÖ ß 12 ##", "\x0b\x0c"]:
        assert np.allclose(Q.features(text), plain_features(text), rtol=1e-12, atol=0)


def worth(g, h):
    return sum(g) ** 2 / (sum(h) + Q.RIDGE)


def plain_tree(g, h, leaves):
    parts = [list(range(len(g)))]
    take = lambda v, p: [v[i] for i in p]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, p in enumerate(parts):
            for cut in range(1, len(p)):
                gain = sum(worth(take(g, q), take(h, q)) for q in (p[:cut], p[cut:])) - worth(take(g, p), take(h, p))
                if gain > best[0] + 1e-12:
                    best = gain, k, cut
        if best[1] is None:
            break
        p = parts[best[1]]
        parts[best[1]:best[1] + 1] = [p[:best[2]], p[best[2]:]]
    out = [0.0] * len(g)
    for p in parts:
        for i in p:
            out[i] = sum(take(g, p)) / (sum(take(h, p)) + Q.RIDGE)
    return out


def test_trees_split_best_first():
    r = np.random.default_rng(7)
    for n in (1, 2, 5, 12, 32):
        for _ in range(10):
            g, h = r.normal(size=n), r.random(n)
            assert np.allclose(Q._tree(g, h, Q.LEAVES), plain_tree(g.tolist(), h.tolist(), Q.LEAVES))


def test_quadrants_are_the_best_cross():
    r = np.random.default_rng(8)
    for n, m in ((1, 1), (1, 4), (2, 2), (5, 3)):
        g, h = r.normal(size=(n, m)), r.random((n, m))
        best, want = 0.0, np.zeros((n, m))
        for i in range(1, n):
            for j in range(1, m):
                cells = [(slice(*a), slice(*b)) for a in ((0, i), (i, n)) for b in ((0, j), (j, m))]
                gain = sum(worth(g[c].ravel(), h[c].ravel()) for c in cells)
                if gain > best:
                    best, want = gain, np.zeros((n, m))
                    for c in cells:
                        want[c] = g[c].sum() / (h[c].sum() + Q.RIDGE)
        got, values = Q._quadrants(g, h)
        assert np.isclose(got, best) and np.allclose(values, want)


def test_a_score_is_a_sum_of_table_entries():
    r = np.random.default_rng(9)
    x = np.round(r.random((600, 4)), 2)
    model = Q.fit(x, ((x[:, 0] > 0.4) != (x[:, 1] > 0.5)).astype(float))
    for row, score in zip(x[:80], model.score(x[:80])):
        logit = model.base + sum(t[bisect.bisect_right(e.tolist(), v)] for t, e, v in zip(model.tables, model.edges, row))
        logit += sum(t[bisect.bisect_right(model.pair_edges[i].tolist(), row[i]), bisect.bisect_right(model.pair_edges[j].tolist(), row[j])] for (i, j), t in model.pairs.items())
        assert np.isclose(score, 1 / (1 + math.exp(-max(-30, min(30, logit)))))


def test_the_fit_is_cyclic_boosting(monkeypatch):
    """One feature after the other, each on the gradient that all before it left."""
    monkeypatch.setattr(Q, "ROUNDS", 3)
    monkeypatch.setattr(Q, "PAIRS", 0)
    r = np.random.default_rng(10)
    x, y = np.round(r.random((200, 3)), 1), (r.random(200) < 0.3).astype(float)
    model = Q.fit(x, y)
    base = math.log(y.mean() / (1 - y.mean()))
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, Q.BINS + 1)[1:-1]).tolist())) for j in range(3)]
    tables, logit = [[0.0] * (len(e) + 1) for e in edges], [base] * 200
    for _ in range(3):
        for j in range(3):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            at = [bisect.bisect_right(edges[j], v) for v in x[:, j]]
            for i, b in enumerate(at):
                p = 1 / (1 + math.exp(-logit[i]))
                g[b] += y[i] - p
                h[b] += p * (1 - p)
            step = [Q.STEP * v for v in plain_tree(g, h, Q.LEAVES)]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            logit = [v + step[b] for v, b in zip(logit, at)]
    assert np.isclose(model.base, base) and all(np.allclose(a, b) for a, b in zip(model.tables, tables))
