"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, each feature in turn gets one shallow tree on its bins, fitted to the
gradient of the log-loss with a small step; the trees of a feature add up to one lookup
table over its bins. The feature pairs whose quadrants explain most of what is left get two-dimensional tables in
the same way. A score is a sum of table entries: vectorised bin additions.

Features come from the text alone. The fit reads the features of at most ``TRAIN_ROWS`` labelled rows, those with
the smallest hash of doc_id among rows whose crc32(doc_id) mod 5 is not 0 (a documented bound; the
labels of the fifth part are never read); scoring covers every document.

Rows: null text counts as empty, whose features are zero; a null doc_id is scored, not held out and stays
null; repeated documents get equal scores; of labels that disagree on an id the larger counts; labels that are
null are ignored; without labels of both kinds the score is the share of label 1 (0.5 without any);
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelens.llm.common import schema, text_rows, text_slices

TRAIN_ROWS, THRESHOLD, HELD_OUT = 20_000, 0.3, 5
FEATURES = ("log_words", "word_bytes", "symbols", "shouts", "upper", "digits", "stutter", "distinct", "lines", "repeated_lines", "marks", "beyond_ascii")
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, STEP, LEAVES, RIDGE = 32, 8, 150, 60, 5, 0.1, 4, 1.0


def _of(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars])


SYMBOLS, MARKS = _of("#*$%&|<>"), _of(".,;:?-()\"'")


def features(text: str) -> tuple[float, ...]:
    """The features of one text, in the order of FEATURES."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, upper = len(raw), int(c[65:91].sum())
    letters = upper + int(c[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (float(np.log1p(n)), (size - int(c[9:14].sum()) - int(c[32])) / n, int(c[SYMBOLS].sum()) / size, int(c[33]) / n, upper / max(1, letters),
            int(c[48:58].sum()) / size, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, len(lines) / n,
            1 - len(set(lines)) / len(lines), int(c[MARKS].sum()) / size, int(c[128:].sum()) / size)


@dataclass
class Model:
    """Intercept, bin edges and tables by feature, and tables by pair."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: bin numbers, table entries, sums."""
        logit = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            logit += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), table in self.pairs.items():
            logit += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins with gradient sums g and curvature sums h: the value of each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                i = int(np.argmax(gain))
                if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                    best = gain[i], k, int(cut[i])
        if best is None:
            break
        _, k, cut = best
        parts[k:k + 1] = [(parts[k][0], cut), (cut, parts[k][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross-shaped tree over a grid: one cut on each side, four leaves; its gain and values."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    best, where = 0.0, None
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            gain = 0.0
            for a, b in ((0, i), (i, n)):
                for c, d in ((0, j), (j, m)):
                    s = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
                    gain += s * s / (ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c] + RIDGE)
            if gain > best:
                best, where = gain, (i, j)
    out = np.zeros_like(g)
    if where is not None:
        i, j = where
        for rows in (slice(0, i), slice(i, n)):
            for cols in (slice(0, j), slice(j, m)):
                out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the chosen pairs."""
    if not len(y):
        return Model(0.0)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Model(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        model.base = 30.0 if y[0] else -30.0
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    logit = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[j])
            step = STEP * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), LEAVES)
            model.tables[j] += step
            logit += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]

    def grids(i, j):
        p = 1 / (1 + np.exp(-logit))
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        cell = coarse[i] * shape[1] + coarse[j]
        return cell, *(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    gains = {(i, j): _quadrants(*grids(i, j)[1:])[0] for i in range(d) for j in range(i + 1, d)}
    chosen = sorted(gains, key=lambda k: -gains[k])[:PAIRS]
    for i, j in chosen:
        model.pairs[i, j] = np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            cell, g, h = grids(i, j)
            step = STEP * _quadrants(g, h)[1]
            model.pairs[i, j] += step
            logit += step.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _with_features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for some in text_slices(batches):
        x = np.array([features(t) for t in some.column("text").to_pylist()])
        rest = [c for c in some.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([some.column(c) for c in rest] + [pa.array(x[:, j].copy()) for j in range(len(FEATURES))], rest + list(FEATURES))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded, fixed sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = text_rows(docs).join(F.broadcast(sample), "doc_id")  # ``rows`` pairs of numbers at most
    spec = "doc_id long, y double, " + ", ".join(f"{f} double" for f in FEATURES)
    got = texts.select("doc_id", "y", "text").mapInArrow(_with_features, schema(spec)).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(rows).collect()
    table = np.array([tuple(r) for r in got], np.float64).reshape(-1, 2 + len(FEATURES))
    return fit(table[:, 2:], table[:, 1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in text_slices(batches):
            x = np.array([features(t) for t in some.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return text_rows(docs).mapInArrow(run, schema("doc_id long, score double"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
