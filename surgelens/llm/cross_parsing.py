"""Language identification by cross-parsing entropy.

A suffix automaton per language, built from labelled text, holds every substring of its sample. A text is parsed
against each: from where a phrase starts, the automaton is followed as long as it can be, which gives the
longest match; the next phrase starts behind it. The language whose parsing needs fewest phrases, normalised, wins: bits
per symbol, phrases * (log2 of the sample's length) / length.

Symbols: letters in lower case; any run of other characters is one blank. Letters beyond the ``SYMBOLS`` most frequent of the samples
are one symbol that no sample holds. Texts are parsed in blocks of ``BLOCK`` symbols, all blocks and
languages of a slice in lockstep with vectorised table look-ups; a phrase ends at its block's end, so the depth of a task does
not grow with a text.

The fit samples at most ``TRAIN_ROWS`` labelled documents of each language by hash (of the ``LANGS`` most frequent languages), cuts their
texts into pieces and takes pieces by hash; all languages share ``TRAIN_CHARS`` characters (one piece each at least), so the
automata are of bounded size. Documents whose crc32(doc_id) mod 4 is 2 are never read by the fit.

Rows: a null text, one without letters, or any text where nothing could be learnt is ``und`` with score 0; a null doc_id is
predicted, not held out and not learnt from; rows with a null lang are not learnt from; a language without letters in its sample
is not learnt; equal entropies go to the first name; the score is the margin to the second language, (second - best) / second, and
1 if only one is known. Repeated rows stay rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelens.llm.common import importable, schema, text_slices

TRAIN_ROWS, TRAIN_CHARS, PIECE, LANGS, PARTS, HELD_OUT = 200, 160_000, 400, 1_000, 4, 2
SYMBOLS, BLOCK = 60, 1_024
#: symbols: 0 ends a block or is unknown, 1 is the blank
UNKNOWN, BLANK = 0, 1


@dataclass(frozen=True)
class Samples:
    """Names of the languages in order, their sample texts, and the letters that have a symbol of their own."""

    langs: tuple[str, ...]
    texts: tuple[str, ...]
    letters: str


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: state x symbol -> state, -1 where there is none; the root is 0."""
    to, link, size = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(to)
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(to), width), -1, np.int32)
    for state, edges in enumerate(to):
        if edges:
            table[state, list(edges)] = list(edges.values())
    return table


class Parser:
    """The automata of all languages in one table; phrases of many blocks at once."""

    def __init__(self, samples: Samples):
        self.langs, self.width = samples.langs, len(samples.letters) + 2
        self.lookup = self._lookup(samples.letters)
        tables, self.roots, at, self.bits = [], [], 0, []
        for text in samples.texts:
            symbols = self.symbols([text])[0]
            table = automaton(symbols.tolist(), self.width)
            tables.append(np.where(table >= 0, table + at, -1).astype(np.int32))
            self.roots.append(at)
            self.bits.append(math.log2(max(2, len(symbols))))
            at += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        # after a phrase ends at a symbol, the next starts with it: its state, or the root for a symbol of no sample
        self.again = np.stack([np.where((row := self.table.reshape(-1, self.width)[r]) >= 0, row, r) for r in self.roots]) if tables else None

    @staticmethod
    def _lookup(letters: str) -> np.ndarray:
        table = np.zeros(0x110000, np.uint8)
        table[[ord(c) for c in letters]] = np.arange(len(letters)) + BLANK + 1
        return table

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        """Symbols of each text, runs of other characters as one blank, none at the ends."""
        lows = [t.lower() for t in texts]
        points = np.frombuffer("".join(lows).encode("utf-32-le"), np.uint32)
        out, at = [], 0
        for t in lows:
            p = points[at:at + len(t)]
            at += len(t)
            s = self.lookup[p]
            odd = np.flatnonzero(s == UNKNOWN)
            if len(odd):
                s = s.copy()
                kinds, where = np.unique(p[odd], return_inverse=True)
                s[odd] = np.array([UNKNOWN if chr(k).isalpha() else BLANK for k in kinds.tolist()], np.uint8)[where]
            blank = s == BLANK
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            s = s[keep]
            out.append(s[int(len(s) > 0 and s[0] == BLANK):len(s) - int(len(s) > 1 and s[-1] == BLANK)])
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (rows) against each language (columns)."""
        cuts = [(i, a, min(a + BLOCK, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), BLOCK)]
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not cuts:
            return counts
        cuts.sort(key=lambda c: c[1] - c[2])  # longest first, so that running blocks stay in front
        size = np.array([z - a for _, a, z in cuts])
        grid = np.zeros((size[0], len(cuts)), np.uint8)
        for k, (i, a, z) in enumerate(cuts):
            grid[:z - a, k] = texts[i][a:z]
        going = np.searchsorted(-size, -np.arange(size[0]), side="left")  # blocks longer than each step
        found = np.zeros((len(self.langs), len(cuts)), np.int64)
        for lang, root in enumerate(self.roots):
            state, ended, again = np.full(len(cuts), root, np.int32), np.ones(len(cuts), np.int32), self.again[lang]
            for step, n in enumerate(going.tolist()):
                c = grid[step, :n]
                now = self.table[state[:n] * self.width + c]
                miss = np.flatnonzero(now < 0)
                if len(miss):
                    # a phrase ends before the symbol; at the root it is the symbol itself
                    ended[miss] += state[miss] != root
                    symbol = c[miss]
                    follow = again[symbol]
                    ended[miss] += follow == root
                    now[miss] = follow
                state[:n] = now
            found[lang] = ended - (state == root)  # a block that ends with a whole phrase starts none
        np.add.at(counts, np.array([i for i, _, _ in cuts]), found.T)
        return counts

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        symbols = self.symbols([t or "" for t in texts])
        length = np.array([len(s) for s in symbols])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.phrases(symbols) * np.array(self.bits) / np.maximum(length, 1)[:, None]
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(texts)), best]
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = np.where(second > 0, (second - low) / np.where(second > 0, second, 1), 0.0)
        else:
            score = np.ones(len(texts))
        some = np.array([bool(len(s)) and bool((s != BLANK).any()) for s in symbols])
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())], np.where(some, score, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % PARTS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Samples:
    """Samples of each language that the labelled, not held out documents name."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    langs = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    if not langs:
        return Samples((), (), "")
    # about 4 * rows of each language pass by hash, so few texts are shuffled; then the first ones of them
    counts = known.sparkSession.createDataFrame(langs, schema("lang string, n long"))
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(2**40)) < F.lit(2**42 * rows) / F.col("n"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    chosen = hashed.withColumn("at", F.row_number().over(first)).where(F.col("at") <= rows).groupBy("lang", "text").agg(F.min("h").alias("h"))  # copies count once
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int"))
    pieces = chosen.select("lang", "h", F.posexplode(F.transform(starts, lambda k: F.substring("text", k * PIECE + 1, F.lit(PIECE)))).alias("piece", "text"))
    share = max(PIECE, chars // len(langs))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h", "piece"), "h", "piece")
    pieces = pieces.withColumn("at", F.row_number().over(order)).where(F.col("at") <= -(-share // PIECE))
    found: dict[str, list[str]] = {}
    for r in pieces.orderBy("lang", "at").select("lang", "text").collect():  # TRAIN_CHARS characters, or PIECE a language
        found.setdefault(r.lang, []).append(r.text)
    texts = {lang: " ".join(p).lower() for lang, p in found.items()}
    texts = {lang: t for lang, t in sorted(texts.items()) if any(c.isalpha() for c in t)}
    letters = Counter(c for t in texts.values() for c in t if c.isalpha())
    letters = sorted(sorted(letters), key=lambda c: -letters[c])[:SYMBOLS]
    return Samples(tuple(texts), tuple(texts.values()), "".join(sorted(letters)))


_PARSERS: dict[Samples, Parser] = {}


def parser_of(samples: Samples) -> Parser:
    """The automata, built once per worker process from the small samples."""
    if samples not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[samples] = Parser(samples)
    return _PARSERS[samples]


def _predict(samples: Samples):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parser = parser_of(samples)
        for b in text_slices(batches):
            lang, score = parser.judged(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def op13(docs: DataFrame) -> DataFrame:
    """One row per document."""
    importable(docs.sparkSession)
    samples = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(samples), schema("doc_id long, held_out boolean, lang_pred string, score double"))
