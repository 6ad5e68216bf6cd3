"""Repetition coverage: rolling hashes of word n-grams, and the characters inside repeated n-grams and lines.

Each word gets the position of its first occurrence as id, mixed to 64 bits; the hash of n words
follows from that of n - 1 by one multiplication and addition, for the whole text at once.
Windows with equal hashes are repeats (a chance collision has odds of about n^2 / 2^64 for n
windows). Coverage of length n: code points of the words inside windows seen before.

Rows: null and empty texts have no words and fail the base rule; null doc_id stays null; each row
is judged alone, so repeated rows and ties get equal results; an empty table gives no rows; the
filter keeps all columns of its input, the measures return their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelens.llm.common import BLANKS, importable, schema, text_rows, text_slices

SYMBOLS = "#*$%&|<>"
#: largest share of characters in repeated n-grams, by n; from 5 on fixed values of the published repetition rules,
#: 3 and 4 catch words repeated in runs
MAX_COVERAGE = {3: 0.30, 4: 0.25, 5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: ... and in repeated lines
MAX_LINE_COVERAGE = 0.20
#: symbols for each hundred word characters
MAX_SYMBOLS = 7
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"coverage_{n} long" for n in MAX_COVERAGE) + ", base_failed boolean, kept boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of small integers."""
    z = (x + np.uint64(1)) * FACTOR
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Windows found twice or more, and those among them seen before; None if there are none."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    again, any_of = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:][same]] = True
    any_of[order[:-1][same]] = True
    return any_of | again, again


def _inside(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the marked windows of n words."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> tuple:
    """The measures of one text, in the order of MEASURES."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup_lines = dup_line_chars = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line)
            elif line.strip(BLANKS):
                seen.add(line)
    repeat_words, coverage = 0, dict.fromkeys(MAX_COVERAGE, 0)
    least = min(MAX_COVERAGE)
    if n > least:
        first: dict[bytes, int] = {}
        h1 = mixed(np.array(list(map(first.setdefault, words, range(n))), np.uint64))
        h, lengths = h1, None
        for k in range(2, max(MAX_COVERAGE) + 1):
            if n < k + 1:
                break
            h = h[:-1] * FACTOR + h1[k - 1:]
            if k < least:
                continue
            found = _repeats(h)
            if found is None:  # longer windows cannot repeat either
                break
            if lengths is None:
                lengths = np.array([len(w) for w in words] if text.isascii() else [len(w.decode()) for w in words], np.int64)
            if k == WINDOW:
                repeat_words = int(_inside(found[0], k, n).sum())
            coverage[k] = int(lengths[_inside(found[1], k, n)].sum())
    base_failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT * n
    kept = not (base_failed or 100 * symbols > MAX_SYMBOLS * chars or dup_line_chars > MAX_LINE_COVERAGE * len(text)
                or any(coverage[k] > most * chars for k, most in MAX_COVERAGE.items()))
    return (n, chars, symbols, dup_lines, repeat_words, dup_line_chars, *coverage.values(), base_failed, kept)


def _measures(batches: Iterator) -> Iterator:
    import pyarrow as pa

    fields = [f.split()[0] for f in MEASURES.split(", ")]
    for some in text_slices(batches):
        columns = list(zip(*map(measure, some.column("text").to_pylist())))
        yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(c, pa.bool_() if isinstance(c[0], bool) else pa.int64()) for c in columns)], ["doc_id", *fields])


def measures(docs: DataFrame) -> DataFrame:
    return text_rows(docs).mapInArrow(_measures, schema("doc_id long, " + MEASURES))


def _kept_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for some in text_slices(batches):
        yield some.filter(pa.array([measure(t or "")[-1] for t in some.column("text").to_pylist()], pa.bool_()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    importable(docs.sparkSession)
    return docs.mapInArrow(_kept_rows, docs.schema)


def op6(docs: DataFrame) -> DataFrame:
    return measures(docs).select(F.col("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                 "dup_line_chars", *[f"coverage_{n}" for n in MAX_COVERAGE])
