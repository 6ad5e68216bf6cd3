"""Awkward inputs that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "One two three", "the and of " * 9_000, "x" * 60_000, "7" * 30_000, "a@" * 2_000, "\n" * 3_000,
    "Été à la plage, œuvre €5 — “quoted” ﬁn İstanbul ΑΣ 한국어 日本語 😀", "tab\tand\x1cseparator \x85 \xa0 nbsp\x00nul", "it's <|endoftext|> we'll 42 3.14",
    "shared line one here\nshared line two here\nown words of the first", "shared line one here\nshared line two here\nown words of the second",
    "write to some.one@mail.example.com or +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
    "stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter stutter",
]
#: names that operators use for themselves
CLASHES = ("fp", "key", "row_key", "place", "drop", "length", "start", "salt", "tie", "least", "root", "n_dropped", "base", "cand", "task", "score")


def rows():
    out = []
    for i, t in enumerate(TEXTS):
        out.append((i * 3, t, "en", f"src{i % 3}", len(t or "")))
    out += [(None, "a text without an id, of some few words", None, None, None), (None, None, None, "src1", 0)]
    out += [out[4], out[13], out[13]]  # repeated rows
    out += [(12, "same id as another row but another text", "en", "src9", 40)]
    out += [(900 + k, "shared line one here\nand something else " + "abcdefgh"[k], "en", f"src{k}", 20) for k in range(6)]
    return out


def documents(spark, clashes: bool = True):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    if clashes:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(c).alias(c) for c in CLASHES])
    return df


def empty(spark):
    return documents(spark, False).where("false")


def keyed(rows_):
    """Rows as a sorted list of tuples, for comparison."""
    return sorted((tuple(r) for r in rows_), key=repr)
