"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

One pass over all lines gives per line key its count and a HyperLogLog sketch of the sites, merged by
aggregation (map-side first, so a very common line is a few rows in the shuffle). Lines whose estimate
is clear of the threshold are decided by it; lines near it get an exact distinct count of their sites, which reads
only their rows. Boilerplate is then taken out of every document but the one with the
smallest doc_id that holds it, so no text is lost from the corpus, and a group of copies keeps one whole copy.

A line is compared as it stands, without white space at its ends; lines without a word are never boilerplate. Its key is
two independent hashes and the length.

Rows: null text stays null and has no lines; a null source counts as no site; a null doc_id never is
the keeper unless all ids are null; repeated rows (same id and text) are treated alike, so the keeper's
repeats keep the line too; an empty table gives no rows; all further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelens.llm.common import fresh, row_key, stored

#: sites from which on a line is boilerplate
SITES = 4
#: sketch size (2^k registers) and the band around the threshold, in standard errors, that is counted exactly
LOG_REGISTERS, BAND = 8, 4.0


def _lines(docs: DataFrame) -> DataFrame:
    """(site, doc_id, row, place, key): one row per line with a word."""
    trimmed = F.expr("trim(BOTH decode(unhex('20090A0B0C0D'), 'UTF-8') FROM line)")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("source").cast("string").alias("site"), F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id").cast("long"), text).alias("row"),
                       F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    rows = rows.withColumn("line", trimmed).where(F.length("line") > 0)
    return rows.select("site", "doc_id", "row", "place", F.struct(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.length("line").alias("n")).alias("key"))


def boilerplate(docs: DataFrame, sites: int = SITES, log_registers: int = LOG_REGISTERS, band: float = BAND) -> DataFrame:
    """(key, keeper): the lines on at least ``sites`` sites and the smallest doc_id that holds each."""
    lines = _lines(docs)
    # a line on n sites occurs n times at least: the exact count prunes before any sketch is made
    counts = lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("key")
    counts = stored(counts, "lines-common")
    common = lines.join(counts, "key", "left_semi")
    sketches = common.groupBy("key").agg(F.hll_sketch_agg("site", log_registers).alias("sketch"), F.min("doc_id").alias("keeper"))
    spread = stored(sketches.select("key", "keeper", F.hll_sketch_estimate("sketch").alias("estimate")), "lines-spread")
    error = band * 1.04 / 2 ** (log_registers / 2)
    low, high = sites * (1 - error), sites * (1 + error) + 1
    near = spread.where(F.col("estimate").between(low, high))
    exact = (lines.join(near, "key").select("key", "keeper", "site").distinct()
             .groupBy("key").agg(F.first("keeper").alias("keeper"), F.count("site").alias("n")).where(F.col("n") >= sites))
    return spread.where(F.col("estimate") > high).select("key", "keeper").union(exact.select("key", "keeper"))


def removals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, drop): for each document row the places of the lines to take out. ``found`` is a written table."""
    hit = _lines(docs).join(found, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return hit.groupBy("row").agg(F.collect_set("place").alias("drop"))


def without_boilerplate(docs: DataFrame, sites: int = SITES, dropped: str | None = None) -> DataFrame:
    """The documents without cross-site lines; ``n_chars`` follows where there is such a column.
    ``dropped`` names a column for the number of lines taken out."""
    key, drop = fresh(docs, "row_key", "row_drop")
    found = stored(boilerplate(docs, sites), "lines-boilerplate")
    out = stored(removals(docs, found), "lines-removals").select(F.col("row").alias(key), F.col("drop").alias(drop))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), text)).join(out.hint("merge"), key, "left")  # one plan at every size: the removals grow with the documents
    # the lines are bound once, and the places left found by hashing: linear in the text
    left = lambda a: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col(drop))
    kept: Column = F.transform(F.array(F.split("text", "\n", -1)), lambda a: F.array_join(F.transform(left(a), lambda i: F.get(a, i)), "\n"))[0]
    new = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept)
    columns = {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    extra = [F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(dropped)] if dropped else []
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns], *extra)


def op10(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_chars, kept_sha256): each document after the removal."""
    dropped = fresh(docs, "n_dropped")[0]
    lines = fresh(docs, "n_lines")[0]
    text = F.coalesce("text", F.lit(""))
    rows = without_boilerplate(docs.withColumn(lines, F.size(F.split(text, "\n", -1)).cast("long")), sites, dropped)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lines).alias("n_lines"), F.col(dropped).alias("n_dropped"),
                       F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, source, text, i, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS t, line
  FROM (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
b AS (SELECT t, min(doc_id) AS keeper FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {SITES}),
k AS (SELECT l.doc_id, l.i, l.line, b.t IS NOT NULL AND l.doc_id <> b.keeper AS gone FROM l LEFT JOIN b ON l.t = b.t),
d AS (SELECT doc_id, count(*) AS total, sum(gone::INT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS rest FROM k GROUP BY doc_id)
SELECT doc_id, total AS n_lines, n_dropped::BIGINT AS n_dropped, length(rest)::BIGINT AS kept_chars, sha256(rest) AS kept_sha256 FROM d
"""
