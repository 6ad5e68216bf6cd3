"""Personal data by patterns and weak supervision, in DataFrame and SQL functions throughout.

Base kinds are found by pattern and check. A match's place follows from the lengths of the gaps (split)
and matches (extract all) before it, so a document's spans are one expression over its row. Patterns are possessive and
start at the edge of a run, which finds the same matches as the plain form in linear time.

The added kind ``secret`` is weakly supervised. Candidates are long runs with a digit in them. Labelers by
pattern, gazetteer of cue words and context vote for, against or not at all. Expectation-maximisation over
the table of vote patterns estimates each labeler's reliability without any label, and with the
resulting probabilities as soft labels a naive Bayes span classifier is fitted on votes and
span features. Its log-odds are sums of table entries, again one expression. Vote patterns and
features take a fixed number of values, so the counts that reach the driver have a bound whatever the corpus.

Rows: null and empty texts have no spans; a null doc_id stays null; repeated rows get equal spans, and count as often in the
fit; an empty table gives no rows and fits nothing; further columns are ignored by ``op8`` and kept by ``masked``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelens.llm.common import fresh, stored, text_rows

KINDS = ("email", "ip", "card", "phone", "secret")
SPAN = "array<struct<s:int,k:int,e:int>>"
#: the patterns of the base kinds; \G keeps a run that continues right after a match
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must hold for a pattern to be tried, and the check of a match m
GUARDS = {"email": "instr({t}, '@') > 0", "ip": r"{t} RLIKE '[0-9]\\.[0-9]'", "card": "{t} RLIKE '[0-9][0-9 -]{{12}}'", "phone": "instr({t}, '+') > 0"}
DIGITS = "regexp_replace({m}, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": r"forall(split({m}, '\\.'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND cast(concat('0', trim(LEADING '0' FROM p)) AS int) <= 255)",
    "card": f"length({DIGITS}) BETWEEN 14 AND 19 AND luhn_check({DIGITS})",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}
#: candidates of the weakly supervised kind, and how much text before one is its context
CANDIDATE, CONTEXT = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+", 24
CUES = "token|secret|passw|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|auth"
HARMLESS = "page|figure|section|chapter|isbn|issn|version|doi|order|serial|model"
#: votes of the labelers over y.m (the run) and y.c (lower-case text before): 1 for, 0 against, -1 none
LABELERS = {
    "hexadecimal": "CASE WHEN y.m RLIKE '^[0-9]+$' THEN 0 WHEN y.m RLIKE '^[0-9a-fA-F]{16,}$' THEN 1 ELSE -1 END",
    "mixture": "CASE WHEN 100 * length(regexp_replace(y.m, '[^0-9]', '')) BETWEEN 20 * length(y.m) AND 80 * length(y.m) THEN 1 ELSE 0 END",
    "cue": rf"CASE WHEN y.c RLIKE '({CUES})' THEN 1 WHEN y.c RLIKE '({HARMLESS})[^a-z]*$' THEN 0 ELSE -1 END",
    "assignment": "CASE WHEN y.c RLIKE '[=:] ?[\"\\']?$' THEN 1 ELSE 0 END",
    "length": "CASE WHEN length(y.m) >= 24 THEN 1 WHEN length(y.m) < 16 THEN 0 ELSE -1 END",
}
#: span features with few values
FEATURES = {
    "size": "cast(least(length(y.m) div 8, 8) AS int)",
    "digits": "cast(10 * length(regexp_replace(y.m, '[^0-9]', '')) div length(y.m) AS int)",
    "signs": "cast(y.m RLIKE '[a-z]' AS int) + 2 * cast(y.m RLIKE '[A-Z]' AS int) + 4 * cast(y.m RLIKE '[_-]' AS int)",
}
ROUNDS, SMOOTH = 40, 0.5
#: matches of a chunk of a text
CHUNK = 128


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _chunks(items: str, body: str) -> str:
    """SQL: bind p to a list and c to its chunks of CHUNK items, then evaluate body. A list that grows by one item
    copies itself each time, so nothing is gathered beyond a chunk; chunks are laid end to end afterwards."""
    cut = f"transform(sequence(0, (size(p) - 1) div {CHUNK}), j -> slice(p, j * {CHUNK} + 1, {CHUNK}))"
    return f"transform(transform(array({items}), p -> {cut}), c -> {body})[0]"


def _walk(t: str, pattern: str, guard: str, item: str, keep: str, kind: str) -> str:
    """Items of all matches of a pattern in text t; over a (place), x.g (gap before), x.m (match).

    Places come from a running sum in two levels: chunk lengths first, then a walk within each chunk."""
    rx = _sql(pattern)
    gaps = f"zip_with(split({t}, '{rx}', -1), array_append(regexp_extract_all({t}, '{rx}', 0), cast(NULL AS string)), (g, m) -> struct(g, m))"
    long = "transform(c, q -> aggregate(q, 0, (n, x) -> n + length(x.g) + coalesce(length(x.m), 0)))"
    inside = f"""aggregate(q, struct(at AS at, cast(array() AS {kind}) AS out),
      (a, x) -> struct(a.at + length(x.g) + coalesce(length(x.m), 0) AS at, CASE WHEN x.m IS NOT NULL AND ({keep}) THEN array_append(a.out, {item}) ELSE a.out END AS out), a -> a.out)"""
    starts = f"transform(array({long}), l -> transform(l, (n, i) -> aggregate(slice(l, 1, i), 0, (s, y) -> s + y)))[0]"
    return f"CASE WHEN {guard} THEN {_chunks(gaps, f'flatten(zip_with(c, {starts}, (q, at) -> {inside}))')} ELSE cast(array() AS {kind}) END"


def base_spans(t: str = "text") -> str:
    """SQL of the base spans of a text: structs of start, kind number and end, in order."""
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        item = f"struct(a.at + length(x.g) AS s, {k} AS k, a.at + length(x.g) + length(x.m) AS e)"
        parts.append(_walk(t, PATTERNS[kind], GUARDS[kind].format(t=t), item, CHECKS[kind].format(m="x.m"), SPAN))
    return f"array_sort(concat({', '.join(parts)}))"


def candidates(t: str = "text") -> str:
    """SQL of the candidate spans with votes and features."""
    values = ", ".join(f"{sql} AS {n}" for n, sql in {**LABELERS, **FEATURES}.items())
    kind = "array<struct<s:int,e:int,m:string,c:string>>"
    item = f"struct(a.at + length(x.g) AS s, a.at + length(x.g) + length(x.m) AS e, x.m AS m, lower(right(x.g, {CONTEXT})) AS c)"
    found = _walk(t, CANDIDATE, f"{t} RLIKE '[0-9]'", item, "true", kind)
    return f"transform({found}, y -> struct(y.s AS s, y.e AS e, {values}))"


def em(patterns: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability of label 1 for each vote pattern, by expectation-maximisation over the labelers'
    rates for each true label; it starts from the share of votes for. ``patterns`` has their counts."""
    q = {}
    for votes in patterns:
        cast = [v for v in votes if v >= 0]
        q[votes] = (sum(cast) + 0.5) / (len(cast) + 1)
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (sum(n * q[v] for v, n in patterns.items()) + SMOOTH) / (total + 2 * SMOOTH)
        rates = []
        for i in range(len(next(iter(patterns), ()))):
            table = {(y, x): SMOOTH for y in (0, 1) for x in (-1, 0, 1)}
            for v, n in patterns.items():
                table[1, v[i]] += n * q[v]
                table[0, v[i]] += n * (1 - q[v])
            sums = {y: sum(table[y, x] for x in (-1, 0, 1)) for y in (0, 1)}
            rates.append({k: w / sums[k[0]] for k, w in table.items()})
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(r[1, x] / r[0, x]) for r, x in zip(rates, v))
            q[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return q


def fit(counts: list[tuple[tuple[int, ...], float]]) -> tuple[float, list[dict[int, float]]] | None:
    """Naive Bayes log-odds tables over votes and features, from soft labels; None without candidates."""
    if not counts:
        return None
    width, votes = len(LABELERS), defaultdict(float)
    for values, n in counts:
        votes[values[:width]] += n
    q = em(dict(votes))
    yes = sum(n * q[v[:width]] for v, n in counts)
    no = sum(n * (1 - q[v[:width]]) for v, n in counts)
    tables = []
    for i in range(len(counts[0][0])):
        seen = defaultdict(lambda: [SMOOTH, SMOOTH])
        for v, n in counts:
            p = q[v[:width]]
            seen[v[i]][1] += n * p
            seen[v[i]][0] += n * (1 - p)
        size = SMOOTH * len(seen)
        tables.append({x: math.log(w[1] / (yes + size)) - math.log(w[0] / (no + size)) for x, w in seen.items()})
    return math.log((yes + SMOOTH) / (no + SMOOTH)), tables


def chosen(model: tuple[float, list[dict[int, float]]] | None, y: str = "y") -> str:
    """SQL: does the classifier take candidate y?"""
    if model is None:
        return "false"
    base, tables = model
    sums = [f"CASE {y}.{name} {' '.join(f'WHEN {x} THEN {w!r}D' for x, w in sorted(t.items()))} ELSE 0D END" for name, t in zip([*LABELERS, *FEATURES], tables)]
    return f"({base!r}D + {' + '.join(sums)}) > 0D"


def analysed(docs: DataFrame) -> DataFrame:
    """(doc_id, base, cand): spans and candidates of each document, without its text; a written table."""
    sql = candidates()
    return stored(text_rows(docs).select("doc_id", F.expr(base_spans()).alias("base"), F.expr(sql).alias("cand")), "pii-spans")


def learn(found: DataFrame) -> tuple[float, list[dict[int, float]]] | None:
    names = [*LABELERS, *FEATURES]
    rows = found.where("size(cand) > 0").select(F.explode("cand").alias("y")).groupBy(*[F.col(f"y.{n}").alias(n) for n in names]).agg(F.count("*").alias("n"))
    return fit(sorted((tuple(r[:-1]), float(r[-1])) for r in rows.collect()))  # values of fixed range


def _all_spans(model, base: str = "base", cand: str = "cand") -> Column:
    """Base spans and the chosen candidates that touch none of them, in order."""
    # each chunk of candidates is held against the base spans of its own stretch of the text only
    near = f"transform(array(struct(get(q, 0).s AS lo, array_max(transform(q, y -> y.e)) AS hi)), r -> filter({base}, b -> b.s < r.hi AND r.lo < b.e))[0]"
    free = f"transform(array({near}), w -> filter(q, y -> NOT exists(w, b -> b.s < y.e AND y.s < b.e)))[0]"
    added = _chunks(f"filter({cand}, y -> {chosen(model)})", f"flatten(transform(c, q -> {free}))")
    return F.expr(f"array_sort(concat({base}, transform({added}, y -> struct(y.s AS s, {KINDS.index('secret')} AS k, y.e AS e))))")


def _told(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(get(array({names}), x.k), ':', x.s, ':', x.e)), ',')")


def op8(docs: DataFrame) -> DataFrame:
    found = analysed(docs)
    rows = found.select("doc_id", "base", _all_spans(learn(found)).alias("every"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(_told("base"), 256).alias("base_sha256"), _told("every").alias("spans"))


def _marked(t: str, spans: str) -> str:
    """SQL of text t with its spans replaced; spans that overlap become one mark, of the first. Each chunk of
    spans works on its own part of the text, up to the furthest end so far."""
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    tops = "transform(c, q -> array_max(transform(q, x -> x.e)))"
    froms = f"transform(array({tops}), l -> transform(l, (n, i) -> struct(coalesce(array_max(slice(l, 1, i)), 0) AS f, greatest(coalesce(array_max(slice(l, 1, i)), 0), n) AS u)))[0]"
    inside = f"""aggregate(q, struct(b.f AS at, cast(array() AS array<string>) AS out),
      (a, x) -> struct(greatest(a.at, x.e) AS at, CASE WHEN x.s >= a.at THEN concat(a.out, array(substring(w, a.at - b.f + 1, x.s - a.at), get(array({names}), x.k))) ELSE a.out END AS out), a -> array_join(a.out, ''))"""
    part = f"transform(array(substring({t}, b.f + 1, b.u - b.f)), w -> {inside})[0]"
    body = f"array_join(zip_with(c, {froms}, (q, b) -> {part}), '')"
    rest = f"substring({t}, array_max(transform({spans}, x -> x.e)) + 1)"
    return f"CASE WHEN size({spans}) = 0 THEN {t} ELSE concat({_chunks(spans, body)}, {rest}) END"


def masked(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced by their kind in angle brackets; ``n_chars`` follows.

    A base pattern that ran on into a neighbour and failed its check can match once the neighbour
    is masked, so base spans are looked for again in the texts that had any."""
    model = learn(analysed(docs))
    base, cand, every, first, again, new = fresh(docs, "spans_base", "spans_cand", "spans_every", "spans_text", "spans_again", "spans_new")
    rows = docs.withColumns({base: F.expr(base_spans("coalesce(text, '')")), cand: F.expr(candidates("coalesce(text, '')"))})
    rows = rows.withColumn(every, _all_spans(model, f"`{base}`", f"`{cand}`")).drop(base, cand)
    rows = rows.withColumn(first, F.expr(_marked("text", f"`{every}`")))
    rows = rows.withColumn(again, F.expr(f"CASE WHEN size(`{every}`) > 0 THEN {base_spans(f'`{first}`')} ELSE cast(array() AS {SPAN}) END"))
    rows = rows.withColumn(new, F.expr(_marked(f"`{first}`", f"`{again}`")))
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size(every) == 0, F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
