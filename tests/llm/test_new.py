import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from surgelens.llm import cross_parsing, prefix_trie, whitening
from tests.llm import cases

# whitening


def spread(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.arange(1, 40.0) ** 2, np.r_[np.full(5, 3.0), np.full(4, 3.0 + 1e-10), np.linspace(0.1, 2, 12)],
                                    np.r_[1e-8, 1e-5, 1, 1, 1, 1e6], np.ones(7), np.r_[np.zeros(4), 2.0, 2.0 + 1e-6], np.array([5.0])])
def test_eigenvectors_to_double_precision(values):
    a = spread(values)
    e, x = whitening.eigenvectors(a)
    assert (np.diff(e) <= 1e-15 * abs(e).max()).all()
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * values.max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14 and np.abs(a @ x - x * e).max() <= 1e-14 * values.max()


def test_close_eigenvalues_are_told_apart():
    # a gap of 1e-9 is far below single precision; the cluster's own matrix finds the vectors
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(12) - 0.5 * (q.T @ q))
    values = np.r_[np.longdouble(1) + 1e-9 * np.arange(4)[::-1], np.linspace(0.1, 0.5, 8)[::-1]]
    a = ((q * values) @ q.T).astype(np.float64)
    _, x = whitening.eigenvectors(a)
    assert np.abs(np.abs((q.T @ x).astype(float)) - np.eye(12)).max() < 1e-5  # the matrix itself is only given to 1e-16 / gap


def brute_whitening(vectors):
    rows = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) and abs(c) < whitening.LIMIT for c in v)]
    sizes = defaultdict(int)
    for _, v in rows:
        sizes[len(v)] += 1
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    rows = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]) for i, v in rows if len(v) == dim]
    n, sums = len(rows), [sum(x[d] for _, x in rows) for d in range(dim)]
    y = np.array([[n * x[d] - sums[d] for d in range(dim)] for _, x in rows], object)
    return rows, n, y, (y.astype(np.float64) / n)


def test_whitening_of_rows(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((60, 10)) * np.arange(1, 11)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    vectors += [(100, None), (101, []), (102, [1.0] * 9 + [None]), (103, [1.0] * 9 + [float("nan")]), (104, [float("inf")] * 10), (105, [1.0, 2.0]), (106, [0.0] * 10), (None, [3.0] * 10)]
    vectors += [vectors[5], vectors[5], (107, [1e20] * 10)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "'x' AS v", "2 AS component", "3 AS whitened")
    got = whitening.op11(df).collect()
    rows, n, y, centred = brute_whitening(vectors)
    assert len(got) == 8 * len(rows) and {g.n for g in got} == {n}
    want = np.cov(centred.T, bias=True)
    e, x = np.linalg.eigh(want)
    e, x = e[::-1], x[:, ::-1]
    by_id = defaultdict(list)
    for g in got:
        by_id[g.vec_id, g.component].append(g)
    for k in range(8):
        w = centred @ x[:, k] / np.sqrt(e[k])
        sign = np.sign(np.dot(w[:60], [by_id[i, k + 1][0].whitened for i in range(60)]))
        for (i, _), value, dev in zip(rows, w * sign, y):
            g = by_id[i, k + 1][0]
            assert g.whitened == pytest.approx(value, rel=1e-9, abs=1e-10) and g.deviation == int((dev**2).sum())
            assert g.explained == pytest.approx(e[k] / np.trace(want), rel=1e-10) and g.identity_error < 1e-10
    assert len(by_id[5, 1]) == 3 and len(by_id[None, 1]) == 1


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert {(g.component, g.whitened, g.deviation, g.explained, g.identity_error) for g in whitening.op11(same).collect()} == {(k, 0.0, 0, 0.0, 0.0) for k in (1, 2, 3)}
    assert whitening.op11(same.where("false")).collect() == [] and whitening.op11(same.selectExpr("vec_id", "cast(null as array<float>) embedding")).collect() == []


def test_exact_integers_beyond_64_bits():
    x = np.array([[2**44, -(2**44)], [0, 1]])
    t = whitening.scaled(x, 2**30, (1, -1))
    assert t.dtype == object and t[0, 0] == 2**74 - 1 and whitening.squares(t) == [None, (2**30 + 1) ** 2 + 1]


# conversation trie

def plain_trie(rows):
    """(conv_id, depth) of each node -> the contract's values, by plain recursion over dictionaries."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        made[c] = tuple(base[:h] + own[h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        saved = (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved + sum(below[k][1] for k in kids[p]))
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_of_awkward_conversations(spark):
    r = np.random.default_rng(5)
    words = ["", None, "hi", "Été", "x" * 50, "same"]
    rows = [(int(c), int(t), ["user", "assistant", None][t % 3], words[r.integers(6)]) for c in range(40) for t in range(r.integers(1, 7))]
    rows += [(c, t, "user", "common") for c in range(100, 160) for t in range(9)]  # whole copies
    rows += [(7, None, "system", "no turn"), (7, None, None, None), (None, 1, "user", "nobody"), (-3, 0, "user", "negative"), (-5, 0, "user", "base of it"), (-5, 1, "user", "more")]
    rows += [(8, 2, "user", "again"), (8, 2, "user", "again"), (8, 2, "assistant", "tie"), (12, 0, None, None)]  # repeats and ties
    rows += [(201, t, "user", f"deep {t // 2}") for t in range(300)] + [(206, 0, "user", "turnless")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "'x' AS digest", "2 AS id")
    got = prefix_trie.op12(df).select(*TRIE_COLUMNS).collect()
    assert cases.keyed(got) == cases.keyed(plain_trie(rows))
    assert prefix_trie.op12(df.where("conv_id is null")).count() == 0


def test_contraction_of_any_tree(spark):
    r = np.random.default_rng(2)
    parent = [None] + [int(r.integers(max(0, i - 3), i)) for i in range(1, 400)] + [None, None, 401]  # deep and bushy, a lone root, and a small tree
    value = [int(v) for v in r.integers(0, 100, len(parent))]
    want = list(value)
    for i in reversed(range(len(parent))):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    kids = [parent.count(i) for i in range(len(parent))]
    tree = spark.createDataFrame([(i, p, k, v, 1) for i, (p, k, v) in enumerate(zip(parent, kids, value))], "id long, parent long, n_children long, a long, b long")
    got = {x.id: (x.a, x.b) for x in prefix_trie.totals(tree, ["a", "b"]).collect()}
    assert len(got) == len(parent) and all(got[i][0] == w for i, w in enumerate(want)) and got[0][1] == 400 and got[400][1] == 1 and got[401][1] == 2


def test_places_of_a_key_over_many_partitions(spark):
    from pyspark.sql import functions as F
    df = spark.range(5_000).select((F.col("id") % 10 < 7).cast("int").alias("k"), (F.col("id") * 7919 % 5_000).alias("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = prefix_trie.placed(df, "k", [F.col("x")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in (0, 1):
        xs = sorted(g.x for g in got if g.k == k)
        assert {(g.x, g.place) for g in got if g.k == k} == {(x, i + 1) for i, x in enumerate(xs)}


# language identification

def plain_phrases(sample, text, block):
    """Longest matches by plain substring search."""
    n = 0
    for a in range(0, len(text), block):
        part, at = text[a:a + block], 0
        while at < len(part):
            z = at + 1
            while z < len(part) and part[at:z + 1] in sample:
                z += 1
            at, n = z, n + 1
    return n


def test_phrases_are_longest_matches():
    r = np.random.default_rng(4)
    draw = lambda n, p: "".join(r.choice(list("abcd "), n, p=p))
    samples = cross_parsing.Samples(("one", "two"), (draw(600, [0.6, 0.1, 0.1, 0.1, 0.1]), draw(300, [0.1, 0.1, 0.6, 0.1, 0.1])), "abcd")
    parser = cross_parsing.Parser(samples)
    texts = [draw(n, [0.3, 0.2, 0.2, 0.2, 0.1]) for n in (1, 2, 30, 1_023, 1_024, 1_025, 3_000)] + ["", "zzz ab", "éé", "A B"]
    symbols = parser.symbols(texts)
    back = ["".join(" ?"[s == 0] if s < 2 else "abcd"[s - 2] for s in t.tolist()) for t in symbols]
    sample = ["".join(" ?"[s == 0] if s < 2 else "abcd"[s - 2] for s in t.tolist()) for t in parser.symbols(list(samples.texts))]
    got = parser.phrases(symbols)
    assert got.tolist() == [[plain_phrases(s, t, cross_parsing.BLOCK) for s in sample] for t in back]


def test_languages_on_held_out_rows(spark):
    from surgelens.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op13_cross_parsing"](spark, d).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(judged) > 200 and sum(judged) / len(judged) > 0.98


def test_held_out_languages_are_not_read(spark):
    rows = [(i, ("le chat est la " if i % 2 else "the cat is in the ") * (3 + i % 5), "fr" if i % 2 else "en") for i in range(80)]
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (cross_parsing.op13(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect() for x in (rows, turned))
    assert cases.keyed(a) == cases.keyed(b) and all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in a)


def test_languages_of_awkward_rows(spark):
    docs = cases.documents(spark)
    got = cross_parsing.op13(docs).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} <= {"en", "und"} and all(0 <= r.score <= 1 for r in got)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id != 12}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in got if r.doc_id in texts)
    assert {(r.lang_pred, r.score) for r in cross_parsing.op13(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {("und", 0.0)}
    assert cross_parsing.op13(cases.empty(spark)).count() == 0
