import random
import re

import numpy as np
import pytest
import xxhash

from surgelens.llm import line_spread, near_texts, repetition, simhash_bk
from surgelens.llm.common import stored
from surgelens.llm.components import components
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, size=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in (np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius) + i + 1).tolist():
            x, y = find(i), find(j)
            top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprints_and_components(spark, tiny):
    from surgelens.llm.queries import QUERIES
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    for got, rows in ((QUERIES["op3_simhash"](spark, tiny), [(r.doc_id, r.text) for r in docs]), (simhash_bk.op3(cases.documents(spark)), [r[:2] for r in cases.rows()])):
        prints = [plain_print(t) for _, t in rows]
        of = groups(prints)
        least = {}
        for (i, _), g in zip(rows, of):
            if i is not None:
                least[g] = min(i, least.get(g, i))
        want = [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, of)]
        assert cases.keyed(got.collect()) == cases.keyed(want)


def test_tree_follows_only_edges_within_the_radius():
    r = random.Random(1)
    tree, held = None, []
    for _ in range(400):
        x = (held[0] if held and r.random() < 0.7 else 0) ^ sum(1 << r.randrange(64) for _ in range(r.randrange(9)))
        if tree:
            assert sorted(tree.prints[i] for i in tree.within(x, 3)) == sorted(p for p in held if (p ^ x).bit_count() <= 3)
            tree.add(x)
        else:
            tree = simhash_bk.BKTree(x)
        held.append(x)


def test_hot_shards_lose_no_link(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 3, dtype=np.uint64)
    many = {int(base[k % 3]) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for k in range(700)} | {int(x) for x in r.integers(0, 2**63, 300, dtype=np.uint64)}
    prints = np.array(sorted(many), np.uint64)
    df = stored(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), "prints")
    root = {e.node: e.root for e in components(simhash_bk.links(df, shard=8)).collect()}
    got = {}
    for x, g in zip(prints.view(np.int64).tolist(), groups(prints)):
        got.setdefault(g, set()).add(root.get(x, x))
    assert all(len(s) == 1 for s in got.values()) and len({x for s in got.values() for x in s}) == len(got)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = simhash_bk.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = cases.rows()
    of = groups([plain_print(r[1]) for r in rows])
    got = kept.collect()
    assert len(got) == len(set(of))
    least = {}
    for r, g in zip(rows, of):
        least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert cases.keyed((r.doc_id,) for r in got) == cases.keyed((None if n else i,) for n, i in least.values())
    assert simhash_bk.one_of_each(cases.empty(spark)).count() == 0 and simhash_bk.op3(cases.empty(spark)).count() == 0


def plain_near(texts, similarity=0.8):
    """Group numbers by brute force: Jaccard similarity of five-word shingles; wordless texts are one group."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def best_rows(rows, of):
    best = {}
    for r, g in zip(rows, of):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def edited(words, r, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("chunk", [near_texts.CHUNK, 4])
def test_near_texts_against_brute_force(spark, chunk):
    r, rows = random.Random(5), []
    for base in range(12):  # groups of edited copies, from all alike to hardly alike, one of them large
        words = [f"w{base}x{r.randrange(500)}" for _ in range(150)]
        rows += [(len(rows) + k, edited(words, r, r.randrange(7))) for k in range(60 if base == 0 else 6)]
    rows += [(7_000 + k, rows[k][1].upper().replace(" ", "\n")) for k in range(0, 100, 3)] + [(8_000 + k, edited(["tiny", "text"], r, 1)) for k in range(4)]
    rows += [(None, rows[5][1]), (None, None), (9_001, ""), (9_002, " \t "), (9_003, "one two three"), rows[3]]
    got = near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk).collect()
    assert cases.keyed(got) == cases.keyed(best_rows(rows, plain_near([t for _, t in rows])))
    assert 15 < len(got) < 0.7 * len(rows)


def runs(r):
    """Copies over the similarity of which one holds a run of a separator or of a phrase, so that their fingerprints lie far apart."""
    rows = []
    for n, run in ((1_000, ". " * 60), (1_000, ". " * 100), (300, "- " * 40), (1_000, "read more here " * 40)) * 3:
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:n // 2], run, *words[n // 2:]]))]
    return rows


@pytest.mark.parametrize("chunk", [near_texts.CHUNK, 1])
def test_near_texts_with_runs_in_one_copy(spark, chunk):
    rows = runs(random.Random(9))
    assert sum((simhash_bk.fingerprint(a) ^ simhash_bk.fingerprint(b)).bit_count() > 24 for (_, a), (_, b) in zip(rows[::2], rows[1::2])) > 6
    got = near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk).collect()
    assert cases.keyed(got) == cases.keyed(best_rows(rows, plain_near([t for _, t in rows]))) == cases.keyed(rows[::2])


@pytest.mark.parametrize("limits", [(near_texts.FEW, near_texts.MANY), (10**9, 0), (0, 10**9)])
@pytest.mark.parametrize("apart", [False, True])
def test_all_members_of_a_shard_are_compared(monkeypatch, limits, apart):
    monkeypatch.setattr(near_texts, "FEW", limits[0])
    monkeypatch.setattr(near_texts, "MANY", limits[1])
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 4, 40, 300)]
    rows = [(k // 4 % 2, k, np.union1d(b[: len(b) - int(r.integers(0, 1 + len(b) // 8))], r.integers(0, 2**63, int(r.integers(0, 1 + len(b) // 8)), dtype=np.uint64))) for k, b in enumerate(base * 12)]
    rows.sort(key=lambda x: x[0])
    edges = near_texts.shard_links(rows, apart)
    sets = {k: set(h.tolist()) for _, k, h in rows}
    side = {k: s for s, k, _ in rows}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and (not apart or side[a] != side[b]) for a, b in edges)
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in edges:
        assert find(a) != find(b)
        top[find(a)] = find(b)
    assert edges and all(find(a) == find(b) for a in sets for b in sets
                         if (not apart or side[a] != side[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_near_texts_of_awkward_and_empty_tables(spark):
    docs, rows = cases.documents(spark), cases.rows()
    kept = near_texts.one_of_each(docs)
    assert kept.columns == docs.columns
    assert cases.keyed((k.doc_id, k.text) for k in kept.collect()) == cases.keyed(x[:2] for x in best_rows(rows, plain_near([x[1] for x in rows])))
    assert near_texts.one_of_each(cases.empty(spark)).count() == 0


def test_pairs_at_the_bound_share_a_band():
    r, missed, n = np.random.default_rng(3), 0, 300
    for _ in range(n):  # 80 of 100 hashes in common
        h = r.integers(0, 2**63, 100, dtype=np.uint64)
        a, b = np.sort(h[:90]), np.sort(h[10:])
        assert near_texts.alike(a, b)
        missed += not set(near_texts.bands(a)) & set(near_texts.bands(b))
    assert missed <= 3


def plain_lines(rows, sites):
    sources, keeper, trim = {}, {}, lambda x: x.strip(" \t\n\x0b\x0c\r")
    for i, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            if trim(line):
                sources.setdefault(trim(line), set()).add(source)
                if i is not None:
                    keeper[trim(line)] = min(i, keeper.get(trim(line), i))
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None))
            continue
        keep = [x for x in text.split("\n") if not (trim(x) and len(sources[trim(x)] - {None}) >= sites and keeper.get(trim(x)) != i)]
        out.append((i, "\n".join(keep)))
    return out


@pytest.mark.parametrize("sites", [1, 2, 4])
def test_lines_on_many_sites_go(spark, sites):
    docs = cases.documents(spark)
    got = line_spread.without_boilerplate(docs, sites)
    assert got.columns == docs.columns
    rows = got.collect()
    assert cases.keyed((r.doc_id, r.text) for r in rows) == cases.keyed(plain_lines(cases.rows(), sites))
    assert all(r.n_chars is None or r.text is None or len(r.text) == r.n_chars or r.n_chars in (20, 40) for r in rows)
    assert line_spread.op10(cases.empty(spark)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * n + k, f"line on {n} sites\nown {n} {k}", "en", f"s{k}", 0) for n in range(1, 40) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for sites in (3, 20):  # few registers make the sketch rough
        found = {r.keeper // 100 for r in line_spread.boilerplate(docs, sites, log_registers=4).collect()}
        assert found == set(range(sites, 40))


def plain_measures(text):
    words = WORD.findall(text or "")
    count, inside = {}, set()
    for i in range(len(words) - 7):
        count.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in count.values():
        if len(at) > 1:
            for i in at:
                inside.update(range(i, i + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    cover = {}
    for n in repetition.MAX_COVERAGE:
        first, of = set(), set()
        for i in range(len(words) - n + 1):
            w = tuple(words[i:i + n])
            if w in first:
                of.update(range(i, i + n))
            first.add(w)
        cover[n] = sum(len(words[i]) for i in of)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), cover


def test_repetition_measures(spark, tiny):
    from surgelens.llm.queries import QUERIES
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    for got, rows in ((QUERIES["op6_repetition"](spark, tiny), [(r.doc_id, r.text) for r in docs]), (repetition.op6(cases.documents(spark)), [r[:2] for r in cases.rows()])):
        want = []
        for i, t in rows:
            *base, cover = plain_measures(t)
            want.append((i, *base, base[0] < 20 or 100 * base[4] > 30 * base[0], *cover.values()))
        got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, *[r[f"coverage_{n}"] for n in cover], r.kept) for r in got.collect()]
        assert cases.keyed(g[:-1] for g in got) == cases.keyed(want)
        assert not any(g[-1] for g in got if g[6])
    kept = repetition.keep_good(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    assert repetition.keep_good(cases.empty(spark)).count() == 0 and repetition.op6(cases.empty(spark)).count() == 0


def test_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = repetition.op6(docs).join(labels, "doc_id").where("n_words >= 20").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.03


def test_pipeline_links_by_fingerprints_and_by_sets(spark):
    """A phrase that both texts repeat gives them one fingerprint, whatever their few other words; copies with a run in one
    of them have fingerprints far apart."""
    import corpus_pipeline
    phrase = "red green blue " * 40
    rows = [(1, phrase + " ".join(f"w{k}" for k in range(12))), (2, phrase + " ".join(f"v{k}" for k in range(12))), (3, "words of their own stand here"), (3, "words of their own stand here")]
    assert (simhash_bk.fingerprint(rows[0][1]) ^ simhash_bk.fingerprint(rows[1][1])).bit_count() <= 3
    assert not near_texts.alike(near_texts.shingle_set(rows[0][1]), near_texts.shingle_set(rows[1][1]))
    far = [(i + 10, t) for i, t in runs(random.Random(9))[:4]]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows + far, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 10, 12]
