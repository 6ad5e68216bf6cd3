import hashlib
import io
import re
import zlib

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from surgelens.llm import permutation_index, pii_votes, quality_gam, warc_bundles
from surgelens.llm.common import stored
from tests.llm import cases
from tests.llm.test_dedup import best_rows, plain_lines, plain_near
from tests.llm.test_tokens import packed_rightly, plain_ids


# quality model

def test_quality_on_held_out_rows(spark):
    from surgelens.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality_gam"](spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(judged) > 40 and sum(p == y for p, y in judged) / len(judged) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "good plain words " * 9 if i % 2 else "bad!! " * 20) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (quality_gam.op1(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect() for x in (labels, turned))
    assert cases.keyed(a) == cases.keyed(b)
    assert all(r.predicted == r.doc_id % 2 for r in a)


def test_quality_of_awkward_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(0, 0), (12, 1), (12, 0), (12, None), (None, 1), (15, 0), (39, 1), (18, 0), (21, 0), (42, 1)], "doc_id long, quality int")
    rows = quality_gam.op1(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    for none in (labels.where("false"), labels.where("quality = 1")):
        assert {round(r.score, 6) for r in quality_gam.op1(docs, none).collect()} <= {0.5, 1.0}
    assert quality_gam.op1(cases.empty(spark), labels).count() == 0


def test_pairs_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4_000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


# WARC

PAGES = [(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (9, None, "x" * 1000), (None, "http://n", "x" * 1000), (3, "u\r\nX: y", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://é", ""),
         (7, "http://g", "é" * 500), (8, "http://h", "é" * 500), (9, None, "x" * 1000), (None, None, "only ids that are null " * 60), (None, "b", "only ids that are null " * 60), (11, "http://long", "long page " * 200_000)]


def test_archives_come_back(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("n", "digest", "response", "d", "file")])
    want, largest = [], {}
    for i, _, h in PAGES:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    for i, _, h in PAGES:
        raw = (h or "").encode()
        top = largest.get(h or "") if len(raw) >= 1000 else i
        refers = top if top is not None and top != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert cases.keyed(warc_bundles.op5(spark, pages).collect()) == cases.keyed(want)
    assert warc_bundles.op5(spark, pages.where("false")).count() == 0


def test_repeated_rows_are_each_reached_by_their_own_id(spark, tmp_path):
    html = "same page " * 200
    rows = [(5, "http://a", html)] * 3 + [(9, "http://b", html), (4, "http://c", "short")] + [(4, "http://c", "short")] * 2 + [(7, "http://d", html)]
    path = str(tmp_path / "w")
    warc_bundles.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    names, found = [], []
    for f in (tmp_path / "w").glob("part-*"):
        reader = warc_bundles.BundleReader(f.read_bytes())
        assert len(reader.where) == len(reader.order) and warc_bundles.parsed(next(iter(reader)))[0]["WARC-Type"] == "warcinfo"
        for name in reader.where:
            h, body = warc_bundles.parsed(reader.one(name))
            assert h["WARC-Record-ID"] == name
            names.append(name)
            if h["WARC-Type"] != "warcinfo":
                found.append((int(h["X-Page-Id"]), h["WARC-Type"], h.get("WARC-Refers-To"), h.get("WARC-Refers-To-Target-URI"), body.decode()))
    assert len(names) == len(set(names)) and len(found) == len(rows)
    digest = hashlib.sha1(html.encode()).hexdigest()
    target = warc_bundles.record_id(9, "http://b", digest, "")
    again = [x for x in found if x[1] == "revisit"]
    assert sorted(x[0] for x in again) == [5, 5, 5, 7] and {x[3] for x in again} == {"http://b"} and {x[4] for x in again} == {""}
    assert {x[2] for x in again} == {target} and target in names
    assert [x[4] for x in found if x[0] == 9] == [html] and [x[4] for x in found if x[0] == 4] == ["short"] * 3


def test_bundles_are_seekable_and_plain(tmp_path):
    bundle, records = warc_bundles.Bundle(500), []
    for i in range(50):
        body = b"p\r\n\r\n" * i
        records.append(warc_bundles.record(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), len(body), 9 if i % 3 == 0 else None))
        bundle.add(*records[-1])
    raw = bundle.close()
    reader = warc_bundles.BundleReader(raw)
    assert len(reader.frames) > 5 and all(reader.one(n) == r for n, r in records) and list(reader) == [r for _, r in records]
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(r for _, r in records)
    fields, payload = warc_bundles.parsed(records[4][1])
    assert fields["WARC-Type"] == "response" and payload == b"p\r\n\r\n" * 4


# personal data

def test_a_text_of_many_matches(spark):
    """Places beyond one chunk, and in time that grows with the text."""
    n = 30_000
    parts = [f"u{i}@m{i % 7}.example.com" if i % 3 else f"10.0.{i % 256}.1" for i in range(n)] + ["tail"]
    df = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    row = pii_votes.op8(df).first()
    assert (row.n_email, row.n_ip) == (n - n // 3, n // 3) and row.base_sha256 == hashlib.sha256(",".join(plain_spans_of(parts)).encode()).hexdigest()
    assert pii_votes.masked(df).first().text == " ".join(["<EMAIL>" if i % 3 else "<IP>" for i in range(n)] + ["tail"])


def plain_spans_of(parts):
    at, out = 0, []
    for p in parts[:-1]:
        out.append(f"{'email' if '@' in p else 'ip'}:{at}:{at + len(p)}")
        at += len(p) + 1
    return out


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(t):
    out = []
    for k, (kind, rx) in enumerate(PLAIN.items()):
        if kind == "email" and t.count("@") > 100:
            continue  # the plain pattern takes long there; these texts hold no address
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def told(spans):
    return ",".join(f"{pii_votes.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_the_plain_patterns(spark, tiny):
    import random

    from surgelens.llm.queries import QUERIES
    r = random.Random(4)
    bits = ["@", "a.b", "@x.co", ".", "1", "23", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+1 (", "555) 123-4567", "\n", "255.1.", "0.0.1", "300", "é", "😀", "_", "%"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["1" * 3000, "a" * 30_000, "1." * 3000, "+" * 2000]
    fuzz = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    for got, rows in ((pii_votes.op8(fuzz), list(enumerate(texts))), (QUERIES["op8_pii_votes"](spark, tiny), [(d.doc_id, d.text) for d in docs]), (pii_votes.op8(cases.documents(spark)), [x[:2] for x in cases.rows()])):
        want = []
        for i, t in rows:
            s = plain_spans(t or "")
            want.append((i, *(sum(k == n for _, k, _ in s) for n in range(4)), hashlib.sha256(told(s).encode()).hexdigest()))
        got = got.collect()
        assert cases.keyed(tuple(g)[:6] for g in got) == cases.keyed(want)
        texts_of = {}
        for i, t in rows:
            texts_of.setdefault(i, []).append(t or "")
        for g in got:  # base spans stay, in order, and added ones touch none of them
            spans = [(int(x.split(":")[1]), pii_votes.KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in g.spans.split(",") if x]
            assert spans == sorted(spans)
            assert any([x for x in spans if x[1] < 4] == plain_spans(t) for t in texts_of[g.doc_id])


def test_secrets_are_found_without_labels(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii_votes.op8(spark.read.parquet(f"{d}/documents.parquet")).collect()
    found = sum(re.fullmatch("[0-9a-fA-F]{40}", texts[r.doc_id][int(s.split(":")[1]):int(s.split(":")[2])]) is not None for r in rows for s in r.spans.split(",") if s.startswith("secret"))
    there = sum(len(re.findall(r'(?i)token = "[0-9a-f]{40}"', t)) for t in texts.values())
    added = sum(s.startswith("secret") for r in rows for s in r.spans.split(","))
    assert there and found >= 0.95 * there and added <= 1.1 * there


def test_em_tells_reliable_labelers():
    r = np.random.default_rng(1)
    y = r.random(4_000) < 0.4
    votes = np.stack([np.where(r.random(4_000) < a, y, ~y) for a in (0.95, 0.9, 0.85, 0.55)], axis=1).astype(int)
    votes[r.random(votes.shape) < 0.2] = -1
    patterns = {}
    for v in map(tuple, votes.tolist()):
        patterns[v] = patterns.get(v, 0) + 1
    q = pii_votes.em(patterns)
    assert np.mean([(q[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), y)]) > 0.93


def test_masked_documents_hold_no_spans(spark):
    docs = cases.documents(spark)
    out = pii_votes.masked(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count() and not any(plain_spans(r.text or "") for r in rows)
    assert any(r.text == "write to <EMAIL> or <PHONE>, host <IP>, card <CARD>" and r.n_chars == len(r.text) for r in rows)
    assert pii_votes.masked(cases.empty(spark)).count() == 0 and pii_votes.op8(cases.empty(spark)).count() == 0


# neighbours

def test_neighbours_and_recall(spark):
    from pyspark.sql import functions as F

    from surgelens.llm.queries import QUERIES
    d = "/root/testdata/sf0.1"
    got = {}
    for r in QUERIES["op9_permutation_index"](spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (v * v[i]).sum(axis=1)
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[ids[i]]
        assert [m[0] for m in mine] == list(range(1, 21)) and all(np.isclose(m[2], s[m[1]], rtol=0, atol=1e-12) for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len({m[1] for m in mine} & set(ids[best].tolist()))
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hits / 20 / len(got) >= 0.9
    del F


def test_the_share_is_the_same_at_every_size(spark):
    for size in (120, 500, 2_000, 16_384):
        assert permutation_index.reranked(size, permutation_index.SHARE, 20) == int(np.ceil(permutation_index.SHARE * size)) + 1
    assert permutation_index.reranked(30, permutation_index.SHARE, 20) == 41
    from surgelens.llm.queries import QUERIES
    d, got, hits = "/root/testdata/sf0.01", {}, 0
    for r in QUERIES["op9_permutation_index"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits / 20 / len(got) >= 0.95


def test_neighbours_of_awkward_vectors(spark):
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(-i % 5)]) for i in range(70)]
    rows += [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [nan, 1.0, 1.0]), (180, [inf, 1.0, 1.0]), (200, [None, 1.0, 1.0]), (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [0.0, 9.0, 9.0]), (33, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("shard", "block", "o", "score")])
    got = permutation_index.search(df, F.col("vec_id") % 20 == 0, n=6, shard=16, block=2).collect()
    fine = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and abs(x) < inf for x in v) and any(v)]
    want = []
    for q in (0, 20, 40, 60):
        x = min(v for i, v in fine if i == q)
        near = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in fine if i != q)[:6]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert cases.keyed((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == cases.keyed(want)
    assert permutation_index.op9(df.where("false")).count() == 0
    few = permutation_index.search(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0, n=20).collect()
    assert len(few) == 2


def test_common_vectors_do_not_crowd_out_smaller_ids(spark):
    from pyspark.sql import functions as F
    r = np.random.default_rng(3)
    same = [0.6, 0.8, 0.0, 0.0]
    rows = [(i, same if i % 2 else r.normal(size=4).tolist()) for i in range(6_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.search(df, F.col("vec_id") == 1, n=20, share=0.01, shard=3_000).orderBy("rank").collect()
    assert [g.vec_id for g in got if abs(g.score - 1) < 1e-12][:5] == [3, 5, 7, 9, 11]


# pipeline

def plain_pipeline(rows):
    from surgelens.llm.repetition import measure
    rows = [r for r in rows if measure(r[1] or "")[-1]]
    rows = [(r[0], t, *r[2:]) for r, (_, t) in zip(rows, plain_lines(rows, 4))]
    return best_rows(rows, plain_near([r[1] for r in rows]))


@pytest.mark.parametrize("which", ["tiny", "awkward"])
def test_pipeline_stage_by_stage(spark, tiny, which):
    if which == "tiny":
        docs = spark.read.parquet(f"{tiny}/documents.parquet")
        rows = [tuple(r) for r in docs.collect()]
    else:
        docs, rows = cases.documents(spark), cases.rows()
    columns, kept = docs.columns, None
    for (name, stage), more in zip(corpus_pipeline.STAGES, [*[True] * 4, False]):
        before, docs = docs, stored(stage(spark, docs, tiny), "stage")
        assert not more or docs.columns == columns, name
        if name == "near dedup":
            kept = docs.collect()
    assert cases.keyed((r.doc_id, r.text) for r in kept) == cases.keyed(r[:2] for r in plain_pipeline(rows))
    assert not any(plain_spans(r.text or "") for r in before.collect())
    from surgelens.llm.word_encoder import WordEncoder, default_vocabulary
    tokenizer = WordEncoder(default_vocabulary()).tokenizer
    assert sum(r.length for r in docs.collect()) == sum(len(plain_ids(tokenizer, r.text, 0)) for r in before.collect())
    packed_rightly(docs.collect(), 2048)


def test_pipeline_of_an_empty_table(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
