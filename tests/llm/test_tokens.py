import zlib

import numpy as np
import pytest

from surgelens.llm import best_fit, piece_bpe, token_planes
from surgelens.llm.word_encoder import WordEncoder, default_vocabulary
from tests.llm import cases


def plain_ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_vocabulary(), chunk_cap=50, part_cap=60)


def test_word_encoder_equals_the_library(encoder):
    import random
    r = random.Random(1)
    pool = [chr(i) for i in range(0x180)] + list("́̇İΣσς  　​﻿œ€’“한ﬁ①²😀") + [" "] * 60 + list("'sS'reLLtdm") * 5 + ["<|endoftext|>"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [t or "" for t in cases.TEXTS]
    assert encoder.fast
    for at in range(0, len(texts), 100):
        some = texts[at:at + 100]
        assert encoder.encode_many(some) == [encoder.plain(t) for t in some]


def test_planes_round_trip():
    r = np.random.default_rng(2)
    for kind in ("byte", "bit"):
        for n in (1, 7, 8, 1000):
            ids = r.integers(0, 2**32, n, dtype=np.uint32)
            assert (token_planes.from_planes(token_planes.to_planes(ids, kind), n, kind) == ids).all()
        ids = r.integers(0, 49_408, 10_001).astype("<u4")
        f = token_planes.PlaneFile(token_planes.encode_file(ids, [(5, 4_000), (None, 6_001)], 3, 4, block=512, kind=kind))
        assert (f.task, f.seq, f.n, f.lengths.tolist(), f.known.tolist()) == (3, 4, 10_001, [4_000, 6_001], [True, False])
        for a, b in ((0, 10_001), (511, 513), (700, 700), (9_999, 10_001)):
            assert (f.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_ids_come_back_from_the_files(spark, encoder, kind, tmp_path):
    docs = cases.documents(spark)
    token_planes.write_ids(docs, str(tmp_path / "f"), file_ids=3_000, block=256, kind=kind)
    got = token_planes.read_ids(spark, str(tmp_path / "f")).collect()
    want = []
    for r in cases.rows():
        ids = plain_ids(encoder.tokenizer, r[1], 1)
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
    assert cases.keyed((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == cases.keyed(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids_in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    known = [i for i in ids_in_order if i is not None]
    assert known == sorted(known) and ids_in_order[:2] == [None, None]


def test_query_of_planes(spark, tiny, encoder):
    from surgelens.llm.queries import QUERIES
    start = 0
    got = {r.doc_id: r for r in QUERIES["op2_token_planes"](spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect():
        ids = plain_ids(encoder.tokenizer, r.text, 1)
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_table(spark):
    assert token_planes.op2(spark, cases.empty(spark)).count() == 0
    assert best_fit.op4(cases.empty(spark)).count() == 0
    assert piece_bpe.op7(cases.empty(spark)).count() == 0


def slow_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    r = np.random.default_rng(3)
    for capacity in (7, 20, 64):
        for _ in range(60):
            lengths = r.integers(1, capacity + 1, r.integers(1, 200)).tolist()
            steps = best_fit.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
            used, spans = {}, {}
            for length, rank, bins, per, first, place in steps.tolist():
                for k in range(bins * per):
                    b, at = first + k // per, place + k % per * length
                    assert used.get(b, 0) == at
                    used[b] = at + length
                    spans[length] = spans.get(length, 0) + 1
            assert spans == {n: lengths.count(n) for n in set(lengths)}
            assert sorted(capacity - u for u in used.values()) == slow_best_fit(lengths, capacity)


def packed_rightly(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_of_awkward_rows(spark, encoder):
    got = best_fit.op4(cases.documents(spark), capacity=64).collect()
    want = []
    for r in cases.rows():
        ids = plain_ids(encoder.tokenizer, r[1], 0)
        want += [(r[0], k, at, len(ids[at:at + 64]), zlib.crc32(ids[at:at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert cases.keyed((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cases.keyed(want)
    assert packed_rightly(got, 64) == len(slow_best_fit([w[3] for w in want], 64))


def test_query_of_packing(spark, tiny):
    from surgelens.llm.queries import QUERIES
    got = QUERIES["op4_best_fit"](spark, tiny).collect()
    assert packed_rightly(got, 2048) == len(slow_best_fit([r.length for r in got], 2048))


def test_pieces_equal_the_library():
    import random
    c = piece_bpe.PieceCodec(piece_bpe.default_model(), unit_cap=40, pair_cap=500)
    r = random.Random(5)
    pool = [chr(i) for i in range(0x180)] + list("▁ ▁▁　​﻿€œ한국어日本語ﬁ①²٣ا😀‍̈”’.,") + [" "] * 100 + list("the and ing tion er") * 8
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [" " * k + "a" * k + "-" * k for k in range(40)] + [t or "" for t in cases.TEXTS]
    assert c.cuts
    for t in texts:
        ids = c.library.encode(t)
        assert c.encode(t) == ids and c.decode(ids) == c.library.decode(ids)


def test_piece_rows(spark, tiny):
    import hashlib

    from surgelens.llm.queries import QUERIES
    lib = piece_bpe.PieceCodec(piece_bpe.default_model()).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    for got, rows in ((QUERIES["op7_piece_bpe"](spark, tiny), [(r.doc_id, r.text) for r in docs]), (piece_bpe.op7(cases.documents(spark)), [r[:2] for r in cases.rows()])):
        ids = [(i, lib.encode(t or "")) for i, t in rows]
        assert cases.keyed(got.collect()) == cases.keyed((i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, x in ids)
    full = piece_bpe.encoded(cases.documents(spark)).collect()
    assert cases.keyed((r.doc_id, r.ids, r.decoded) for r in full) == cases.keyed((i, x, lib.decode(x)) for (i, _), x in zip([r[:2] for r in cases.rows()], [lib.encode(r[1] or "") for r in cases.rows()]))
