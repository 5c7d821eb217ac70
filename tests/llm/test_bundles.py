"""Archives, clusters and alignments against plain versions of what they compute."""

import collections
import hashlib
import io
import random

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from domspark.llm import alignment, centroids, warc

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PAGE = "page_id long, url string, html string"


def plain_records(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        b = (r[2] or "").encode()
        groups[hashlib.sha256(b).hexdigest(), len(b)].append(r[0])
    out = []
    for (digest, n), ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, n, digest, "revisit", ids[0]) if k and n >= 100 else (i, n, digest, "response", None) for k, i in enumerate(ids)]
    return sorted(out, key=str)


ROWS = [
    (1, "u", "x" * 200), (2, "v", "x" * 200), (2, "v", "x" * 200), (9, "a\r\nWARC-Type: b", "y" * 200), (9, "a", "y" * 200), (9, "a", "y" * 200), (None, "u", "é" * 150), (None, None, "é" * 150), (None, "u", "z" * 300), (5, "u", "z" * 300),
    (3, None, None), (3, None, None), (4, "w", ""), (7, "q", "s" * 99), (8, "q", "s" * 99), (6, "long", "l\r\n\r\n" * 200_000),
]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_records(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    pages = spark.createDataFrame(ROWS, PAGE).withColumns({c: F.lit("clash") for c in ("payload", "digest", "key", "first", "size", "hot", "x", "p")})
    got = sorted(map(tuple, warc.op11_warc(pages, str(tmp_path / "a")).collect()), key=str)
    assert got == plain_records(ROWS)
    assert warc.op11_warc(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_tables_of_bundles(spark, tmp_path):
    path = str(tmp_path / "a")
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i % 70} " * 50) for i in range(100)] + ROWS, PAGE)
    warc.write_archives(pages, path, frame=2_000, bundle=3_000)
    rows = warc.read_archives(spark, path, payload=True).collect()
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {r[2] or "" for r in pages.collect()}
    ids = {r.record_id for r in rows}
    assert len(ids) == len(rows) == 116
    index = warc.record_index(spark, path).collect()
    assert {r.record_id for r in index} == ids and len({r.bundle for r in index}) > 4 and max(r.frame for r in index) > 0
    # A revisit's header names the record of the response.
    name = index[0].bundle
    asked = rows[::9]
    got = warc.fetch(spark.createDataFrame([(r.record_id,) for r in asked], "record_id string"), path).collect()
    assert sorted(got) == sorted(asked)
    with open(name, "rb") as f:
        bundle = warc.Seekable(f)
        own = next(r.record_id for r in index if r.bundle == name)
        assert warc.parsed(bundle.find(bytes.fromhex(own.replace("-", ""))))[0]["WARC-Record-ID"] == f"<urn:uuid:{own}>"
        assert bundle.find(b"\x00" * 16) is None
        f.seek(0)
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()  # a reader that knows no seek table
    at, seen = 0, 0
    while at < len(whole):
        head, _, at = warc.parsed(whole, at)
        seen += 1
        if "WARC-Refers-To" in head:
            assert head["WARC-Refers-To"][10:-1] in ids
    assert seen == sum(r.bundle == name for r in index)
    warc.write_archives(pages.limit(3), path)
    assert warc.read_archives(spark, path).count() == 119


def test_a_damaged_frame_is_told():
    out = io.BytesIO()
    bundle = warc.Bundle(out, 100)
    for i in range(5):
        bundle.add(bytes([i]) * 16, bytes([65 + i]) * 90)
    bundle.close()
    good = warc.Seekable(io.BytesIO(out.getvalue()))
    assert len(good) == 6 and [good.find(bytes([i]) * 16)[0] for i in range(5)] == [65, 66, 67, 68, 69]
    with pytest.raises(ValueError):
        warc.Seekable(io.BytesIO(out.getvalue()[:-1]))


def plain_clusters(rows, k=8, rounds=10):
    keep = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(keep, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c, x = np.array([v for _, v in first], np.int64), np.array([v for _, v in keep], np.int64)
    for r in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            for j in set(own.tolist()):
                c[j] = x[own == j].sum(0) // (own == j).sum()
    d = d.min(1)
    return sorted(((i, int(o), int(z), int(d[own == o].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[o].tolist())).encode()).hexdigest()) for (i, _), o, z in zip(keep, own, d, strict=True)), key=str)


def vectors(n, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.normal(i % 11, 2, 64)) * scale]) for i in range(n)]


@pytest.mark.parametrize("scale", [1 / 64, 1.0, 900.0])
def test_clusters(spark, scale):
    rows = vectors(300, scale=scale)
    rows += [(i, rows[7][1]) for i in range(300, 400)] + [rows[3], rows[3], (None, rows[9][1]), (401, None), (402, [1.0] * 63), (403, [None] * 64), (404, [float("nan")] * 64), (405, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("own", F.lit("clash"))
    assert sorted(map(tuple, centroids.yinyang(df).collect()), key=str) == plain_clusters(rows)


def test_few_vectors(spark):
    for rows in ([], vectors(1), vectors(5), [(i, [0.0] * 64) for i in range(20)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert sorted(map(tuple, centroids.yinyang(df).collect()), key=str) == (plain_clusters(rows) if rows else [])
    assert centroids.yinyang(spark.createDataFrame([(1, [1e38] * 64)], "vec_id long, embedding array<float>")).count() == 0


def test_filters_agree_with_scans_and_leave_most_alone():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-40, 40, (400, 6)) + 300 * k for k in range(5)])
    c = x[rng.choice(len(x), 12, replace=False)]
    group = centroids.grouped(c, 4)
    own, upper, lower = centroids.first_pass(x, c, group)
    for _ in range(12):
        before, c = c, np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
        moved = np.sqrt(((c - before) ** 2).sum(1)) * (1 + centroids.MARGIN)
        own, upper, lower = centroids.next_pass(x, own, upper, lower, c, group, moved)
        d = ((x[:, None] - c) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        rest = np.sqrt(d.astype(float))
        assert (upper >= rest[np.arange(len(x)), own]).all()
        rest[np.arange(len(x)), own] = np.inf
        assert all((lower[:, g] <= rest[:, group == g].min(1)).all() for g in range(group.max() + 1))
    assert (lower.min(1) > upper).mean() > 0.5  # that many are settled by the global filter


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    from domspark.llm.bpe import byte_letters

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = byte_letters()
    a_bytes = {i: bytes(letter[c] for c in s) for s, i in a.get_vocab(with_added_tokens=False).items() if all(c in letter for c in s)}
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], collections.Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in x) != want or b"".join(map(b_bytes, y)) != want:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in x]).tolist(), np.cumsum([len(b_bytes(i)) for i in y]).tolist()
        both = sorted({*ends_a} & {*ends_b})
        of = lambda ids, ends: [[i for i, e in zip(ids, ends, strict=True) if lo < e <= hi] for lo, hi in zip([0, *both], both, strict=False)]
        groups = list(zip(of(x, ends_a), of(y, ends_b), strict=True))
        links = [(i, j) for i, e, s in zip(x, ends_a, [0, *ends_a], strict=False) for j, f, g in zip(y, ends_b, [0, *ends_b], strict=False) if s < f and g < e]
        count.update(links)
        found.append((len(x), len(y), len(groups), links, ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)))
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(count[k] == best[k[1]] for k in r[3]), sum(count[k] for k in r[3]), hashlib.sha256(r[4].encode()).hexdigest()) for r in found]


def test_alignment(spark):
    rng = random.Random(8)
    pool = ["the ", "Tree", "\n", "  ", "\t", "\r\n", ";\r", "▁", "é", "日本語", "1234", "'s", "<s>", "<|endoftext|>", "<0x41>", " ", " ", "\x1c", "\x00", "😀", ".", "don't ", "x" * 30, "​", "᠎", "﻿", "　", "\x85"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + ["word" * 500 + " " + "y z " * 300, None, "", " ", "\n", "▁ a", "a\r b"]
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_documents(docs, A, B, chunk=500, bucket=300, groups=False).collect()}
    want = plain_alignment(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[0] > 0 for w in want) > 100


def test_alignment_of_odd_rows(spark):
    docs = odd_docs(spark).where("doc_id is null or doc_id <> 9")  # the long row is left to the plain version's patience
    rows = docs.select("doc_id", "text").collect()
    got = [(r.doc_id, *r[1:8]) for r in alignment.align_documents(docs, A, B).collect()]
    assert sorted(got, key=str) == sorted([(r.doc_id, *w) for r, w in zip(rows, plain_alignment([r.text for r in rows]), strict=True)], key=str)
    one = alignment.align_documents(docs.where("doc_id = 7"), A, B).first()
    assert hashlib.sha256(one.groups.encode()).hexdigest() == one.groups_sha256
    assert alignment.op13_alignment(empty_docs(spark), A, B).count() == 0
