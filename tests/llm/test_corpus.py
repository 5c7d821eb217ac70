"""Operators that need the whole corpus, against brute force on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import empty_docs, odd_docs, odd_rows, plain_words
from pyspark.sql import functions as F

from domspark.llm import jaccard, lattice, substrings, toxicity
from domspark.llm.components import components
from domspark.llm.suffix import common, deep_shallow_sort

PIECES = P.path("piece_bpe_32k.model")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return collections.Counter((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies():
    """Families whose members are near the bound, so that hubs, short lists and multiplied blocks all have work."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for family in range(6):
        base = [word() for _ in range(90)]
        for _ in range(70 if family < 2 else 8):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t[: len(t) - rng.randint(0, 6)])))
    rows += [(len(rows) + i, " ".join(word() for _ in range(40))) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("which", ["odd", "near"])
def test_jaccard(spark, which, monkeypatch):
    if which == "near":
        monkeypatch.setattr(jaccard, "LONG", 12)
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
        monkeypatch.setattr(jaccard, "COLUMNS", 64)
    docs = odd_docs(spark) if which == "odd" else spark.createDataFrame(near_copies(), "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert got == plain_components(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    worded = {c for _, n, c in plain_components(rows) if n}
    assert sorted((d for d, t in left if plain_words(t)), key=str) == sorted(worded, key=str)
    assert sum(not plain_words(t) for _, t in left) == sum(not plain_words(t) for _, t in rows)


def test_jaccard_of_text_ids(spark):
    rows = [(f"d{i:03d}", t) for i, (_, t) in enumerate(near_copies()[:60])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == plain_components(rows)
    assert {r.doc_id for r in jaccard.one_of_each(docs).collect()} == {c for _, _, c in plain_components(rows)}


def test_jaccard_of_nothing(spark):
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(2)
    for _ in range(200):
        n, w = rng.randint(1, 60), rng.choice([0, 1, 5, 40, 127])
        base = [bytes(rng.choice(b"ab\0") for _ in range(w)) for _ in range(3)]
        strings = []
        for _ in range(n):
            b = bytearray(rng.choice(base))
            if w and rng.random() < 0.6:
                b[rng.randrange(w)] = rng.choice(b"abc\0")
            strings.append(bytes(b[: rng.randint(0, w)]))
        group = np.sort(np.array([rng.randint(0, 3) for _ in range(n)]))
        rows = np.zeros((n, w), np.uint8)
        for i, s in enumerate(strings):
            rows[i, : len(s)] = np.frombuffer(s, np.uint8)
        order, shared = deep_shallow_sort(rows, np.array([len(s) for s in strings]), group)
        want = sorted(range(n), key=lambda i: (group[i], strings[i] + b"\0" * (w - len(strings[i])), len(strings[i])))
        assert [(group[i], strings[i]) for i in order] == [(group[i], strings[i]) for i in want]
        for k in range(n):
            first = k == 0 or group[order[k]] != group[order[k - 1]]
            assert shared[k] == (-1 if first else common(strings[order[k]], strings[order[k - 1]]))


def plain_cuts(rows, length=400):
    count = collections.Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest()] += 1
    return out


def passages():
    """Texts that share passages of lengths around the bound, within and across texts, periodic ones too."""
    rng = random.Random(9)
    letters = "abcdefghijklmnop éß\n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (360, 370, 385, 400, 420, 600, 900, 2000)]
    rows = []
    for d in range(80):
        parts = [make(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, max(0, len(s) - 380))
            parts += [s[cut : cut + rng.randint(min(350, len(s)), len(s))], make(rng.randint(0, 200))]
        rows.append((d, "".join(parts)))
    rows += [(100, "ab" * 500), (101, "x" * 399), (102, "y" * 401), (103, "ab" * 150 + "q" + "ab" * 260), (104, None), (105, ""), (105, shared[5]), (None, shared[6])]
    return rows


@pytest.mark.parametrize("which", ["odd", "passages"])
def test_substrings(spark, which):
    if which == "odd":
        rows = [(i, t) for i, t, *_ in odd_rows() if len(t or "") < 50_000]
        docs = odd_docs(spark).where("coalesce(length(text), 0) < 50000")
    else:
        rows = passages()
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter(tuple(r)[:5] for r in substrings.op7_substring_dedup(docs).collect())
    assert got == plain_cuts(rows)


def test_substrings_of_a_very_long_text(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    part = make(5_000)
    rows = [(1, make(200_000) + part + make(150_000)), (2, part), (3, "ab" * 60_000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.op7_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (5_000, 1), 2: (5_000, 1), 3: (120_000, 1)}


def plain_shared(rows, n=51):
    """Which rows share a window of n words with a row of another id or text."""
    own = collections.defaultdict(set)
    windows = []
    for d, t in rows:
        w = plain_words(t)
        windows.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
        for x in windows[-1]:
            own[x].add((d, t))
    return collections.Counter((d, int(any(len(own[x]) > 1 for x in of))) for (d, _), of in zip(rows, windows, strict=True))


def worded_passages():
    """Texts that share passages of 40 to 90 words: in foreign text, in copies, in each other's parts, and periodic ones."""
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n))
    shared = [make(n) for n in (40, 50, 51, 52, 60, 75, 90)]
    rows = []
    for d in range(90):
        s = rng.choice(shared).split()
        cut = rng.randint(0, max(0, len(s) - 51))
        rows.append((d, " ".join([make(rng.randint(0, 70)), *s[cut : cut + rng.randint(46, 90)], make(rng.randint(0, 70))])))
    base = make(300)
    rows += [(200 + i, base.replace(" a1 ", f" z{i} ") + " " + make(60)) for i in range(6)]
    alone = make(55)
    rows += [(300, "of " * 80), (301, "of " * 50), (302, "of " * 51 + make(30)), (303, alone + " " + alone), (304, None), (305, ""), (306, shared[5].upper()), (None, shared[6]), (307, make(50)), (307, "x " + alone.replace(" ", "\n"))]
    return rows


def test_rows_with_passages(spark):
    for rows in (worded_passages(), [(i, t) for i, t, *_ in odd_rows()]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert collections.Counter((r.doc_id, r.passage) for r in substrings.op7_substring_dedup(docs).collect()) == plain_shared(rows)


def test_substrings_of_nothing(spark):
    assert substrings.op7_substring_dedup(empty_docs(spark)).count() == 0


def test_substrings_of_a_crowded_core(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, near = make(430), make(25)
    # One passage in different surroundings, in pairs that share some of them too.
    rows = [(d, make(rng.randint(150, 300)) + (near[: rng.randint(0, 25)] if d % 3 else near) + shared[rng.choice([0, 0, 7, 20]) :] + near[: rng.randint(0, 25)] + make(200)) for d in range(60)]
    rows += passages()[:30]
    most = []
    resolve = substrings._resolve
    monkeypatch.setattr(substrings, "_resolve", lambda parts: most.append(parts.groupBy("core").count().agg({"count": "max"}).first()[0] or 0) or resolve(parts))
    monkeypatch.setattr(substrings, "MOST_ROWS", 6, raising=False)
    monkeypatch.setattr(substrings, "MOST_SENT", 500)  # so that windows are counted both ways
    got = collections.Counter(tuple(r)[:5] for r in substrings.op7_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == plain_cuts(rows)
    assert max(most) <= 6


def test_lattice_sums_all_segmentations():
    pieces, log_p = lattice.read_pieces(PIECES)
    la = lattice.Lattice(pieces, [log_p])
    weight = dict(zip(pieces, np.exp(log_p), strict=True))
    for w in ("the", "nation", "über", "x%q", "\U0001f600", "a" * 70, "characteristics", "representations"):
        s = ("▁" + w).encode()
        sums = [1.0, *[0.0] * len(s)]
        for j in range(1, len(s) + 1):
            sums[j] = sum(sums[i] * weight.get(s[i:j], 0) for i in range(j))
        want = math.log10(sums[-1] * weight[b""])
        assert la.log10([w.encode(), b"other"])[0][0] == pytest.approx(want, rel=1e-9)
    expected = la.expected([b"nation", b"the"], log_p)
    assert expected[-1] == 2 and expected.sum() > 4


def test_lattice_of_short_words(monkeypatch):
    pieces, log_p = lattice.read_pieces(PIECES)
    la = lattice.Lattice(pieces, [log_p])
    words = [b"nation", b"the", "über".encode(), b"", b"characteristics", b"x%q", b"a" * 30]
    short = la.log10(words), la.expected(words, log_p)
    monkeypatch.setattr(lattice.Lattice, "_short", lambda *_: False)
    for a, b in zip(short, (la.log10(words), la.expected(words, log_p)), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_lattice_base_and_shape(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_SENT", 200)  # so that most words are joined
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*plain_words(t), b"\0 end"]
    count = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    want = sorted(((d, held(d), len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)) for d, t in rows for w in [tokens(t)]), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lattice.op1_lattice_likelihood(docs, PIECES).collect()), key=str)
    key = lambda r: tuple(map(str, r[:5]))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
    assert sum(a[5] for a in got) == pytest.approx(sum(b[5] for b in want))
    assert all(a[6] < 0 for a in got)


def test_lattice_scores(spark):
    """score and lattice_score from the learned weights, by summing all segmentations and whole-word arcs in plain Python."""
    docs = [(i, t, "en" if (i or 0) % 2 else None) for i, t, *_ in odd_rows() if len(t or "") < 5_000]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    pieces, log_p = lattice.read_pieces(PIECES)
    names, share = lattice.class_names(df.withColumn("held_out", F.expr("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) = 1")))
    own = lambda lang: names.index(lang) if lang in names else len(names)
    counts = [collections.Counter() for _ in share]
    for d, t, lang in docs:
        if not held(d):
            counts[own(lang)].update([*plain_words(t), b""])
    every = sorted({w for _, t, _ in docs for w in plain_words(t)})
    table = spark.createDataFrame([(bytearray(w), 1, *(c[w] for c in counts)) for w in every], "word binary, n long, " + ", ".join(f"c{i} long" for i in range(len(share))))
    weights = lattice.learned_weights(table, pieces, log_p, len(share))

    def spelt(w, z):
        weight = dict(zip(pieces, np.exp(weights[z]), strict=True))
        s = "▁".encode() + w if w else b""
        sums = [1.0, *[0.0] * len(s)]
        for j in range(1, len(s) + 1):
            sums[j] = sum(sums[i] * weight.get(s[i:j], 0) for i in range(j))
        return sums[-1] * weight[b""]

    p = [{w: spelt(w, z) for w in [*every, b""]} for z in range(len(share))]

    def word_in(w, z):
        c, total = counts[z], sum(counts[z].values())
        n = [sum(1 for x, m in c.items() if x and m == k) for k in (1, 2, 3, 4)]
        a = [max(1, x) for x in n]
        y = a[0] / (a[0] + 2 * a[1])
        cut = [min(max(1 - 2 * y * a[1] / a[0], 0.05), 0.95), min(max(2 - 3 * y * a[2] / a[1], 0.05), 1.95), min(max(3 - 4 * y * a[3] / a[2], 0.05), 2.95)]
        free = (sum(cut[min(m, 3) - 1] for x, m in c.items() if x)) / (total + 1)
        if not w:
            return (c[b""] + 1) / (total + 1)
        return (c[w] - cut[min(c[w], 3) - 1] if c[w] else 0) / (total + 1) + free * p[z][w]

    want = {}
    for d, t, _ in docs:
        ws = [*plain_words(t), b""]
        mix = [math.log10(share[z]) + sum(math.log10(word_in(w, z)) for w in ws) for z in range(len(share))]
        top = max(mix)
        want.setdefault((str(d), len(ws)), []).append((top + math.log10(sum(10 ** (m - top) for m in mix)), sum(math.log10(sum(share[z] * p[z][w] for z in range(len(share)))) for w in ws)))
    got = {}
    for r in lattice.op1_lattice_likelihood(df, PIECES).collect():
        got.setdefault((str(r.doc_id), r.n_tokens), []).append((r.score, r.lattice_score))
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-5)


def test_lattice_weights_see_all_words(spark):
    pieces, log_p = lattice.read_pieces(PIECES)
    words = [b"nation", b"the", b"there", "über".encode(), b"rate", b"ration", b"other"]
    in_class = [[1, 1, 0, 0, 1, 2, 0], [0, 3, 1, 1, 0, 1, 0]]
    table = spark.createDataFrame([(bytearray(w), 5, *c) for w, *c in zip(words, *in_class, strict=True)] + [(bytearray(), 9, 4, 4)], "word binary, n long, c0 long, c1 long")
    want = log_p
    step = lambda some, p: (lambda n: np.log(n / n.sum()))(lattice.Lattice(pieces, [p]).expected(some, p) + 0.1)
    for _ in range(4):
        want = step([w for w, a, b in zip(words, *in_class, strict=True) if a or b], want)
    want = [step([w for w, n in zip(words, c, strict=True) if n], want) for c in in_class]
    got = lattice.learned_weights(table.repartition(3), pieces, log_p, 2)
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a, b, rtol=1e-9)


def test_lattice_of_nothing(spark):
    assert lattice.op1_lattice_likelihood(empty_docs(spark), PIECES).count() == 0
    untrained = odd_docs(spark).where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    assert all(math.isfinite(r.score) for r in lattice.op1_lattice_likelihood(untrained, PIECES).collect())


def test_toxicity_risk_and_gradient():
    rng = np.random.default_rng(5)
    for shift in (-3.0, 0.0, 3.0):
        z, is_p = rng.normal(size=40) + shift, np.arange(40) < 15
        z[is_p] += 2 * shift
        got, g = toxicity.risk(z, is_p, 0.3)
        loss = lambda x: math.log1p(math.exp(-x))
        own, rest = [loss(x) for x in z[is_p]], [loss(-x) for x in z[~is_p]]
        excess = sum(rest) / 25 - 0.3 * sum(loss(-x) for x in z[is_p]) / 15
        assert got == pytest.approx(0.3 * sum(own) / 15 + max(0, excess))
        part = (lambda x: toxicity.risk(x, is_p, 0.3)[0]) if excess >= 0 else lambda x: -(np.logaddexp(0, x)[~is_p].mean() - 0.3 * np.logaddexp(0, x)[is_p].mean())
        for i in (0, 7, 20, 39):
            step = np.zeros(40)
            step[i] = 1e-6
            assert g[i] == pytest.approx((part(z + step) - part(z - step)) / 2e-6, abs=1e-6)


def test_toxicity_learns(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(1200):
        words = [rng.choice(plain) for _ in range(60)]
        bad = d % 8 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["vile", "grubblish", "grubblent", "grubblard"])
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.op10_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held)
    assert right > 0.97


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.op10_toxicity(odd_docs(spark), labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.op10_toxicity(empty_docs(spark), labels).count() == 0
    assert toxicity.op10_toxicity(odd_docs(spark), labels.limit(0)).count() == len(odd_rows())
