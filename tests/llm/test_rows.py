"""Operators that look at one row at a time, against plain versions."""

import collections
import hashlib
import random
import re
import time
import re
import time

import public_tokenizers as P
import pytest
from helpers import empty_docs, odd_docs, odd_rows

from pyspark.sql import functions as F

from domspark.llm import bpe, decontaminate, html_text, quality, secrets, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_quality(spark, small, which):
    docs = odd_docs(spark) if which == "odd" else small
    rows = quality.op2_quality_rules(docs).collect()
    texts = collections.Counter((r.doc_id, plain_quality(r.text)) for r in docs.select("doc_id", "text").collect())
    got = collections.Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == texts
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.op2_quality_rules(empty_docs(spark)).count() == 0


def test_quality_keeps_good_and_rejects_junk(spark):
    good = "The river runs under the old bridge and it is the last of the long days that we had in the green hills of the north. " * 2
    rows = [(1, good + "One more line of it for the end."), (2, " | ".join(f"w{i}" for i in range(80))), (3, " ".join(f"W{i}!!" for i in range(80))), (4, " ".join(w for w in good.split() for _ in range(4)))]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] is False and got[3] is False and got[4] is False
    once = spark.createDataFrame([(1, good[: len(good) // 2] + "One more line of it for the end.")], "doc_id long, text string")
    assert quality.judge(once).first().kept


@pytest.fixture(scope="module")
def automaton():
    return bpe.load(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_bpe_words(automaton, tokenizer):
    rng = random.Random(1)
    letters = "abcdefgh the ing \n\t '’éèßñ|%#!0123²½٣ \x1c\x1f\x85\xa0 　😀漢字मा_-sStTrR'"
    words = bpe.Words(automaton, most=500)
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = [int(i) for x in bpe.encoded_words(t, words) for i in x[1].split(",")]
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids
        assert automaton.decode(ids) == t
    assert len(words) <= 500


def test_bpe_small_automata():
    merges = [(b"a", b"a"), (b"b", b"c"), (b"aa", b"b"), (b"x", b"a"), (b"a", b"bc")]
    vocabulary = {bytes([c]): i for i, c in enumerate(b"abcx")}
    for u, v in merges:
        vocabulary[u + v] = len(vocabulary)
    a = bpe.Automaton(vocabulary, merges)

    def merged(word):
        parts = [bytes([c]) for c in word]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocabulary[p] for p in parts]

    assert len(a.lacks) > 3 and not a.has(a.arc[b"a"], a.arc[b"aa"]) and a.has(a.arc[b"aa"], a.arc[b"a"])
    rng = random.Random(2)
    for _ in range(3000):
        w = bytes(rng.choice(b"aaabcx") for _ in range(rng.randint(0, 12)))
        assert a.encode(w) == merged(w), w


def test_bpe_random_automata():
    """Merges of random tokens, applied one after another in plain Python, against the compiled table."""
    rng = random.Random(14)
    for _ in range(150):
        vocabulary = {bytes([c]): i for i, c in enumerate(b"abc")}
        merges = []
        while len(merges) < 9:
            u, v = rng.choice([*vocabulary]), rng.choice([*vocabulary])
            if u + v not in vocabulary:
                vocabulary[u + v] = len(vocabulary)
                merges.append((u, v))
        a = bpe.Automaton(vocabulary, merges)
        for _ in range(60):
            w = bytes(rng.choice(b"aabc") for _ in range(rng.randint(0, 14)))
            parts = [bytes([c]) for c in w]
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert [a.label[i] for i in a.encode(w)] == parts, (merges, w)


def test_bpe_of_a_very_long_word(automaton, tokenizer):
    rng = random.Random(15)
    for t in ("a" * 60_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))):
        began = time.process_time()
        assert automaton.encode(t.encode()) == tokenizer.encode(t, add_special_tokens=False).ids
        assert time.process_time() - began < 10


def test_bpe_documents(spark, tokenizer):
    want = []
    for i, t, *_ in odd_rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.op9_bpe(odd_docs(spark), P.path("byte_bpe_50k.json")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.op9_bpe(empty_docs(spark), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, tokenizer, rule):
    tokenizer.encode_special_tokens = True
    got = collections.defaultdict(list)
    for r in token_counts.count_tokens(odd_docs(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule=rule).collect():
        got[r.doc_id].append((r.section, r.start, r.end, r.n_tokens))
    for i, t, *_ in odd_rows()[1:15]:
        t = t or ""
        lines = t.split("\n")
        ends, at = [], 0
        for x in lines[:-1]:
            at += len(x) + 1
            ends.append(at)
        if lines[-1] or not ends:
            ends.append(len(t))
        starts = [0, *ends[:-1]]
        n = [0] * len(ends)
        for a, b in tokenizer.encode(t, add_special_tokens=False).offsets:
            parts = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
            n[parts.index(max(parts)) if rule == "majority" else next(k for k, e in enumerate(ends) if a < e)] += 1
        assert sorted(got[i]) == [(k, s, e, m) for k, (s, e, m) in enumerate(zip(starts, ends, n, strict=True))]
    tokenizer.encode_special_tokens = False
    assert token_counts.count_tokens(empty_docs(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW](?:[oO][rR][dD]|[dD]))|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_base(spark, small):
    rng = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "tokſen", "toKen", "=", ":", " = ", '"', "'", "abc", "abcdef123", "AKIA", "AKIA" + "B7" * 9, "0123456789abcdef" * 2, " ", "\n", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for t in texts:
        assert secrets.shown(secrets.base_spans(t)) == plain_secrets(t)
    rows = secrets.op8_secret_scans(small.unionByName(odd_docs(spark).select(*small.columns))).collect()
    want = collections.Counter((i, hashlib.sha256(plain_secrets(t or "").encode()).hexdigest()) for i, t in [*((r.doc_id, r.text) for r in small.collect()), *((i, t) for i, t, *_ in odd_rows())])
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert secrets.op8_secret_scans(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('k = "Zx81mQpL0aVn22"\npassword = k', ["Zx81mQpL0aVn22"]),
        ('a = b\nb = "Ab3dEf6hIj9kLm"\nauth_token => a', ["Ab3dEf6hIj9kLm"]),
        ('const API_KEY = "abC9-" + "d83kfjs02k"', ["d83kfjs02k"]),
        ('password = "${PASS}"', []),
        ('greeting = "hello-there-World-12"', []),
        ("x == 'Zx81mQpL0aVn22'", []),
        ('k = "Aa11Bb22Cc33Dd"\nk = "Zx81mQpL0aVn22"\npassword = k', ["Zx81mQpL0aVn22"]),
        ('k = "Aa11Bb22Cc33Dd"\nk += "Zx81mQpL0aVn22"\npassword = k', ["Aa11Bb22Cc33Dd", "Zx81mQpL0aVn22"]),
        ('password = k\nk = "Aa11Bb22Cc33Dd"\nk = "Zx81mQpL0aVn22"', ["Aa11Bb22Cc33Dd"]),
        ("say = \"my auth_key = 'Zx81mQpL0aVn22' is\"", []),
        ("# auth_key = k\nk = 'Zx81mQpL0aVn22'", []),
        ("# k = 'Zx81mQpL0aVn22'\n# bearer_auth = k", ["Zx81mQpL0aVn22"]),
        ("/* k = 'Zx81mQpL0aVn22'\n*/ credential = k", []),
        ('pwd = """\nx = \'Zx81mQpL0aVn22\'\n"""', []),
        ('pwd = """Zx81mQpL0aVn22"""', ["Zx81mQpL0aVn22"]),
        ('pwd = (\\\n"Zx81mQpL0aVn22" +\n "Aa11Bb22Cc33Dd")', ["Zx81mQpL0aVn22", "Aa11Bb22Cc33Dd"]),
        ('{"url": "http://a.b/c", "auth-key": "Zx81mQpL0aVn22"}', ["Zx81mQpL0aVn22"]),
        ("config['credential'] = 'Zx81mQpL0aVn22'", ["Zx81mQpL0aVn22"]),
        ("it's the users' pwd: 'Zx81mQpL0aVn22'", ["Zx81mQpL0aVn22"]),
        ('a = b\nb = a\nb = "Zx81mQpL0aVn22"\npwd = b', ["Zx81mQpL0aVn22"]),
    ],
)
def test_secret_literals(text, found):
    spans = secrets.all_spans(text, secrets.base_spans(text))
    assert [text[a:b] for a, k, b in spans if k == 3] == found
    assert all(f not in secrets.redacted(text, spans, "[s]") for f in found)


def plain_reach(lines):
    """The literals (by number) that reach a name with the part pwd, by following each literal through all later and earlier lines."""
    def stands_for(i, name):
        before = [j for j in range(i) if lines[j][0] == name]
        after = [j for j in range(i, len(lines)) if lines[j][0] == name]
        return before[-1] if before else after[0] if after else None

    out = set()
    for start in range(len(lines)):
        seen, todo = set(), [start]
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            todo += [j for j in range(len(lines)) for t in lines[j][2] if isinstance(t, str) and stands_for(j, t) == i]
            todo += [j for j in range(i + 1, len(lines)) if lines[j][1] and lines[j][0] == lines[i][0] and stands_for(j, lines[j][0]) == i]
        if any("pwd" in lines[i][0] for i in seen):
            out |= {t for t in lines[start][2] if isinstance(t, int)}
    return out


def test_secret_flows():
    rng = random.Random(8)
    names = ["a", "b", "c", "d", "x_pwd", "y_pwd"]
    for _ in range(400):
        lines = [(rng.choice(names), rng.random() < 0.2, [rng.choice([rng.choice(names), i * 10 + k]) for k in range(rng.randint(1, 3))]) for i in range(rng.randint(1, 12))]
        show = lambda t: t if isinstance(t, str) else f'"Zx8mQ-pLaVn{t:03d}"'
        text = "\n".join(f"{n} {'+=' if adds else '='} {' + '.join(map(show, terms))}" for n, adds, terms in lines)
        got = {int(text[a:b][-3:]) for a, k, b in secrets.all_spans(text, secrets.base_spans(text)) if k == 3}
        known = {n for n, _, _ in lines}
        assert got == plain_reach([(n, adds, [t for t in terms if not isinstance(t, str) or t in known]) for n, adds, terms in lines]), text


def test_secrets_of_very_long_texts():
    chain = "k0 = 'Zx81mQpL0aVn22'\n" + "".join(f"k{i} = k{i - 1}\n" for i in range(1, 20_000)) + "pwd = k19999\n"
    many = "password=abcdef pwd='Zx81mQpL0aVn22' " * 20_000
    marks = "/* " * 30_000 + "# " * 30_000 + "' " * 30_000 + '""" ' * 9_999 + "a=" * 30_000 + "x" * 100_000 + " =" * 30_000
    for text, n in ((chain, 1), (many, 20_000), (marks, 0)):
        began = time.process_time()
        assert sum(k == 3 for _, k, _ in secrets.all_spans(text, secrets.base_spans(text))) == n
        assert time.process_time() - began < 3


def plain_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignments_at_once():
    rng = random.Random(13)
    make = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    for _ in range(60):
        m, most = rng.randint(1, 14), rng.randint(0, 4)
        pairs = [(make(m), make(rng.randint(1, 22))) for _ in range(9)]
        assert decontaminate.any_within([p for p, _ in pairs], [t for _, t in pairs], most).tolist() == [plain_edits(p, t) <= most for p, t in pairs]


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(24)) for _ in range(4)]
    rows, want = [], set()
    for d in range(36):
        t = [word() for _ in range(30)]
        if d % 2:
            i = rng.randrange(4)
            passage = list(items[i])
            for _ in range(d % 9):
                passage[rng.randrange(len(passage))] = rng.choice("xyz")
            t[10:10] = ["".join(passage).upper() if d % 4 == 1 else "".join(passage).replace(" ", " || ")]
        rows.append((d, " ".join(t)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, items[0])], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "short")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    for d, t in rows:
        plain = re.sub(r"[\W_]+", " ", t.lower())
        for i, x in enumerate(items):
            window, edits, _ = decontaminate.bounds(len(x))
            if d % 2 and any(plain_edits(x[s : s + window], plain) <= edits for s in range(0, len(x) - window + 1, 1)):
                want.add((d, i))
    assert got == want | {(None, 0)}
    left = decontaminate.without_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want} | {500, 501}
    assert left.schema == docs.schema
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_in_slices(spark, monkeypatch):
    """Text ids, clashing columns, repeated rows, a very long text, a phrase that many items share; hits and items a few at a time."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    common = "a phrase that all of the items have in their middle"
    items = {f"i{k}": f"{' '.join(word() for _ in range(12))} {common} {' '.join(word() for _ in range(12))}" for k in range(60)}
    long = " ".join(word() for _ in range(30_000))
    texts = {"a": long[:70_000] + " " + items["i7"] + " " + long[70_000:], "b": common * 10, "c": items["i3"][40:] + " " + items["i9"], "d": long, "e": ""}
    docs = spark.createDataFrame([*texts.items(), ("c", texts["c"])], "doc_id string, text string")
    for name in ("t", "item_id", "start", "end", "edits", "shared"):
        docs = docs.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([*items.items()], "item_id string, text string").withColumn("t", F.lit("clash"))
    monkeypatch.setattr(decontaminate, "MOST_SENT", 3_000)
    monkeypatch.setattr(decontaminate, "MOST_HITS", 500)
    got = collections.Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect())
    assert {(d, i) for d, i, _ in got} == {("a", "i7"), ("c", "i3"), ("c", "i9")} and got["c", "i9", 0] == 2 and got["a", "i7", 0] == 1
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == ["b", "d", "e"]


PAGE = """<html><head><title>no</title></head><body><nav><ul><li><a href=1>menu</a></li></ul></nav><div class="cookie-notice">The site is of the and in that for it on was as with be by</div>
<article><header><h1>A &amp; B</h1></header><p>The quick brown fox jumps over the lazy dog and it is in the end of the day.<br>more<p>Short.<p><b>Open
 <aside>side</aside><div class="ad">buy</div><form><p>mail</p><input></form><section id="comments"><p>The reader said that it is the best of all and for the rest.</p></section><ul><li>item <i>one</i></li></ul></article><footer>f</footer>"""


def test_html_text(spark):
    want = "A & B The quick brown fox jumps over the lazy dog and it is in the end of the day. more Short. Open item one"
    assert html_text.main_text(PAGE) == want
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>The one of all the days that it was in the house of the old man and his tree.", "x"), (5, "z", "<p " * 500, "x")], "page_id long, url string, html string, text string")
    rows = sorted(html_text.extract(pages).collect(), key=str)
    assert [r.n_chars for r in rows if r.page_id == 1] == [len(want)] * 2
    assert [r.text for r in rows if r.page_id in (2, 3, 5)] == [""] * 3
    assert [r.text for r in rows if r.page_id is None][0].startswith("The one")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_neighbours_decide():
    p = "<p>The quick brown fox jumps over the lazy dog and it is in the end of the day for all.</p>"
    assert "Short one" in html_text.main_text(f"<div>{p}<p>Short one</p>{p}</div><nav><p>No</p></nav>")
    assert "Lone" not in html_text.main_text(f"{p}<div></div><p>x</p><nav><p>No</p></nav><p>Lone</p><nav><p>No</p></nav>")


def test_html_comments_as_articles():
    p = "<p>The quick brown fox jumps over the lazy dog and it is in the end of the day for all.</p>"
    got = html_text.main_text(f"<article class='post'>{p}<article class='comment'>{p.replace('fox', 'cat')}</article></article>")
    assert "fox" in got and "cat" not in got


def test_html_doubtful_names():
    p = "<p>The quick brown fox jumps over the lazy dog and it is in the end of the day for all.</p>"
    cat = p.replace("fox", "cat")
    got = html_text.main_text(f"<article>{p}<div class='content legal'>{cat}</div><div class='share'><p>Share this now</p></div><div class='cookie legal'>{p.replace('fox', 'cow')}</div>{p}</article><div class='legal'>{p.replace('fox', 'pig')}</div>")
    assert "cat" in got and "Share" not in got and "cow" not in got and "pig" not in got


def test_html_of_very_long_and_nested_pages(spark):
    p = "<p>The quick brown fox jumps over the lazy dog and it is in the end of the day for all.</p>"
    long = "<main>" + p * 20_000 + "</main>"
    deep = "<div>" * 20_000 + p + "</div>" * 20_000
    rows = [(1, "u", long), (2, "u", deep), (3, "u", "<" * 100_000)]
    began = time.process_time()
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].n_chars == len(p) * 20_000 - 7 * 20_000 + 20_000 - 1
    assert got[2].text.startswith("The quick")
    assert time.process_time() - began < 30


def test_lexed_as_by_one_pattern():
    plain = {p: re.compile(("" if p is secrets._REMARK else f"{secrets._COMMENT}|") + f"{secrets._STRING}|{secrets._SIGN}", re.A | re.M) for p in (secrets._CODE, secrets._REMARK)}
    rng = random.Random(12)
    for _ in range(4_000):
        text = "".join(rng.choice(['"', "'", "`", '"""', "'''", "\\", "\n", "=", ":", " ", "a", "#", "//", "/*", "*/", '\\"']) for _ in range(rng.randrange(1, 25)))
        for p, whole in plain.items():
            assert list(secrets.lexed(p, text, 0, len(text))) == [(m.lastgroup, *m.span()) for m in whole.finditer(text)]


@pytest.mark.parametrize("quote", ['"', "'", "`"])
def test_a_megabyte_of_escaped_quotes(quote):
    text = "password = " + quote + f"\\{quote}" * 500_000
    began = time.process_time()
    assert secrets.pairs(text)[0] is not None
    assert time.process_time() - began < 3


def test_linked_cards_are_links():
    prose = " ".join(["The quick brown fox jumps over the lazy dog and then it runs to the house of the old man"] * 3)
    card = f'<a href="/x"><div><h3>Teaser</h3><p>{prose.replace("fox", "cat")}</p></div></a>'
    got = html_text.blocks(f"<div>{card}<p>{prose}</p></div>")
    assert [b.link_words == b.words for b in got] == [True, True, False]
    text = html_text.main_text(f"<p>{prose}</p>{card}<p>{prose.replace('fox', 'cow')}</p>")
    assert "fox" in text and "cow" in text and "cat" not in text
    # A link that nothing closes ends with its block or the next link; an anchor without an address is none.
    assert [b.link_words for b in html_text.blocks('<p><a href="/x">one two</p><p>three</p><a name="n">four five</a><div><a href="/y">six<a>seven</div>')] == [2, 0, 0, 1]


def test_html_with_columns_of_the_results_names(spark):
    rows = [(1, "u", "<p>one two</p>", "clash", -1, "x"), (1, "u", "<p>one two</p>", "clash", -1, "x"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, bad string")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "one two", 7), (1, "u", "one two", 7), (None, None, "", 0)], key=str)
