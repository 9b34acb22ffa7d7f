import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cellarium.llm import decontaminate as D
from cellarium.llm import html_text as H
from cellarium.llm import quality_rules as Q
from cellarium.llm import secrets as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeat = len(words), len(marked)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 20 or 100 * repeat > 30 * n


def test_quality_rules(make_docs):
    r = random.Random(1)
    prose = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(300))
    texts = [None, "", " \n", prose, prose + "\n" + prose, "line one\nline one\n\n\nx | y & é z\x85w", ("ab cd " * 5000), prose[:900] + "\n" + prose[:900], "\x1c a\x0bb", "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(9000)), "w " * 19, " ".join(map(str, range(20)))]
    got = {x["doc_id"]: x for x in Q.compression_bands(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"], got[i]["base_failed"]) == brute_rules(t), i
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert got[3]["kept"] and not got[6]["kept"]
    assert Q.compression_bands(make_docs([])).count() == 0
    assert Q.compression_bands(make_docs(["a", "a"], [1, 1])).count() == 2


def test_verdicts_against_brute_force(make_docs):
    """Ratios of the whole and of every chunk, and the bands, worked out once more."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))
    texts = [prose(n) for n in (5, 25, 60, 200, 900, 4000)] + ["same words again and again " * n for n in (8, 300)] + [prose(800) + " ab" * 6000, prose(3000) + "".join(chr(r.randrange(33, 127)) for _ in range(9000)), None, "", prose(40), "é" * 3000]
    z = zstandard.ZstdCompressor(level=Q.LEVEL)
    band = lambda n, x: next(low <= x <= high for below, low, high in Q.BANDS if n < below)
    got = {x["doc_id"]: x for x in Q.compression_bands(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        raw, failed = (t or "").encode(), brute_rules(t)[-1]
        chunks = [raw[k : k + Q.CHUNK_BYTES] for k in range(0, len(raw), Q.CHUNK_BYTES)] if len(raw) > Q.CHUNK_BYTES else []
        bad = sum(len(c) for c in chunks if not band(len(c), len(z.compress(c)) / len(c)))
        ratio = len(z.compress(raw)) / len(raw) if raw else 0.0
        assert got[i]["ratio"] == ratio and got[i]["bad_chunk_share"] == (bad / len(raw) if raw else 0.0)
        assert got[i]["kept"] == (not failed and band(len(raw), ratio) and bad <= Q.CHUNK_SHARE * len(raw))
    assert {got[i]["kept"] for i in range(len(texts))} == {True, False}
    assert Q.compression_bands(make_docs(["a"], [None])).first()["doc_id"] is None


def test_bands():
    noise = np.random.default_rng(0).integers(33, 127, 30000).astype(np.uint8).tobytes().decode()
    spaced = " ".join(noise[i : i + 7] for i in range(0, len(noise), 7))
    from cellarium.llm.common import WordHash

    out = Q.measure(spaced, WordHash(), zstandard.ZstdCompressor(level=3))
    assert not out[5] and not out[6], "incompressible text passes the base and fails its band"


# -- HTML ----------------------------------------------------------------------------------------------------------------
def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var a='</p><p>no';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        (page("<nav><a>Menu</a></nav><article><h1>Head</h1><p>One &amp; two<br>three</p><p> Four\n  five </p></article><footer>F</footer>"), "Head One & two three Four five"),
        (page("<header>Site</header><div class='ad'>Buy this now please</div><main><p>Text <b>bold</b>er.</p><aside>Side</aside><form>Name <input></form><p>&#233;&eacute;</p></main>"), "Text bolder. éé"),
        (page("<article><p>Body text.</p><div id='comments'><p>First!</p></div><section class='cookie-notice'>We use cookies</section></article>"), "Body text."),
        (page("<article><p>cut off &am")[: -len("</body></html>")], "cut off &am"),
        (page("<article><p>a<p>b<b>c</p></article><footer>x</footer>"), "a bc"),
        (page("<div id='top'><a>Home</a> <a>About</a> <a>More</a></div><div><p>" + "A long paragraph of plain words. " * 8 + "</p><p>" + "Another one follows here. " * 9 + "</p></div><div><a>x</a><a>y</a></div>"), ("A long paragraph of plain words. " * 8 + "Another one follows here. " * 9).strip()),
    ],
)
def test_main_text(html, want):
    assert H.main_text(html) == want


LONG = ["A long paragraph of plain words. " * 8, "Another one follows here. " * 9, "And a third one ends it all. " * 9]


def test_article_is_a_prior_only():
    teasers = "".join(f"<article><a>Teaser {i}</a> <a>more</a></article>" for i in range(9))
    got = H.main_text(page(teasers + "<div>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div>"))
    assert all(x.strip() in got for x in LONG) and "Teaser 0" not in got
    got = H.main_text(page("<article>" + "".join(f"<p>Verse {i} of a poem</p>" for i in range(20)) + f"</article><div><a>x</a></div><div>{LONG[0]}</div>"))
    assert got.startswith("Verse 0 of a poem Verse 1") and "Verse 19" in got


def test_short_blocks_of_the_main_text_stay():
    items = "<ul>" + "".join(f"<li>a short item {i}</li>" for i in range(8)) + "</ul>"
    cells = "<table>" + "".join(f"<tr><td>cell {i}</td><td>{i}</td></tr>" for i in range(6)) + "</table>"
    menu = "<div>" + "".join(f"<a href='/{i}'>Menu {i}</a> " for i in range(9)) + "</div>"
    text = f"<p>{LONG[0]}</p>{items}<p>{LONG[1]}</p>{cells}<div><div>short line</div></div><p>{LONG[2]}</p>{items}"
    words = " ".join(re.sub("<[^>]*>", " ", text).split())
    assert H.main_text(page(f"{menu}<div>{text}</div>{menu}")) == words
    assert H.main_text(page(f"{menu}{text}{menu}")) == words
    split = "".join(f"<section><div>{x}</div></section>" for x in (LONG[0], items, LONG[1], cells, LONG[2]))
    assert H.main_text(page(f"{menu}<div>{split}</div>{menu}")) == " ".join(re.sub("<[^>]*>", " ", split).split())


def test_names_and_nested_inlines():
    assert H.main_text(page("<article><p>One <span class='ad'><span>Buy</span> now <b>here</b></span> two</p></article>")) == "One two"
    assert H.main_text(page("<article><div class='post-header'><h1>Title</h1></div><p>Text <mark id='note-share'>shares</mark> rose.</p></article>")) == "Title Text shares rose."
    got = H.main_text(page(f"<article><h2 id='related-work'>Related</h2><p id='share-of-market'>{LONG[0]}</p><section id='search-algorithms'><p>{LONG[1]}</p></section><div id='share'>Share me</div><p class='notice'>Mind this</p></article>"))
    assert got == " ".join(["Related", LONG[0].strip(), LONG[1].strip()])


@pytest.mark.parametrize("seed", range(6))
def test_generated_pages(seed, monkeypatch):
    """Pages without names or articles: paragraphs between menus, whose text is known; the threshold decides."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    menu = lambda: "<div><ul>" + "".join(f"<li><b>{word()}</b></li>" for _ in range(r.randint(8, 15))) + "</ul></div>"
    paras = [" ".join(word() for _ in range(r.randint(30, 80))) for _ in range(r.randint(3, 8))]
    html = page(menu() + menu() + "<div>" + "".join(f"<p>{p}</p>" for p in paras) + "</div>" + menu())
    assert H.main_text(html) == " ".join(paras)
    monkeypatch.setattr(H, "threshold", lambda v: float("-inf"))
    assert H.main_text(html) != " ".join(paras), "without the two clusters another text comes out"


def test_threshold_decides_beside_an_article(monkeypatch):
    teasers = "".join(f"<article><b>Teaser {i}</b> <i>more</i></article>" for i in range(9))
    html = page(teasers + "<div>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div>")
    found = H.main_text(html)
    monkeypatch.setattr(H, "threshold", lambda v: float("-inf"))
    assert H.main_text(html) != found


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", page("<article><p>é x</p></article>")), (2, None, None), (2, None, None), (3, "v", "<p>" * 3000 + "deep")], "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("z")})
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.extract(pages).collect())
    assert got[0] == (1, "é x", 3) and got[1] == got[2] == (2, "", 0) and len(got) == 4
    assert H.extract(pages.limit(0)).count() == 0


# -- decontamination -----------------------------------------------------------------------------------------------------
def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at every pair of places."""
    a, b, out = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and doc[i + k] >= 0 and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        out += best[0]
        for k in range(best[0]):
            a[best[1] + k] = b[best[2] + k] = True


def test_tiles_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(60):
        item = r.integers(0, 9, r.integers(1, 30))
        parts = [item[s : s + r.integers(1, 12)] for s in r.integers(0, len(item), 4)]
        doc = np.concatenate([x for p in parts for x in (p, r.integers(-1, 9, r.integers(0, 6)))])
        found = D.tiles(doc, item, 3)
        assert sum(t[2] for t in found) == brute_tiles(doc.tolist(), item.tolist(), min(3, len(item)))
        assert [t[2] for t in found] == sorted((t[2] for t in found), reverse=True)
        for s, p, k in found:
            assert doc[s : s + k].tolist() == item[p : p + k].tolist()


def test_decontamination(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (5, "some other words that nobody has ever used")], "item_id long, text string").withColumn("coverage", F.lit(1))
    docs = make_docs(["x " + item.upper() + ". y", "zeta eta theta iota kappa, and alpha beta gamma delta epsilon!", "alpha beta gamma delta then nothing", None, "", "well one two three", "one x two", "y " * 50000 + item])
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect())
    assert got == [(0, 1), (1, 1), (5, 4), (7, 1)]
    clean = D.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 6]
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 8


def brute_contaminated(docs, items, least, share):
    """Every document against every item."""
    clean = lambda t: D.clean((t or "").lower().encode().split())
    out = []
    for i, t in docs:
        for k, x in items:
            a, b = clean(t), clean(x)
            ids = {w: n for n, w in enumerate(dict.fromkeys(b))}
            if b and brute_tiles([ids.get(w, -1) for w in a], [ids[w] for w in b], min(least, len(b))) >= share * len(b):
                out.append((i, k))
    return sorted(out, key=str)


def test_contaminated_against_brute_force(spark, make_docs):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["of", "the", "and"] * 10
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((2, 4, 7, 12, 30))))) for i in range(14)]
    items += [(20, items[0][1]), (20, items[0][1]), (21, "of the and of the and of the"), (22, None), (23, "")]
    texts = []
    for _ in range(30):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 12)))]
        for _ in range(r.randint(0, 2)):
            x = r.choice(items)[1] or ""
            w = x.split()
            k = r.randint(0, max(0, len(w) - 1))
            parts.append(r.choice((x.upper(), " ".join(w[k:] + w[:k]), " ".join(w[: k + 1]), f"({x}),")))
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], "of the and " * 40, None, "", "!! -- ??"]
    ids = [None if i % 9 == 5 else i for i in range(len(texts))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x["doc_id"], x["item_id"]) for x in D.contaminated(make_docs(texts, ids), bench).collect()), key=str)
    assert got == brute_contaminated(list(zip(ids, texts, strict=True)), items, D.LEAST, D.COVERAGE)
    kept = D.drop_contaminated(make_docs(texts), bench)
    bad = {i for i, _ in brute_contaminated(list(enumerate(texts)), items, D.LEAST, D.COVERAGE)}
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i in range(len(texts)) if i not in bad]


def test_bloom_filter_lets_seeds_through(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    bits = D._bitmap(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"))
    assert len(D._maybe(bits, h)) == len(h)
    assert len(D._maybe(bits, np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64))) < 50


def test_equal_hashes_of_different_words(monkeypatch):
    """With hashes that say nothing the words still decide."""
    monkeypatch.setattr(D.Running, "windows", lambda self, size: np.zeros(max(0, len(self.sums) - size), np.uint64))
    item, doc = np.arange(6), np.array([9, 1, 2, 3, 8, 8])
    assert D.tiles(doc, item, 3) == [(1, 1, 3)] and D.tiles(np.array([7, 7, 7]), item, 3) == []


# -- secrets -------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def trees(spark):
    return S.trained(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_secrets(spark, make_docs, trees):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'word token = "{key}" more', f"commit {key} fixed", "theredanbleshrethenation is a word", None, "", f'a token = "{key}"\nb token = "{key}"', "4785380592391139", "x" * 100000, f'TOKEN = "{key.upper()}"!!']
    docs = make_docs(texts)
    got = {(r["doc_id"], r["finding"]): r["is_secret"] for r in S.scan(docs, trees).collect()}
    assert got == {(0, 0): True, (1, 0): False, (2, 0): False, (5, 0): True, (5, 1): True, (6, 0): False, (7, 0): False, (8, 0): True}
    clean = {r["doc_id"]: r for r in S.redact(docs.withColumn("n_chars", F.lit(1).cast("long")), trees).collect()}
    assert clean[0]["text"] == 'word token = "[SECRET]" more' and clean[0]["n_chars"] == 28
    assert clean[5]["text"] == 'a token = "[SECRET]"\nb token = "[SECRET]"'
    assert all(clean[i]["text"] == texts[i] and clean[i]["n_chars"] == 1 for i in (1, 2, 3, 4, 6, 7))
    assert S.redact(docs, trees, count_col=None).columns == docs.columns
    assert S.scan(docs.limit(0), trees).count() == 0
    assert "Python" not in S.scan(docs, trees)._jdf.queryExecution().executedPlan().toString()


def test_short_secrets(make_docs, trees):
    secret = {'the password: "hunter2pw" works': "hunter2pw", "set api_key = k3Jd82hQx9Lp now": "k3Jd82hQx9Lp", 'DB_PASSWORD="pa!Ss@w0rd#x9"': "pa!Ss@w0rd#x9"}
    plain = ["Note: words follow here", "the password is required and the token expired", 'name = "garden"', "count: 12345 rows", "password: changeme"]
    docs = make_docs([*secret, *plain])
    clean = {r["doc_id"]: r["text"] for r in S.redact(docs, trees, count_col=None).collect()}
    assert [clean[i] for i in range(len(clean))] == [t.replace(c, S.SECRET) for t, c in secret.items()] + plain
    got = {(r["doc_id"], r["n_chars"]) for r in S.scan(docs, trees).collect() if r["is_secret"]}
    assert got == {(i, len(c)) for i, c in enumerate(secret.values())}


def test_forest_expression(spark, trees):
    """Held-out findings: the expression votes as the trees do, and is right."""
    held = S.labelled_findings(n=400, seed=99)
    rows = spark.createDataFrame(held, "c string, l string, r string, p string, y int")
    got = rows.select(S.features(F.struct("c", "l", "r", "p"), trees.words).alias("f"), "y").withColumn("s", F.element_at(F.transform(F.array("f"), lambda f: S._votes(trees.trees, f)), 1)).collect()
    assert all(g["s"] == pytest.approx(S.vote(trees.trees, list(g["f"]))) for g in got)
    assert np.mean([(g["s"] >= S.CUT) == bool(g["y"]) for g in got]) > 0.93


def test_candidates_against_brute_force(make_docs, trees):
    """Places and digests of all candidates, by another engine's regular expressions; scores by the trees, one by one."""
    r = random.Random(3)
    bits = ["token", "password: ", "api_key = ", '"', "'", "=", ": ", "aB3$x9!", "f" * 20, "x1-_/." * 4, "word", " ", "\n", "é", "hunter2", "secret is ", "key", "(", "]", "Bearer ", "a=b", "==", "https://x.org/abcdef/ghijkl"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(150)] + [None, "", "q" * 40000, "password: p4ss" * 2, "password: p4ss" * 2]
    ids = [None if i % 11 == 3 else i for i in range(len(texts))]
    want, long = [], re.compile(f"^{S._LONG}$")
    for i, t in zip(ids, texts, strict=True):
        for k, m in enumerate(re.finditer(S.CANDIDATE, t or "")):
            head = "" if long.match(m[0]) else re.match(f"^{S._HEAD}{S._QUOTE}?", m[0])[0]
            c = m[0][len(head) :]
            want.append((str(i), k, c, m.start() + len(head), len(c), zlib.crc32(c.encode())))
    got = S.scan(make_docs(texts, ids), trees).collect()
    assert sorted((str(x["doc_id"]), x["finding"], x["candidate"], x["start"], x["n_chars"], x["crc32"]) for x in got) == sorted(want)
    assert all(x["is_secret"] == (x["score"] >= S.CUT) for x in got)


def test_own_findings_and_dictionary(spark, make_docs):
    docs = make_docs(["garden river garden bridge", "River, garden!", None, "x"])
    assert S.dictionary(docs) == ["garden", "river"] and S.dictionary(docs, size=1) == ["garden"] and S.dictionary(docs.limit(0)) == []
    assert all(re.fullmatch(S.pattern_of(["ab", "abc", "b"]), w) for w in ("ab", "abc", "b")) and not re.search(S.pattern_of([]), "a")
    rows = spark.createDataFrame([(c * 18, "at ", "", "", int(c in "kz")) for c in "abckzdefzk"] * 6 + [(None, "", "", "", 1)], "c string, l string, r string, p string, y int")
    upper = rows.withColumn("c", F.when(F.col("y") == 1, F.upper("c")).otherwise(F.col("c")))
    scanner = S.trained(docs, upper)
    got = [x["is_secret"] for x in S.scan(make_docs(["K" * 18, "e" * 18]), scanner).orderBy("doc_id").collect()]
    assert got == [True, False], "the forest follows the findings that are given"
    assert not any(x["is_secret"] for x in S.scan(make_docs(["K" * 18]), S.trained(docs, upper.limit(0))).collect())


def test_redact_keeps_clashing_columns(make_docs, trees):
    docs = make_docs(['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None]).withColumns({"_clean": F.lit("mine"), "a.b": F.lit(1)})
    got = S.redact(docs, trees, count_col=None)
    assert got.columns == docs.columns and [x["_clean"] for x in got.collect()] == ["mine", "mine"]
