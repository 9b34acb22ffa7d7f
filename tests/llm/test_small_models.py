import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import langid, ordinal, toxicity
from cellarium.llm.textmodel import Featurizer, labelled

TEXTS = {
    "en": "the house and the garden are near that river with this bridge",
    "de": "das haus und der garten sind nicht weit von der brücke über den fluss",
    "fr": "la maison et le jardin sont près de la rivière avec un pont",
}


def corpus(n=60):
    r = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = sorted(TEXTS)[i % 3]
        out.append((i, " ".join(r.choice(TEXTS[lang].split(), 12)), lang))
    return out


def test_language(spark):
    docs = spark.createDataFrame([*corpus(), (100, None, "en"), (101, "123 !?", None), (102, "", "fr"), (103, "der garten und das haus " * 8000, None), (None, "the river and the bridge", "en"), (0, corpus()[0][1], "de")], "doc_id long, text string, lang string")
    docs = docs.withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "held_out": F.lit(0)})
    model = langid.fit_documents(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == 66
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in corpus() if i)
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got) and not by[None]["held_out"]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert langid.identify(docs.limit(0), langid.fit_documents(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit_documents(docs.limit(0))).collect()} == {"und"}


def test_language_ignores_other_columns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.fit_documents(docs)
    a = {r["doc_id"]: r["score"] for r in langid.identify(docs, model).collect()}
    b = {r["doc_id"]: r["score"] for r in langid.identify(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def toxic_rows(n=300):
    r = np.random.default_rng(2)
    words = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        t = list(r.choice(words, 30))
        bad = i % 5 == 0
        if bad:
            t[3:3] = list(r.choice(["idiot", "stupid", "grublik", "grubsch"], 3))
        out.append({"doc_id": i, "text": " ".join(t), "toxic": int(bad)})
    return out


def test_toxicity(spark, make_docs):
    chain = toxicity.fit(toxic_rows())
    docs = make_docs(["word1 word2 idiot word3 stupid", "word1 word2 word3 word4", None, "", "grubnew grubly word5 grubsch"])
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, chain).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True}
    nothing = toxicity.fit([])
    assert not any(r["toxic"] for r in toxicity.score_toxicity(docs, nothing).collect())
    assert toxicity.score_toxicity(docs.limit(0), chain).count() == 0


def test_toxicity_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = labelled(docs, labels, ["toxic"])
    train, test = [r for r in rows if r["doc_id"] % 3], [r for r in rows if not r["doc_id"] % 3]
    chain = toxicity.fit(train)
    got = chain.predict(*Featurizer()([r["text"] for r in test]))[:, -1] >= chain.cut
    want = np.array([r["toxic"] == 1 for r in test])
    assert (got & want).sum() >= 0.6 * want.sum() and (got & ~want).sum() <= 0.06 * (~want).sum(), "of 275 rows, 38 toxic"


def test_given_categories(spark, make_docs):
    """Labels with categories of their own: the chain has a link for each, in order, and uses the earlier ones."""
    rows = [r | {"rude": r["toxic"], "long": int(r["doc_id"] % 2)} for r in toxic_rows()]
    chain = toxicity.fit(rows, ["rude", "long"])
    assert chain.names == ["rude", "long", "toxic"] and [len(x.dense) for x in chain.links] == [0, 1, 2] and abs(chain.links[2].dense[0]) > 0.01
    got = toxicity.score_toxicity(make_docs(["word1 idiot stupid"]), chain)
    assert got.columns == ["doc_id", "p_rude", "p_long", "p_toxic", "toxic"]


def brute_features(text):
    """Presence of hashed features, token by token."""
    from cellarium.llm import textmodel as M

    text, out = text or "", set()
    for t in text.split():
        out |= set(M.token_features(t))
    n = len(text.split())
    out.add(M._h(f"length {n.bit_length()}"))
    if n:
        lines = [x for x in text.split("\n") if x.strip()]
        out |= {M._h(f"distinct {8 * len(set(text.split())) // n} {n.bit_length()}"), M._h(f"lines {8 * len(set(lines)) // len(lines)}")}
        out |= {M._h(f"upper {10 * sum('A' <= c <= 'Z' for c in text) // len(text)}"), M._h(f"signs {20 * sum(c in '#*$%&|<>!' for c in text) // len(text)}")}
    return out - {M.FEATURES}


ODD = ["Word word, WORD! a1b2 x", None, "", " \n ", "é É naïve ÀB9 $$$ ###", "日本語 text 123", "a\nb\na\n\n", "token " * 3000 + "Q" * 5000 + "7x" * 400, "same", "same"]


def test_scores_against_brute_force(make_docs):
    """Both classifiers' queries, from features taken one by one."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    docs = make_docs(ODD, [1, 2, 3, 4, 5, 6, 7, 8, None, None])
    chain = toxicity.fit(toxic_rows())
    model = ordinal.fit(Featurizer().each([r["text"] for r in toxic_rows()]), np.array([2 - 2 * r["toxic"] if r["doc_id"] % 7 else 1 for r in toxic_rows()]))
    want_p, want_t = {}, {}
    for i, t in zip([1, 2, 3, 4, 5, 6, 7, 8, None, None], ODD, strict=True):
        f, p = sorted(brute_features(t)), []
        for x in chain.links:
            p.append(sig(x.weights[f].astype(float).sum() + np.dot(x.dense, p) + x.bias))
        want_p[i], want_t[i] = p, sig(model.weights[f].astype(float).sum() - model.cuts)
    got = toxicity.score_toxicity(docs, chain).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert np.allclose([r[f"p_{c}"] for c in chain.names], want_p[r["doc_id"]], atol=1e-4) and r["toxic"] == (r["p_toxic"] >= chain.cut)
    for r in ordinal.score_quality(docs, model).collect():
        t = want_t[r["doc_id"]]
        assert np.isclose(r["expected_grade"], t.sum(), atol=1e-4) and np.isclose(r["p_tail"], t[0], atol=1e-4)
        assert r["selected"] == (r["p_tail"] >= 0.5 and r["expected_grade"] >= 1)


def test_best_cut_ties():
    assert toxicity.best_cut(np.array([0.5, 0.5, 0.5]), np.array([True, False, True])) < 0.5
    assert toxicity.best_cut(np.array([0.2, 0.9]), np.array([False, False])) > 1


def test_kernel_against_brute_force():
    """Scores from the kernel of two sets of n-grams, one pair after another."""
    texts, langs = [t for _, t, _ in corpus()], [x for _, _, x in corpus()]
    m = langid.fit(texts, langs)
    sets = [set(langid.grams(langid.letters(t)).tolist()) for t in texts]
    marks = [{g for g in range(langid.BUCKETS) if m.index[g] >= 0 and m.landmarks[m.index[g], c] > 0} for c in range(0, m.landmarks.shape[1], 17)]
    s, known = m.product([np.array(sorted(x)) for x in sets[:9]], np.vstack([m.landmarks, np.zeros((1, m.landmarks.shape[1]))]))
    for i, a in enumerate(sets[:9]):
        for c, b in zip(range(0, m.landmarks.shape[1], 17), marks, strict=True):
            assert s[i, c] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), abs=1e-5)
    every = {g for x in sets for g in x}
    assert sum(m.index >= 0) == len(every), "with as many landmarks as texts, every n-gram counts"
    langs, scores = m.predict(["щука и рак", "the house and the garden"])
    assert scores[0] < 0.15 < 0.9 < scores[1] and langs[1] == "en"


def test_labelled_is_bounded_and_clean(spark, make_docs):
    docs = make_docs(["a b", "c d", None, "e f"])
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (3, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert [(r["doc_id"], r["toxic"]) for r in labelled(docs, labels, ["toxic"])] == [(0, 1), (3, 0)]
    assert len(labelled(docs, labels, ["toxic"], limit=1)) <= 1


def test_fits_are_bounded(spark):
    from cellarium.llm.common import bounded_rows

    rows = spark.createDataFrame([(1, "a" * 50), (1, "b" * 5), (1, "b" * 5), (2, "c" * 5), (None, "x"), (3, None)], "id long, text string")
    got = bounded_rows(rows, "id", "text", 10, 20, 1)
    assert sorted((r["id"], r["text"]) for r in got) == [(1, "bbbbb"), (2, "ccccc")], "each row once; what is too long is passed over"
    assert len(bounded_rows(rows, "id", "text", 1, 1000, 1)) == 1 and bounded_rows(rows.limit(0), "id", "text", 5, 5, 1) == []


def test_ordinal_gradient():
    r = np.random.default_rng(0)
    y, s, e = r.integers(0, 3, 40), r.normal(size=40), np.array([-0.3, 0.4])

    def loss(s, e):
        cuts = np.array([e[0], e[0] + np.exp(e[1])])
        tail = np.column_stack([np.ones(40), 1 / (1 + np.exp(cuts[0] - s)), 1 / (1 + np.exp(cuts[1] - s)), np.zeros(40)])
        return -np.log(tail[np.arange(40), y] - tail[np.arange(40), y + 1]).sum()

    gs, ge = ordinal.cumulative_slope(y, 3)(s, e)
    for i in (0, 7, 20):
        d = np.eye(40)[i] * 1e-5
        assert gs[i] == pytest.approx((loss(s + d, e) - loss(s - d, e)) / 2e-5, abs=1e-4)
    for i in range(2):
        d = np.eye(2)[i] * 1e-5
        assert ge[i] == pytest.approx((loss(s, e + d) - loss(s, e - d)) / 2e-5, abs=1e-3)


def test_ordinal(spark, make_docs):
    make = Featurizer()
    rows = [(r["text"] + (" bad !!! $$$" if i % 4 == 1 else ""), 0 if i % 4 == 1 else 1 if r["toxic"] else 2) for i, r in enumerate(toxic_rows(400))]
    model = ordinal.fit(make.each([t for t, _ in rows]), np.array([g for _, g in rows]))
    assert model.cuts[0] < model.cuts[1]
    docs = make_docs(["word1 word2 word3 " * 10, "word1 word2 bad !!! $$$", None, ""])
    got = {r["doc_id"]: r for r in ordinal.score_quality(docs, model).collect()}
    assert got[0]["selected"] and not got[1]["selected"] and got[0]["expected_grade"] > got[1]["expected_grade"]
    assert len(got) == 4 and ordinal.score_quality(docs.limit(0), model).count() == 0
    only = ordinal.fit(make.each(["a"]), np.array([0]))
    assert not any(r["selected"] for r in ordinal.score_quality(docs, only).collect())
    assert all(r["selected"] for r in ordinal.score_quality(docs, ordinal.fit([], np.array([]))).collect())
