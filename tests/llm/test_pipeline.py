import zlib

import numpy as np
import pytest

import corpus_pipeline
from cellarium.llm import packing as P
from cellarium.llm.common import ascii_words

from .test_layout import check, whole_ids
from .test_ngram_join import brute, sets_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    from cellarium.llm.common import written

    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, SF))
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language(steps):
    assert {r["doc_id"] for r in steps[0]} - {r["doc_id"] for r in steps[1]} == set()
    assert steps[1][0].asDict().keys() == steps[0][0].asDict().keys()


def test_duplicates(steps):
    ids, texts = zip(*[(r["doc_id"], r["text"]) for r in steps[1]], strict=True)
    comps = brute(ids, sets_of(texts))
    assert {r["doc_id"] for r in steps[2]} == {i for i, (_, c) in comps.items() if i == c}
    assert by_id(steps[2]) == {i: r for i, r in by_id(steps[1]).items() if comps[i][1] == i}


def test_benchmark(spark, steps):
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(x := b" ".join(ascii_words(r["text"]))) > 0]
    has = {r["doc_id"] for r in steps[2] if any(x in b" ".join(ascii_words(r["text"])) for x in items)}
    gone = {r["doc_id"] for r in steps[2]} - {r["doc_id"] for r in steps[3]}
    assert has <= gone and len(gone) <= len(has) + 2


def test_secrets(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r["text"] == before[i]["text"] or "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        assert 'token = "' not in r["text"].lower() or "[SECRET]" in r["text"]


def test_packing(steps):
    rows = sorted(steps[4], key=lambda r: r["doc_id"])
    number = {r["doc_id"]: i for i, r in enumerate(rows)}
    pieces = [r.asDict() | {"doc_id": number[r["doc_id"]]} for r in steps[5]]
    check(pieces, whole_ids([r["text"] for r in rows]))
    assert zlib.crc32(b"") == 0 and np.dtype("<u4").itemsize == 4 and P.WINDOW == 4096


def test_run(spark, steps):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["sequence_id"])
    assert len({key(r) for r in corpus_pipeline.run(spark, SF).collect()}) == len(steps[5])


@pytest.fixture
def edge_docs(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    words = "the house and the garden are near that river with this bridge for all of them".split()
    r = np.random.default_rng(5)
    prose = [" ".join(r.choice(words, 60)) for _ in range(6)]
    texts = [*prose, prose[0], None, "", "123 ??", item, prose[1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', prose[2], prose[3] + " end"]
    ids = [*range(6), 6, 7, 8, 9, 10, 11, None, 13]
    rows = [(i, t, "en", None if k % 4 == 0 else "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, lang string, source string, n_chars long")


def test_edges_through_all_stages(spark, edge_docs):
    """Nulls, empty texts, copies, rows that repeat, a leak and a secret, through every stage on its predecessor's rows."""
    from cellarium.llm.common import written

    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["language_id"](spark, edge_docs, SF))
    left = sorted(str(r["doc_id"]) for r in docs.collect())
    assert not {"7", "8", "9"} & set(left) and left.count("4") == 3 and "None" in left
    docs = written(stages["near_duplicates"](spark, docs, SF))
    left = sorted(str(r["doc_id"]) for r in docs.collect())
    assert left.count("4") == 1 and "6" not in left and "None" in left and {"0", "1", "2", "3", "4", "5", "10"} <= set(left)
    docs = written(stages["decontamination"](spark, docs, SF))
    assert "10" not in {str(r["doc_id"]) for r in docs.collect()}
    docs = written(stages["secret_scan"](spark, docs, SF))
    assert docs.columns == edge_docs.columns and docs.dtypes == edge_docs.dtypes
    assert not any("24be64439e3e" in r["text"] for r in docs.collect())
    packed = stages["mixture_packing"](spark, docs, SF).collect()
    assert sum(r["length"] for r in packed) == sum(len(x) for x in whole_ids([r["text"] for r in docs.collect()]))


def test_no_documents(spark, edge_docs):
    from cellarium.llm.common import written

    docs = written(edge_docs.limit(0))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0
