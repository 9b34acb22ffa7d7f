import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import packing as P
from cellarium.llm import sharding as G


# -- sharding --------------------------------------------------------------------------------------------------------
def test_shards(make_docs):
    texts = [f"text {i // 3}" for i in range(90)] + [None, None, "", "", "é" * 50000] + ["hot"] * 60 + [f"single {i}" for i in range(37)]
    docs = make_docs(texts)
    rows = G.balanced_shards(docs).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert by[i]["size"] == len(raw) + 1 and by[i]["text_crc32"] == zlib.crc32(raw) and by[i]["law"] == "rows" and by[i]["grown_shard"] is None
    counts = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    whole = sum(len({by[i]["shard"] for i in range(k, k + 3)}) == 1 for k in range(0, 90, 3))
    assert whole >= 25, "groups that fit stay together"


@pytest.mark.parametrize("texts", [[], ["a"], ["a"] * 9, [None] * 5])
def test_small_shards(make_docs, texts):
    rows = G.balanced_shards(make_docs(texts)).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1


def test_cut_links(make_docs):
    """Groups of every size: few links are cut, and more groups stay whole than a random dealing would leave whole."""
    r = np.random.default_rng(1)
    texts = [f"g{g}" for g in range(120) for _ in range(int(r.integers(2, 6)))] + [f"m{g}" for g in range(12) for _ in range(20)] + [f"one{i}" for i in range(200)]
    rows = G.balanced_shards(make_docs(texts)).collect()
    by = {}
    for x in rows:
        by.setdefault(texts[x["doc_id"]], []).append(x["shard"])
    groups = [s for s in by.values() if len(s) > 1]
    assert sum(len(set(s)) == 1 for s in groups) >= len(groups) - 7, "only groups at the end of a gap are cut"
    counts = [sum(x["shard"] == s for x in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1


def test_null_ids_and_ties(make_docs):
    rows = G.balanced_shards(make_docs(["a", "a", "b", None], [None, None, 1, 1])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None", "None"] and sorted(r["shard"] for r in rows) == sorted({r["shard"] for r in rows})
    packed = P.pack_mixture(make_docs(["a b", "a b", None], [None, None, 1])).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in packed) == [("1", 1), ("None", 3), ("None", 3)]


def test_moves_respect_capacity():
    r = np.random.default_rng(0)
    for _ in range(50):
        want = r.integers(0, 30, (4, 4)) * (1 - np.eye(4, dtype=int))
        room = r.integers(0, 20, 4).tolist()
        flow = np.array(G.allowed_moves(want.tolist(), room))
        assert (flow <= want).all() and (flow.sum(axis=0) <= np.array(room) + flow.sum(axis=1)).all()


# -- packing ---------------------------------------------------------------------------------------------------------
def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path())
    return [np.array([*e.ids, P.END_ID], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = [f"word{i} and some more words, " * (i % 40 + 1) for i in range(150)] + [None, "", "日本語 text", "Café ΣΑΣ", "it's we'll '''s", "\x1c\x1dx", "<|endoftext|> y", "long text " * 9000]


def check(rows, ids):
    seen = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        x = ids[r["doc_id"]]
        assert seen.get(r["doc_id"], 0) == r["start"] and r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] = r["start"] + r["length"]
    assert all(seen[i] == len(x) for i, x in enumerate(ids))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    fill = []
    for q in sorted(by):
        at = 0
        for r in sorted(by[q], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        fill.append(at)
    assert sorted(by) == list(range(len(by))) and all(f == P.WINDOW for f in fill[:-1]) and fill[-1] <= P.WINDOW
    return by


def test_round_trip(make_docs):
    rows = P.pack_mixture(make_docs(TEXTS)).collect()
    ids = whole_ids(TEXTS)
    by = check(rows, ids)
    share = {}
    for i, x in enumerate(ids):
        share[f"s{i % 3}"] = share.get(f"s{i % 3}", 0) + len(x)
    total = sum(share.values())
    for q in sorted(by)[: total // P.WINDOW - 1]:
        for s, n in share.items():
            got = sum(r["length"] for r in by[q] if r["source"] == s)
            assert abs(got - P.WINDOW * n / total) <= 2 * P.QUANTUM


def test_windows_have_their_tokens(make_docs):
    rows, ids = P.pack_mixture(make_docs(TEXTS)).collect(), whole_ids(TEXTS)
    windows = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        x = np.frombuffer(r["ids"], "<u4")
        assert x.tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist()
        windows[r["sequence_id"]] = windows.get(r["sequence_id"], 0) + len(x)
    assert sum(windows.values()) == sum(map(len, ids)) and all(n == P.WINDOW for q, n in windows.items() if q < max(windows))


def test_targets_and_edges(make_docs):
    docs = make_docs(TEXTS).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("a")))
    rows = P.pack_mixture(docs, targets={"a": 3.0, None: 1.0}).collect()
    by = check(rows, whole_ids(TEXTS))
    first = by[0]
    assert sum(r["length"] for r in first if r["source"] == "a") == 3 * P.WINDOW // 4
    assert P.pack_mixture(make_docs([])).count() == 0
    one = P.pack_mixture(make_docs([None, None], [7, 7])).collect()
    assert [(r["doc_id"], r["length"]) for r in one] == [(7, 1), (7, 1)]


@pytest.mark.parametrize("cache", [20, 500_000])
def test_encoder_keeps_its_bounds(monkeypatch, cache):
    monkeypatch.setattr(P, "CACHE_WORDS", cache)
    e, want = P.Encoder(P.tokenizer_path()), whole_ids(TEXTS)
    for lo in (0, 0, 60, 120):  # the first again, with its words known
        ids, n = e([t or "" for t in TEXTS[lo : lo + 60]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x[:-1].tolist() for x in want[lo : lo + 60]]
    assert e([])[0].tolist() == []


def round_robin(full, weights):
    """Real counters: every queue that isn't dry earns credit by its weight; the one that reaches half a quantum first is
    served, and what it then owes is carried on."""
    credit, served, out = [Fraction(0)] * len(full), [0] * len(full), []
    while len(out) < sum(full):
        open_ = [k for k in range(len(full)) if served[k] < full[k]]
        wait = min((Fraction(1, 2) - credit[k]) / weights[k] for k in open_)
        first = next(k for k in open_ if (Fraction(1, 2) - credit[k]) / weights[k] == wait)
        for k in open_:
            credit[k] += wait * weights[k]
        credit[first] -= 1
        served[first] += 1
        out.append(first)
    return out


@pytest.mark.parametrize("full, weights", [([40, 30, 20], [40, 30, 20]), ([5, 60, 0, 7], [8, 1, 3, 3]), ([3], [1]), ([1, 100], [100, 1]), ([12, 12, 12], [1, 1, 1])])
def test_places_are_the_round_robins(full, weights):
    want = round_robin(full, weights)
    for k, n in enumerate(full):
        j = np.arange(n)
        assert P.quanta_before(np.full(n, k), j, weights, full).tolist() == [i for i, x in enumerate(want) if x == k]


def test_deficits_are_carried_and_bounded():
    full, weights = [1600, 700, 90], [1600, 700, 90]
    order, owed = round_robin(full, weights), []
    for at in range(0, len(order), P.WINDOW // P.QUANTUM):
        owed.append(P.deficits([order[:at].count(k) for k in range(3)], weights))
    assert max(abs(x) for o in owed for x in o) <= 1.5 and any(abs(x) > 0.1 for o in owed for x in o)


@pytest.mark.parametrize("targets", [None, {"s0": 8.0, "s1": 1.0, "s2": 1.0}])
@pytest.mark.parametrize("queues", [4096, 2])
def test_query_against_round_robin(make_docs, monkeypatch, targets, queues):
    monkeypatch.setattr(P, "QUEUES", queues)
    rows, ids = P.pack_mixture(make_docs(TEXTS), targets=targets).collect(), whole_ids(TEXTS)
    check(rows, ids)
    tokens = {}
    for i, x in enumerate(ids):
        tokens[f"s{i % 3}"] = tokens.get(f"s{i % 3}", 0) + len(x)
    names = sorted(tokens, key=lambda s: (-tokens[s], s))
    of = {s: min(k, queues) for k, s in enumerate(names)}  # the sources beyond share a queue
    sizes = [sum(tokens[s] for s in names if of[s] == k) for k in range(len(set(of.values())))]
    given = [None if targets is None else sum(targets[s] for s in names if of[s] == k) for k in range(len(sizes))]
    want = round_robin([n // P.QUANTUM for n in sizes], P.whole_weights(sizes, given))
    for r in rows:
        at = (r["sequence_id"] * P.WINDOW + r["offset"]) // P.QUANTUM
        assert at >= len(want) or want[at] == of[r["source"]]
