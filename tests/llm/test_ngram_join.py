import tracemalloc

import numpy as np
import pytest

from cellarium.llm import ngram_join as J
from cellarium.llm.common import WordHash, ascii_words, shingles


def sets_of(texts):
    words = [ascii_words(t) for t in texts]
    return [set() if not w else {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def brute(ids, sets):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, sets, strict=True):
        for j, b in zip(ids, sets, strict=True):
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("tile_rows, centres", [(4096, 4), (2, 1)])
def test_against_brute_force(make_docs, near_texts, monkeypatch, tile_rows, centres):
    monkeypatch.setattr(J, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(J, "CENTRES", centres)
    ids = [3 * i + 1 for i in range(len(near_texts))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_jaccard_join(make_docs(near_texts, ids)).collect()}
    assert got == brute(ids, sets_of(near_texts))


def test_edges(spark, make_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_jaccard_join(make_docs(["a b", "A  B", None, "", "a b", "c", "a b"], [5, 4, 3, 2, 5, None, None])).collect()}
    assert got == {(5, 1, 4), (4, 1, 4), (3, 0, 3), (2, 0, 2), (None, 1, None)}
    assert J.ngram_jaccard_join(make_docs([])).count() == 0


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)]))
        if len(b) and J.similar(a, b):
            assert J.possible(J.signature(a), J.signature(b), len(a), len(b))


def test_exact_threshold():
    words = WordHash()
    a = shingles(words.of([str(i).encode() for i in range(14)]), 5)  # 10 shingles
    assert J.similar(a, a[:8]) and not J.similar(a, a[:7]) and not J.similar(a, a[:0])


def test_chain_of_links(make_docs):
    """Documents far apart at the ends, linked one by one."""
    texts = [" ".join(f"t{k}" for k in range(i * 6, i * 6 + 100)) for i in range(12)]
    assert {r["component_id"] for r in J.ngram_jaccard_join(make_docs(texts)).collect()} == {0}


@pytest.mark.parametrize("shingles, rows", [(1_000_000, 2048), (60, 3)])
def test_links_of_every_class(make_docs, near_texts, monkeypatch, shingles, rows):
    """The links inside a group of near copies too, whichever tiles they lie in."""
    monkeypatch.setattr(J, "LINK_SHINGLES", shingles)
    monkeypatch.setattr(J, "LINK_ROWS", rows)
    words = [f"n{i}" for i in range(240)]
    copies = [" ".join([*words[:k], "x", *words[k + 1 :], *["end"] * (k % 9)]) for k in range(0, 240, 8)]
    texts = [*near_texts, *copies]
    sets = sets_of(texts)
    classes = set(map(frozenset, sets)) - {frozenset()}
    want = {s: sum(100 * len(s & t) >= 80 * len(s | t) for t in classes if t != s) for s in classes}
    got = {r["doc_id"]: r["n_links"] for r in J.ngram_jaccard_join(make_docs(texts)).collect()}
    assert got == {i: want.get(frozenset(s), 0) for i, s in enumerate(sets)} and max(got.values()) > 16


def test_a_large_tile_is_counted_in_strips():
    """Beside the one matrix of all pairs there are no others."""
    n, rng = 2000, np.random.default_rng(4)
    sets = [np.sort(rng.permutation(22)[:20]).astype(np.uint64) for _ in range(n)]
    rows = np.zeros((n, 22), np.int64)
    for i, s in enumerate(sets):
        rows[i, s.astype(np.int64)] = 1
    both = rows @ rows.T
    want = (100 * both >= 80 * (40 - both)).sum(axis=1) - 1
    tracemalloc.start()
    got = J.links_of(list(range(n)), [0] * n, sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == want.tolist() and 0 < want.min()
    assert peak < 3 * 4 * n * n


def test_links_of_a_tile():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(30)]
    sets += [np.append(s[1:], np.uint64(1 << 63)) for s in (rng.integers(1000 * k, 1000 * k + 900, 60).astype(np.uint64) for k in range(1, 20)) for s in (np.unique(s), np.unique(s))]
    for blocks in ([0] * len(sets), [i % 2 for i in range(len(sets))]):
        want = [sum(i != j and (len(set(blocks)) == 1 or blocks[i] != blocks[j]) and J.similar(np.sort(a), np.sort(b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
        assert J.links_of(list(range(len(sets))), blocks, sets).tolist() == want
