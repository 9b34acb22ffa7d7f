import random

import pytest

from cellarium.functions import bits as B
from cellarium.plans import index as I
from cellarium.plans import strategies as S


def test_bits():
    assert B.to_bits(B.to_mask([5, 0, 3])) == [0, 3, 5]
    assert B.gather_int(0b1010, [1, 2, 3]) == 0b101
    assert B.scatter_int(0b101, [1, 2, 3]) == 0b1010
    assert list(B.subsets(0b101)) == [0, 1, 4, 5]
    assert B.group_values([1], 2) == [[0, 1], [2, 3]]
    assert B.reorder([0, 1, 2, 3], [7, 3]) == [0, 2, 1, 3]
    assert [B.width_of(n) for n in (1, 2, 3, 5, 8, 9)] == [0, 1, 2, 3, 3, 4]


def test_prepare():
    rng = random.Random(5)
    sets = [tuple(sorted(rng.sample(range(12), rng.randint(2, 6)))) for _ in range(40)] + [tuple(range(12))]
    ix = I.CuboidIndex(sets, 12)
    for _ in range(20):
        q = sorted(rng.sample(range(12), 4))
        naive = ix.prepare_naive(q)
        assert set(q) <= set(sets[naive.cuboid])
        assert naive.cost == min(len(s) for s in sets if set(q) <= set(s))
        batch = ix.prepare_batch(q)
        for f in batch:
            assert [sets[f.cuboid][p] for p in f.positions] == [b for i, b in enumerate(q) if f.covered >> i & 1]
            assert not any(f is not g and f.dominated_by(g) and not g.dominated_by(f) for g in batch)
        covers = {B.gather_int(B.to_mask(s) & B.to_mask(q), q) for s in sets[:-1]}
        assert all(any(f.covered & c == c for f in batch) for c in covers)
        sizes = [f.covered.bit_count() for f in ix.prepare_online(q)]
        assert sizes == sorted(sizes) and sizes[-1] == 4


def test_parents_and_tries():
    sets = S.randomized(10, 6, 2, 5, seed=1)
    trie = I.SetTrie()
    for s in sets:
        trie.add(s, len(s))
    for i, p in enumerate(I.parents(sets)):
        if p >= 0:
            assert set(sets[i]) < set(sets[p])
            assert len(sets[p]) == min(len(s) for s in sets if set(sets[i]) < set(s))
        cost, path = trie.cheapest_superset(sets[i])
        assert cost == len(sets[i]) and tuple(path) == sets[i]
    assert trie.subsets(range(10)) == sorted(map(list, set(sets)))
    assert not trie.has_superset([3, 99])
    assert I.parents_base(sets)[-1] == -1


@pytest.mark.parametrize("make", [lambda: S.randomized(12, 6, 3, 6), lambda: S.schema_based([[0, 1, 2], [3, 4], [5, 6, 7, 8]], 5, 2, 5), lambda: S.single_size(10, 4, 3), lambda: S.old_randomized(8, 0.1, 1.2), lambda: S.all_or_nothing([[0, 1], [2, 3, 4], [5]], 4), lambda: S.budgeted(10, 12, 3, 0.25)])
def test_strategies(make):
    sets = make()
    assert sets == make(), "a seed gives one list"
    assert len(set(sets)) == len(sets) and len(sets[-1]) == max(map(len, sets))


def test_prefix_sets():
    columns = [[0, 1, 2], [3, 4]]
    for s in S.schema_based(columns, 6, 2, 4)[:-1]:
        for c in columns:
            k = len(set(c) & set(s))
            assert set(c[len(c) - k :]) == set(c) & set(s)
    assert S.prefix_count(columns, 5) == [1, 2, 3, 3, 2, 1]


def test_sizes():
    assert S.base2_counts(16, 6, 3, 6) == {3: 32, 4: 16, 5: 8, 6: 4}
    assert S.expected_cells(20, 2) == pytest.approx(4)
    assert S.worst_case_bytes([[0, 1], range(10)], 100, 10) == 32 + 1000
    assert S.fd_size([1, 1], [0, 0], 100, [0, 1]) == 2 and S.fd_size([3, 1, 2], [0, 0, 1], 100, [0, 1, 2]) == 32
    assert S.score("power", 0b110, 0b011) == 2 and S.score("uncovered", 0b110, 0b011) == -1


def test_trie_plans_are_the_scans():
    for seed in range(5):
        sets = S.randomized(9, 5, 1, 6, seed=seed)
        assert I.parents_trie(sets) == I.parents(sets)


def test_moments_gained():
    assert S.moments_gained(0b111, 0b111, []) == 8 and S.moments_gained(0b111, 0b111, [0b011]) == 4
    assert S.moments_gained(0b111, 0b111, [0b011, 0b110]) == 2 and S.moments_gained(0b011, 0b111, [0b111]) == 0
    assert S.score("contained", 0b011, 0b111) == 4 and S.score("contained", 0b1011, 0b111) == 0


def test_all_prefix_sets_when_few_are_drawn():
    columns = [[0, 1, 2, 3, 4, 5], [6]]
    assert S._prefix_sets(random.Random(0), columns, 6, 9) == {(0, 1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 6)}


def test_profiler(spark):
    from cellarium.profiling import Profiler

    p = Profiler()
    for _ in range(2):
        with p.span("outer"), p.span("inner"):
            pass
    assert [(r["name"], r["runs"]) for r in p.table(spark).orderBy("name").collect()] == [("inner", 2), ("outer", 2)]
    p.reset()
    assert p.table(spark).count() == 0
