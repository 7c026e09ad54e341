import random

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.common import words
from tessera.llm.components import connected_components
from tessera.llm.minhash import estimate, near_duplicates, shingle_set, sketch


def brute(rows, k, percent):
    """n and component of each row by comparing all pairs of sets."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= percent * either:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((len(sets[i]), -1 if least.get(find(i)) is None else least[find(i)]) for i in range(len(rows)))


@pytest.fixture
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.choice((1, 1, 2, 6))):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(150):
        own = list(hot)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((n, " ".join(own)))
        n += 1
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "Two WORDS"), (n + 4, "two\twords"), (n + 5, "two"), (3, rows[0][1]), (None, rows[0][1]), (None, "alone in the world of texts")]


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, 64), (5, 80, 8)])
def test_against_all_pairs(spark, corpus, monkeypatch, k, percent, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 40)
    docs = spark.createDataFrame([(d, t, "x") for d, t in corpus], "doc_id long, text string, node string")
    got = near_duplicates(docs, k, percent).collect()
    assert sorted((r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(corpus, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    for share in (0.3, 0.6, 0.9):
        b = np.concatenate([a[: int(len(a) * share)], rng.integers(0, 2**63, len(a) - int(len(a) * share), dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = estimate(sketch(a)[None], sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - true) < 0.17
    assert len(shingle_set(words("a b"), 5)) == 1 and len(shingle_set([], 3)) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3), (500, 501), (501, 502), (502, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 400)) and got[502] == got[501] == 500


@pytest.mark.parametrize("small", [64, 0])
def test_null_ids_link_like_others(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    base = [f"a{i}" for i in range(60)]
    # each text is linked with the next one only, the second and third have no id
    chain = [" ".join(base[i:] + [f"c{j}" for j in range(i)]) for i in (0, 4, 8, 12)]
    rows = [(3, chain[0]), (None, chain[1]), (None, chain[2]), (5, chain[3]), (None, "alone in the world of texts"), (None, chain[0])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert brute(rows, 3, 85) == sorted((r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.component_id) == [(0, 3, False)] * 3 + [(3, 3, True), (5, 3, False)]


def test_very_long_texts(spark):
    long = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-20])), (3, " ".join(reversed(long))), (4, "w1 " * 50_000)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[4].n_shingles == 1 and got[1].n_shingles == 59_998
