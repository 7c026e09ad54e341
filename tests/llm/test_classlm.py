import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import classlm
from tessera.llm.classlm import exchange, learn, lm_scores, rare_words, read_corpus, type_classes


def test_scores_and_base(spark):
    texts = ["the cat sat on the mat", "A dog RAN on the mat\nthe end", None, "", "le chat est sur la table", "the cat ran", "the dog sat", "le chien est la", "un chat sur un chien", "zzz unseen words here"] * 6
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = [r.asDict() for r in lm_scores(spark, docs, frequent=6, clustered=20, classes=4).collect()]
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for i, t, _ in rows if not held(i) for w in [*tokens(t), "</end>"])
    n, v = sum(counts.values()), len(counts)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        own = [*tokens(by_id[r["doc_id"]]), "</end>"]
        assert r["n_tokens"] == len(own) and r["train_tokens"] == n and r["held_out"] == held(r["doc_id"])
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_scores(spark, docs.limit(0)).count() == 0


def test_exchange_separates_blocks():
    rng = np.random.default_rng(3)
    pairs = np.zeros((12, 12))
    pairs[:6, :6] = rng.integers(50, 90, (6, 6))
    pairs[6:, 6:] = rng.integers(20, 60, (6, 6))
    of = exchange(pairs, 2, 10)
    assert len(set(of[:6])) == 1 and len(set(of[6:])) == 1 and of[0] != of[6]


@pytest.mark.parametrize(("part", "pack"), [(1_000_000, 400_000), (50, 30)])
def test_every_word_has_a_class_from_its_neighbours(spark, monkeypatch, part, pack):
    monkeypatch.setattr(classlm, "PART", part)
    monkeypatch.setattr(classlm, "PACK", pack)

    def text(i):
        # rare words of two kinds (f after "the", g after "to") end alike; some stand next to each other
        one = lambda f, j: f"{f}{(i * 7 + j * 3) % 40}end" + (f" {f}{(i + j) % 40}end" if j % 5 == 0 else "")
        return " ".join(f"the {one('f', j)} is to {one('g', j)} now the cat is to go now" for j in range(12))

    rows = [(i, text(i)) for i in range(80)] + [(80, None), (81, "unseen words the cat unseen"), (82, "f3end g3end to nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    args = {"frequent": 8, "clustered": 20, "classes": 9}
    corpus = read_corpus(docs, frequent=8)
    of = type_classes(corpus, 20, 9)
    m, _ = learn(corpus, of, 9)
    counted = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in (t or "").encode().lower().split())
    names = {np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64): w for w in counted}
    table = {names[r.word]: (r.n, r["class"]) for r in rare_words(corpus, of, 9).collect()}
    assert {w: n for w, (n, _) in table.items()} == {w: n for w, n in counted.items() if w not in m.types.words}
    assert len(m.types.words) == 8 and min(counted[w] for w in m.types.words) >= max(n for n, _ in table.values())
    groups = [{c for w, (n, c) in table.items() if w.startswith(f) and w.endswith(b"end") and n > 5} for f in (b"f", b"g")]
    assert groups[0] and groups[1] and not groups[0] & groups[1]

    def word_class(w):
        if w is None:
            return m.of[m.types.end]
        return m.of[m.types.words[w]] if w in m.types.words else table[w][1] if w in table else m.start(w)

    def emitted(w):
        if w is None or w in m.types.words:
            return m.emit[m.types.end if w is None else m.types.words[w]]
        return math.log10(table.get(w, (0, 0))[0] + classlm.ADD) - m.inside[word_class(w)]

    for c in range(9):
        known = [w for w in [None, *m.types.words, *table] if word_class(w) == c]
        assert abs(sum(10 ** emitted(w) for w in known) + classlm.ADD / 10 ** m.inside[c] - 1) < 1e-9
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    full = np.zeros((9, 9))
    for i, t in rows:
        own = [None, *(t or "").encode().lower().split(), None]
        for v, w in zip(own, own[1:], strict=False):
            full[word_class(v), word_class(w)] += not held(i)
    assert np.allclose(m.step, classlm._steps(full))
    for r in lm_scores(spark, docs, **args).collect():
        own = [None, *(dict(rows)[r.doc_id] or "").encode().lower().split(), None]
        want = sum(m.step[word_class(v), word_class(w)] + emitted(w) for v, w in zip(own, own[1:], strict=False))
        assert math.isclose(r.score, want, rel_tol=1e-9), r
