import random
import zlib

import numpy as np

from tessera.llm.quality import dual_descent, keep_good, quality_scores
from tessera.llm.toxicity import Lexicon, fold, toxicity_scores


def test_quality_on_held_out(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = lambda: " ".join(word() + rng.choice(("***", "!!", " |")) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), i) for i in range(300)] + [(900, None, 1), (901, "", 1), (5, "extra row of an id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(spark, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    first = [r for r in got if r.doc_id < 300 and r.doc_id != 5 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in first) >= 0.95 * len(first)
    kept = keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and 180 <= kept.count() <= 215
    assert quality_scores(spark, docs.limit(0), labels).count() == 0
    assert quality_scores(spark, docs, labels.limit(0)).count() == len(rows)


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 5, 3) + (0 if i % 2 else 5)) for i in range(80)]
    w, b = dual_descent(rows, np.ones(10), np.array([1 if i % 2 else -1 for i in range(80)]))
    assert all((w[x].sum() + b > 0) == bool(i % 2) for i, x in enumerate(rows))


def test_folding_and_exceptions():
    assert fold("1D10T, Іdіоt ｓcum!") == ["idiot", "idiot", "scum"]
    lexicon = Lexicon({"trash": 2.0, "idiot": 3.0}, {"vequ": 4.0})
    assert lexicon.weigh("You 1d1ot, vequista")[:2] == (7.0, 2)
    assert lexicon.weigh("the trash can")[:2] == (0, 0) and lexicon.weigh("trash")[:2] == (2.0, 1) and lexicon.weigh("trashy idiots")[:2] == (0, 0)
    assert lexicon.weigh(None) == (0, 0, 0)


def test_toxicity_on_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    insult = lambda: rng.choice(("zork", "m0ron", "vequ" + word()))
    rows = []
    for i in range(400):
        w = [word() for _ in range(80)]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(80)] = insult()
        rows.append((i, " ".join(w), 1))
    docs = spark.createDataFrame(rows + [(1000, None, 1), (1001, "", 1)], "doc_id long, text string, hits int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = [r for r in toxicity_scores(spark, docs, labels).collect()]
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in own) >= 0.97 * len(own)
    assert not any(r.predicted for r in got if r.doc_id >= 1000)
    assert toxicity_scores(spark, docs.limit(0), labels).count() == 0


def test_samples_do_not_depend_on_the_partitioning(spark):
    """Near copies that share a key, ties and repeated rows at the sample's edge: the same rows stay."""
    from tessera.llm.sampling import labelled_sample

    rows = [(i, f"the same words in every text again and again number {i % 4}") for i in range(80)] + [(5, "the same words in every text again and again number 1")] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, 1), (6, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = [sorted(map(tuple, labelled_sample(docs.repartition(n), labels, "quality", 5, 15)[0].collect())) for n in (1, 3, 7)]
    assert made[0] == made[1] == made[2] and made[0]


def test_lexicon_folds_and_excepts():
    from tessera.llm.toxicity import EXCEPTIONS, SEEDS, Lexicon, fold

    for form in ("IDIOT", "ídíöt", "1d10t", "іdіоt", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\uff29\uff24\uff29\uff2f\uff34", "id\u200biot", "\u0131diot"):
        assert fold(form) == ["idiot"], form
    plain = Lexicon(SEEDS, {})
    assert plain.weigh("an idiot")[1] == 1 and all(plain.weigh(p)[1] == 0 for p in EXCEPTIONS)
    many = Lexicon(SEEDS, {}).weigh("trash can " * 20_000 + "trash")
    assert many[1] == 1
