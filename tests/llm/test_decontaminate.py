import random

from tessera.llm.decontaminate import Matcher, contamination, drop_contaminated, edit_search, normalize, pieces


def brute(pattern, text, most):
    """Sellers' table: the least distance of a place in text, and the first end that has it."""
    row = list(range(len(pattern) + 1))
    best = None
    for j, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (p != c)))
        row = new
        if row[-1] <= most and (best is None or row[-1] < best[0]):
            best = (row[-1], j + 1)
    return best


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        how = rng.randrange(3)
        if how == 0:
            s[i] = rng.choice("abcde ")
        elif how == 1:
            s.insert(i, rng.choice("abcde "))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_edit_search_matches_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))
        k = rng.randrange(0, 4)
        assert edit_search(p, t, k) == brute(p, t, k), (p, t, k)


def test_pieces_cover_item():
    for k in range(12):
        leaves = pieces(0, "x" * 60, k)
        assert len(leaves) == k + 1 and sum(len(p.text) for p in leaves) == 60 and all(len(p.text) >= 3 for p in leaves)


def test_matcher_matches_brute_force():
    rng = random.Random(2)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(5, 90)))) for i in range(30)]
    matcher = Matcher(items, 0.1)
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(300))
        i, item = rng.choice(items)
        text = text[:150] + " " + edited(rng, item, rng.randrange(0, 8)) + " " + text[150:]
        norm = normalize(text)
        want = set()
        for j, raw in items:
            p = normalize(raw)
            if p and (b := brute(p, norm, max(0, min(int(0.1 * len(p)), len(p) // 4 - 1)))):
                want.add((j, b[0]))
        assert {(j, d) for j, d, _ in matcher.find(text)} == want


def test_tables(spark):
    passage = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, f"Before. {passage.upper()}!\n after", "x"), (2, passage.replace("quick", "quack"), "y"), (3, None, "z"), (4, "", "z"), (5, "something else " * 500, "z"), (1, passage, "again")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, passage, 1), (11, passage, 2), (12, None, 3), (13, "?!", 4), (None, "absent words that nobody wrote here", 5)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in contamination(spark, docs, bench).collect())
    assert got == [(1, 10, 0), (1, 10, 0), (1, 11, 0), (1, 11, 0), (2, 10, 1), (2, 11, 1)]
    kept = drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert contamination(spark, docs.limit(0), bench).count() == 0 and contamination(spark, docs, bench.limit(0)).count() == 0
