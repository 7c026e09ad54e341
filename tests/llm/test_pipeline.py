import hashlib
import random
import struct

import public_tokenizers
from test_minhash import brute
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.pii import pseudonymize, session_key
from tessera.llm.quality import train


def test_near_dedup_judges_rows_not_ids(spark):
    long = " ".join(f"a{i}" for i in range(60))
    copy, clean = long + " end", " ".join(f"b{i}" for i in range(60))
    rows = [(1, long, "x"), (7, copy, "x"), (7, clean, "x"), (7, clean, "x"), (8, clean + " end", "x"), (9, None, "x"), (9, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, long), (7, clean), (9, "")]


def test_near_dedup_removes_copies_without_ids(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(1, long), (None, long), (None, long + " end"), (None, "no copy of anything"), (None, "no copy of anything"), (None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "no copy of anything"), (1, long)]


def test_whole_run_against_its_stages_one_by_one(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "to") for b in ("n", "rd", "st", "ve", "x", "mple")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    texts = [prose(rng.randrange(30, 90)) for _ in range(60)]
    junk = [" ".join(rng.choice(("$$$", "%%", "!!!1", "#", "@@")) + str(rng.randrange(10**6)) for _ in range(rng.randrange(20, 80))) for _ in range(40)]
    item = prose(25)
    rows = list(enumerate(texts + junk))
    rows += [(200, texts[0]), (201, texts[1] + " kern"), (202, prose(20) + " " + item + " " + prose(20)), (203, item.replace("kest", "kexst")), (204, prose(30) + " SSN 123-45-6789"), (205, prose(40))]
    labels = [(i, int(i < 60), 0) for i in range(100)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(i, t) for i, t in rows if model.score(t) >= 0.3]
    assert {i for i, _ in kept} >= {*range(60), *range(200, 206)} and sum(i in dict(kept) for i in range(60, 100)) < 20
    least = {root for _, root in brute(kept, 5, 80)}
    kept = [(i, t) for i, t in kept if i in least and i not in (202, 203)]
    assert {0, 1, 204, 205} <= set(dict(kept)) and not {200, 201} & set(dict(kept))
    private = {r.doc_id: r.text for r in pseudonymize(spark.createDataFrame(kept, "doc_id long, text string"), session_key(spark)).collect()}
    assert "123-45-6789" not in private[204] and all(private[i] == t for i, t in kept if i != 204)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in private.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {tuple(r) for r in got.collect()} == want
