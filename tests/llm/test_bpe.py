import hashlib

import pytest

pytest.importorskip("tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.bpe import Bpe, bpe_decode, bpe_encode, read_vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "Hello world", "don't we're 1234 ***!!", "É́ é ñ ß ΣΑΣ ς İstanbul ﬁ", "a b c\x85d\x1ce​f", "<|startoftext|>x<|endoftext|> <|endoftext|", "日本語 テキスト 😀😀 🏽", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20,
    "\t\n  tabs \r\n", "x" * 3000, "Ünïcödé's 'll 'd I'M ٣४",
]


def test_against_library():
    lib, own = Tokenizer.from_file(PATH), Bpe(read_vocabulary(PATH))
    for t in TEXTS:
        want = lib.encode(t, add_special_tokens=False).ids
        ids, decoded = own.encode(t)
        assert memoryview(ids).cast("I").tolist() == want if ids else want == [], repr(t)
        assert decoded == lib.decode(want, skip_special_tokens=False), repr(t)


def test_documents(spark):
    docs = spark.createDataFrame([(1, TEXTS[2], "a"), (2, None, "b"), (3, "", "c"), (1, TEXTS[2], "a"), (None, "x", "d")], "doc_id long, text string, decoded string")
    rows = bpe_encode(spark, docs, PATH)
    lib = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id or 0, r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in rows.collect())
    want = sorted((r.doc_id or 0, len(i := lib.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest()) for r in docs.collect())
    assert got == want
    back = {(r.doc_id, r.text) for r in bpe_decode(spark, rows, PATH).collect()}
    assert back == {(r.doc_id, r.decoded) for r in rows.collect()}
    assert bpe_encode(spark, docs.limit(0), PATH).count() == 0
