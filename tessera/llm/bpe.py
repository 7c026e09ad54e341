"""Byte-pair encoding and decoding over a public vocabulary file.

A piece's symbols form a doubly linked list; a heap holds (rank, place) of the pairs that can merge, and
entries whose symbols have changed since are skipped when they come up. Pieces are encoded once for each
worker while its bounded cache holds them. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import text_only

#: Bytes of a vocabulary file that may be broadcast.
VOCABULARY_BYTES = 64 << 20
#: Pieces that a worker remembers before it starts anew.
CACHE = 120_000
_SPACE = regex.compile(r"\p{White_Space}+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """One vocabulary: normalising, splitting into pieces, merging, decoding."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}
        kinds = [n["type"] for n in (d.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizers {kinds}")
        first = d["pre_tokenizer"]["pretokenizers"][0]
        # white space has been folded to single spaces before the split
        self.piece = regex.compile(first["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        chars = _byte_chars()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.cache: dict[str, tuple[bytes, str]] = {}

    def normalize(self, text: str) -> str:
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        # each character alone: no final sigma
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((merged, ids[k])):
                    heapq.heappush(heap, (r[0], i, merged, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], merged))):
                heapq.heappush(heap, (r[0], h, ids[h], merged, r[1]))
        return [x for x in ids if x >= 0]

    def _learn(self, piece: str) -> tuple[bytes, str]:
        ids = self.merge(piece)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[piece] = out = (b"".join(i.to_bytes(4, "little") for i in ids), self.decode(ids))
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        ids: list[bytes] = []
        decoded: list[str] = []
        cache = self.cache
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                ids.append(self.added[part].to_bytes(4, "little"))
                decoded.append(part)
            elif part:
                for p in self.piece.findall(self.normalize(part)):
                    a, b = cache.get(p) or self._learn(p)
                    ids.append(a)
                    decoded.append(b)
        return b"".join(ids), " ".join(decoded)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=4)
def _loaded(spec: str) -> Bpe:
    return Bpe(spec)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver; larger files than VOCABULARY_BYTES are refused."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(VOCABULARY_BYTES + 1)
    if len(spec) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} characters")
    return spec


def bpe_encode(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian 32-bit integers), decoded for every row of docs (doc_id, text).

    `vocabulary` is the path of a tokenizer file. A null or empty text has no ids and decodes to the empty
    text. Repeated rows are encoded each; further columns are ignored; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [bpe.encode(t.as_py() or "") for t in part.column(1)]
                ids = [i for i, _ in both]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([d for _, d in both], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    docs = text_only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def bpe_decode(spark: SparkSession, encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text for rows (doc_id, ids) as bpe_encode gives them: vocabulary strings joined by spaces; null ids give null."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in batches:
            texts = [None if b is None else bpe.decode(memoryview(b).cast("I").tolist()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    encoded = text_only(encoded, "doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
