"""Brown class-based n-gram scoring.

A token is a frequent word, the end of a text, or a rare word. Texts are encoded once: each token becomes the
number of its type (a frequent word, the end, or the last letters of a rare word), and 64-bit hashes of the
rare words are kept beside the numbers (of a billion rare words two share a hash with a chance of 3 %). Exchange clustering assigns types to classes: the largest types one by one, each moving
to the class that gains the most likelihood of the class bigrams; then all types at once, round by round, each
moving to the class that fits the classes of all its neighbours best, decided in parallel by ranges of types.
Every rare word follows by its own neighbours' classes, where a rare neighbour counts by the class of its last
letters. A text's probability is the product of class transitions (a bigram mixed with the class unigram) and
of words within classes, each smoothed; so the whole vocabulary and one unknown word for each class add up to
one. Only a word that the training part lacks has the class of its last letters.

All counts come from the whole training part and stay distributed: only the bigrams of the largest types, the
classes of types and the counts of classes, whose numbers are parameters, reach the driver. Rare tokens travel
twice, packed by the thousand: to the part of their word, where it gets its count and class, and back to the
part of their text, where they meet the classes of rare neighbours. Parts have a bounded mean size, as their
number grows with the tokens, and no rare word is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget_shuffles, held_out, lean, materialize, mix64, release, text_only, words

#: Words that are types of their own, types that are exchanged one by one, classes, rounds of these exchanges.
FREQUENT, CLUSTERED, CLASSES, EXCHANGES = 50_000, 1_500, 64, 6
#: Rounds in which all types are exchanged at once.
ROUNDS = 1
#: Rare-word types: by so many last bytes; at most so many, the others are one type.
SUFFIX, SUFFIX_TYPES = 3, 2_000
#: Weight of the class bigram against the class unigram; additive constants.
MIX, ADD = 0.95, 0.1
#: Distinct words whose counts a task holds before it passes them on; rare tokens that it packs at once; mean rare tokens of a part.
FLUSH, PACK, PART = 250_000, 200_000, 250_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()

    for batch in batches:
        for text in batch.column(0):
            counts.update(words(text.as_py()))
            if len(counts) > FLUSH:
                yield from flush()
    yield from flush()


@dataclass
class Types:
    """Frequent words by number (with counts), rare-word types after them, then the type of all other forms and the end."""

    words: dict[bytes, int]
    counts: np.ndarray  # training count of each frequent word
    suffixes: dict[bytes, int]
    n: int

    @property
    def end(self) -> int:
        return self.n - 1

    @property
    def kind(self) -> type:
        """The numbers' type in encoded texts."""
        return np.uint16 if self.n <= 1 << 16 else np.uint32

    def rare(self, word: bytes) -> int:
        return self.suffixes.get(word[-SUFFIX:], self.n - 2)

    def is_rare(self, x: np.ndarray) -> np.ndarray:
        return (x >= len(self.words)) & (x != self.end)


class _Numbers(dict):
    """Types of words; those of rare words are found anew each time."""

    def __init__(self, types: Types):
        super().__init__(types.words)
        self._rare = types.rare

    def __missing__(self, word: bytes) -> int:
        return self._rare(word)


def _encoded(shared):
    """Rows (row, doc_id, held, n, ids, rare) of rows (row, doc_id, held, text): the types' numbers, and hashes of the rare words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = shared.value
        number, first, hashed = _Numbers(types), len(types.words), xxhash.xxh3_64_intdigest
        for batch in batches:
            n, ids, rare = [], [], []
            for text in batch.column(3):
                tokens = words(text.as_py())
                x = np.fromiter(map(number.__getitem__, tokens), types.kind, len(tokens))
                n.append(len(tokens))
                ids.append(x.tobytes())
                at = np.flatnonzero(x >= first).tolist()
                rare.append(np.fromiter((hashed(tokens[p]) for p in at), np.uint64, len(at)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())], names=["row", "doc_id", "held", "n", "ids", "rare"])

    return lean(run)


def _stream(ids: pa.Array, types: Types) -> np.ndarray:
    """The numbers of several texts, with one end before, between and after them: an end closes one text and opens the next."""
    end = np.array([types.end], types.kind).tobytes()
    return np.frombuffer(end.join([b"", *ids.to_pylist(), b""]), types.kind).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows that aren't empty."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _pairs(types: Types, group: np.ndarray, n: int):
    """Counts of neighbouring groups of types (numbers under n) over encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in _slices(batches):
            x = group[_stream(batch.column(0), types)]
            total += np.bincount(x[:-1] * n + x[1:], minlength=n * n)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["pair", "n"])

    return lean(run)


def _collect_pairs(train: DataFrame, types: Types, group: np.ndarray, n: int) -> np.ndarray:
    """The square matrix of counts, n by n; its size is the bound of what is collected."""
    rows = train.select("ids").mapInArrow(_pairs(types, group, n), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each type from the square matrix of type bigrams, by greedy exchange in order of frequency."""
    n = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    of = np.empty(n, int)
    of[order] = np.arange(n) % min(classes, max(1, n))
    c = min(classes, max(1, n))
    one = np.eye(c)[of]
    right = pairs @ one  # counts of each type before each class
    left = pairs.T @ one  # counts of each type after each class
    cc = one.T @ right
    own = np.diag(pairs)
    xlogx = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for t in order:
            a = of[t]
            r, le, s = right[t].copy(), left[t].copy(), own[t]
            # without t
            cc[a] -= r
            cc[:, a] -= le
            cc[a, a] += s
            r[a] -= s
            le[a] -= s
            row, col = cc.sum(1), cc.sum(0)
            # gain of the likelihood sum N(c,d) log N(c,d) - sum N(c) log N(c) (before) - (after) with t in class b
            base_r = xlogx(cc)
            add_r = xlogx(cc + r[None, :])
            add_c = xlogx(cc + le[:, None])
            diag = np.arange(c)
            gain = (add_r - base_r).sum(1) + (add_c - base_r).sum(0)
            both = xlogx(cc[diag, diag] + r + le + s)
            gain += both - base_r[diag, diag] - (add_r - base_r)[diag, diag] - (add_c - base_r)[diag, diag]
            gain -= xlogx(row + r.sum() + s) - xlogx(row) + xlogx(col + le.sum() + s) - xlogx(col)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            r[b] += s
            le[b] += s
            # back in: r and le count t's neighbours with t itself in b
            cc[b] += r
            cc[:, b] += le
            cc[b, b] -= s
            if b != a:
                moved += 1
                of[t] = b
                right[:, a] -= pairs[:, t]
                right[:, b] += pairs[:, t]
                left[:, a] -= pairs[t]
                left[:, b] += pairs[t]
        if not moved:
            break
    return of


def assign(right: np.ndarray, left: np.ndarray, cc: np.ndarray) -> np.ndarray:
    """The best class of types or words from their counts before (right) and after (left) each class."""
    before = np.log((cc + 0.5) / (cc.sum(0, keepdims=True) + 0.5 * len(cc)))  # log P(c | next class)
    after = np.log((cc + 0.5) / (cc.sum(1, keepdims=True) + 0.5 * len(cc)))  # log P(next | c)
    return np.argmax(right @ after.T + left @ before, axis=1)


def _neighbours(types: Types, of: np.ndarray, k: int):
    """Counts of (type, slot) over encoded texts; slot: the class before the type, or k and the class after it; class k is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = types.n * (k + 1)
        left, right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for batch in _slices(batches):
            x = _stream(batch.column(0), types)
            c = of[x]
            np.add.at(left, x[1:] * (k + 1) + c[:-1], 1)
            np.add.at(right, x[:-1] * (k + 1) + c[1:], 1)
        for total, more in ((left, 0), (right, k)):
            at = np.flatnonzero(total)
            at = at[at % (k + 1) < k]
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((part // (k + 1)).astype(np.int32)), pa.array((part % (k + 1) + more).astype(np.int32)), pa.array(total[part])], names=["type", "slot", "n"])

    return lean(run)


def _choose(n: int, cc: np.ndarray):
    """(type, class) of the types of a partition of (type, slot, n)."""
    k = len(cc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * 2 * k)
        for batch in batches:
            t, slot, c = (batch.column(i).to_numpy() for i in range(3))
            np.add.at(total, t.astype(np.int64) * 2 * k + slot, c)
        m = total.reshape(n, 2 * k)
        met = np.flatnonzero(m.any(axis=1))
        for i in range(0, len(met), 4_000):
            seen = met[i : i + 4_000]
            best = assign(m[seen, k:], m[seen, :k], cc)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(best.astype(np.int32))], names=["type", "class"])

    return lean(run)


def _round(train: DataFrame, types: Types, of: np.ndarray, cc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The types' classes after those in `which` have moved at once to what fits their neighbours; types without a class are no neighbours."""
    k = len(cc)
    met = train.select("ids").mapInArrow(_neighbours(types, of, k), "type int, slot int, n int")
    rows = met.repartition("type").mapInArrow(_choose(types.n, cc), "type int, class int").toArrow()
    best = of.copy()
    best[which] = np.where(of[which] == k, 0, of[which])  # what met no class is in the first one
    found = np.full(types.n, -1)
    found[rows.column("type").to_numpy()] = rows.column("class").to_numpy()
    moved = which[found[which] >= 0]
    best[moved] = found[moved]
    return best


@dataclass
class Corpus:
    """Encoded texts, with what was counted over their training part."""

    texts: DataFrame  # row, doc_id, held, n, ids, rare: written
    parts: int  # of the rare tokens
    types: Types
    size: np.ndarray  # training tokens of each type
    total: int
    vocabulary: int
    ends: int  # training texts

    @property
    def train(self) -> DataFrame:
        return self.texts.filter("not held")


def read_corpus(docs: DataFrame, mod: int = 10, frequent: int = FREQUENT) -> Corpus:
    """The rows of docs (doc_id, text), encoded by the words of those whose crc32(doc_id as text) mod `mod` isn't 0."""
    spark = docs.sparkSession
    docs = text_only(docs, "doc_id", "text").withColumn("held", held_out("doc_id", mod))
    train = docs.filter("not held")
    counts = materialize(train.select("text").mapInArrow(lean(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ends = train.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    rest = counts
    if top:
        least, last = top[-1][1], top[-1][0]
        rest = counts.filter((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(bytearray(last)))))
    last_bytes = F.expr(f"substring(word, greatest(length(word) - {SUFFIX - 1}, 1), {SUFFIX})")
    by_end = [(bytes(r.s), r.n) for r in rest.groupBy(last_bytes.alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(SUFFIX_TYPES).collect()]
    release(counts)
    n = len(top) + len(by_end) + 2
    types = Types({w: i for i, (w, _) in enumerate(top)}, np.array([c for _, c in top], float), {s: len(top) + i for i, (s, _) in enumerate(by_end)}, n)
    tokens = sums["n"] or 0
    known = [*types.counts, *(c for _, c in by_end)]
    size = np.array([*known, tokens - sum(known), ends], float)
    shared = spark.sparkContext.broadcast(types)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # written once: the rows' numbers must be the same in all uses
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held", "text").mapInArrow(_encoded(shared), f"row long, doc_id {kind}, held boolean, n long, ids binary, rare binary")
    texts = materialize(texts)
    rare = texts.agg(F.sum(F.octet_length("rare"))).first()[0] or 0
    return Corpus(texts, max(1, rare // 8 // PART), types, size, tokens + ends, sums["v"] + (1 if ends else 0), ends)


def type_classes(corpus: Corpus, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every type."""
    types, size, k = corpus.types, corpus.size, classes
    big = np.argsort(-size, kind="stable")[: clustered - 1]
    if types.end not in big:
        big = np.append(big[:-1], types.end)
    # the largest types one by one; the others are one group, until they are assigned
    group = np.full(types.n, len(big))
    group[big] = np.arange(len(big))
    matrix = _collect_pairs(corpus.train, types, group, len(big) + 1)
    of_group = exchange(matrix[:-1, :-1], classes, EXCHANGES) if len(big) else np.empty(0, int)
    one = np.zeros((len(big) + 1, k))
    one[np.arange(len(big)), of_group] = 1
    of = np.full(types.n, k)
    of[big] = of_group
    others = np.setdiff1d(np.arange(types.n), big)
    of = _round(corpus.train, types, of, one.T @ matrix @ one, others)
    for _ in range(rounds):
        of = _round(corpus.train, types, of, _collect_pairs(corpus.train, types, of, k), np.arange(types.n))
    return of


def _steps(full: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from the counts of class bigrams."""
    unigram = (full.sum(0) + ADD) / (full.sum() + ADD * len(full))
    bigram = (full + ADD * unigram[None, :]) / (full.sum(1, keepdims=True) + ADD)
    return np.log10(MIX * bigram + (1 - MIX) * unigram[None, :])


@dataclass
class Learned:
    """The model with a class for every word; rare words' counts and classes travel with their tokens."""

    types: Types
    of: np.ndarray  # class of each type; of rare-word types: where unknown words go
    step: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(word | class) of frequent words and the end, by type; 0 for rare-word types
    inside: np.ndarray  # log10 of the denominator of each class, that a count plus ADD is divided by
    base: np.ndarray  # base log10 probability by type; of rare-word types the denominator's part alone

    def start(self, word: bytes) -> int:
        return int(self.of[self.types.rare(word)])


#: What is packed of a rare token on its way to its word and on its way back to its text. flags: 1 the text is
#: held out, 2 and 4 the token before and after is rare; before and after are then the classes of last letters.
TO_WORD = (("word", "<u8"), ("row", "<i8"), ("place", "<u4"), ("before", "<i2"), ("after", "<i2"), ("start", "<i2"), ("flags", "u1"))
TO_TEXT = (("row", "<i8"), ("place", "<u4"), ("before", "<i2"), ("after", "<i2"), ("flags", "u1"), ("class", "<i2"), ("n", "<i8"))
#: Of a rare token in its text: the class before it (-1 where that token is rare too), its own, and the one after it.
IN_TEXT = (("row", "<i8"), ("before", "<i2"), ("class", "<i2"), ("after", "<i2"), ("flags", "u1"), ("n", "<i8"))
PACKED = "part int, packed binary, class int, n long, v long"


def _pack(fields: tuple, of: dict[str, np.ndarray]) -> bytes:
    return b"".join(of[name].astype(kind, copy=False).tobytes() for name, kind in fields)


def _unpack(fields: tuple, packs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in fields)
    columns: list[list[np.ndarray]] = [[] for _ in fields]
    for pack in packs:
        n, at = len(pack) // width, 0
        for column, (_, kind) in zip(columns, fields, strict=True):
            column.append(np.frombuffer(pack, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate([np.empty(0, kind), *column]) for (name, kind), column in zip(fields, columns, strict=True)}


def _rows(parts: list[int], packs: list[bytes], stats: tuple = ((), (), ())) -> pa.RecordBatch:
    """Packs of parts, then the counts n of tokens and v of words of classes."""
    more = len(stats[0])
    none = lambda n, kind: pa.nulls(n, kind)
    columns = [pa.array([*parts, *[None] * more], pa.int32()), pa.array([*packs, *[None] * more], pa.binary())]
    columns += [pa.concat_arrays([none(len(parts), kind), pa.array(x, kind)]) for x, kind in zip(stats, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "packed", "class", "n", "v"])


def _dealt(fields: tuple, of: dict[str, np.ndarray], part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One pack for each part that has tokens."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for i in range(0, len(cuts), 1_000):
        some = cuts[i : i + 1_001].tolist()
        ends = some[1:] if len(some) > 1_000 else [*some[1:], len(part)]
        packs = [_pack(fields, {name: x[order[a:b]] for name, x in of.items()}) for a, b in zip(some, ends, strict=False)]
        yield _rows(part[some[: len(packs)]].tolist(), packs)


def _parts(batches: Iterator[pa.RecordBatch], fields: tuple) -> Iterator[tuple[dict[str, np.ndarray] | None, pa.RecordBatch | None]]:
    """The tokens of each part, from packs sorted by part; rows without a pack are passed on as they are."""
    at, packs = None, []
    for batch in batches:
        bare = batch.column(1).is_null()
        if bare.true_count:
            yield None, batch.filter(bare)
        for part, pack in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part is None:
                continue
            if part != at and packs:
                yield _unpack(fields, packs), None
                packs = []
            at = part
            packs.append(pack.as_py())
    if packs:
        yield _unpack(fields, packs), None


def _to_words(types: Types, of: np.ndarray, parts: int):
    """Packs of the rare tokens of encoded texts (row, held, ids, rare) by parts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict[str, np.ndarray]] = []
        held = 0

        def flush():
            if made:
                whole = {name: np.concatenate([m[name] for m in made]) for name, _ in TO_WORD}
                yield from _dealt(TO_WORD, whole, (whole["word"] % np.uint64(parts)).astype(np.int64))
                made.clear()

        for batch in _slices(batches, 1_000):
            x = _stream(batch.column(2), types)
            rare = types.is_rare(x)
            at = np.flatnonzero(rare)
            if not len(at):
                continue
            text = np.cumsum(x == types.end)[at] - 1
            c = of[x].astype(np.int16)
            row = batch.column(0).to_numpy()[text]
            flags = batch.column(1).to_numpy(zero_copy_only=False)[text].astype(np.uint8) | rare[at - 1].astype(np.uint8) << 1 | rare[at + 1].astype(np.uint8) << 2
            word = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)
            made.append({"word": word, "row": row, "place": at.astype(np.uint32), "before": c[at - 1], "after": c[at + 1], "start": c[at], "flags": flags})
            held += len(at)
            if held > PACK:
                yield from flush()
                held = 0
        yield from flush()

    return lean(run)


def _classed(t: dict[str, np.ndarray], cc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their training counts and classes, the order of tokens by word and the place of each token's word, of one part's tokens."""
    k = len(cc)
    order = np.argsort(t["word"], kind="stable")
    word = t["word"][order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, int)
    which = np.cumsum(np.r_[False, word[1:] != word[:-1]]) if len(word) else np.empty(0, int)
    learned = (t["flags"][order] & 1) == 0
    n = np.bincount(which, weights=learned, minlength=len(first)).astype(np.int64)
    best = t["start"][order][first].astype(np.int64)  # of words that the training part lacks
    before, after = t["before"][order].astype(np.int64), t["after"][order].astype(np.int64)
    ends = np.append(first[1:], len(word))
    for i in range(0, len(first), 4_000):
        a, b = first[i], ends[min(i + 4_000, len(first)) - 1]
        use = learned[a:b]
        at = (which[a:b][use] - i) * (2 * k)
        m = np.bincount(np.concatenate([at + before[a:b][use], at + k + after[a:b][use]]), minlength=min(4_000, len(first) - i) * 2 * k).reshape(-1, 2 * k)
        some = n[i : i + 4_000] > 0
        best[i : i + 4_000][some] = assign(m[some, k:], m[some, :k], cc)
    return word[first], n, best, order, which


def _at_words(cc: np.ndarray, parts: int):
    """Packs of tokens with their word's class and training count by parts of texts, and each class's tokens and words, from packs by parts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(cc)), np.int64)
        for t, _ in _parts(batches, TO_WORD):
            _, n, best, order, which = _classed(t, cc)
            sums[0] += np.bincount(best, weights=n, minlength=len(cc)).astype(np.int64)
            sums[1] += np.bincount(best[n > 0], minlength=len(cc))
            t = {name: x[order] for name, x in t.items() if name in ("row", "place", "before", "after", "flags")}
            t |= {"class": best[which], "n": n[which]}
            yield from _dealt(TO_TEXT, t, (mix64(t["row"].view(np.uint64)) % np.uint64(parts)).astype(np.int64))
        c = np.flatnonzero(sums[1])
        yield _rows([], [], (c, sums[0][c], sums[1][c]))

    return lean(run)


def _at_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of tokens with the classes around them, whole texts together, from packs by parts of texts; other rows are passed on."""
    for t, bare in _parts(batches, TO_TEXT):
        if bare is not None:
            yield bare
            continue
        order = np.lexsort((t["place"], t["row"]))
        t = {name: x[order] for name, x in t.items()}
        # the token after a rare one that is followed by a rare one is the next here
        t["after"] = np.where(t["flags"] & 4, np.append(t["class"][1:], 0), t["after"])
        t["before"] = np.where(t["flags"] & 2, -1, t["before"])
        new = np.flatnonzero(np.r_[True, t["row"][1:] != t["row"][:-1]])
        cuts = [*new[np.flatnonzero(np.diff(new // 100_000, prepend=-1))].tolist(), len(order)]
        yield _rows([0] * (len(cuts) - 1), [_pack(IN_TEXT, {name: x[a:b] for name, x in t.items()}) for a, b in zip(cuts, cuts[1:], strict=False)])


def _bigrams(k: int):
    """Counts of class bigrams with a rare word in training texts, from packs of tokens in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for pack in batch.column(0).to_pylist():
                t = _unpack(IN_TEXT, [pack])
                use = (t["flags"] & 1) == 0
                c, before, after = (t[x][use].astype(np.int64) for x in ("class", "before", "after"))
                total += np.bincount(np.concatenate([(before * k + c)[before >= 0], c * k + after]), minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return lean(run)


def rare_words(corpus: Corpus, of: np.ndarray, k: int) -> DataFrame:
    """word (its hash), n, class of the rare words of the training part."""
    cc = _collect_pairs(corpus.train, corpus.types, of, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _parts(batches, TO_WORD):
            word, n, best, _, _ = _classed(t, cc)
            yield pa.RecordBatch.from_arrays([pa.array(word[n > 0].view(np.int64)), pa.array(n[n > 0]), pa.array(best[n > 0].astype(np.int32))], names=["word", "n", "class"])

    return _by_words(corpus, of).mapInArrow(run, "word long, n long, class int")


def _by_words(corpus: Corpus, of: np.ndarray) -> DataFrame:
    packs = corpus.texts.select("row", "held", "ids", "rare").mapInArrow(_to_words(corpus.types, of, corpus.parts), PACKED)
    return packs.repartition("part").sortWithinPartitions("part")


def learn(corpus: Corpus, of: np.ndarray, k: int) -> tuple[Learned, DataFrame]:
    """The model with classes learned for every training word, and packs of all rare tokens in their texts (IN_TEXT)."""
    types = corpus.types
    placed = _by_words(corpus, of).mapInArrow(_at_words(_collect_pairs(corpus.train, types, of, k), corpus.parts), PACKED)
    met = materialize(placed.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_at_texts), PACKED))
    tokens = met.filter("packed is not null").select("packed")
    # frequent words and the end among themselves: rare ones are in a class of their own that is left out
    rarely = types.is_rare(np.arange(types.n))
    full = _collect_pairs(corpus.train, types, np.where(rarely, k, of), k + 1)[:k, :k].copy()
    for r in tokens.mapInArrow(_bigrams(k), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        full[divmod(r["pair"], k)] += r["n"]
    # frequent words and the end, then the rare words of each class and one unknown word
    own = np.flatnonzero(~rarely)
    in_class = np.bincount(of[own], weights=corpus.size[own], minlength=k)
    members = np.bincount(of[own], minlength=k)
    for r in met.filter("packed is null").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        in_class[r["class"]] += r["n"]
        members[r["class"]] += r["v"]
    inside = np.log10(in_class + ADD * (members + 1))
    emit = np.where(rarely, 0.0, np.log10(corpus.size + ADD) - inside[of])
    base = np.where(rarely, 0.0, np.log10(corpus.size + ADD)) - np.log10(corpus.total + ADD * (corpus.vocabulary + 1))
    return Learned(types, of, _steps(full), emit, inside, base), tokens


def _sums(shared):
    """(row, doc_id, held, n, known, base, log) of encoded texts (row, doc_id, held, n, ids): all that doesn't need a rare word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _slices(batches):
            n = batch.column(3).to_numpy()
            x = _stream(batch.column(4), m.types)
            known = ~m.types.is_rare(x)
            c = m.of[x]
            log = np.where(known[:-1] & known[1:], m.step[c[:-1], c[1:]], 0.0) + m.emit[x[1:]]
            text = np.repeat(np.arange(batch.num_rows), n + 1)
            known, base, log = (np.bincount(text, weights=w, minlength=batch.num_rows) for w in (known[1:], m.base[x[1:]], log))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(known.astype(np.int64)), pa.array(base), pa.array(log)], names=["row", "doc_id", "held", "n", "known", "base", "log"])

    return lean(run)


def _met(shared):
    """(row, rare_log, rare_base, met) of texts with rare tokens, from packs that hold whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for pack in batch.column(0).to_pylist():
                t = _unpack(IN_TEXT, [pack])
                c, before, after = (t[x].astype(np.int64) for x in ("class", "before", "after"))
                base = np.log10(t["n"] + ADD)
                log = base - m.inside[c] + np.where(before >= 0, m.step[before, c], 0.0) + m.step[c, after]
                row, text = np.unique(t["row"], return_inverse=True)
                log, base, met = (np.bincount(text, weights=w, minlength=len(row)) for w in (log, base, t["n"] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(log), pa.array(base), pa.array(met.astype(np.int64))], names=["row", "rare_log", "rare_base", "met"])

    return lean(run)


def lm_scores(spark: SparkSession, docs: DataFrame, mod: int = 10, frequent: int = FREQUENT, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. Rows whose crc32(doc_id as
    text) mod `mod` isn't 0 are learned from. A null or empty text is its end alone. Repeated rows are scored
    and learned from each. Without training rows all words are unknown and the end too. An empty table gives
    no rows.
    """
    corpus = read_corpus(docs, mod, frequent)
    forget_shuffles(spark)
    of = type_classes(corpus, clustered, classes)
    forget_shuffles(spark)
    made, tokens = learn(corpus, of, classes)
    shared = spark.sparkContext.broadcast(made)
    total = corpus.total
    kind = corpus.texts.schema["doc_id"].dataType.simpleString()
    sums = corpus.texts.select("row", "doc_id", "held", "n", "ids").mapInArrow(_sums(shared), f"row long, doc_id {kind}, held boolean, n long, known long, base double, log double")
    met = tokens.mapInArrow(_met(shared), "row long, rare_log double, rare_base double, met long")
    out = sums.join(met, "row", "left")
    known = F.col("known") - (0 if total else 1) + F.coalesce("met", F.lit(0))  # without training texts the end is unknown too
    return out.select(
        "doc_id", F.col("held").alias("held_out"), (F.col("n") + 1).alias("n_tokens"), known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("log") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
