"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

1. A document's set of word shingles is hashed to 64 bits each; a sketch has one bucket for each hash
   function, and a bucket keeps the least value compressed to 16 bits: 6 for the count of leading zeros,
   10 for the mantissa bits that follow.
2. Documents with equal sets are one node from here on, so copies cost nothing more.
3. Bands of four registers give bucket keys. Every member of a bucket is paired with the bucket's least
   node only; pairs whose Jaccard estimate (corrected for register collisions) is far below the threshold
   go, the others are confirmed on the full sets, and components are formed.
4. Only buckets whose members are still in several components can hide a further link between
   components. Small ones are compared across components by sketch, and what passes is confirmed on full
   sets. Each large one is cut into blocks of bounded size; a task gets the sketches and texts of two
   blocks, compares across components by sketch (pairs that met in an earlier band were compared there)
   and confirms at once, and passes on only the links that join components. So every link of a banded
   pair counts, no task holds a whole bucket, buckets never grow together, and what tasks pass on grows
   with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, materialize, mix64, release, words
from tessera.llm.components import connected_components

BANDS, ROWS, MANTISSA = 32, 4, 10
REGISTERS = BANDS * ROWS
#: Standard deviations of the estimate below the threshold at which a candidate is given up.
MARGIN = 5.0
#: Members of buckets that are compared pair by pair; members of larger ones that a task holds on each side.
SMALL, BLOCK = 64, 512
#: Shingle hashes of sets that a task keeps at hand, 8 bytes each; beyond it sets are made anew from their texts.
HELD = 2_000_000
#: Hashes of 8 bytes up to which a list of texts is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000

_seeds = np.random.Generator(np.random.PCG64(20240501))
_MUL = _seeds.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """64-bit hashes of words; forgets them all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHash()


def shingle_set(tokens: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none an empty set."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, n)
    k = min(k, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = acc * _STEP + h[j : n - k + 1 + j]
    return np.unique(mix64(acc))


def sketch(s: np.ndarray) -> np.ndarray:
    """The compressed registers (uint16) of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, (s[i : i + 1024, None] * _MUL + _ADD).min(axis=0), out=least)
    bits = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - bits, 63).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs (rows), corrected for registers that agree by chance."""
    agree = (a == b).mean(axis=1)
    na, nb = na.astype(float), nb.astype(float)
    chance = 2.0**-MANTISSA / (2 * np.log(2)) * na * nb / np.maximum(na + nb, 1) ** 2
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate below which a pair at the threshold falls with a chance under 1e-6."""
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / REGISTERS) ** 0.5


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, regs = [], [], []
            for text in batch.column(1):
                s = shingle_set(words(text.as_py()), k)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            more = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary()), *(batch.column(c) for c in more)], names=["doc_id", "n_shingles", "node", "regs", *more])

    return lean(run, _hashes)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)
        keys = mix64(mix64(r) + _BAND).view(np.int64).ravel()
        at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))], names=["key", "node", "band"])


def _likely(least: float):
    """Keeps the pairs (a, b, regs_a, regs_b, n_a, n_b) whose estimate is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            est = estimate(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy())
            keep = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Groups of rows that agree in their first `keys` columns, as columns, from rows sorted by these."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if row[:keys] != at:
                if rows:
                    yield [list(c) for c in zip(*rows, strict=True)]
                at, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield [list(c) for c in zip(*rows, strict=True)]


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def _across(least: float):
    """Likely pairs of different components from a bucket's rows (key, node, root, regs, n, band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for _, node, root, raw, n, band in _groups(batches, 1):
            regs = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, REGISTERS)
            r64, n, root, band = regs.view(np.uint64), np.array(n), np.array(root, object), band[0]
            for x in range(len(node)):
                y = np.arange(x + 1, len(node))
                y = y[root[y] != root[x]]
                # a pair that met in an earlier band has been compared there
                y = y[~(r64[y, :band] == r64[x, :band]).any(axis=1)]
                if len(y):
                    y = y[estimate(regs[y], regs[[x]], n[y], n[[x]]) >= least]
                    out.extend((node[x], node[z]) for z in y)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _sets(k: int):
    """The shingle set of (name, text), kept at hand within HELD."""
    known: dict = {}
    held = 0

    def of(name, text: str) -> np.ndarray:
        nonlocal held
        if (s := known.get(name)) is None:
            if held > HELD:
                known.clear()
                held = 0
            known[name] = s = shingle_set(words(text), k)
            held += len(s)
        return s

    return of


def _cells(k: int, percent: int, least: float):
    """Confirmed links that join components from two blocks of a large bucket: rows (key, i, j, band, block, node, root, regs, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, band, block, node, root, raw, n, text in _groups(batches, 3):
            regs = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, REGISTERS)
            r64, n, side, band = regs.view(np.uint64), np.array(n), np.array(block), band[0]
            comp = np.unique(np.array(root, object), return_inverse=True)[1]
            of = _sets(k)
            out = []
            second = np.flatnonzero(side == j[0])
            for x in np.flatnonzero(side == i[0]):
                y = second[second > x] if i[0] == j[0] else second
                y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                if len(y):
                    y = y[~(r64[y, :band] == r64[x, :band]).any(axis=1)]
                if len(y):
                    y = y[estimate(regs[y], regs[[x]], n[y], n[[x]]) >= least]
                for z in y:
                    if comp[z] != comp[x]:
                        s, t = of(x, text[x]), of(z, text[z])
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(t) - both):
                            comp[comp == comp[z]] = comp[x]
                            out.append((node[x], node[z]))
            if out:
                yield _edges(out)

    return lean(run, _hashes)


def _confirm(k: int, percent: int):
    """Keeps the pairs (a, b, text_a, text_b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(k)
        for batch in batches:
            cols = [batch.column(c) for c in range(4)]
            keep = []
            for a, b, x, y in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2], cols[3], strict=True):
                s, t = of(a, x.as_py()), of(b, y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([cols[0].filter(keep), cols[1].filter(keep)], names=["a", "b"])

    return lean(run, _hashes)


PAIRS = "a binary, b binary"


def _texts(nodes: DataFrame, docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(node, text) of the nodes, written. reps: node, hash of one text that it stands for; ids may be null or repeat."""
    need = materialize(nodes.join(reps, "node").select("node", "rep"))
    few = need.count() <= BROADCAST_IDS
    full = docs.select("text").join(F.broadcast(need) if few else need, F.xxhash64("text") == F.col("rep"))
    # texts that share a hash may differ: the node tells which is meant
    full = materialize(full.select("node", "text").mapInArrow(_own(k), "node binary, text string").dropDuplicates(["node"]))
    release(need)
    return full


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of nodes that the full texts confirm."""
    full = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, reps, k)
    a = full.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = full.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    out = materialize(both.mapInArrow(_confirm(k, percent), PAIRS))
    release(full)
    return out


def _own(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [xxhash.xxh3_128_digest(shingle_set(words(t.as_py()), k).tobytes()) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return lean(run, _hashes)


def text_digest() -> Column:
    """128 bits of `text` as hexadecimal digits; with the id it tells apart the rows that near_duplicates judges."""
    return F.md5(F.col("text").cast("binary"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, digests: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; further columns are ignored).

    Rows are linked when 100 * |A & B| >= percent * |A | B| over their sets of shingles (words between
    ASCII white space, A-Z lower-cased; fewer words than a shingle has make one). component_id is the
    least doc_id that links reach; kept says whether it is the row's own. Null, empty and blank texts
    have no shingles, are linked with nothing and are kept. Rows that repeat an id and a text share a
    component; rows with a null id have their component's least id, or null if it has none, and are kept
    only in the latter case. An empty table gives no rows. With `digests` a further column, text_digest,
    tells which text of an id a row is.
    """
    docs = docs.select("doc_id", "text")
    carried = {"text_digest": text_digest()} if digests else {}
    passed = {"text_hash": F.xxhash64("text"), **carried}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    least = least_estimate(percent)
    kinds = ", text_hash long" + "".join(f", {c} string" for c in carried)
    sigs = materialize(docs.select("*", *(v.alias(c) for c, v in passed.items())).mapInArrow(_sketches(shingle_words), f"doc_id {id_type}, n_shingles long, node binary, regs binary{kinds}"))
    distinct = materialize(sigs.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("rep"), F.min("regs").alias("regs"), F.min("n_shingles").alias("n"), F.count("*").alias("copies")))
    bands = distinct.select("node", "regs").mapInArrow(_bands, "key long, node binary, band int")
    shared = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    members = materialize(bands.join(shared, "key").select("key", "node", "band", "leader", "members"))

    side = distinct.select("node", "regs", "n")
    a = side.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    b = side.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    stars = members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = materialize(stars.join(b, "b").join(a, "a").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely(least), PAIRS))
    reps = distinct.select("node", "rep")
    links = _verified(likely, docs, reps, shingle_words, percent)
    roots = connected_components(links)

    where = materialize(members.join(roots, "node", "left").select("key", "node", "band", "members", F.coalesce("root", "node").alias("root")))
    release(members)
    open_keys = where.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    some = materialize(where.join(open_keys, "key"))
    release(where)
    small = some.filter(F.col("members") <= SMALL).join(side, "node").select("key", "node", "root", "regs", "n", "band")
    more = materialize(small.repartition("key").sortWithinPartitions("key").mapInArrow(_across(least), PAIRS).distinct().join(likely, ["a", "b"], "left_anti"))
    release(likely)
    more_links = _verified(more, docs, reps, shingle_words, percent)
    release(more)

    large = some.filter(F.col("members") > SMALL)
    if not large.isEmpty():
        # a member goes to every cell of its block and another one of the same bucket
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        texts = _texts(large.select("node").distinct(), docs, reps, shingle_words)
        dealt = large.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).join(side, "node").join(texts, "node")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "root", "regs", "n", "text")
        cells = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = materialize(cells.mapInArrow(_cells(shingle_words, percent, least), PAIRS))
        release(texts)
        links, more_links = materialize(links.unionAll(more_links).unionAll(found)), found
    elif not more_links.isEmpty():
        links = materialize(links.unionAll(more_links))
    if not more_links.isEmpty():
        release(roots)
        roots = connected_components(links)
    release(some, links)

    labels = roots.join(distinct.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(labels, "root").select("node", "component_id")
    single = distinct.filter("copies > 1").join(roots, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    known = linked.unionAll(single)
    out = sigs.select("doc_id", "n_shingles", "node", *carried).join(known, "node", "left")
    component = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *carried))
    release(sigs, distinct, roots)
    return out
