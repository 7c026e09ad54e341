"""Quality by naive-Bayes support vectors over n-gram indicators.

Tokens are reduced to shapes (letters by case, digits, marks; a word that repeats the one before it is a
shape of its own), so the one- to three-gram vocabulary is small and the same in all languages. Each
indicator is scaled by the classes' log-count ratio, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. A logistic curve over margins of documents kept aside gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, lean, mix64, text_only
from tessera.llm.sampling import labelled_sample, logistic, probability

#: Labelled training documents of each class that the model is fitted on, at most.
PER_CLASS = 3000
_REPEAT = np.uint64(0x51ED270B9F1A4D3B)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = mix64(np.arange(1, 5, dtype=np.uint64))


def shape(word: str) -> str:
    """Letters become a or A, digits 0, marks stay; runs are cut to three, letters and digits to one."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] == [k] and (k in "Aa0" or out[-3:] == [k] * 3):
            continue
        out.append(k)
    return "".join(out)[:12]


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass"))
        return h


_shapes = _Shapes()


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the one- to three-grams of shapes, and of the length's power of two."""
    tokens = (text or "").split()
    n = len(tokens)
    out = [mix64(np.array([n.bit_length()], np.uint64) ^ _ORDERS[3])]
    if n:
        ids = np.fromiter(map(_shapes.__getitem__, tokens), np.uint64, n)
        if n > 1:
            same = np.fromiter(map(str.__eq__, tokens, tokens[1:]), np.bool_, n - 1)
            ids[1:][same] = _REPEAT
        acc = ids
        for order in range(3):
            if order:
                acc = acc[:-1] * _STEP + ids[order:]
            if not len(acc):
                break
            out.append(mix64(np.unique(acc) ^ _ORDERS[order]))
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, own: np.ndarray) -> float:
        if not len(self.features):
            return self.bias
        at = np.minimum(np.searchsorted(self.features, own), len(self.features) - 1)
        return float(self.weights[at[self.features[at] == own]].sum()) + self.bias

    def score(self, text: str | None) -> float:
        return float(probability(np.array(self.slope * self.margin(indicators(text)) + self.offset)))


def dual_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss over rows of indicator places scaled by r; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    norm = np.array([float((r[x] ** 2).sum()) + 1.0 for x in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            g = y[i] * (float((w[x] * r[x]).sum()) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[x] += d * r[x]
                bias += d
                moved += abs(new - alpha[i])
                alpha[i] = new
        if moved < 1e-4 * len(rows):
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float, smooth: float = 1.0, least_docs: int = 3) -> Model:
    """The model of indicator sets and labels 0/1; every fifth row calibrates and isn't learned from."""
    aside = np.arange(len(rows)) % 5 == 0
    if len(set(y[~aside].tolist())) < 2:
        slope, offset = logistic(np.empty(0), np.empty(0), prior)
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0, slope, offset)
    learn = [x for x, a in zip(rows, aside, strict=True) if not a]
    features, docs = np.unique(np.concatenate(learn), return_counts=True)
    features = features[docs >= min(least_docs, len(learn))]
    places = [np.searchsorted(features, np.intersect1d(x, features, assume_unique=True)) for x in learn]
    yl = np.where(y[~aside] == 1, 1, -1)
    count = {s: np.bincount(np.concatenate([np.empty(0, int), *(p for p, v in zip(places, yl, strict=True) if v == s)]), minlength=len(features)) + smooth for s in (1, -1)}
    r = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    w, bias = dual_descent(places, r, yl)
    model = Model(features, w * r, bias, 1.0, 0.0)
    margins = np.array([model.margin(x) for x in rows])
    model.slope, model.offset = logistic(margins[aside], y[aside], prior)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [indicators(t.as_py()).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "label", "features"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, per_class: int = PER_CLASS) -> Model:
    sample, prior = labelled_sample(docs, labels, label, mod, per_class)
    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sorted((r.doc_id, r.label, r.features) for r in sample.mapInArrow(lean(_features, _shapes), f"doc_id {kind}, label int, features array<long>").collect())
    rows = [np.sort(np.array(f, np.int64).view(np.uint64)) for _, _, f in got]
    # the order of a hash mixes the classes, whatever the ids mean
    mixed = np.argsort([xxhash.xxh3_64_intdigest(str(d).encode()) for d, _, _ in got], kind="stable")
    return fit([rows[i] for i in mixed], np.array([got[i][1] for i in mixed], int), prior)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels has doc_id and quality.

    Null and empty texts are scored by the bias and the empty length. Repeated rows are scored each. With
    no labels, or labels of one class, every row gets the prior. An empty table gives no rows.
    """
    model = spark.sparkContext.broadcast(train(docs, labels, "quality", mod, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    docs = text_only(docs, "doc_id", "text")
    out = docs.mapInArrow(lean(run, _shapes), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id", mod).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    model = spark.sparkContext.broadcast(train(docs, labels, "quality", mod, per_class))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run, _shapes), docs.schema)
