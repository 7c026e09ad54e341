"""Bounded samples of labelled documents and the last step of both classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, lean, materialize, release, text_only, words
from tessera.llm.minhash import _hashes, shingle_set


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle hash: copies and most near copies of a text share it."""
    for batch in batches:
        keys = [int(s[0] >> np.uint64(1)) if len(s := shingle_set(words(t.as_py()), 3)) else 0 for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.int64())], names=["doc_id", "text", "label", "key"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, per_class: int) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most per_class training documents of each class, and the share of label 1.

    Training ids are those whose crc32(doc_id as text) mod `mod` isn't 0. An id with several labels counts
    with its largest; null labels and ids don't count. Ids are taken in the order of a hash, so the sample
    doesn't depend on the partitioning; of near copies one stays.
    """
    train = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    train = train.filter(~held_out("doc_id", mod)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = train.filter("label = 0").orderBy(*order).limit(per_class).unionAll(train.filter("label = 1").orderBy(*order).limit(per_class))
    ids = materialize(ids)  # at most twice per_class rows, so it may be broadcast
    found = text_only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    found = found.mapInArrow(lean(_with_key, _hashes), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string, label int, key long")
    # of near copies the least id stays, and of rows that share it the least text
    one = found.groupBy("key", "label").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    out = materialize(one.select("r.doc_id", "r.text", "label"))
    release(ids)
    return out, n.get(1, 0) / total if total else 0.5


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of P(1 | x) by Newton steps with a small ridge; classes weigh equally, then the prior shifts the offset."""
    if not len(x) or len(set(y.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return 0.0, float(np.log(p / (1 - p)))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * np.array([beta[0], 0])
        hess = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    p = min(max(prior, 1e-3), 1 - 1e-3)
    return float(beta[0]), float(beta[1] + np.log(p / (1 - p)))


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
