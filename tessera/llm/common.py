"""What the training-data operators share: scratch tables in the shared folder, words, splits by crc32."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df as a written Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path and (spark := _scratch.pop(path, None)):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage: shuffle files of queries that are over go with it."""
    spark._jvm.System.gc()


def lean(run: Callable, *caches: dict) -> Callable:
    """run, an iterator over Arrow batches, that empties caches and gives memory back when a task ends: Python workers live on after it."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            pa.default_memory_pool().release_unused()

    return task


@atexit.register
def _sweep() -> None:
    """At the driver's end the scratch tables that results still read go too."""
    for path, spark in list(_scratch.items()):
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended before
            return


def held_out(doc_id: str | Column, mod: int) -> Column:
    """True where crc32(doc_id as text) mod `mod` is 0; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % mod == 0


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (space, tab to carriage return), A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_only(docs: DataFrame, *keep: str) -> DataFrame:
    """Only the named columns, so that columns of other names can't clash with an operator's own."""
    return docs.select(*(F.col(f"`{k}`") for k in keep))
