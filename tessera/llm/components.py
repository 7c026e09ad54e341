"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one grouped minimum (combined before the shuffle) and one join, so a node with very
many neighbours is never gathered into one task: the join's partitions of that node can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component that a partition's own edges make: at most one edge a node."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounded memory: what is known so far goes out as it is
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), schema.field(0).type), pa.array([find(x) for x in list(parent)], schema.field(1).type)], schema=schema)
            parent.clear()
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([find(x) for x in nodes], schema.field(1).type)], schema=schema)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with v < u."""
    if large:  # all neighbours; those above the node move to the least of them and itself
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the neighbours below the node move to the least of them, and so does the node
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return moved.filter("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root), a written table, for every node of `edges` (two columns of one orderable type); root is the least node reachable.

    Loops and repeated edges are allowed; an edge with a null end is dropped; no edges give no rows.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialize(e.mapInArrow(_contract, e.schema).distinct())
    mark = None
    while True:  # the steps settle: every one moves nodes to lesser ones
        e2 = materialize(_stars(_stars(e, large=True), large=False))
        release(e)
        e = e2
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v"), F.col("v")))
    nodes = materialize(nodes.distinct())
    release(e)
    return nodes
