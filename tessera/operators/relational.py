"""Set operations, joins by name, top-k, bare columns and recursive queries as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def compound(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """first op1 second op2 third ..., strictly from left to right, by position; names are the first's.

    Operators: union all, union, intersect, except; all but the first remove repeated rows.
    """
    out = first
    for op, other in rest:
        other = other.toDF(*out.columns)
        match op.lower():
            case "union all":
                out = out.unionAll(other)
            case "union":
                out = out.unionAll(other).distinct()
            case "intersect":
                out = out.intersect(other)
            case "except":
                out = out.subtract(other)
            case _:
                raise ValueError(f"unknown set operator {op!r}")
    return out


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get :1, :2 and so on."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = seen.get(c.lower(), 0)
        seen[c.lower()] = n + 1
        names.append(f"{c}:{n}" if n else c)
    return df.toDF(*names)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns of equal names, each of which comes once; without any, all pairs."""
    shared = [c for c in left.columns if c.lower() in {r.lower() for r in right.columns}]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def order_limit(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET; a negative limit means none, a negative offset 0. With a limit Spark keeps only the top rows of each task."""
    out = df.orderBy(*order) if order else df
    if offset > 0:
        out = out.offset(offset)
    return out if limit is None or limit < 0 else out.limit(limit)


def lateral_top(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[Column], limit: int) -> DataFrame:
    """left, LATERAL (right's rows of left's key ORDER BY ... LIMIT limit): every left row with the first rows of its key; NULL keys have none.

    The order is the window's own. Spark's plan of such a LATERAL sorts below the exchange when the subquery doesn't
    return the order's columns, and numbers the rows as they arrive from other executors or from spilled runs.
    """
    number = F.row_number().over(Window.partitionBy(right_key).orderBy(*order))
    first = right.withColumn("_number", number).filter(F.col("_number") <= limit).drop("_number")
    return left.join(first, left[left_key] == first[right_key])


def group_with_bare(df: DataFrame, keys: list[str], extreme: tuple[str, str] | None, bare: list[str], *aggregates: Column) -> DataFrame:
    """GROUP BY whose further columns come from the row of the lone minimum or maximum (kind, column), else from the least row.

    One aggregation: ties and missing extremes are settled by the bare columns themselves, so the result doesn't depend on the order of rows.
    """
    row = F.struct(*bare)
    pick = F.min(row)
    if extreme:
        kind, column = extreme
        ends = F.min(column) if kind == "min" else F.max(column)
        # of equal extremes the least row: the order key puts the extreme first, then the row itself
        at = F.col(column) if kind == "min" else -F.col(column)
        pick = F.coalesce(F.min(F.when(F.col(column).isNotNull(), F.struct(at.alias("at"), row.alias("row"))))["row"], F.min(row))
        aggregates = (ends.alias(f"{kind}_{column}"), *aggregates)
    out = df.groupBy(*keys).agg(*aggregates, pick.alias("_row"))
    return out.select(*[c for c in out.columns if c != "_row"], *(F.col(f"_row.{c}").alias(c) for c in bare))


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int | None = None, most_rounds: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: seed, then step over the rows that are new, until there are none.

    distinct is UNION (rows seen before don't come again), else UNION ALL; limit stops when so many rows are
    there. Each round's rows are written in the checkpoint folder, so that plans don't grow with the depth.
    """
    names = seed.columns
    frontier = (seed.distinct() if distinct else seed).checkpoint()
    rows = frontier
    found = frontier.count()
    for _ in range(most_rounds):
        if limit is not None and found >= limit:
            return rows.limit(limit)
        new = step(frontier).toDF(*names)
        if distinct:
            # set difference: NULLs are equal here, as UNION has it
            new = new.subtract(rows)
        frontier = new.checkpoint()
        n = frontier.count()
        if n == 0:
            return rows
        found += n
        rows = rows.unionAll(frontier)
    raise RuntimeError(f"no end after {most_rounds} rounds")


def values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """VALUES rows with columns column1, column2 and so on."""
    return spark.createDataFrame(rows, [f"column{i + 1}" for i in range(len(rows[0]))])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """left joined with right where low <= point <= high (high may be past several bins of the width).

    Points and intervals meet in equal bins, so the join is by hash instead of over all pairs; an interval is
    repeated once for each bin it touches. NULLs match nothing.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = right.filter(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    binned = left.withColumn("_bin", F.floor(F.col(point) / width))
    return binned.join(spread, "_bin").filter(F.col(point).between(F.col(low), F.col(high))).drop("_bin")
