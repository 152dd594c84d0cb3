"""Rows of vectors made ready: which take part, equal vectors as one node, arrays in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.store import settled


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def digest(*columns: str) -> Column:
    """128 bits that stand for equal values."""
    return F.struct(F.xxhash64(*columns).alias("d1"), F.xxhash64(F.lit(99), *columns).alias("d2"))


def usual_size(rows: DataFrame) -> int:
    """The size that most vectors have (ties: the smaller); vectors of another size take no part."""
    most = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return most["n"] if most else 0


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """An Arrow list column whose lists have one size as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of an Arrow list column by the size of their lists, each with its matrix."""
    size = np.diff(column.offsets.to_numpy())
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        yield rows, matrix(column if len(rows) == len(column) else column.take(pa.array(rows)))


def bounded_sample(nodes: DataFrame, most: int, salt: int) -> np.ndarray:
    """At most about ``most`` vectors of ``nodes``, drawn by a hash of the node, in node order."""
    n = nodes.count()
    if n > most:
        nodes = nodes.filter(F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    rows = nodes.select("node", "embedding").collect()  # bounded by most
    return np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["node"])], dtype=np.float64)


def distinct_nodes(rows: DataFrame, keep_ids: int) -> DataFrame:
    """Equal vectors (and groups) as one node: d, node, group, embedding, mult, ids (the smallest ``keep_ids``).

    ``rows`` has vec_id, group, embedding, d. Which ids are kept is decided before the shuffle too,
    so a vector that a third of the rows share costs each task a few rows."""
    from pyspark.sql.window import Window as W

    counted = rows.groupBy("d").agg(F.count("*").alias("mult"), F.first("group").alias("group"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"))
    counted = settled(counted.withColumn("node", F.monotonically_increasing_id()))
    if not keep_ids:
        return counted
    few = rows.select("d", "vec_id").withColumn("r", F.row_number().over(W.partitionBy("d").orderBy("vec_id"))).filter(F.col("r") <= keep_ids)
    ids = few.groupBy("d").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return settled(counted.join(ids, "d"))
