"""All pairs within buckets, in tiles of a fixed size.

A bucket with more rows than a tile is cut into parts by a hash, and every two parts meet in a
tile of their own, so no task holds a hot bucket whole and no pair is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.store import settled

#: Up to so many oversized buckets their sizes are sent to every task; beyond, a shuffle join is used.
BROADCAST_BUCKETS = 20_000


def tiled(rows: DataFrame, key: list[str], part_by: Column, tile: int) -> DataFrame:
    """``rows`` with tile_i, tile_j (parts that meet) and part (the row's own), in tile order.

    Rows of a bucket of at most ``tile`` rows come once, others once for each part of their bucket.
    The result is dealt and sorted by ``key``, tile_i and tile_j."""
    large = settled(rows.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") > tile))
    if large.count() <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    parts = F.ceil(F.coalesce("__n", F.lit(1)) / tile).cast("int")
    out = rows.join(large, key, "left").withColumn("__parts", parts).drop("__n")
    out = out.withColumn("part", F.pmod(F.xxhash64(part_by), F.col("__parts")).cast("int"))
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    out = out.select("*", F.least("part", "__other").alias("tile_i"), F.greatest("part", "__other").alias("tile_j")).drop("__other")
    by = [*key, "tile_i", "tile_j"]
    return out.repartition(*by).sortWithinPartitions(*by, "part")


def by_group(columns: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], at_least: int = 20_000):
    """A function for mapInArrow over rows sorted by ``columns``: ``work`` gets some 20,000 rows (and
    never a part of a group) with the start of each group and the end."""

    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in columns:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_least:
                t = pa.Table.from_batches(held).combine_chunks()
                s = starts_of(t)
                if len(s) > 1:
                    yield from work(t.slice(0, int(s[-1])), s)
                    t = t.slice(int(s[-1]))
                held, n = t.to_batches(), t.num_rows
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from work(t, np.append(starts_of(t), t.num_rows))

    return run


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` after linking i with j: each label is the smallest index its group reaches."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            on = labels[labels]
            if (on == labels).all():
                break
            labels = on
