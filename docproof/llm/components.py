"""Connected components of a link table that never leaves Spark."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.llm.store import dropped, settled
from docproof.llm.tiles import joined_labels

#: Links that a task contracts at a time.
HELD = 1 << 18


def _contracted(most: int):
    """The links of a task, ``most`` at a time, as links of each node to the smallest one that it reaches by them."""

    def run(batches):
        held, n = [], 0
        for batch in chain(batches, [None]):  # None: the end
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n and (batch is None or n >= most):
                t = pa.Table.from_batches(held)
                a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
                node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = joined_labels(np.arange(len(node)), at[: len(a)], at[len(a) :])
                own = np.flatnonzero(label != np.arange(len(node)))
                yield pa.record_batch({"a": node[own], "b": node[label[own]]})
                held, n = [], 0

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (columns a, b, both long).

    Each task first contracts the links that it reads, which leaves fewer of them and shorter chains.
    Then alternating star contraction: every node hands its larger neighbours to its smallest one, then
    itself and its smaller ones; each round is a few shuffles of narrow rows, minima are combined
    before the shuffle, and the rounds grow with the logarithm of the longest chain. The end is
    reached when each node has one link, to a node that has none."""
    both = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = settled(both.mapInArrow(_contracted(HELD), "a long, b long").distinct())
    while not _stars(edges):
        either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = either.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = either.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        before, edges = edges, settled(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        dropped(before)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a smaller one at most, and then is not the smaller one of any."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.max(F.expr("up + down > 1 and up > 0"))).first()[0]
