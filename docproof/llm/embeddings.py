"""Embedding near-dedup by iterative quantisation.

A rotation of the principal axes is learnt on a bounded sample so that the signs of the rotated
vectors are balanced binary codes that lose little. Vectors of one label whose codes agree on a whole
block of bits meet in a bucket of that block's table (multi-index Hamming tables); the tables are the
same whatever the size, and a bucket of many vectors is compared in tiles. In a bucket, pairs whose codes are too many bits apart are
dropped, and the others are ranked by the cosine of the original vectors in double precision. A pair
that meets in several tables counts in the first of them only, so links are counted without
emitting pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
nor do rows without a label; vectors link with others of their own size only; equal vectors of a
label are one node whose rows link with each other; repeated rows are vectors like any other; a row
without vec_id links and counts, but names no component; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.llm import vectors
from docproof.llm.components import components
from docproof.llm.store import settled
from docproof.llm.tiles import by_group, joined_labels, tiled
from docproof.llm.vectors import by_size, matrix

#: Vectors that the rotation is learnt from, at most about.
SAMPLE = 8192
#: Blocks of the code. At cosine 0.98 a bit differs with a probability of about 0.064, so a pair has no
#: block of 10 in common once in some 40,000 times.
BLOCKS, BITS, TILE = 10, 64, 4096
#: Pairs whose cosine is worked out at a time.
PRODUCTS = 1 << 16


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the projection to codes: principal axes turned so that codes lose least (ITQ)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False) if len(x) > 1 else (0, 0, np.eye(x.shape[1]))
    axes = axes[: min(bits, x.shape[1])].T
    v = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes (fewer bits for short vectors): signs of the rotated unit vectors. Vectors of another
    size than the model's are brought to it by a fixed random projection, which nearly keeps angles."""
    if x.shape[1] != len(mean):
        x = x @ np.random.default_rng(x.shape[1]).normal(size=(x.shape[1], len(mean)))
    bits = ((x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ projection) >= 0
    bits = np.pad(bits, ((0, 0), (0, 64 - bits.shape[1])))
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def table_masks(bits: int) -> list[int]:
    """Bits of each table: one block each, of tables and labels of any size."""
    blocks = min(BLOCKS, bits)
    cuts = [round(bits * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def far_bits(bits: int, least: float) -> int:
    """The least distance of codes that pairs of cosine ``least`` reach once in a million times at most,
    if a bit differs half as often again as for random planes."""
    p = min(0.5, 1.5 * math.acos(max(-1.0, min(1.0, least))) / math.pi)
    tail = 1.0
    for d in range(bits + 1):
        tail -= math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
        if tail <= 1e-6:
            return d + 1
    return bits + 1


def _at_least(x: np.ndarray, norm: np.ndarray, a: int, b: int, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether rows i (of a..b) and j (from a on) have a cosine of at least ``least``. Where most pairs of the
    block are asked, one product decides all but those too close to tell."""
    fit, open_ = np.zeros(len(i), bool), np.arange(len(i))
    if 8 * len(i) > (b - a) * (len(x) - a):
        near = ((x[a:b] @ x[a:].T) / norm[a:b, None] / norm[None, a:])[i - a, j - a]
        fit, open_ = near > least, np.flatnonzero(np.abs(near - least) < 1e-9)
    i, j = i[open_], j[open_]
    fit[open_] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= least
    return fit


def near_links(nodes: DataFrame, least: float, sample: int = SAMPLE) -> DataFrame:
    """node, n (rows of other nodes linked in a tile), root (a node of the same tile's component).

    ``nodes`` has node, group, embedding, mult; a node comes once for each tile that holds a link."""
    usual = vectors.usual_size(nodes)
    x = vectors.bounded_sample(nodes.filter(F.size("embedding") == usual), sample, 3)
    if not len(x):
        return nodes.sparkSession.createDataFrame([], "node long, n long, root long")
    mean, projection = learn_rotation(x)
    bits = projection.shape[1]
    masks, far = np.array(table_masks(bits), dtype=np.uint64), far_bits(bits, least)
    model = nodes.sparkSession.sparkContext.broadcast((mean, projection))

    def coded(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, np.uint64)
            for rows, x in by_size(batch.column("embedding")):
                code[rows] = codes(x, *model.value)
            yield pa.record_batch([*batch.columns, pa.array(code.view(np.int64))], names=[*batch.schema.names, "code"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    kind_group = nodes.schema["group"].dataType.simpleString()
    rows = nodes.select("node", "group", "embedding", "mult").mapInArrow(coded, f"node long, group {kind_group}, embedding {kind}, mult long, code long")
    signed = [int(m) - (1 << 64) if int(m) >> 63 else int(m) for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("code").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(signed)])
    rows = rows.withColumn("group_key", F.xxhash64("group", F.size("embedding"))).withColumn("k", F.explode(keys)).select("node", "group_key", "embedding", "mult", "code", "k.table", "k.bits")

    def work(t: pa.Table, starts: np.ndarray):
        node, mult, code, part = (t.column(c).to_numpy() for c in ("node", "mult", "code", "part"))
        code, embedding = code.view(np.uint64), t.column("embedding").combine_chunks()
        table, apart = t.column("table").to_numpy(), t.column("tile_i").to_numpy() != t.column("tile_j").to_numpy()
        n, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if hi - lo < 2:
                continue
            x = matrix(embedding.slice(lo, hi - lo))
            norm = np.linalg.norm(x, axis=1)
            step = max(1, PRODUCTS // (hi - lo))
            for a in range(0, hi - lo, step):
                b = min(a + step, hi - lo)
                apart_by = np.bitwise_count(code[lo + a : lo + b, None] ^ code[None, lo + a : hi])
                i, j = np.nonzero(apart_by < far)
                i, j = i[i < j] + a, j[i < j] + a
                fit = _at_least(x, norm, a, b, i, j, least)
                i, j = lo + i[fit], lo + j[fit]
                if not len(i):
                    continue
                same = (((code[i] ^ code[j])[:, None] & masks[None, :]) == 0).argmax(axis=1) == table[lo]
                fit = same & ((part[i] != part[j]) | ~apart[lo])
                i, j = i[fit], j[fit]
                np.add.at(n, i, mult[j])
                np.add.at(n, j, mult[i])
                label = joined_labels(label, i, j)
        own = np.flatnonzero(n)
        yield pa.record_batch({"node": node[own], "n": n[own], "root": node[label[own]]})

    key = ["group_key", "table", "bits"]
    dealt = tiled(rows, key, F.col("node"), TILE)
    return dealt.mapInArrow(by_group([*key, "tile_i", "tile_j"], work, 8192), "node long, n long, root long")


def near_duplicates(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding, label)."""
    able = F.col("label").isNotNull() & vectors.usable(F.col("embedding"))
    rows = rows.select("vec_id", F.col("label").alias("group"), "embedding", able.alias("able")).withColumn("d", vectors.digest("group", "embedding"))
    nodes = vectors.distinct_nodes(rows.filter("able"), 0)
    found = settled(near_links(nodes, least))
    total = found.groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "at")
    known = nodes.select("d", "node", "mult", "first_id").join(total, "node", "left").join(linked, F.col("node") == F.col("at"), "left")
    known = known.select("d", "first_id", F.coalesce("component", "node").alias("component"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    first = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(first, "component").select("d", "n_links", "component_id")
    out = rows.filter("able").select("vec_id", "d").join(known, "d").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
