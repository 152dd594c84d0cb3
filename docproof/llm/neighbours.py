"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Every distinct vector is a node. Random projections deal the nodes into small blocks whose exact
neighbours start the graph; NN-descent then improves it by Spark joins: at each node its
neighbours, and the nodes that have it as a neighbour, are introduced to each other, and who
improves on another's list is added to it. A query walks the graph with a beam: in each round its
best nodes that it has not yet left are left for their neighbours, until none remain. For inner
products a coordinate is added that gives all vectors the norm of the longest, so neighbours in
the graph are neighbours by angle, whatever the norms. What a search returns is measured again on
the original vectors in double precision. The graph and the walks are approximate; recall on the
given embeddings is in the README and in the tests. NN-descent ends when a round changes less than
one neighbour in a hundred, a walk when nothing is left to leave, and every node is reachable: the
starting blocks of one round are dealt at random, so none is ever alone, and a node that is in
nobody's list is added to that of one of its own neighbours. A query that finds fewer results than
it could is compared with all rows.

Cases: vectors that are null, empty, zero, of another size than most, or hold null or non-finite
components take no part, nor do rows without vec_id; equal vectors are one node and each of its
rows is a candidate and may be a query; a query has fewer results than asked for only if there
are fewer candidates; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.llm import vectors
from docproof.llm.labelled import lists
from docproof.llm.store import dropped, settled
from docproof.llm.textbytes import mixed
from docproof.llm.tiles import by_group, tiled

NEIGHBOURS, REVERSE, SETTLED = 32, 24, 0.01
#: Nodes in a starting block, about; blocks that turn out larger than TILE are split at random.
BLOCK, STARTS, TILE = 800, 3, 2048
BEAM, LEAVES = 288, 64
#: Vectors for the cuts of the projections, at most about.
SAMPLE = 4096
#: Nodes that a search task scores against, about.
SCORED = 4096


def _ranked(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int, flag: np.ndarray | None = None):
    """Of equal (owner, other) one, then each owner's ``most`` best, best first; ties to the smaller id."""
    order = np.lexsort((-flag if flag is not None else sim, other, owner))
    owner, other, sim = owner[order], other[order], sim[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    keep = order[first]
    owner, other, sim = owner[first], other[first], sim[first]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, keep = owner[order], other[order], sim[order], keep[order]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    ok = rank < most
    return owner[ok], other[ok], sim[ok], keep[ok]


def _flat(t: pa.Table, owner: str):
    ids, sims = t.column("ids").combine_chunks(), t.column("sims").combine_chunks()
    sizes = np.diff(ids.offsets.to_numpy())
    return np.repeat(t.column(owner).to_numpy(), sizes), ids.flatten().to_numpy(), sims.flatten().to_numpy()


def _as_lists(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> dict:
    who, sizes = np.unique(owner, return_counts=True)
    return {"node": who, "ids": lists(ids, sizes, pa.int64()), "sims": lists(sims, sizes, pa.float32()), "fresh": lists(fresh, sizes, pa.int8())}


#: ``fresh`` is 1 for a neighbour that has not been introduced to the others yet.
LISTS = "node long, ids array<long>, sims array<float>, fresh array<tinyint>"


def merged(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of all lists of each node; a neighbour that was known before is not fresh."""

    def work(t: pa.Table, _):
        owner, ids, sims = _flat(t, "node")
        fresh = t.column("fresh").combine_chunks().flatten().to_numpy()
        owner, ids, sims, keep = _ranked(owner, ids, sims, most, 1 - fresh)
        yield pa.record_batch(_as_lists(owner, ids, sims, fresh[keep]))

    return found.repartition("node").sortWithinPartitions("node").mapInArrow(by_group(["node"], work), LISTS)


def _decoded(column: pa.ChunkedArray, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    return raw.reshape(len(column), -1) if len(column) else raw.reshape(0, 1)


def lifted(nodes: DataFrame) -> DataFrame:
    """node, vec (float32, with the coordinate that evens out norms), small (the same in bytes)."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = nodes.agg(F.max(square).alias("m")).first()["m"] or 1.0

    def run(batches):
        for batch in batches:
            x = vectors.matrix(batch.column("embedding"))
            rest = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
            x = np.column_stack([x, rest]).astype(np.float32)
            small = np.rint(x * (127 / math.sqrt(top))).astype(np.int8)
            yield pa.record_batch({"node": batch.column("node"), "vec": pa.array([r.tobytes() for r in x], pa.binary()), "small": pa.array([r.tobytes() for r in small], pa.binary())})

    return settled(nodes.select("node", "embedding").mapInArrow(run, "node long, vec binary, small binary"))


def _start(vecs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Exact neighbours within the blocks of a few random projections."""
    n = nodes.count()
    bits, blocks = max(0, round(math.log2(max(n, 1) / BLOCK))), max(1, n // BLOCK)
    x = vectors.bounded_sample(nodes, SAMPLE, 8)
    planes = np.random.default_rng(3).normal(size=(STARTS, x.shape[1], bits))
    cuts = np.stack([np.median(x @ p, axis=0) for p in planes]) if bits else np.zeros((STARTS, 0))
    shared = vecs.sparkSession.sparkContext.broadcast((planes, cuts))

    def keyed(batches):
        planes, cuts = shared.value
        for batch in batches:
            x = _decoded(batch.column("vec"), np.float32)[:, :-1]
            for r in range(STARTS):
                key = ((x @ planes[r] > cuts[r]) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.record_batch({"start": np.full(len(x), r, np.int32), "key": key, "node": batch.column("node"), "vec": batch.column("vec")})
            # and once in blocks dealt at random
            key = (mixed(batch.column("node").to_numpy().view(np.uint64)) >> np.uint64(1)).astype(np.int64) % blocks
            yield pa.record_batch({"start": np.full(len(x), STARTS, np.int32), "key": key, "node": batch.column("node"), "vec": batch.column("vec")})

    def work(t: pa.Table, starts: np.ndarray):
        node, x = t.column("node").to_numpy(), _decoded(t.column("vec"), np.float32)
        for lo, hi in zip(starts, starts[1:], strict=False):
            sim = x[lo:hi] @ x[lo:hi].T
            np.fill_diagonal(sim, -np.inf)
            m = min(k, hi - lo - 1)
            if m > 0:
                best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                owner = np.repeat(node[lo:hi], m)
                owner, ids, sims, _ = _ranked(owner, node[lo:hi][best].ravel(), np.take_along_axis(sim, best, 1).ravel(), m)
                yield pa.record_batch(_as_lists(owner, ids, sims, np.ones(len(ids), np.int8)))

    rows = vecs.select("node", "vec").mapInArrow(keyed, "start int, key long, node long, vec binary")
    dealt = tiled(rows, ["start", "key"], F.struct("node", "start"), TILE).filter("tile_i = tile_j and tile_i = part")
    return dealt.mapInArrow(by_group(["start", "key", "tile_i"], work, 1), LISTS)


def _introduced(graph: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """What the neighbours of each node, and those it is a neighbour of, find in each other, unless they
    have met before."""
    bar = F.when(F.size("ids") >= k, F.array_min("sims")).otherwise(F.lit(-1e30)).cast("float")
    known = vecs.select("node", "small").join(graph.select("node", bar.alias("bar")), "node", "left")
    pairs = graph.select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("e")).select("node", F.col("e.ids").alias("id"), F.col("e.sims").alias("sim"), F.col("e.fresh").alias("fresh"))
    ahead = pairs.select(F.col("node").alias("at"), F.col("id").alias("member"), "fresh")
    nearest = W.partitionBy("id").orderBy(F.desc("sim"), "node")
    back = pairs.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= REVERSE).select(F.col("id").alias("at"), F.col("node").alias("member"), "fresh")
    both = ahead.unionByName(back).groupBy("at", "member").agg(F.max("fresh").alias("fresh"))
    met = both.join(known, F.col("member") == F.col("node")).select("at", "member", "fresh", "small", F.coalesce("bar", F.lit(-1e30).cast("float")).alias("bar"))

    def work(t: pa.Table, starts: np.ndarray):
        member, bar, x = t.column("member").to_numpy(), t.column("bar").to_numpy(), _decoded(t.column("small"), np.int8).astype(np.float32) / 127
        fresh, owner, other, sims = t.column("fresh").to_numpy() > 0, [], [], []
        for lo, hi in zip(starts, starts[1:], strict=False):
            new = fresh[lo:hi]
            if not new.any():
                continue
            sim = x[lo:hi] @ x[lo:hi].T
            np.fill_diagonal(sim, -np.inf)
            i, j = np.nonzero((sim > bar[lo:hi, None]) & (new[:, None] | new[None, :]))
            owner.append(member[lo + i])
            other.append(member[lo + j])
            sims.append(sim[i, j])
        if owner:
            o, w, s, _ = _ranked(np.concatenate(owner), np.concatenate(other), np.concatenate(sims).astype(np.float32), k)
            yield pa.record_batch(_as_lists(o, w, s, np.ones(len(w), np.int8)))

    return met.repartition("at").sortWithinPartitions("at").mapInArrow(by_group(["at"], work), LISTS)


def build_graph(nodes: DataFrame, vecs: DataFrame, k: int = NEIGHBOURS, settled_at: float = SETTLED) -> DataFrame:
    """node, ids: about the ``k`` nearest other nodes of each node, best first, and behind them nodes that are
    in no other list.

    Similarities are relative to the longest vector's square, on vectors rounded to bytes."""
    graph = settled(merged(_start(vecs, nodes, k), k))
    size = F.sum(F.size("ids")).alias("n")
    changed = F.sum(F.aggregate("fresh", F.lit(0), lambda a, x: a + x)).alias("changed")
    while True:
        count = graph.agg(F.coalesce(size, F.lit(0)).alias("n"), F.coalesce(changed, F.lit(0)).alias("changed")).first()
        if count["changed"] <= settled_at * count["n"]:
            break
        old = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(0).cast("tinyint")))
        before, graph = graph, settled(merged(old.unionByName(_introduced(graph, vecs, k)), k))
        dropped(before)
    lost = graph.join(graph.select(F.explode("ids").alias("node")).distinct(), "node", "left_anti").filter(F.size("ids") > 0)
    host = F.get("ids", F.pmod(F.xxhash64("node"), F.size("ids")).cast("int"))
    guests = lost.select(host.alias("node"), F.col("node").alias("guest")).groupBy("node").agg(F.sort_array(F.collect_list("guest")).alias("guests"))
    return settled(graph.join(guests, "node", "left").select("node", F.concat("ids", F.coalesce("guests", F.expr("cast(array() as array<bigint>)"))).alias("ids")))


BEAM_ROW = "q long, qvec binary, ids array<long>, sims array<float>, gone array<boolean>"


def _beams(rows: DataFrame, beam: int) -> DataFrame:
    """The best ``beam`` nodes of each query; a node that was left stays left."""

    def work(t: pa.Table, starts: np.ndarray):
        owner, ids, sims = _flat(t, "q")
        gone = t.column("gone").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int8)
        owner, ids, sims, keep = _ranked(owner, ids, sims, beam, gone)
        who, sizes = np.unique(owner, return_counts=True)
        vec = {q: v for q, v in zip(t.column("q").to_pylist(), t.column("qvec").to_pylist(), strict=True) if v is not None}
        yield pa.record_batch({"q": who, "qvec": pa.array([vec[q] for q in who.tolist()], pa.binary()), "ids": lists(ids, sizes, pa.int64()), "sims": lists(sims, sizes, pa.float32()), "gone": lists(gone[keep].astype(bool), sizes, pa.bool_())})

    return rows.repartition("q").sortWithinPartitions("q").mapInArrow(by_group(["q"], work, 2000), BEAM_ROW)


def search(graph: DataFrame, vecs: DataFrame, starts: DataFrame, beam: int = BEAM, leaves: int = LEAVES) -> DataFrame:
    """q, ids, sims: the best nodes that walks from ``starts`` (q, qvec, ids: nodes to start at) end with.

    Scoring sends nodes and the queries that ask for them to the same task, each once."""
    blocks = max(1, -(-vecs.count() // SCORED))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    points = vecs.select(deal("node").alias("block"), F.lit(0).alias("asks"), F.col("node").alias("id"), "vec", F.lit(None).cast("array<long>").alias("ids"), F.lit(0.0).cast("float").alias("bar"))

    def work(t: pa.Table, starts: np.ndarray):
        asks, ident = t.column("asks").to_numpy(), t.column("id").to_numpy()
        for lo, hi in zip(starts, starts[1:], strict=False):
            cut = lo + int((asks[lo:hi] == 0).sum())
            order = np.argsort(ident[lo:cut])
            node, x = ident[lo:cut][order], _decoded(t.column("vec").slice(lo, cut - lo), np.float32)[order]
            for a in range(cut, hi, 2000):
                part = t.slice(a, min(2000, hi - a))
                wanted = part.column("ids").combine_chunks()
                sizes = np.diff(wanted.offsets.to_numpy())
                ids = wanted.flatten().to_numpy()
                at, who = np.searchsorted(node, ids), np.repeat(np.arange(len(sizes)), sizes)
                sim = np.einsum("ij,ij->i", x[at], _decoded(part.column("vec"), np.float32)[who]).astype(np.float32)
                ok = sim > part.column("bar").to_numpy()[who]
                found = np.bincount(who[ok], minlength=len(sizes))
                some = found > 0
                yield pa.record_batch({"q": part.column("id").to_numpy()[some], "ids": lists(ids[ok], found[some], pa.int64()), "sims": lists(sim[ok], found[some], pa.float32())})

    def scored(asked: DataFrame) -> DataFrame:
        """``asked``: q, qvec, w, bar; gives q, ids, sims of what is above the bar."""
        ask = asked.groupBy(deal("w").alias("block"), "q").agg(F.collect_set("w").alias("ids"), F.first("qvec").alias("vec"), F.first("bar").alias("bar"))
        ask = ask.select("block", F.lit(1).alias("asks"), F.col("q").alias("id"), "vec", "ids", "bar")
        dealt = points.unionByName(ask).repartition("block").sortWithinPartitions("block", "asks")
        return dealt.mapInArrow(by_group(["block"], work, 1), "q long, ids array<long>, sims array<float>")

    def with_flags(rows: DataFrame) -> DataFrame:
        return rows.select("q", F.lit(None).cast("binary").alias("qvec"), "ids", "sims", F.transform("ids", lambda _: F.lit(False)).alias("gone"))

    first = starts.select("q", "qvec", F.explode("ids").alias("w"), F.lit(-1e30).cast("float").alias("bar"))
    empty = starts.select("q", "qvec", F.expr("cast(array() as array<bigint>) ids"), F.expr("cast(array() as array<float>) sims"), F.expr("cast(array() as array<boolean>) gone"))
    state = settled(_beams(empty.unionByName(with_flags(scored(first))), beam))
    while True:  # a node that was left never comes back, so every walk ends
        spots = F.filter(F.transform("gone", lambda g, i: F.when(~g, i)), lambda i: i.isNotNull())
        state = state.withColumn("leave", F.slice(spots, 1, leaves))
        full = F.when(F.size("ids") >= beam, F.element_at("sims", -1)).otherwise(F.lit(-1e30)).cast("float")
        out = state.select("q", "qvec", full.alias("bar"), F.explode(F.transform("leave", lambda i: F.get("ids", i))).alias("v"))
        if out.isEmpty():
            break
        asked = out.join(graph.select(F.col("node").alias("v"), F.col("ids").alias("next")), "v").select("q", "qvec", "bar", F.explode("next").alias("w"))
        left = state.select("q", "qvec", "ids", "sims", F.transform("gone", lambda g, i: g | F.array_contains("leave", i)).alias("gone"))
        before, state = state, settled(_beams(left.unionByName(with_flags(scored(asked))), beam))
        dropped(before)
    return state.select("q", "ids", "sims")


def _exact(short: DataFrame, vecs: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """q, node: the ``k`` best nodes for the queries q, compared with all nodes, some queries at a time."""
    spark, out, asked = short.sparkSession, None, settled(short.join(vecs.withColumnRenamed("node", "q"), "q").select("q", "vec"))
    blocks = -(-asked.count() // block)
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        ids = np.array([r["q"] for r in part], np.int64)
        shared = spark.sparkContext.broadcast((ids, _decoded(pa.array([bytes(r["vec"]) for r in part], pa.binary()), np.float32)[:, :-1] if part else None))

        def near(batches, shared=shared):
            ids, x = shared.value
            for batch in batches:
                if len(ids) and batch.num_rows:
                    node = batch.column("node").to_numpy()
                    sim = x @ _decoded(batch.column("vec"), np.float32)[:, :-1].T
                    m = min(k, len(node))
                    at = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    yield pa.record_batch({"q": np.repeat(ids, m), "node": node[at].ravel(), "sim": np.take_along_axis(sim, at, 1).ravel()})

        found = vecs.select("node", "vec").mapInArrow(near, "q long, node long, sim float")
        out = found if out is None else out.unionByName(found)
    best = W.partitionBy("q").orderBy(F.desc("sim"), "node")
    return out.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "node")


def nearest(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``rows`` (vec_id,
    embedding) for which ``is_query`` holds, without itself. Walks start at the row's own node."""
    able = F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding"))
    rows = rows.select("vec_id", "embedding", F.lit(0).alias("group")).filter(able)
    size = vectors.usual_size(rows)
    rows = rows.filter(F.size("embedding") == size).withColumn("d", vectors.digest("embedding"))
    nodes = vectors.distinct_nodes(rows, k + 1)
    if nodes.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vecs = lifted(nodes)
    graph = build_graph(nodes, vecs)
    asking = settled(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "d").join(nodes.select("d", "node"), "d").select("query_id", "node"))
    own = asking.select("node").distinct()
    zero = F.expr("concat(substring(vec, 1, octet_length(vec) - 4), X'00000000')")  # a query's added coordinate is zero
    starts = own.join(vecs.select("node", zero.alias("qvec")), "node").join(graph.select("node", "ids"), "node", "left").select(F.col("node").alias("q"), "qvec", F.concat(F.coalesce("ids", F.expr("cast(array() as array<bigint>)")), F.array("node")).alias("ids"))
    found = settled(search(graph, vecs, starts).select("q", F.slice("ids", 1, k + 5).alias("ids")))
    best = found.select("q", F.explode("ids").alias("node"))
    enough = min(k + 1, nodes.count())
    short = settled(own.select(F.col("node").alias("q")).join(found.filter(F.size("ids") >= enough), "q", "left_anti"))
    if not short.isEmpty():
        best = best.join(short, "q", "left_anti").unionByName(_exact(short, vecs, k + 5))
    both = best.join(nodes.select("node", "embedding", "ids"), "node").join(nodes.select(F.col("node").alias("q"), F.col("embedding").alias("asked")), "q")
    product = F.aggregate(F.zip_with("embedding", "asked", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    ranked = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = both.select("q", product.alias("score"), F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1)
    each = W.partitionBy("query_id").orderBy("r")
    out = asking.join(near, asking["node"] == near["q"]).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(each))
    return out.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
