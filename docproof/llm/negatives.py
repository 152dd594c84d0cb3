"""Hard-negative mining with exact integer scores by the method of the Four Russians.

Vectors are quantised to integers and candidates are kept as bit planes: eight dimensions of one plane
are one byte. For each group of eight dimensions an anchor has a table of all 256 sums of subsets of its
components, so a byte of a plane is a lookup, and planes are put together by shifts and adds, highest
first. Anchors and candidates meet in tiles, a block of anchors and a group of candidate blocks each;
a tile streams its candidates and keeps only what is still among the first, so what is shuffled grows
with the anchors and not with the pairs. One round finds each anchor's positives (candidates of its
label alone are scored), a second one the negatives in the window of each positive.

Cases: rows without vec_id or label, and vectors that are null or hold null or non-finite components
take no part; zero and empty vectors do, with score 0; vectors are scored with those of their own size
only; repeated rows are rows like any other (an anchor's copy is one of its positives), and rows of equal
score and vec_id give equal rows of the result in any order; components are kept as 64-bit integers, at
which larger ones stop; a positive of negative score has an empty window; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.llm.store import settled
from docproof.llm.vectors import by_size

#: Candidates in a packed block, blocks in a tile, anchors in a tile, and candidates scored at a time.
BLOCK, BLOCKS, ANCHORS, STEP = 8192, 8, 128, 1024
PACKED = "block long, size int, n int, ids binary, labels binary, bits int, planes binary"
ANCHOR = "anchor long, size int, anchor_id long, label long, vector array<long>"
LEAST = np.iinfo(np.int64).min


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    q = np.floor(x.astype(np.float64) * scale)
    return np.clip(q, -(2.0**62), 2.0**62).astype(np.int64)


def bit_planes(q: np.ndarray) -> np.ndarray:
    """Planes of ``q`` (n, d) in two's complement, lowest first, the last the sign: (bits, groups, n) bytes."""
    far = int(max(q.max(initial=0), -1 - q.min(initial=0)))
    bits = far.bit_length() + 1
    q = np.pad(q, ((0, 0), (0, -q.shape[1] % 8)))
    return np.stack([np.packbits((q >> b & 1).astype(bool), axis=1, bitorder="little").T for b in range(bits)])


def from_planes(planes: np.ndarray, size: int) -> np.ndarray:
    """The integers (n, size) that :func:`bit_planes` was given."""
    ones = np.unpackbits(planes, axis=1, bitorder="little")[:, :size].astype(np.int64)
    weight = np.int64(1) << np.arange(len(planes), dtype=np.int64)
    weight[-1] *= -1
    return np.einsum("bdn,b->nd", ones, weight)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """For each group of eight dimensions the sums of all subsets of an anchor's components: (groups, 256, anchors)."""
    a = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8))).T.reshape(-1, 8, len(anchors))
    out = np.zeros((a.shape[0], 256, a.shape[2]), a.dtype)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + a[:, i : i + 1]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors): one lookup for each byte of each plane, planes shifted and added."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found, plane = np.empty_like(total), np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        plane[:] = 0
        for g in range(planes.shape[1]):
            np.take(tables[g], planes[b, g], axis=0, out=found)
            plane += found
        total <<= 1
        if b == len(planes) - 1:
            total -= plane
        else:
            total += plane
    return total


def packed(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: float, block: int = BLOCK) -> DataFrame:
    """Rows of usable vectors in settled blocks of bit planes: PACKED columns, ``ids`` and ``labels`` 64-bit each."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("embedding"))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine)
    rows = rows.filter(F.coalesce(able, F.lit(False)))
    blocks = max(1, -(-rows.count() // block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            for at, x in by_size(batch.column("embedding").cast(pa.list_(pa.float64()))):
                planes = bit_planes(quantised(x, scale))
                yield pa.record_batch({
                    "block": [number], "size": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(at)], pa.int32()), "ids": [ids[at].tobytes()],
                    "labels": [labels[at].tobytes()], "bits": pa.array([len(planes)], pa.int32()), "planes": [planes.tobytes()],
                })
                number += 1

    return settled(rows.repartition(blocks).mapInArrow(pack, PACKED))


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and planes of a packed block."""
    planes = np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], -(-row["size"] // 8), row["n"])
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), planes


def anchors_of(blocks: DataFrame, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of packed blocks whose ids ``wanted`` picks, with their vectors: ANCHOR columns. An anchor's number is
    that of its block with its place, which is how it knows itself among the candidates."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, planes = unpacked(row)
                at = np.flatnonzero(wanted(ids))
                if not len(at):
                    continue
                v = from_planes(planes[:, :, at], row["size"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * row["size"]), pa.array(v.ravel()))
                yield pa.record_batch([pa.array(number_of(row["block"], at)), pa.array(np.full(len(at), row["size"], np.int32)), pa.array(ids[at]), pa.array(labels[at]), lists], names=["anchor", "size", "anchor_id", "label", "vector"])

    return settled(blocks.mapInArrow(pick, ANCHOR))


def number_of(block: int, at: np.ndarray) -> np.ndarray:
    """Numbers of the rows ``at`` of a block: unique, as a batch has less than 2**20 rows."""
    return (np.int64(block >> 32) << 44) + (np.int64(block & 0xFFFFFF) << 20) + at


class Best:
    """The first ``most`` rows of each slot by (score falling, id), taken in as candidates stream by."""

    def __init__(self, slots: int, most: int) -> None:
        self.most, self.bar = most, np.full(slots, LEAST)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def take(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place == self.most - 1
        self.bar[slot[full]] = score[full]


def _met(blocks: DataFrame, anchors: DataFrame, work: Callable, columns: list[str], result: str, anchors_a_tile: int, blocks_a_tile: int) -> DataFrame:
    """``work`` on each tile: a block of anchors and the stream of a group of candidate blocks of their size.

    A tile's rows come to one task with its anchors first; it holds them and one candidate block."""
    n_blocks, n_anchors = blocks.count(), anchors.count()
    groups, dealt = max(1, -(-n_blocks // blocks_a_tile)), max(1, -(-n_anchors // anchors_a_tile))
    tile = lambda a, g: (a * groups + g).alias("tile")
    asking = anchors.select(F.pmod(F.xxhash64("anchor"), F.lit(dealt)).alias("a"), F.struct(*[c for c in columns]).alias("q"))
    asking = asking.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(tile(F.col("a"), F.col("g")), F.lit(0).alias("turn"), "q", F.lit(None).alias("c"))
    given = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), F.struct(*blocks.columns).alias("c"))
    given = given.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)))).select(tile(F.col("a"), F.col("g")), F.lit(1).alias("turn"), F.lit(None).alias("q"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, streams = None, [], {}

        def closed() -> Iterator[pa.RecordBatch]:
            for s in streams.values():
                yield from s.result()

        for batch in batches:
            for tile, q, c in zip(batch.column("tile").to_pylist(), batch.column("q"), batch.column("c"), strict=True):
                if tile != now:
                    yield from closed()
                    now, asked, streams = tile, [], {}
                if c.is_valid:
                    row = c.as_py()
                    if row["size"] not in streams and (own := [a for a in asked if a["size"] == row["size"]]):
                        streams[row["size"]] = work(own)
                    if row["size"] in streams:
                        streams[row["size"]].add(row)
                else:
                    asked.append(q.as_py())
        yield from closed()

    both = asking.unionByName(given).repartition(max(1, dealt * groups), "tile").sortWithinPartitions("tile", "turn")
    return both.mapInArrow(run, result)


def _fits(q: np.ndarray, bits: int) -> bool:
    """Whether no sum on the way to a score of ``q`` with so many planes leaves 32 bits."""
    return float(np.abs(q.astype(np.float64)).sum(axis=1).max()) * 2.0**bits < 2.0**31


class _Scorer:
    """Subset-sum tables of the anchors of a tile, and the scores of candidate blocks by lookups."""

    def __init__(self, own: list[dict]) -> None:
        self.vectors = np.array([a["vector"] for a in own], np.int64).reshape(len(own), -1)
        self.number = np.array([a["anchor"] for a in own], np.int64)
        self.label = np.array([a["label"] for a in own], np.int64)
        self._tables: dict = {}

    def tables(self, bits: int) -> np.ndarray:
        kind = np.int32 if _fits(self.vectors, bits) else np.int64
        if kind not in self._tables:
            self._tables[kind] = subset_sums(self.vectors.astype(kind))
        return self._tables[kind]

    def steps(self, row: dict, at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """ids, labels, numbers and scores of the candidates ``at`` (all), some at a time."""
        ids, labels, planes = unpacked(row)
        at = np.arange(len(ids)) if at is None else at
        tables = self.tables(row["bits"])
        for lo in range(0, len(at), STEP):
            part = at[lo : lo + STEP]
            yield ids[part], labels[part], number_of(row["block"], part), scores(tables, np.ascontiguousarray(planes[:, :, part]))


class _Positives(_Scorer):
    """The first ``most`` other rows of each anchor's label; only candidates of its label are scored."""

    def __init__(self, own: list[dict], most: int) -> None:
        super().__init__(own)
        self.parts = {int(x): np.flatnonzero(self.label == x) for x in np.unique(self.label)}
        self.of = {x: _Scorer([own[i] for i in at]) for x, at in self.parts.items()}
        self.best = Best(len(own), most)

    def add(self, row: dict) -> None:
        labels = np.frombuffer(row["labels"], np.int64)
        for label, anchors in self.parts.items():
            same = np.flatnonzero(labels == label)
            for ids, _, number, score in self.of[label].steps(row, same):
                i, j = np.nonzero((score >= self.best.bar[anchors]) & (number[:, None] != self.number[anchors]))
                self.best.take(anchors[j], score[i, j].astype(np.int64), ids[i])

    def result(self) -> Iterator[pa.RecordBatch]:
        b = self.best
        yield pa.record_batch({"anchor": self.number[b.slot], "positive_id": b.id, "positive_score": b.score})


class _Negatives(_Scorer):
    """For each positive of an anchor the first ``most`` rows of other labels in its window."""

    def __init__(self, own: list[dict], most: int, low: int, high: int) -> None:
        super().__init__(own)
        self.pair = [(a["anchor"], p["place"], int(p["score"])) for a in own for p in a["positives"]]
        self.anchor = np.array([i for i, a in enumerate(own) for _ in a["positives"]], np.int64)
        p = [x[2] for x in self.pair]
        # 100 n >= low p and 100 n <= high p in whole numbers; Python's integers do not overflow.
        self.low = np.array([max(-(-low * x // 100), LEAST + 1) for x in p], np.int64)
        self.high = np.array([high * x // 100 for x in p], np.int64)
        self.best = Best(len(p), most)

    def add(self, row: dict) -> None:
        for ids, labels, _, score in self.steps(row):
            other = labels[:, None] != self.label
            least = np.maximum(self.low, self.best.bar)
            for k in range(0, len(self.anchor), 64):
                at = slice(k, k + 64)
                s = score[:, self.anchor[at]]
                i, j = np.nonzero((s >= least[at]) & (s <= self.high[at]) & other[:, self.anchor[at]])
                self.best.take(j + k, s[i, j].astype(np.int64), ids[i])

    def result(self) -> Iterator[pa.RecordBatch]:
        b = self.best
        anchor, place = (np.array([p[i] for p in self.pair], np.int64)[b.slot] if self.pair else np.zeros(0, np.int64) for i in (0, 1))
        yield pa.record_batch({"anchor": anchor, "place": place, "negative_id": b.id, "negative_score": b.score})


def hard_negatives(
    rows: DataFrame, asks: Callable[[np.ndarray], np.ndarray], label: Column | None = None, *, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: float = 256.0, block: int = BLOCK, blocks: int = BLOCKS, anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label (or the expression ``label``); ``asks`` picks the anchors from an
    array of vec_ids. An anchor's positives are its first rows of the same label; the negatives of each
    are the first rows of other labels whose score is between ``low`` and ``high`` hundredths of its own."""
    held = packed(rows, "vec_id", F.col("label") if label is None else label, "embedding", scale, block)
    asking = anchors_of(held, asks)
    columns = ["anchor", "size", "label", "vector"]
    near = _met(held, asking, lambda own: _Positives(own, positives), columns, "anchor long, positive_id long, positive_score long", anchors, blocks)
    first = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = settled(near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives))
    known = near.groupBy("anchor").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("positives"))  # at most ``positives``
    asking = settled(asking.join(known, "anchor"))
    found = _met(held, asking, lambda own: _Negatives(own, negatives, low, high), [*columns, "positives"], "anchor long, place long, negative_id long, negative_score long", anchors, blocks)
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = near.join(asking.select("anchor", "anchor_id"), "anchor").withColumn("place", F.col("place").cast("long"))
    return found.join(pairs, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
