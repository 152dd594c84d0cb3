"""SimHash near-dedup with bit-sliced comparison.

Fingerprints of 64 bits come from all word shingles of a text. Equal fingerprints are one node;
nodes that differ in at most ``radius`` bits agree on some of a few bit blocks, so they meet in a
bucket of one of the tables built on those blocks. Within a bucket the bit planes of 64
fingerprints each are stored vertically, carry-save counters update 64 distances at a time, and a
comparison is abandoned as soon as all its distances exceed the radius. Buckets report spanning
links only, and components are contracted on Spark; nothing is lost, as every pair within the
radius meets.

:func:`keep_first` drops near copies whose shingle sets have a Jaccard similarity of ``least``. Such
pairs differ in up to some fifteen bits, too many for exact block tables at scale, so its tables
are built on samples of bits, as many as it takes to see 98 % of the pairs that are twelve bits
apart. Candidates in their buckets are found by the same bit-sliced comparison, and a link counts
only once the shingles themselves have been compared.

Cases: null, empty and blank texts have fingerprint zero and link like any other; texts shorter
than a shingle are one shingle; repeated rows share fingerprint and component; a row without
doc_id links by its fingerprint, and a component without any id has component_id null; a text is
read whole, and a task needs some 50 times the bytes of the longest; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.llm.columns import free
from docproof.llm.components import components
from docproof.llm.store import dropped, settled
from docproof.llm.textbytes import LOWER, mixed, positions, shingles, text_blocks, words
from docproof.llm.tiles import by_group, joined_labels, tiled
from docproof.llm.xxh64 import xxh64

TILE = 2048
SEED = 42


def fingerprint_block(data: np.ndarray, offsets: np.ndarray, shingle: int, more: int = 0) -> np.ndarray:
    """Fingerprint of each text of a block, with ``more`` further words of 64 bits from other hashes of the shingles."""
    starts, ends, row = words(data, offsets)
    n = len(offsets) - 1
    at, place, _ = positions(starts, ends)
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1  # in the text with one space after each word
    spaced = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    spaced[place + np.repeat(begin, sizes)] = LOWER[data[at]]
    count = np.bincount(row, minlength=n)
    last = np.arange(len(row)) + shingle - 1
    whole = np.flatnonzero((last < len(row)) & (row[np.minimum(last, len(row) - 1)] == row)) if len(row) else last
    first_word = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < shingle))
    s = np.concatenate([begin[whole], begin[first_word[short]]])
    final = np.concatenate([whole + shingle - 1, first_word[short] + count[short] - 1])
    e = begin[final] + sizes[final]
    owner = np.concatenate([row[whole], short])
    order = np.argsort(owner, kind="stable")
    s, e, owner = s[order], e[order], owner[order]
    out = np.zeros((n, 1 + more), np.uint64)
    if not len(s):
        return out
    rows, cut, total = np.unique(owner, return_index=True, return_counts=True)
    # shingles are hashed and unpacked some thousands at a time, so a long text needs no more memory
    sums = np.zeros((len(rows), 64 * (1 + more)), np.int64)
    step = (1 << 20) // (64 * (1 + more))
    for lo in range(0, len(s), step):
        hi = min(lo + step, len(s))
        from_, upto = int(s[lo:hi].min()), int(e[lo:hi].max())
        h = xxh64(spaced[from_:upto], s[lo:hi] - from_, e[lo:hi] - from_, SEED)
        turns = [h]
        for _ in range(more):
            turns.append(mixed(turns[-1]))
        bits = np.unpackbits(np.stack(turns, 1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        k = np.arange(np.searchsorted(cut, lo, "right") - 1, np.searchsorted(cut, hi, "left"))
        sums[k] += np.add.reduceat(bits, np.maximum(cut[k] - lo, 0), axis=0, dtype=np.int64)
    out[rows] = np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view("<u8")
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint_block(data, offsets, shingle)[:, 0] for _, _, data, offsets in text_blocks(batch, "text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": np.concatenate([np.zeros(0, np.uint64), *fp]).view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def tables_for(n: int, radius: int) -> list[int]:
    """Bit masks of the tables: with radius + extra blocks, two fingerprints within the radius agree
    on ``extra`` of them. More rows take more blocks, so buckets stay small; all choices are exact."""
    extra = 1
    while n / 2 ** (64 * extra / (radius + extra)) > TILE:
        extra += 1
    m = radius + extra
    cuts = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(m), extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fp: np.ndarray, starts: np.ndarray, radius: int, ask: np.ndarray | None = None, chunk: int = 1 << 15, upto: np.ndarray | None = None):
    """Pairs i < j within the groups that begin at ``starts`` (and end) whose distance is at most ``radius``;
    with ``ask`` only those where j asks, with ``upto`` only those where i < upto[j]."""
    n = len(fp)
    lanes = -(-n // 64)
    padded = np.zeros(lanes * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(lanes, 64, 8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    begin = np.repeat(starts[:-1], np.diff(starts))
    upto = np.arange(n) if upto is None else upto
    query = np.flatnonzero((upto > begin) if ask is None else (upto > begin) & ask)
    first = begin[query] // 64
    many = (upto[query] - 1) // 64 - first + 1
    total = np.cumsum(many)
    ones = ~np.uint64(0)
    for lo in range(0, int(total[-1]) if len(query) else 0, chunk):
        at = np.arange(lo, min(lo + chunk, int(total[-1])))
        q = np.searchsorted(total, at, "right")
        block = first[q] + at - (total[q] - many[q])
        q = query[q]
        own, low, high = fp[q], begin[q] - block * 64, upto[q] - block * 64
        valid = np.where(low > 0, ones << np.clip(low, 0, 63).astype(np.uint64), ones)
        valid &= np.where(high < 64, (np.uint64(1) << np.clip(high, 0, 63).astype(np.uint64)) - np.uint64(1), ones)
        c = np.zeros((max(radius.bit_length(), 1), len(q)), np.uint64)
        over = np.zeros(len(q), np.uint64)
        for p in range(64):
            x = planes[p][block] ^ (np.uint64(0) - ((own >> np.uint64(p)) & np.uint64(1)))
            for k in range(len(c)):
                c[k], x = c[k] ^ x, c[k] & x
            over |= x
            if p % 8 == 7:
                valid &= ~(over | _above(c, radius))
                open_ = valid != 0
                if not open_.all():  # blocks that all exceed the radius are left
                    q, own, block, valid, over, c = q[open_], own[open_], block[open_], valid[open_], over[open_], c[:, open_]
                if not len(q):
                    break
        if len(q):
            hit, lane = np.nonzero(np.unpackbits(valid.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield block[hit] * 64 + lane, q[hit]


def _above(c: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counters (a row for each of their bits) are above ``radius``."""
    above, equal = np.zeros(c.shape[1], np.uint64), ~np.zeros(c.shape[1], np.uint64)
    for k in reversed(range(len(c))):
        if radius >> k & 1:
            equal &= c[k]
        else:
            above |= equal & c[k]
            equal &= ~c[k]
    return above


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: fingerprints (column fp, distinct) within ``radius`` bits, as spanning links of each bucket."""
    masks = tables_for(nodes.count(), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for t, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(tables).alias("k")).select("fp", "k.table", "k.bits")

    def work(t: pa.Table, starts: np.ndarray):
        fp = t.column("fp").to_numpy().view(np.uint64)
        label = np.arange(len(fp))
        for i, j in close_pairs(fp, starts, radius):
            label = joined_labels(label, i, j)
        own = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.record_batch({"a": fp[own].view(np.int64), "b": fp[label[own]].view(np.int64)})

    dealt = tiled(rows, ["table", "bits"], F.col("fp"), TILE)
    return dealt.select("table", "bits", "tile_i", "tile_j", "fp").mapInArrow(by_group(["table", "bits", "tile_i", "tile_j"], work), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) of every row."""
    fps = settled(fingerprints(docs, shingle))
    nodes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "component").join(first, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: Nodes of a bucket of sampled bits, at most, in the first round; where more agree, further bits set them apart.
BUCKET = 2048
#: Distance whose pairs the sampled tables see with the probability SEEN.
ASSURED, SEEN = 12, 0.98
#: Of 128 further bits, so many differ at most between texts of a similarity of 0.8, but once in 1,000 times.
FURTHER = 33
#: Words of a long fingerprint, and bits that it may differ in: three standard deviations above what texts of a
#: similarity of 0.8 do; at 0.7 one pair in 200 does.
LONG, LONG_APART = 16, 190
#: Up to so many candidates of a round are told to every task; beyond, texts are shuffled to them.
BROADCAST_ASKS = 200_000
#: Candidates that a task verifies against one text; a text with more is sent to several tasks.
VERIFIED = 2000
#: Nodes of a tile whose shingles are compared, and pairs of one node that are compared before links are looked at again.
CLOSE, AT_ONCE = 512, 64


def sampled_tables(n: int) -> tuple[int, np.ndarray]:
    """Bits of a bucket's key for ``n`` nodes, and the order of bits of each table."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / (BUCKET / 2))))
    agree = math.prod((64 - bits - i) / (64 - i) for i in range(ASSURED))
    count = 1 if agree >= 1 else math.ceil(math.log(1 - SEEN) / math.log(1 - agree))
    rng = np.random.default_rng(21)
    return bits, np.stack([rng.permutation(64) for _ in range(count)])


def _keys(orders: np.ndarray, columns: list[str]):
    """For each table a key whose leading bits are those that the table takes first, with ``columns``."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for t, order in enumerate(orders):
                key = np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="big")).view(">u8").ravel().astype(np.uint64)
                yield pa.record_batch({"tab": np.full(len(fp), t, np.int32), "key": key.view(np.int64), **{c: batch.column(c) for c in columns}})

    return run


NODE = ["node", "first_id", "fp", "f2", "f3"]


def keyed(nodes: DataFrame, orders: np.ndarray, columns: list[str]) -> DataFrame:
    """tab, key and ``columns`` (all long) of every node in each table."""
    return nodes.select(*columns).mapInArrow(_keys(orders, columns), "tab int, key long, " + ", ".join(f"{c} long" for c in columns))


def bucketed(nodes: DataFrame) -> DataFrame:
    """tab, bits, bucket, node, first_id, fp, f2, f3: every node in a bucket of each table, of about ``BUCKET`` nodes.

    A bucket with more is split by the next four bits, again and again, so a group of copies that
    holds a third of all nodes comes in buckets of the same size; nodes that agree in all bits are
    dealt by a hash. What is split apart here meets in :func:`across`."""
    bits, orders = sampled_tables(nodes.count())
    rows = keyed(nodes, orders, NODE)
    lead = lambda b: F.lit(0).cast("long") if not b else F.shiftrightunsigned("key", 64 - b)
    rows = settled(rows.withColumn("bits", F.lit(bits)).withColumn("bucket", lead(bits)))
    done, used = [], []
    while True:
        large = settled(rows.groupBy("tab", "bits", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET))
        used += [rows, large]
        if large.isEmpty():
            done.append(rows.drop("key"))
            break
        done.append(rows.join(large, ["tab", "bits", "bucket"], "left_anti").drop("key"))
        more = rows.join(large, ["tab", "bits", "bucket"])
        if bits >= 64:
            done.append(more.withColumn("bits", (65 + F.pmod(F.xxhash64("tab", "node"), F.ceil(F.col("n") / BUCKET))).cast("int")).drop("key", "n"))
            break
        bits = min(64, bits + 4)
        rows = settled(more.drop("n").withColumn("bits", F.lit(bits)).withColumn("bucket", lead(bits)))
    out = settled(_united(done))
    dropped(*used)
    return out


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _candidates(t: pa.Table, starts: np.ndarray, radius: int, upto: np.ndarray | None = None):
    """Pairs i < j of a bucket within the radius (i < upto[j]), and their distance. What the bit-sliced
    comparison lets pass is looked at again with the 128 further bits, which tell copies from texts
    that share a part."""
    fp, f2, f3 = (t.column(c).to_numpy().view(np.uint64) for c in ("fp", "f2", "f3"))  # of signed numbers numpy counts the bits of the magnitude
    for i, j in close_pairs(fp, starts, radius, upto=upto):
        further = np.bitwise_count(f2[i] ^ f2[j]) + np.bitwise_count(f3[i] ^ f3[j])
        like = further <= FURTHER
        i, j = i[like], j[like]
        yield i, j, further[like] + np.bitwise_count(fp[i] ^ fp[j])


KEY = ["tab", "bits", "bucket"]


def _in_buckets(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "first_id", "node").mapInArrow(by_group(KEY, work), schema)


def nearest(buckets: DataFrame, radius: int, most: int) -> DataFrame:
    """a, b: for each node ``a`` of a bucket its ``most`` nearest candidates ``b`` that come before it, by
    first_id and node."""

    def work(t: pa.Table, starts: np.ndarray):
        node, near, held = t.column("node").to_numpy(), [np.zeros(0, np.int64)], 0

        def best() -> np.ndarray:
            """The candidates held, in the order of who asks, distance and place, up to ``most`` of each."""
            keys = np.sort(np.concatenate(near))
            j = keys >> 40
            return keys[np.arange(len(j)) - np.searchsorted(j, j) < most]

        for i, j, distance in _candidates(t, starts, radius):
            near.append((j << 40) | (distance.astype(np.int64) << 32) | i)
            held += len(j)
            if held > 1 << 21:
                near, held = [best()], 0
        keys = best()
        i, j = keys & 0xFFFFFFFF, keys >> 40
        yield pa.record_batch({"a": node[j], "b": node[i]})

    return _in_buckets(buckets, work, "a long, b long").distinct()


def across(nodes: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """tab, bucket, node, first_id, fp, f2, f3, part_of: every node (with its component) in a bucket of each table, for
    :func:`_apart`, and the bits that each table takes. No bucket is split."""
    bits, orders = sampled_tables(nodes.count())
    lead = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    masks = (np.uint64(1) << orders[:, :bits].astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    return settled(keyed(nodes, orders, [*NODE, "part_of"]).withColumn("bucket", lead).drop("key")), masks


TILE_KEY = ["tab", "bucket", "tile_i", "tile_j"]


def _apart(radius: int, masks: np.ndarray, work):
    """For :func:`by_group`: what ``work`` gives for tiles, the first row of each row's component and each batch
    of candidates i, j that are of different components. Rows come by component, so those of one component are
    not compared. Of all tables and tiles where two nodes meet the first one counts."""

    def run(t: pa.Table, starts: np.ndarray):
        new, own = np.zeros(t.num_rows, bool), t.column("part_of").to_numpy()
        new[starts[:-1]] = True
        new[1:] |= own[1:] != own[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        fp, tab, part, tile_i, tile_j = (t.column(c).to_numpy() for c in ("fp", "tab", "part", "tile_i", "tile_j"))

        def found():
            for i, j, _ in _candidates(t, starts, radius, first):
                here = (part[i] != part[j]) | (tile_i[i] == tile_j[i])
                i, j = i[here], j[here]
                here, differ = np.ones(len(i), bool), (fp[i] ^ fp[j]).view(np.uint64)
                for k, mask in enumerate(masks[: int(tab[i].max(initial=0))]):
                    here &= (tab[i] <= k) | (differ & mask != 0)
                yield i[here], j[here]

        yield from work(t, first, found())

    return run


def _in_tiles(rows: DataFrame, tile: int) -> DataFrame:
    return tiled(rows, ["tab", "bucket"], F.col("node"), tile).sortWithinPartitions(*TILE_KEY, "part_of", "node")


def _involved(rows: DataFrame, radius: int, masks: np.ndarray) -> DataFrame:
    """node: those that have a candidate of another component."""

    def work(t: pa.Table, _, found):
        node, some = t.column("node").to_numpy(), np.zeros(t.num_rows, bool)
        for i, j in found:
            some[i] = True
            some[j] = True
        yield pa.record_batch({"node": np.unique(node[some])})

    return _in_tiles(rows, TILE).mapInArrow(by_group(TILE_KEY, _apart(radius, masks, work)), "node long").distinct()


def _alike(t: pa.Table, found):
    """Of the candidates those whose fingerprints of 1,024 bits (``long``) are near enough."""
    words = np.frombuffer(b"".join(t.column("long").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    for i, j in found:
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            like = np.bitwise_count(words[p] ^ words[q]).sum(axis=1) <= LONG_APART
            yield p[like], q[like]


MET = [*TILE_KEY, "part", *NODE, "part_of", "long"]


def _meeting(rows: DataFrame, radius: int, masks: np.ndarray) -> DataFrame:
    """``rows`` (with ``long``) in the tiles where they have a candidate of another component."""

    def work(t: pa.Table, _, found):
        some = np.zeros(t.num_rows, bool)
        for i, j in _alike(t, found):
            some[i] = True
            some[j] = True
        yield from t.select(MET).filter(pa.array(some)).combine_chunks().to_batches()

    dealt = _in_tiles(rows, CLOSE).select(*MET)
    return dealt.mapInArrow(by_group(TILE_KEY, _apart(radius, masks, work)), dealt.schema)


def _spanning(t: pa.Table, label: np.ndarray, found, least: float):
    """Pairs found whose shingle sets (``own``) have a Jaccard similarity of at least ``least``, as links that span
    what they join: a pair whose rows are joined already is not compared any more. ``label`` is the first row of
    each row's component."""
    own, label = t.column("own").combine_chunks(), label.copy()
    at = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] // 4
    token, size = np.frombuffer(own.buffers()[2], np.uint32), np.diff(at)
    for i, j in found:
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        begin = np.flatnonzero(np.append(True, j[1:] != j[:-1])[: len(j)])
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(j)], strict=True):
            k, others = j[lo], i[lo:hi]
            others = others[least * np.maximum(size[others], size[k]) <= np.minimum(size[others], size[k])]
            mine = token[at[k] : at[k + 1]]
            while len(others := others[label[others] != label[k]]):
                p, others = others[:AT_ONCE], others[AT_ONCE:]
                cut = np.append(0, np.cumsum(size[p]))
                their = token[np.arange(int(cut[-1])) + np.repeat(at[p] - cut[:-1], size[p])]
                known = mine[np.minimum(np.searchsorted(mine, their), len(mine) - 1)] == their
                both = np.add.reduceat(known.astype(np.int64), cut[:-1])
                linked = p[both >= least * (size[p] + size[k] - both)]
                if not len(linked):
                    continue
                groups, which = np.unique(label[linked], return_index=True)
                yield np.full(len(which), k), linked[which]
                groups = np.append(groups, label[k])
                label[np.isin(label, groups)] = groups.min()


def _all_near(met: DataFrame, radius: int, masks: np.ndarray, least: float) -> DataFrame:
    """a, b: links between all candidates of ``met`` (with their shingles, ``own``) that are similar, spanning in each tile."""

    def work(t: pa.Table, first: np.ndarray, found):
        node = t.column("node").to_numpy()
        for i, j in _spanning(t, first, _alike(t, found), least):
            yield pa.record_batch({"a": node[i], "b": node[j]})

    dealt = met.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "part_of", "node")
    return dealt.mapInArrow(by_group(TILE_KEY, _apart(radius, masks, work), 4000), "a long, b long")


def _set(token: np.ndarray, text: np.ndarray) -> bytes:
    """The shingles of a text, 32 bits each, sorted, each once."""
    own = np.unique((token >> np.uint64(32)).astype(np.uint32)).tobytes()
    if own:
        return own
    whole = b" ".join(LOWER[text].tobytes().split())  # too short for a shingle: the whole sequence is one
    return hashlib.blake2b(whole, digest_size=4).digest()


def _sets(shingle: int):
    """The shingles of a text, for itself and for each text it asks."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                token, cut = shingles(data, offsets, shingle)
                out = []
                for i, r in enumerate(batch.slice(lo, hi - lo).select(["node", "asked", "salts"]).to_pylist()):
                    own = _set(token[cut[i] : cut[i + 1]], data[offsets[i] : offsets[i + 1]])
                    out += [(r["node"], s, r["node"], 0, own) for s in range(r["salts"] or 0)]
                    out += [(c["b"], c["salt"], r["node"], 1, own) for c in r["asked"] or ()]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["at", "salt", "node", "asks", "own"])

    return run


def _similar(least: float):
    def work(t: pa.Table, starts: np.ndarray):
        node, asks, own = t.column("node").to_numpy(), t.column("asks").to_numpy(), t.column("own").combine_chunks()
        a, b = [], []
        for g, end in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if asks[g]:
                continue
            base = np.frombuffer(own[g].as_buffer(), np.uint32)
            for k in range(g + 1, end):
                x = np.frombuffer(own[k].as_buffer(), np.uint32)
                if least * max(len(x), len(base)) > min(len(x), len(base)):
                    continue
                both = len(x) + len(base) - len(np.union1d(x, base))
                if both >= least * (len(x) + len(base) - both):
                    a.append(node[k])
                    b.append(node[g])
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def verified(asked: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of the pairs a, b (nodes) those whose shingle sets have a Jaccard similarity of at least ``least``.

    A text that many ask is sent to as many tasks as it takes."""
    many = asked.groupBy("b").agg(F.ceil(F.count("*") / VERIFIED).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt")
    lists = asked.select("a", "b").join(many, "b").groupBy("a").agg(F.collect_list(F.struct("b", salt)).alias("asked"))
    need = lists.withColumnRenamed("a", "node").join(many.withColumnRenamed("b", "node"), "node", "full_outer")
    need = need.join(nodes, "node").select("node", F.col("first_id").alias("doc_id"), "d1", "d2", "asked", "salts")
    if asked.count() <= BROADCAST_ASKS:
        need = F.broadcast(need)
    texts = docs.join(need, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    sets = texts.select("node", "text", "asked", "salts").mapInArrow(_sets(shingle), "at long, salt int, node long, asks int, own binary")
    dealt = sets.repartition("at", "salt").sortWithinPartitions("at", "salt", "asks")
    return dealt.mapInArrow(by_group(["at", "salt"], _similar(least), 4000), "a long, b long")


def similar_links(docs: DataFrame, shingle: int = 5, radius: int = 15, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, first_id: distinct texts of rows with an id, d1, d2: 128 bits of a hash of them) and
    their verified links a, b.

    Each node first asks its two nearest candidates of each bucket of a bounded size. That joins most
    of what belongs together. Then all candidates that are still in different components are compared,
    in tiles of whole buckets: fingerprints of 1,024 bits, made for those concerned, tell in which tiles
    two of them are alike, and only there their shingles are sent. A tile compares all its candidates and
    gives the links that span what they join, so a group of many near copies gives a few for each of them.
    A candidate is left only where it is in one component already."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(99), text).alias("d2"))
    docs = docs.filter("doc_id is not null")

    def run(batches):
        for batch in batches:
            fp = [fingerprint_block(data, offsets, shingle, 2) for _, _, data, offsets in text_blocks(batch, "text")]
            fp = np.concatenate([np.zeros((0, 3), np.uint64), *fp]).view(np.int64)
            yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "d1", "d2")}, "fp": fp[:, 0].copy(), "f2": fp[:, 1].copy(), "f3": fp[:, 2].copy()})

    marked = docs.mapInArrow(run, "doc_id long, d1 long, d2 long, fp long, f2 long, f3 long").filter("fp <> 0")
    nodes = marked.groupBy("d1", "d2", "fp", "f2", "f3").agg(F.min("doc_id").alias("first_id"))
    nodes = settled(nodes.withColumn("node", F.monotonically_increasing_id()))
    buckets = bucketed(nodes)
    asked = settled(nearest(buckets, radius, 2))
    dropped(buckets)
    links = settled(verified(asked, nodes, docs, shingle, least))
    linked = components(links).withColumnRenamed("component", "part_of")
    rows, masks = across(nodes.join(linked, "node", "left").withColumn("part_of", F.coalesce("part_of", "node")))
    some = settled(_involved(rows, radius, masks))
    if some.isEmpty():
        return nodes, links
    concerned = nodes.join(some, "node").select("node", F.col("first_id").alias("doc_id"), "d1", "d2")
    if concerned.count() <= BROADCAST_ASKS:
        concerned = F.broadcast(concerned)

    def longer(batches):
        for batch in batches:
            fp, own = [np.zeros((0, LONG), np.uint64)], []
            for _, _, data, offsets in text_blocks(batch, "text"):
                fp.append(fingerprint_block(data, offsets, shingle, LONG - 1))
                token, cut = shingles(data, offsets, shingle)
                own += [_set(token[cut[i] : cut[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(cut) - 1)]
            yield pa.record_batch({"node": batch.column("node"), "long": pa.array([x.tobytes() for x in np.concatenate(fp)], pa.binary()), "own": pa.array(own, pa.binary())})

    texts = docs.join(concerned, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    long = settled(texts.select("node", "text").mapInArrow(longer, "node long, long binary, own binary"))
    met = settled(_meeting(settled(rows.join(long.drop("own"), "node")), radius, masks))
    more = settled(_all_near(met.join(long.drop("long"), "node"), radius, masks, least))
    return nodes, links.unionByName(more)


def keep_first(docs: DataFrame, shingle: int = 5, radius: int = 15, least: float = 0.8) -> DataFrame:
    """``docs`` without the near duplicates of a document with a smaller id; columns as they were.

    Near duplicates are the components of the links that :func:`similar_links` finds. Rows that share
    an id are one document, they stay or go together. Rows without an id (a whole number) link with
    nothing and stay, and so do rows without any word."""
    nodes, links = similar_links(docs, shingle, radius, least)
    linked = components(links)
    rooted = nodes.join(linked, "node", "left").select("d1", "d2", "first_id", F.coalesce("component", "node").alias("component"))
    first = rooted.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = rooted.join(first, "component").select("d1", "d2", "least_id")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").try_cast("long").alias("number"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(99), text).alias("d2"))
    away = settled(rows.join(named, ["d1", "d2"]).filter("number > least_id").select("id").distinct())
    (name,) = free(docs.columns, "id")
    return docs.join(away.withColumnRenamed("id", name), F.col("doc_id") == F.col(name), "left_anti")
