"""Source divergence audit over a vocabulary kept as minimal acyclic transducers.

One scan counts in how many documents of its language each term occurs; the kept terms are sorted by
range over the cluster and numbered in lexicographic order of their UTF-8 bytes. Each shard of the sorted
terms becomes a minimal acyclic transducer for each of its languages: a state stands for all that may
follow, and the outputs of the arcs on a term's way add up to its ordinal. A second scan streams the
texts through the transducers and recounts terms by ordinal for each (language, source). The ordinals
cut the vocabulary into blocks whose counts are compared for all sources at once, and break ties.

All arithmetic is in whole numbers. A pass over the texts takes ``PASS`` shards of ``SHARD`` terms, sent to
the tasks; larger vocabularies take further passes, so what is sent does not grow with them. Of the
sources of a language ``TILE`` meet ``TILE`` others in a task.

Cases: null text, lang and source are ''; rows are documents, repeated ones too, with or without doc_id; a
group without kept terms has pairs (all 0 where its language keeps none) and no terms; a language with one
source has no pairs; equal values rank by the UTF-8 bytes of the item; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.llm.store import dropped, settled
from docproof.llm.textbytes import LOWER, text_blocks
from docproof.llm.tiles import by_group

#: Terms of a shard, shards of a pass, bytes of text at a time, terms of a block, sources of a tile.
SHARD, PASS, BYTES, BLOCK, TILE = 1 << 17, 16, 1 << 22, 4096, 64
#: Bytes of terms: letters of ASCII, and all bytes of other characters.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
UNIT = 1_000_000_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block of texts, A-Z lower-cased, as an Arrow array, and the text each is in."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    off = np.append(0, np.cumsum(ends - starts))
    held = LOWER[data[inside]]
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(held)])
    return array, np.searchsorted(offsets, starts, "right") - 1


def _coded(values: list) -> tuple[np.ndarray, list]:
    """Numbers of equal values, and the distinct values."""
    known: dict = {}
    return np.array([known.setdefault(v, len(known)) for v in values], np.int64), list(known)


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, df: documents of the language with the term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, langs = _coded(batch.column("lang").to_pylist())
            for lo, hi, data, offsets in text_blocks(batch, "text", BYTES):
                found, row = terms(data, offsets)
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                n = len(coded.dictionary)
                once = np.unique(row * n + coded.indices.to_numpy())
                key, df = np.unique(lang[lo:hi][once // n] * n + once % n, return_counts=True)
                yield pa.record_batch({
                    "lang": pa.array(langs, pa.string()).take(pa.array(key // n)), "df": df,
                    "term": coded.dictionary.take(pa.array(key % n)).cast(pa.large_string()).cast(pa.string()),
                }).select(["lang", "term", "df"])

    rows = docs.select("lang", "text").mapInArrow(counted, "lang string, term string, df long")
    return rows.groupBy("lang", "term").agg(F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, ord, place: the terms in at least ``least`` documents of their language, numbered in order of
    (lang, term) over all (``ord``) and within the language (``place``)."""
    kept = document_counts(docs).filter(F.col("df") >= least).select("lang", "term")
    order = settled(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()))
    # One row a partition: how many terms stand before it.
    sizes = order.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    offsets = docs.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part long, before long")
    placed = order.withColumn("part", F.shiftright("id", 33)).join(F.broadcast(offsets), "part")
    placed = settled(placed.select("lang", "term", (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord")))
    begins = placed.groupBy("lang").agg(F.min("ord").alias("begin"))
    return placed.join(begins, "lang").select("lang", "term", "ord", (F.col("ord") - F.col("begin")).alias("place"))


def minimal(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The minimal acyclic transducer of sorted distinct ``words``: arcs by (state << 8 | byte), their target and
    output, which states accept, and the first state. Outputs along a word add up to its place."""
    known: dict = {}
    ends, arcs, last = [False], [[]], b""

    def close(depth: int) -> None:
        while len(arcs) > depth + 1:
            state = known.setdefault((ends.pop(), tuple(arcs.pop())), len(known))
            arcs[-1].append((last[len(arcs) - 1], state))

    for word in words:
        same = 0
        for a, b in zip(last, word):  # noqa: B905
            if a != b:
                break
            same += 1
        close(same)
        for _ in range(len(word) - same):
            ends.append(False)
            arcs.append([])
        ends[-1] = True
        last = word
    close(0)
    root = known.setdefault((ends[0], tuple(arcs[0])), len(known))
    reach, key, target, out = [0] * len(known), [], [], []
    for (final, own), state in known.items():  # a state is known after all that follow it
        n = int(final)
        for byte, to in own:
            key.append(state << 8 | byte)
            target.append(to)
            out.append(n)
            n += reach[to]
        reach[state] = n
    final = np.fromiter((f for f, _ in known), bool, len(known))
    return np.array(key, np.int64), np.array(target, np.int32), np.array(out, np.int32), final, root


def transducers(vocabulary: DataFrame, shard: int) -> DataFrame:
    """shard, lang, begin (place of its first term), arcs, targets, outputs, final, root: one row a shard and language."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(rows: pa.Table) -> pa.RecordBatch:
            key, target, out, final, root = minimal(rows.column("term").cast(pa.binary()).to_pylist())
            first = rows.slice(0, 1).to_pylist()[0]
            return pa.record_batch({
                "shard": [first["shard"]], "lang": [first["lang"]], "begin": [first["place"]], "arcs": [key.tobytes()], "targets": [target.tobytes()],
                "outputs": [out.tobytes()], "final": [final.tobytes()], "root": pa.array([root], pa.int32()),
            })

        for batch in batches:
            # A term at place 0 begins a language, one of another shard a shard.
            shards, place = batch.column("shard").to_numpy(), batch.column("place").to_numpy()
            new = place == 0
            new[1:] |= shards[1:] != shards[:-1]
            new[:1] |= bool(held) and held[-1].column("shard")[-1].as_py() != shards[0]
            cuts = [0, *np.flatnonzero(new).tolist(), len(new)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and lo < hi and new[lo]:
                    yield closed(pa.Table.from_batches(held))
                    held = []
                if lo < hi:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield closed(pa.Table.from_batches(held))

    rows = vocabulary.withColumn("shard", F.floor(F.col("ord") / shard)).select("shard", "lang", "term", "place", "ord")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "ord")
    return rows.mapInArrow(built, "shard long, lang string, begin long, arcs binary, targets binary, outputs binary, final binary, root int")


def walked(made: tuple, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word (its bytes begin at ``begins``) its place in the transducer, -1 for words not in it."""
    arcs, targets, outputs, final, root = made
    state, place, on, i = np.full(len(begins), root, np.int64), np.zeros(len(begins), np.int64), np.arange(len(begins)), 0
    while True:
        on = on[sizes[on] > i]
        if not len(on):
            break
        key = state[on] << 8 | data[begins[on] + i]
        at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
        fits = arcs[at] == key
        state[on[~fits]] = -1
        on, at = on[fits], at[fits]
        state[on] = targets[at]
        place[on] += outputs[at]
        i += 1
    return np.where((state >= 0) & final[state], place, -1)


def recounted(docs: DataFrame, made: DataFrame, shards: int) -> DataFrame:
    """lang, source, place, n: occurrences of each kept term in each group, recounted through the transducers."""
    context, out = docs.sparkSession.sparkContext, None
    for lo in range(0, shards, PASS):
        rows = made.filter((F.col("shard") >= lo) & (F.col("shard") < lo + PASS)).collect()  # PASS shards of bounded size
        by_lang: dict = {}
        for r in sorted(rows, key=lambda r: r["begin"]):
            parts = (np.frombuffer(r["arcs"], np.int64), np.frombuffer(r["targets"], np.int32), np.frombuffer(r["outputs"], np.int32), np.frombuffer(r["final"], bool), r["root"])
            by_lang.setdefault(r["lang"], []).append((r["begin"], parts))
        part = docs.select("lang", "source", "text").mapInArrow(_streamed(context.broadcast(by_lang)), "lang string, source string, place long, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("lang", "source", "place").agg(F.sum("n").alias("n"))


def _streamed(shared):
    """For mapInArrow: the terms of each block through the transducers of their language, counted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, groups = _coded(list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)))
            for lo, hi, data, offsets in text_blocks(batch, "text", BYTES):
                found, row = terms(data, offsets)
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                n = len(coded.dictionary)
                key, count = np.unique(group[lo:hi][row] * n + coded.indices.to_numpy(), return_counts=True)
                of, word = key // n, key % n
                _, off, held = coded.dictionary.buffers()
                off, held = np.frombuffer(off, np.int64)[: n + 1], np.frombuffer(held, np.uint8)
                place = np.full(len(key), -1, np.int64)
                for lang in {groups[g][0] for g in np.unique(of)}:
                    own = np.flatnonzero(np.array([x[0] == lang for x in groups])[of])
                    seen = np.unique(word[own])
                    at = np.full(len(seen), -1, np.int64)
                    for begin, made in shared.value.get(lang, ()):
                        left = np.flatnonzero(at < 0)
                        there = walked(made, held, off[seen[left]], off[seen[left] + 1] - off[seen[left]])
                        at[left[there >= 0]] = there[there >= 0] + begin
                    place[own] = at[np.searchsorted(seen, word[own])]
                kept = np.flatnonzero(place >= 0)
                names = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(of[kept])) for i in (0, 1)]
                yield pa.record_batch([*names, pa.array(place[kept]), pa.array(count[kept])], names=["lang", "source", "place", "n"])

    return run


def _share(count, total) -> F.Column:
    """1 + floor(UNIT * (count + 1) / total), exactly."""
    return F.lit(1) + F.expr(f"(cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div ({total})")


def _sums(rows: DataFrame, tile: int) -> DataFrame:
    """begin, a, b, value: sums over a block of terms of f between sources ``a`` and ``b`` of a language, both ways.

    ``rows``: begin (of the language), block, source_no, slot (the term in its block; -1 for what p is where the term
    does not occur), p, block_terms. A tile of sources by sources is one matrix of terms each."""
    rows = rows.withColumn("part", F.floor(F.col("source_no") / tile).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / tile).cast("int"))))
    rows = rows.select("*", F.least("part", "other").alias("tile_i"), F.greatest("part", "other").alias("tile_j")).drop("other", "sources")
    key = ["begin", "block", "tile_i", "tile_j"]

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin, source, slot, p, size, i, j = (t.column(c).to_numpy() for c in ("begin", "source_no", "slot", "p", "block_terms", "tile_i", "tile_j"))
        for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            names, at = np.unique(source[lo:hi], return_inverse=True)
            none, given = slot[lo:hi] < 0, slot[lo:hi] >= 0
            usual = np.zeros(len(names), np.int64)
            usual[at[none]] = p[lo:hi][none]
            m = np.repeat(usual[:, None], size[lo], axis=1)
            m[at[given], slot[lo:hi][given]] = p[lo:hi][given]
            first = names // tile == i[lo]
            a, b, value = [], [], []
            for k in range(len(names)):
                # Within a tile each meets all, between two tiles those of the other.
                met = np.flatnonzero((np.arange(len(names)) != k) if i[lo] == j[lo] else first != first[k])
                gap = m[k] - m[met]
                a.append(np.full(len(met), names[k]))
                b.append(names[met])
                value.append((gap * gap // m[met]).sum(axis=1))
            yield pa.record_batch({"begin": np.full(sum(map(len, a)), begin[lo]), "a": np.concatenate(a), "b": np.concatenate(b), "value": np.concatenate(value)})

    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(by_group(key, work), "begin long, a long, b long, value long")


def audit(docs: DataFrame, least: int = 3, most: int = 200, shard: int = SHARD, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: how each group's terms diverge from the other sources of its language
    (part ``pair``, all of them) and which terms set it apart from the language (part ``term``, the first ``most``)."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    words = settled(vocabulary(docs, least))
    langs = words.groupBy("lang").agg(F.count("*").alias("v"), F.min("ord").alias("begin"))
    last = words.agg(F.max("ord")).first()[0]
    shards = 0 if last is None else last // shard + 1
    made = settled(transducers(words, shard))
    counts = settled(recounted(docs, made, max(1, shards)))
    dropped(made)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbers = W.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", "begin", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(numbers) - 1).cast("long").alias("source_no"))
    groups = settled(groups.withColumn("sources", F.count("*").over(W.partitionBy("lang"))))

    # Pairs: blocks of terms by sources, with what p is where a term does not occur.
    full = groups.filter("v > 0")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / block))
    absent = full.select("*", F.explode(blocks).alias("block")).select("begin", "block", "source_no", "sources", F.lit(-1).cast("long").alias("slot"), _share(0, "total + v").alias("p"), F.least(F.lit(block), F.col("v") - F.col("block") * block).alias("block_terms"))
    present = counts.join(full, ["lang", "source"])
    there = present.withColumn("block", F.floor(F.col("place") / block)).select("begin", "block", "source_no", "sources", (F.col("place") % block).alias("slot"), _share("n", "total + v").alias("p"), F.least(F.lit(block), F.col("v") - F.col("block") * block).alias("block_terms"))
    value = _sums(absent.unionByName(there), tile).groupBy("begin", "a", "b").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source", "begin", F.col("source_no").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("source_no").alias("b"))
    pairs = one.join(other, "lang").filter("a <> b").join(value, ["begin", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    # Terms: against the language, whose counts are the sums over its groups.
    whole = langs.join(groups.groupBy("lang").agg(F.sum("total").alias("all")), "lang").select("lang", "all")
    of_lang = counts.groupBy("lang", "place").agg(F.sum("n").alias("n_lang")).join(whole, "lang")
    told = present.join(of_lang, ["lang", "place"]).select("lang", "source", "begin", "place", _share("n", "total + v").alias("p"), _share("n_lang", "`all` + v").alias("q"))
    told = told.filter("p > q").select("lang", "source", "begin", "place", F.expr("((p - q) * (p - q)) div q").alias("value"))
    ranked = told.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "place"))).filter(F.col("rank") <= most)
    shown = ranked.join(words.select("lang", "place", F.col("term").alias("item")), ["lang", "place"])
    return pairs.unionByName(shown.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
