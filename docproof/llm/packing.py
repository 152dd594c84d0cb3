"""Packing documents into batches of a token budget, in length buckets that pad least.

The lengths of all documents are counted into one histogram; dynamic programming over it chooses
the bucket boundaries for which padding every document up to its boundary adds the fewest tokens.
Inside a bucket, batches hold as many documents as the budget allows at the bucket's length. Where
a document stands in its bucket is found from counts of small shards, so a bucket that holds most
documents is never in one task.

Cases: a null or empty text has length 0 and pads like any other; a document longer than the
budget is a batch of its own, with its whole length; repeated rows are documents of their own and
stand side by side; rows without doc_id are packed too; an empty table gives no rows; further
columns are carried along, and one that is named as a result column has ``input_`` before its name;
a text is counted whole, in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.llm.columns import free, kept_names
from docproof.llm.mixing import word_count
from docproof.llm.store import settled

#: Distinct lengths that the histogram tells apart; if there are more, lengths that agree in their
#: leading bits share a bin, which stands for its largest.
BINS = 1 << 16
#: Rows of a shard of a bucket, about.
SHARD = 50_000
#: Up to so many shards their offsets are sent to every task; beyond, a shuffle join is used.
BROADCAST_SHARDS = 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that add the fewest padding tokens in all.

    ``lengths`` ascend. cost(i, j) pads all of i..j-1 to lengths[j-1]; the best last cut moves up
    with j, so each layer is solved for the middle positions first and the others between them."""
    m = len(lengths)
    if not m:
        return []
    n = np.append(0, np.cumsum(counts)).astype(np.float64)
    t = np.append(0, np.cumsum(counts * lengths)).astype(np.float64)

    def cost(i, j):
        return lengths[j - 1] * (n[j] - n[i]) - (t[j] - t[i])

    best = np.append(0.0, cost(0, np.arange(1, m + 1)))
    best[0] = 0
    cuts = []
    for _ in range(1, min(buckets, m)):
        new, cut = best.copy(), np.zeros(m + 1, np.int64)
        low, high = np.zeros(m + 2, np.int64), np.full(m + 2, m)
        spans = [(1, m)]
        while spans:  # all middles of one level at once
            mids = np.array([(a + b) // 2 for a, b in spans])
            lo, hi = low[[a for a, _ in spans]], np.minimum(high[[b for _, b in spans]], mids - 1)
            hi = np.maximum(hi, lo)
            size = hi - lo + 1
            begin = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(begin - lo, size)
            j = np.repeat(mids, size)
            value = np.where(i < j, best[i] + cost(np.minimum(i, j - 1), j), np.inf)
            least = np.minimum.reduceat(value, begin)
            where = np.flatnonzero(value == np.repeat(least, size))
            first = where[np.unique(np.searchsorted(begin, where, "right"), return_index=True)[1]]
            cut[mids], new[mids] = i[first], least
            after = []
            for (a, b), mid, c in zip(spans, mids.tolist(), i[first].tolist(), strict=True):
                if a < mid:
                    low[a], high[mid - 1] = low[a], c
                    after.append((a, mid - 1))
                if mid < b:
                    low[mid + 1], high[b] = c, high[b]
                    after.append((mid + 1, b))
            spans = after
        cuts.append(cut)
        best = new
    out, j = [], m
    for cut in reversed(cuts):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            return out[::-1]
    out.append(int(lengths[j - 1]))
    return out[::-1]


def length_histogram(rows: DataFrame) -> list:
    """n (a length), c (rows of that length), ascending; at most ``BINS`` of them.

    The driver gets one row more at most. Only where there are more distinct lengths are the leading
    bits that a bin keeps reduced, so short lengths stay apart and long ones share bins of a relative width."""
    exact = rows.groupBy(F.col("n_tokens").alias("n")).agg(F.count("*").alias("c"))
    found = exact.orderBy("n").limit(BINS + 1).collect()
    if len(found) <= BINS:
        return found
    exact = settled(exact)
    for bits in range(BINS.bit_length() - 1, 0, -1):
        step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin("n")) - bits)).cast("long")
        bins = exact.groupBy((F.col("n") - F.col("n") % step).alias("bin")).agg(F.max("n").alias("n"), F.sum("c").alias("c"))
        found = bins.select("n", "c").orderBy("n").limit(BINS + 1).collect()
        if len(found) <= BINS:
            break
    return found


RESULTS = ["n_tokens", "bucket", "pad_to", "batch", "slot"]


def pack(rows: DataFrame, length: Column, key: list[str], buckets: int = 8, budget: int = 65_536, without: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with n_tokens, bucket, pad_to, batch (within the bucket) and slot (within the batch).

    ``key`` orders the documents of a bucket, after a hash of it, so that reruns agree. Columns of
    ``without`` are left out; those named as a result column are kept as ``input_<name>``."""
    names = kept_names([c for c in rows.columns if c not in without], RESULTS)
    h, shard, before, n, *keys = free([*names.values(), *RESULTS], "h", "shard", "before", "n", *[f"key{i}" for i in range(len(key))])
    own = [F.col(f"`{name}`") for name in names.values()]
    sized = rows.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()], length.cast("long").alias("n_tokens"), *[F.col(f"`{k}`").alias(name) for k, name in zip(key, keys, strict=True)])
    rows = settled(sized.withColumn(h, F.xxhash64(*keys)))
    histogram = length_histogram(rows)
    sizes, counts = np.array([r["n"] for r in histogram], np.int64), np.array([r["c"] for r in histogram], np.int64)
    bounds = boundaries(sizes, counts, buckets)
    inside = np.searchsorted(bounds, sizes) if bounds else sizes
    per = [int(counts[inside == b].sum()) for b in range(len(bounds))]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values or [1]]), F.col("bucket") + 1)
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("pad_to", of([int(b) for b in bounds]).cast("long"))
    rows = rows.withColumn(shard, F.pmod(h, of([-(-x // SHARD) for x in per])).cast("int"))
    counted = rows.groupBy("bucket", shard).agg(F.count("*").alias(n))
    earlier = W.partitionBy("bucket").orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    offsets = settled(counted.select("bucket", shard, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before)))
    if offsets.count() <= BROADCAST_SHARDS:
        offsets = F.broadcast(offsets)
    within = W.partitionBy("bucket", shard).orderBy(h, *keys, "n_tokens")
    at = F.col(before) + F.row_number().over(within) - 1
    held = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("pad_to", F.lit(1)))).cast("long")
    out = rows.join(offsets, ["bucket", shard])
    return out.select(*own, "n_tokens", "bucket", "pad_to", F.floor(at / held).cast("long").alias("batch"), (at % held).cast("int").alias("slot"))


def pack_documents(docs: DataFrame, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """Batches of documents, a token being a word: every column but the text, and what :func:`pack` adds."""
    text = tuple(c for c in docs.columns if c.lower() == "text")
    return pack(docs, word_count(F.col("text")), ["doc_id"], buckets, budget, text)
