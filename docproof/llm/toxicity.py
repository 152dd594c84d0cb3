"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first 4, 5 and 6 bytes (stems), as
64-bit hashes. Of those in three and more documents of the bounded training sample the ``TERMS`` that
tell the classes apart best are the features; the machine learns a weight for each (FTRL, sparse)
and ``FACTORS`` factors whose products weigh pairs of terms, such as an insult beside a mention of
a group, that no sum of single weights can express.

Cases: a null or empty text has only the bias; unlabelled, null-labelled or id-less rows teach
nothing; without any label the score is 0.5; repeated rows get the same score; long texts are
read whole, in blocks; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.llm import labelled
from docproof.llm.store import settled
from docproof.llm.textbytes import LOWER, hashed, mixed, positions, text_blocks, words

#: Labelled documents that are learnt from, at most about.
SAMPLE = 20_000
#: Terms of the model. More of them do worse on held-out documents: the sample is too small to learn
#: factors for terms that stand in a few of its documents (figures are in the README).
TERMS, PER_LABEL, FACTORS, ROUNDS = 8192, 3, 4, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 1e-3
STEP, DECAY = 0.05, 1e-4
STEMS = (4, 5, 6)
_BITS = 1 << 22


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term occurrence of a block."""
    starts, ends, row = words(data, offsets)
    hashes, rows = [], []
    for size in (None, *STEMS):
        long = np.ones(len(starts), bool) if size is None else ends - starts > size
        s = starts[long]
        at, place, begin = positions(s, ends[long] if size is None else s + size)
        hashes.append(mixed(hashed(LOWER[data[at]], place, begin) + np.uint64(size or 0)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once in a row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def _counts(batches):
    """Per batch, how many documents, and how many of label 1, hold each term: summed before any shuffle."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        seen = [(h, label[lo + row]) for lo, _, data, offsets in text_blocks(batch, "text") for h, row in [_distinct(*terms(data, offsets))]]
        if not seen:
            continue
        h, y = (np.concatenate(x) for x in zip(*seen, strict=True))
        term, at = np.unique(h, return_inverse=True)
        yield pa.record_batch({"term": term.view(np.int64), "df": np.bincount(at, minlength=len(term)), "a": np.bincount(at, weights=y, minlength=len(term)).astype(np.int64)})


def telling_terms(rows: DataFrame, most: int) -> np.ndarray:
    """The ``most`` hashes with the largest z of their log odds ratio between the classes, sorted; no more
    than ``PER_LABEL`` for each labelled document."""
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    pos, neg = float(n["p"]), float(n["n"] - n["p"])
    most = min(most, PER_LABEL * n["n"])
    found = rows.mapInArrow(_counts, "term long, df long, a long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("df").alias("df")).filter("df >= 3")
    a, b = F.col("a") + 0.5, F.col("df") - F.col("a") + 0.5
    z = (F.log(a / (pos + 1 - a)) - F.log(b / (neg + 1 - b))) / F.sqrt(1 / a + 1 / b)
    best = found.orderBy(F.desc(F.abs(z)), "term").limit(most).select("term").collect()  # bounded by most
    return np.sort(np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64))


class Lookup:
    """Index of a hash among the kept ones; a bit table turns most others away."""

    def __init__(self, kept: np.ndarray):
        self.kept, self.bits = kept, np.zeros(_BITS, bool)
        self.bits[(kept % np.uint64(_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and row of the occurrences that are kept, each once in a row, by row."""
        hit = self.bits[(h % np.uint64(_BITS)).astype(np.int64)]
        h, row = h[hit], row[hit]
        if not len(self.kept):
            return h[:0].astype(np.int64), row[:0]
        at = np.minimum(np.searchsorted(self.kept, h), len(self.kept) - 1)
        hit = self.kept[at] == h
        key = np.unique(row[hit] * len(self.kept) + at[hit])
        return key % len(self.kept), key // len(self.kept)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _found(lookup: Lookup):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                at, row = lookup.find(*terms(data, offsets))
                own = {c: batch.column(c).slice(lo, hi - lo) for c in ("key", "label", "part")}
                yield pa.record_batch({**own, "at": labelled.lists(at.astype(np.int32), np.bincount(row, minlength=hi - lo), pa.int32())})

    return run


def _learner():
    def learn(state: list[np.ndarray], group: pa.Table) -> list[np.ndarray]:
        z, n, v, q = state  # the last slot of z and n is the bias
        lists = group["at"].combine_chunks()
        cut, at = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, y in enumerate(group["label"].to_numpy()):
            own = at[cut[i] : cut[i + 1]]
            line = np.append(own, len(z) - 1)
            zi, ni = z[line], n[line]
            w = _weights(zi, ni)
            vi = v[own]
            s = vi.sum(axis=0)
            d = 1 / (1 + np.exp(-np.clip(w.sum() + 0.5 * (s @ s - (vi * vi).sum()), -35, 35))) - y
            more = ni + d * d
            z[line] = zi + d - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[line] = more
            if len(own) > 1:
                g = np.clip(d * (s - vi) + DECAY * vi, -1, 1)
                q[own] += g * g
                v[own] = vi - STEP * g / np.sqrt(q[own])
        return [z, n, v, q]

    return learn


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept term hashes, weights (the bias last) and factors, learnt outside the held-out fold."""
    rows = labelled.training_sample(docs, labels, label, folds, held_out, sample)
    kept = telling_terms(rows, TERMS)
    rows = settled(rows.mapInArrow(_found(Lookup(kept)), "key long, label int, part int, at array<int>"))
    m = len(kept)
    start = [np.zeros(m + 1), np.zeros(m + 1), np.random.default_rng(1).normal(0, 0.01, (m, FACTORS)), np.full((m, FACTORS), 1.0)]
    z, n, v, _ = labelled.trained_in_rounds(rows, start, _learner(), ROUNDS)
    return kept, _weights(z, n), v


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: list[Lookup] = []

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        kept, w, v = shared.value
        if not cache:
            cache.append(Lookup(kept))
        out = np.full(batch.num_rows, w[-1])
        for lo, hi, data, offsets in text_blocks(batch, "text"):
            at, row = cache[0].find(*terms(data, offsets))
            out[lo:hi] += np.bincount(row, weights=w[at], minlength=hi - lo)
            for f in range(v.shape[1]):
                out[lo:hi] += 0.5 * (np.bincount(row, weights=v[at, f], minlength=hi - lo) ** 2 - np.bincount(row, weights=v[at, f] ** 2, minlength=hi - lo))
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return labelled.scored(docs, scores, folds, held_out, threshold)
