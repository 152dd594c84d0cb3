"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Features are words, word pairs, word shapes (letters, capitals and digits as classes, punctuation
as it is) and shape pairs, hashed to ``DIM`` slots; a feature's value is its share of the text's
words, so long and short texts are judged alike. A score is one sparse dot product.

Cases: a null or empty text has only the bias; unlabelled, null-labelled or id-less rows teach
nothing; without any label the score is 0.5; repeated rows get the same score; very long texts
are read whole, in blocks; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.llm import labelled
from docproof.llm.store import settled
from docproof.llm.textbytes import hashed, mixed, pairs, positions, text_blocks, words

DIM = 1 << 18
#: Labelled documents that are learnt from, at most about.
SAMPLE = 20_000
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0, 1e-4
SCALE = 8.0

#: Classes of the shape: 1 letter, 2 capital, 3 digit; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 1
SHAPE[128:] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and row of each feature occurrence of a block, and the number of words of each row."""
    starts, ends, row = words(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    at, place, begin = positions(starts, ends)
    kind = SHAPE[data[at]]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (place[1:] == 0)
    turn = np.cumsum(new) - 1
    shape_begin = turn[begin] if len(begin) else begin
    shapes = hashed(kind[new], np.arange(int(new.sum())) - np.repeat(shape_begin, np.diff(np.append(shape_begin, new.sum()))), shape_begin)
    plain = hashed(data[at], place, begin)
    slots, rows = [], []
    for salt, h in ((1, plain), (2, shapes)):
        two, two_row = pairs(h, row)
        slots += [mixed(h + np.uint64(salt)), mixed(two + np.uint64(16 + salt))]
        rows += [row, two_row]
    slot = (np.concatenate(slots) % np.uint64(DIM - 1)).astype(np.int64) + 1
    return slot, np.concatenate(rows), n


def _rows(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch, "text"):
            slot, row, n = features(data, offsets)
            key, count = np.unique(row * DIM + slot, return_counts=True)
            row, slot = key // DIM, key % DIM
            value = (count * SCALE / np.maximum(n[row], 1)).astype(np.float32)
            sizes = np.bincount(row, minlength=hi - lo)
            yield pa.record_batch({
                "key": batch.column("key").slice(lo, hi - lo), "label": batch.column("label").slice(lo, hi - lo), "part": batch.column("part").slice(lo, hi - lo),
                "slots": labelled.lists(slot.astype(np.int32), sizes, pa.int32()), "values": labelled.lists(value, sizes, pa.float32()),
            })


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights for accumulated gradients ``z`` and squared gradients ``n``."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(state: list[np.ndarray], group: pa.Table) -> list[np.ndarray]:
    z, n = state
    slots, values = group["slots"].combine_chunks(), group["values"].combine_chunks()
    offsets, flat, x_flat = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy().astype(np.float64)
    for i, y in enumerate(group["label"].to_numpy()):
        at = np.append(flat[offsets[i] : offsets[i + 1]], 0)
        x = np.append(x_flat[offsets[i] : offsets[i + 1]], 1.0)
        zi, ni = z[at], n[at]
        w = weights_of(zi, ni)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        more = ni + g * g
        z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
        n[at] = more
    return [z, n]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """The weights learnt from at most about ``sample`` labelled documents outside the held-out fold."""
    rows = labelled.training_sample(docs, labels, label, folds, held_out, sample)
    rows = settled(rows.mapInArrow(_rows, "key long, label int, part int, slots array<int>, values array<float>"))
    z, n = labelled.trained_in_rounds(rows, [np.zeros(DIM), np.zeros(DIM)], _learn, ROUNDS)
    return weights_of(z, n).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        w, out = shared.value, np.zeros(batch.num_rows)
        for lo, hi, data, offsets in text_blocks(batch, "text"):
            slot, row, n = features(data, offsets)
            out[lo:hi] = np.bincount(row, weights=w[slot], minlength=hi - lo) * SCALE / np.maximum(n, 1) + w[0]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return labelled.scored(docs, scores, folds, held_out, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    weights = fit(docs, labels, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                slot, row, n = features(data, offsets)
                out = np.bincount(row, weights=shared.value[slot], minlength=hi - lo) * SCALE / np.maximum(n, 1) + shared.value[0]
                yield batch.slice(lo, hi - lo).filter(pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
