"""Which documents hold which texts whole: one mark of a text finds the candidates by an equi-join, then the whole
is looked for.

A window of ``span`` bytes is marked by the least hash of its grams. A text of at least so many bytes is known by the
least hash of all its grams, which marks a window within it; wherever the text stands that window stands, so a document
that gives the marks of all its windows gives this one. Neighbouring windows mostly share their mark, so marks are few.
No candidate is missed, whatever the text is made of or stands in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.session import broadcast_if_small, written

#: Bytes of a gram at most, of the text that is marked at a time, and of the largest window.
GRAM, PIECE, LARGEST = 32, 1 << 20, 1 << 16
MULTIPLIER, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def span(size):
    """The window of texts of ``size`` bytes: the largest power of four that fits."""
    fits = [F.when(size >= 4**i, 4**i) for i in range(LARGEST.bit_length() // 2, -1, -1)]
    return F.coalesce(*fits)


def _hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each place on."""
    h, n = text.astype(np.uint64) + np.uint64(1), 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(MULTIPLIER, n, 1 << 64)) + h[n:]
        n *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours."""
    n = 1
    while 2 * n <= window:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    rest = window - n
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _gram(wide: int) -> int:
    return min(GRAM, max(1, wide // 2))


def _marks(data: np.ndarray, ends: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and mark of the windows of ``wide`` bytes of texts that stand one after the other, once where neighbours share it."""
    gram, out = _gram(wide), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    begins = np.append(0, ends[:-1])
    for lo in range(0, len(data) - wide + 1, PIECE):
        m = _least(_hashes(data[lo : lo + PIECE + wide - 1], gram), wide - gram + 1)
        new = np.append(True, m[1:] != m[:-1])
        new[begins[(begins >= lo) & (begins < lo + len(m))] - lo] = True
        at = np.flatnonzero(new)
        of = np.searchsorted(ends, lo + at, "right")
        whole = lo + at + wide <= ends[of]
        out.append((of[whole], m[at[whole]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column without nulls and where each value ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def holding(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id: every document whose text holds that of an item. ``texts``: item_id, text; ``documents``: doc_id, text.

    An empty text is in every document that has one."""
    texts, documents = texts.filter("text is not null").select("item_id", "text"), documents.filter("text is not null").select("doc_id", "text")
    sized = texts.withColumn("span", span(F.octet_length("text")))
    wide = sorted(r[0] for r in sized.select("span").distinct().collect() if r[0])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [int(_hashes(np.frombuffer(t.encode(), np.uint8), _gram(s)).min()) for t, s in zip(batch.column("text").to_pylist(), batch.column("span").to_pylist(), strict=True)]
            yield batch.append_column("mark", pa.array(np.array(marks, np.uint64).view(np.int64)))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes(batch.column("text"))
            for s in wide:
                of, mark = _marks(data, ends, s)
                yield pa.record_batch([batch.column("doc_id").take(pa.array(of)), pa.array(np.full(len(of), s, np.int32)), pa.array(mark.view(np.int64))], names=["doc_id", "span", "mark"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    keys = written(sized.filter("span is not null").select("item_id", "text", "span").mapInArrow(known, f"item_id {kind(texts, 'item_id')}, text string, span int, mark long"))
    marks = documents.mapInArrow(given, f"doc_id {kind(documents, 'doc_id')}, span int, mark long")
    found = marks.join(broadcast_if_small(keys.select("span", "mark").distinct()), ["span", "mark"], "left_semi").distinct()
    candidates = written(found.join(keys, ["span", "mark"]).select("item_id", "text", "doc_id"))
    whole = documents.withColumnRenamed("text", "whole").join(broadcast_if_small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    held = candidates.join(whole, "doc_id").filter(F.contains("whole", "text")).select("item_id", "doc_id")
    return held.unionByName(texts.filter("text = ''").select("item_id").crossJoin(documents.select("doc_id")))
