"""What the two classifiers share: folds, a bounded training sample, and rounds of training.

Training runs on Spark: in each round every part of the sample continues from the shared model
in a task of its own, and the parts' models are averaged (iterative parameter mixing). A model
has a fixed size, so what comes to the driver does not grow with the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.tiles import by_group

#: Number of parts that train side by side in a round.
PARTS = 4


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """At most about ``most`` labelled documents outside the held-out fold: key, label, part, text.

    Labels that are null or without an id teach nothing; of contradicting labels of one document
    the larger counts, and of several texts of one id the one with the least hash. The sample is
    drawn by a hash of the id, so reruns agree, and as it is bounded by ``most`` its ids can be
    broadcast next to the texts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    text = F.coalesce("text", F.lit(""))
    joined = docs.select("doc_id", text.alias("text")).join(F.broadcast(known), "doc_id")
    joined = joined.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("__label").alias("__label"))
    key = F.xxhash64(F.lit(6), "doc_id")
    return joined.select(key.alias("key"), F.col("__label").alias("label"), F.pmod(key, F.lit(PARTS)).cast("int").alias("part"), "text")


def trained_in_rounds(sample: DataFrame, state: list[np.ndarray], learn: Callable[[list[np.ndarray], pa.Table], list[np.ndarray]], rounds: int) -> list[np.ndarray]:
    """``learn`` applied to each part of ``sample`` (sorted by key) from the shared state, averaged, ``rounds`` times."""
    schema = "rows long, " + ", ".join(f"s{i} binary" for i in range(len(state)))
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(state)

        def one(t: pa.Table, starts: np.ndarray):
            for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                own = learn([x.copy() for x in shared.value], t.slice(lo, hi - lo))
                yield pa.record_batch({"rows": [hi - lo], **{f"s{i}": pa.array([x.tobytes()], pa.binary()) for i, x in enumerate(own)}})

        dealt = sample.repartitionByRange(PARTS, "part").sortWithinPartitions("part", "key")
        parts = dealt.mapInArrow(by_group(["part"], one), schema).collect()  # PARTS rows of fixed size
        total = sum(p["rows"] for p in parts)
        if total:
            state = [sum(np.frombuffer(p[f"s{i}"], dtype=x.dtype).reshape(x.shape) * (p["rows"] / total) for p in parts).astype(x.dtype) for i, x in enumerate(state)]
        del parts
        shared.destroy()
    return state


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one flat array and the number of values of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def scored(docs: DataFrame, score: Callable[[pa.RecordBatch], np.ndarray], folds: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the score comes from the text column alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(score(batch), pa.float64())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
