"""Structured Streaming forms of the batch jobs; run to the end of what is there with ``available_now``.

Each is held against its batch twin. Late events past the watermark are left out of live spend
(batch counts them); ``dedup`` keeps a key for good, ``dedup_within`` forgets it after the watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from docproof.operators import prepare as P
from docproof.session import written
from docproof.sources import uploads as U


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A parquet folder as a stream; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Settings of a stream whose state is appended to: kept in RocksDB, of which a batch writes its changes.
APPENDED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings while a stream is started, which keeps them."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def available_now(rows: DataFrame, out: str, state: str, mode: str = "append", make: Callable[[DataFrame], DataFrame] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """``rows`` run to the end; every batch is written to a folder of its number, so a batch that is
    run again replaces itself. Returns what was written, with ``batch``. ``conf``: settings the stream is started with."""

    def write(df: DataFrame, batch: int) -> None:
        (make(df) if make else df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with settings(rows.sparkSession, conf or {}):
        running = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(write).start()
    running.awaitTermination()
    return rows.sparkSession.read.option("basePath", out).parquet(out)


def ingest(pages: DataFrame, out: str, state: str) -> DataFrame:
    """Arriving pages to chunks with embeddings, each arrival once."""

    def make(df: DataFrame) -> DataFrame:
        chunks = P.chunk_pages(df).withColumn("key", F.concat_ws("/", "document_id", "page_number", "ordinal_in_page"))
        return chunks.join(P.hashed_embeddings(chunks, "key"), "key")

    return available_now(pages, out, state, make=make)


def ingest_uploads(files: DataFrame, parse: Callable[[bytes], list[str]], out: str, state: str, magic: str = "%PDF", largest: int = 25 * 1024 * 1024) -> DataFrame:
    """Arriving files (:func:`uploads.stream_uploads`) to chunks with embeddings, or to the reason why there are none:
    path, document_id, reason, and of each chunk its page, place, text, offsets and embedding."""
    return available_now(files, out, state, make=lambda df: uploaded_chunks(df, parse, magic, largest))


def uploaded_chunks(files: DataFrame, parse: Callable[[bytes], list[str]], magic: str = "%PDF", largest: int = 25 * 1024 * 1024) -> DataFrame:
    """The batch twin of :func:`ingest_uploads`."""
    read = written(U.parsed_uploads(files, parse, magic, largest))  # each file is parsed once
    pages = read.filter("reason is null").select(F.struct("path", "document_id").alias("document_id"), "page_number", "text")
    chunks = P.chunk_pages(pages).withColumn("key", F.concat_ws("/", "document_id.path", "page_number", "ordinal_in_page"))
    held = P.hashed_embeddings(chunks, "key", "document_id", "page_number", "ordinal_in_page", "text", "char_start", "char_end").drop("key")
    held = held.select("document_id.path", "document_id.document_id", F.lit(None).cast("string").alias("reason"), *held.columns[1:])
    return held.unionByName(read.filter("reason is not null").select("path", "document_id", "reason"), allowMissingColumns=True)


def dedup(uploads: DataFrame) -> DataFrame:
    """The first upload of each content in a portfolio; its keys are kept for good."""
    return uploads.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["portfolio_id", "sha256"])


def dedup_within(uploads: DataFrame, at: str, delay: str) -> DataFrame:
    """As :func:`dedup` with bounded state: a content that returns after ``delay`` is new again."""
    return uploads.withColumn("sha256", F.sha2("content", 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["portfolio_id", "sha256"])


def spend(priced: DataFrame, delay: str = "1 day") -> DataFrame:
    """day, kind, cost, calls, live; in update mode the last row of a day and kind holds."""
    by = priced.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"), "kind")
    return by.agg(F.sum("cost_usd").cast("decimal(14,6)").alias("cost"), F.count("*").alias("calls")).select(F.to_date("w.start").alias("day"), "kind", "cost", "calls")


def budget_guard(priced: DataFrame, budget_micros: int) -> DataFrame:
    """event_id, day, refused of each call, by the day's accepted spend so far (in millionths).

    A day is one key: what is accepted depends on all before it, so a day's calls of a batch are taken in order."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        calls = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        out = []
        for event, cost in zip(calls["event_id"], calls["micros"], strict=True):
            refused = spent >= budget_micros
            spent += 0 if refused else int(cost)
            out.append((event, key[0], refused))
        state.update((spent,))
        yield pd.DataFrame(out, columns=["event_id", "day", "refused"])

    calls = priced.select("event_id", "created_at", F.to_date("created_at").alias("day"), (F.col("cost_usd") * 1_000_000).cast("long").alias("micros"))
    return calls.groupBy("day").applyInPandasWithState(decide, "event_id long, day date, refused boolean", "spent long", "append", GroupStateTimeout.NoTimeout)


ANSWER = "question_id long, status string, answer string, citations long"


def answers(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """question_id, status, answer, citations: an answer's events folded into a row when it finishes,
    or as failed when nothing comes for ``timeout_ms``.

    Give a timeout to streams that run on: one that runs to the end of its input would wait for it. Pieces of an
    unfinished answer are appended to a list, so a batch writes what is new in it and not the answer so far; the
    list needs :data:`APPENDED_STATE` where the stream is started. Events that come after the end of their answer begin
    another one.

    ``events``: question_id, seq, type (text, citation, finished), block, text, valid, stop_reason."""
    mode = "processingTime" if timeout_ms else "none"
    return events.groupBy("question_id").transformWithStateInPandas(AnswerFold(timeout_ms), ANSWER, "append", mode)


class AnswerFold(StatefulProcessor):
    """What there is of an answer: its pieces of text as a list, the count of its valid citations, and a timer."""

    def __init__(self, timeout_ms: int | None) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, block long, text string")
        self.cited = handle.getValueState("cited", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new, valid, stop = [], 0, None
        for df in rows:
            said = df[df["type"] == "text"]
            new += [(int(seq), int(block), text) for seq, block, text in zip(said["seq"], said["block"], said["text"], strict=True)]
            valid += int(df.loc[df["type"] == "citation", "valid"].sum())
            for reason in df.loc[df["type"] == "finished", "stop_reason"]:
                stop = reason or "end_turn"
        if self.timeout_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        cited = valid + (self.cited.get()[0] if self.cited.exists() else 0)
        if stop is None:
            if new:
                self.pieces.appendList(new)
            if valid:
                self.cited.update((cited,))
            if self.timeout_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            return
        joined: dict[int, str] = {}
        for _, block, text in sorted([*(tuple(p) for p in self.pieces.get()), *new]):
            joined[block] = joined.get(block, "") + text
        self.forget()
        answer = "\n".join(t for t in (x.strip() for x in joined.values()) if t) or None
        status = "failed" if stop in ("refusal", "error") else "answered" if cited else "unanswered"
        yield self.row(key, status, answer, cited)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        yield self.row(key, "failed", None, 0)

    def forget(self) -> None:
        self.pieces.clear()
        self.cited.clear()

    @staticmethod
    def row(key: tuple, *values: object) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *values)], columns=["question_id", "status", "answer", "citations"])
