"""Sources and sinks: uploaded files, derived tables, the register as CSV, model request rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns of raw files, which a stream has to be told.
FILE = "path string, modificationTime timestamp, length long, content binary"


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files: path, modificationTime, length, content. Spark passes over files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def stream_uploads(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int = 100) -> DataFrame:
    """As :func:`read_uploads`, as a stream: files that arrive in a folder, each once."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)


def parsed_uploads(files: DataFrame, parse: Callable[[bytes], list[str]], magic: str = "%PDF", largest: int = 25 * 1024 * 1024) -> DataFrame:
    """path, document_id (SHA-256 of the bytes), reason, page_number, text: a row for each page of each file, or one that
    says why there are none; ``parse`` makes page texts of bytes, of one file at a time.

    A file that is not admitted is not parsed; one that ``parse`` raises on is ``unreadable``, one without any text has
    ``no_text_layer``."""

    def pages_of(blob: bytes) -> tuple[str | None, list[str]]:
        try:
            texts = list(parse(blob))
        except Exception:  # noqa: BLE001  whatever a parser raises on a damaged file
            return "unreadable", []
        return (None, texts) if any(t and t.strip() for t in texts) else ("no_text_layer", [])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, document, reason, blob = (batch.column(c)[i] for c in ("path", "document_id", "reason", "content"))
                reason, texts = (reason.as_py(), []) if reason.is_valid else pages_of(blob.as_py() or b"")
                for lo in range(0, max(1, len(texts)), 1000):
                    part = texts[lo : lo + 1000]
                    n = max(1, len(part))
                    numbers = range(lo + 1, lo + n + 1) if reason is None else [None]
                    yield pa.record_batch({
                        "path": pa.array([path.as_py()] * n, pa.string()), "document_id": pa.array([document.as_py()] * n, pa.string()), "reason": pa.array([reason] * n, pa.string()),
                        "page_number": pa.array(numbers, pa.int32()), "text": pa.array(part if reason is None else [None], pa.string()),
                    })

    rows = admit_uploads(files, magic, largest).withColumn("document_id", F.sha2("content", 256))
    rows = rows.select("path", "document_id", "reason", F.when(F.col("reason").isNull(), F.col("content")).alias("content"))
    return rows.mapInArrow(read, "path string, document_id string, reason string, page_number int, text string")


def admit_uploads(files: DataFrame, magic: str = "%PDF", largest: int = 25 * 1024 * 1024) -> DataFrame:
    """``files`` (content) with ``reason``: too_large is tested before not_supported; null means admitted."""
    prefix = F.substring("content", 1, len(magic.encode()))
    return files.withColumn("reason", F.when(F.octet_length("content") > largest, "too_large").when(F.coalesce(prefix, F.lit(b"")) != F.lit(magic.encode()), "not_supported"))


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """A derived table as parquet; with ``by`` only the partitions present in ``rows`` are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, by: str = "document_id", order: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """A derived table in ``buckets`` files by hash of ``by``, each sorted by it and ``order``; returns the table ``name``.

    Tables bucketed alike are joined and grouped by ``by`` without a shuffle."""
    rows.repartition(buckets, by).write.mode("overwrite").option("path", path).bucketBy(buckets, by).sortBy(by, *order).saveAsTable(name)
    return rows.sparkSession.table(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, by: str = "document_id", order: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """The table that another session wrote with :func:`write_bucketed`, made known to this one."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    sorted_by = ", ".join(f"`{c}`" for c in (by, *order))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY ({sorted_by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def csv_safe(c: Column) -> Column:
    """No spreadsheet formula: an apostrophe before a leading = + - @, tab, carriage return or line feed; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike("^[=+\\-@\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_money(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.format_number(c, 2), ",", ""), F.lit(""))


def csv_bool(c: Column) -> Column:
    return F.coalesce(F.when(c, "yes").otherwise(F.when(c.isNotNull(), "no")), F.lit(""))


def request_payloads(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, payload: the question, and before it each source as one citable document, in source order.

    ``sources``: question_id, source_index, chunk_id, title, page_number, blocks; ``questions``:
    question_id, text. A source without blocks keeps its place with "(no text)", so citations by
    position stay right."""
    block = F.transform(F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(F.array(F.lit("(no text)"))), lambda b: F.struct(F.lit("text").alias("type"), b.alias("text")))
    document = F.struct(
        F.lit("document").alias("type"), F.struct(F.lit("content").alias("type"), block.alias("content")).alias("source"),
        F.concat("title", F.lit(" — page "), F.col("page_number").cast("string")).alias("title"),
        F.to_json(F.struct("source_index", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("page_number").alias("page"))).alias("context"),
        F.struct(F.lit(True).alias("enabled")).alias("citations"),
    )
    rows = sources.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("source_index", document.alias("document")))).alias("d"))
    content = F.struct(F.transform("d", lambda x: x["document"]).alias("documents"), F.col("text").alias("question"))
    return rows.join(questions.select("question_id", "text"), "question_id").select("question_id", F.to_json(content).alias("payload"))


def extraction_payloads(chunks: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """document_id, payload: the document's chunks in order, labelled, and a line for each field wanted."""
    label = F.concat(F.lit("[chunk "), F.col("chunk_id").cast("string"), F.lit("] (page "), F.col("page_number").cast("string"), F.lit(")\n"), "text")
    rows = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", label.alias("t")))).alias("c"))
    wanted = "\n".join(f"- {k} ({t})" for k, t in fields)
    return rows.select("document_id", F.concat(F.array_join(F.transform("c", lambda x: x["t"]), "\n\n"), F.lit("\n\nFields:\n" + wanted)).alias("payload"))
