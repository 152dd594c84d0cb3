"""The register: one row a document, pivoted from the latest finished extraction, and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docproof.operators.evidence import shown_value
from docproof.sources.uploads import csv_bool, csv_money, csv_safe

STATES = ("confirmed", "corrected", "rejected", "pending")


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """document_id, extraction_id: the newest finished extraction, ties to the larger id."""
    done = extractions.filter("status = 'done'")
    return done.groupBy("document_id").agg(F.max(F.struct("created_at", "extraction_id")).alias("l")).select("document_id", "l.extraction_id")


def register(values: DataFrame, extractions: DataFrame, documents: DataFrame, fields: list[str], include_unreviewed: bool = False) -> DataFrame:
    """A row for each document with a finished extraction: ``fields`` as columns, n_<status>, complete.

    ``values``: extraction_id, field_key, value, corrected, review_status; ``documents``: document_id,
    portfolio_name, title (ready and visible ones). The pivot's columns are given, so it takes no
    extra pass, and the counts come from the same shuffle."""
    latest = latest_extraction(extractions)
    rows = values.join(latest, "extraction_id").withColumn("shown", shown_value(F.col("review_status"), F.col("value"), F.col("corrected"), include_unreviewed))
    cells = [F.max(F.when(F.col("field_key") == f, F.col("shown"))).alias(f) for f in fields]
    counts = [F.count_if(F.col("review_status") == s).alias(f"n_{s}") for s in STATES]
    complete = ~F.coalesce(F.bool_or((F.col("review_status") == "pending") & F.col("value").isNotNull()), F.lit(False))
    wide = rows.groupBy("document_id").agg(*cells, *counts, complete.alias("complete"))
    return documents.join(wide, "document_id").orderBy("portfolio_name", "title", "document_id")


def register_expiring(rows: DataFrame, before: str) -> DataFrame:
    """Terms that end before a date; missing and unreadable dates never do."""
    return rows.filter(F.try_to_date("term_end", "yyyy-MM-dd") < F.lit(before).cast("date"))


def register_has_break(rows: DataFrame, has: bool) -> DataFrame:
    return rows.filter(F.col("break_date").isNotNull() == F.lit(has))


def register_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("documents"), F.count_if("complete").alias("complete"), F.coalesce(F.sum("n_pending"), F.lit(0)).alias("pending_values"))


def register_by_term_end(rows: DataFrame) -> DataFrame:
    """Soonest end first, missing ones last, then title."""
    return rows.orderBy(F.asc_nulls_last("term_end"), "title", "document_id")


def unreviewed_cells(reviewed: DataFrame, everything: DataFrame, fields: list[str]) -> DataFrame:
    """document_id, cells: fields that show a value only when unreviewed ones are included."""
    both = everything.alias("e").join(reviewed.alias("r"), "document_id")
    names = F.array(*[F.when(F.col(f"e.{f}").isNotNull() & F.col(f"r.{f}").isNull(), F.lit(f)) for f in fields])
    return both.select("document_id", F.filter(names, lambda n: n.isNotNull()).alias("cells"))


def review_queue(values: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, title, pending, issues of documents with pending values; most issues first."""
    rows = values.filter("review_status = 'pending'").join(latest_extraction(extractions), "extraction_id")
    n = rows.groupBy("document_id").agg(F.count("*").alias("pending"), F.count_if(F.col("issue").isNotNull()).alias("issues"))
    return documents.join(n, "document_id").select("document_id", "title", "pending", "issues").orderBy(F.desc("issues"), F.desc("pending"), "title")


def review_totals(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("documents"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))


def pending_extraction_requests(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Ready documents without a queued or running extraction."""
    return documents.filter("status = 'ready'").join(extractions.filter("status in ('queued', 'running')"), "document_id", "left_anti")


def register_csv(rows: DataFrame, text: list[str], money: list[str], flags: list[str]) -> DataFrame:
    """Every cell as it stands in the CSV file; write it with ``.write.option("header", True).csv(path)``."""
    return rows.select(*[csv_safe(F.col(c)).alias(c) for c in text], *[csv_money(F.col(c).try_cast("double")).alias(c) for c in money], *[csv_bool(F.col(c)).alias(c) for c in flags])
