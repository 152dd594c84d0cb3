"""Views over a work queue's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def job_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """job_id, status, attempts, last_error from an attempt log (job_id, seq, outcome, terminal, error).

    Done if the last attempt is; else queued while attempts are left and none was terminal; else failed."""
    rows = attempts.groupBy("job_id").agg(
        F.max_by("outcome", "seq").alias("last"),
        F.count_if(F.col("outcome") == "failed").alias("attempts"),
        F.coalesce(F.bool_or(F.col("terminal") & (F.col("outcome") == "failed")), F.lit(False)).alias("terminal"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"),
    )
    status = F.when(F.col("last") == "done", "done").when(~F.col("terminal") & (F.col("attempts") < most), "queued").otherwise("failed")
    return rows.select("job_id", status.alias("status"), "attempts", "last_error")


def stranded_jobs(jobs: DataFrame, documents: DataFrame, now, minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """``jobs`` and ``documents`` after jobs that have run for longer are queued again, their attempts
    unchanged, and so are the documents they were processing. ``now``: a timestamp column."""
    late = (F.col("status") == "running") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    moved = jobs.withColumn("status", F.when(late, "queued").otherwise(F.col("status")))
    touched = jobs.filter(late).select("document_id", F.lit(True).alias("touched")).distinct()
    status = F.when(F.col("touched") & (F.col("status") == "processing"), "queued").otherwise(F.col("status"))
    return moved, documents.join(touched, "document_id", "left").withColumn("status", status).drop("touched")
