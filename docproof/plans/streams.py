"""Streaming queries, run to the end of the given tables; their SQL is that of the batch twins."""

from __future__ import annotations

import io

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docproof.operators import spend as S
from docproof.plans import domain as D
from docproof.plans.access_spend import ACCESS, BUDGET
from docproof.plans.domain import sql
from docproof.plans.prepare import SENTENCES
from docproof.plans.registry import query
from docproof.session import shared_path, table
from docproof.sources import uploads as U
from docproof.streaming import jobs as J


def folders(spark, name):
    base = shared_path(spark, name)
    return f"{base}/out", f"{base}/state"


def staged(spark, rows, name):
    """``rows`` as a folder of files for a stream to read."""
    path = folders(spark, name)[0]
    rows.write.parquet(path)
    return J.stream(spark, path)


def priced_stream(spark, d):
    """Model calls as they come, priced before they are streamed on."""
    return staged(spark, S.price_calls(D.usage_events(spark, d), D.prices(spark)).select("event_id", "user_id", "kind", "created_at", "cost_usd").coalesce(4), "calls")


@query("stream_ingest")
def stream_ingest(spark, d):
    pages = staged(spark, D.pages(spark, d), "pages")
    rows = J.ingest(pages, *folders(spark, "ingest"))
    return rows.select("document_id", "page_number", "ordinal_in_page", F.md5("text").alias("digest"), F.size("embedding").alias("dims"))


#: The texts of the documents table in the order of its file, as the pages of one upload.
V_UPLOADED = "SELECT 0 AS document_id, row_number() OVER () AS page_number, text FROM documents"


def texts_of(blob: bytes) -> list[str]:
    """The texts of a parquet file, as its pages."""
    return pq.read_table(io.BytesIO(blob), columns=["text"]).column("text").to_pylist()


@query("stream_uploads", sql("SELECT page_number::INT AS page_number, ordinal_in_page::INT AS ordinal_in_page, char_start::INT AS char_start, char_end::INT AS char_end, md5(text) AS digest FROM v_packed", **{**SENTENCES, "v_page": V_UPLOADED}))
def stream_uploads(spark, d):
    """The part files of the documents table as uploads that arrive, each text a page, to chunks with vectors. A path with
    a pattern may be a file or a folder."""
    rows = J.ingest_uploads(U.stream_uploads(spark, f"{d}/document[s].parquet"), texts_of, *folders(spark, "uploads"), magic="PAR1", largest=2**31 - 1)
    return rows.select("page_number", "ordinal_in_page", "char_start", "char_end", F.md5("text").alias("digest"))


@query("stream_dedup", sql("SELECT DISTINCT portfolio_id, sha256(content) AS sha256 FROM v_upload"))
def stream_dedup(spark, d):
    rows = J.dedup(staged(spark, D.uploads(spark, d), "uploads")).select("portfolio_id", "sha256")
    return J.available_now(rows, *folders(spark, "dedup")).select("portfolio_id", "sha256")


@query("stream_spend", sql("SELECT created_at::DATE AS day, kind, sum(cost_usd)::DECIMAL(14,6) AS cost, count(*) AS calls FROM v_priced GROUP BY 1, 2", **ACCESS))
def stream_spend(spark, d):
    rows = J.available_now(J.spend(priced_stream(spark, d), "60 days"), *folders(spark, "spend"), mode="update")
    return rows.groupBy("day", "kind").agg(F.max_by(F.struct("cost", "calls"), "batch").alias("x")).select("day", "kind", "x.cost", "x.calls")


@query("stream_budget_guard", sql(f"SELECT event_id, created_at::DATE AS day, coalesce(sum(cost_usd) OVER (PARTITION BY created_at::DATE ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {BUDGET}::DECIMAL(10,2) AS refused FROM v_priced", **ACCESS))
def stream_budget_guard(spark, d):
    rows = J.budget_guard(priced_stream(spark, d), round(float(BUDGET) * 1_000_000))
    return J.available_now(rows, *folders(spark, "guard")).select("event_id", "day", "refused")


@query("stream_answers", sql("""SELECT c.conv_id AS question_id, CASE WHEN c.conv_id % 7 = 0 THEN 'failed' WHEN c.conv_id % 3 = 0 THEN 'answered' ELSE 'unanswered' END AS status,
 string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS answer, (c.conv_id % 3 = 0)::BIGINT AS citations FROM conversations c WHERE role = 'assistant' GROUP BY c.conv_id"""))
def stream_answers(spark, d):
    """Assistant turns as blocks of an answer, with a citation for every third conversation."""
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    null = F.lit(None).cast("string")
    texts = said.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("seq"), F.lit("text").alias("type"), F.col("turn").alias("block"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("valid"), null.alias("stop_reason"))
    ids = said.select(F.col("conv_id").alias("question_id")).distinct()
    cited = ids.filter("question_id % 3 = 0").select("question_id", F.lit(10**6).cast("long").alias("seq"), F.lit("citation").alias("type"), F.lit(0).cast("long").alias("block"), null.alias("text"), F.lit(True).alias("valid"), null.alias("stop_reason"))
    stop = F.when(F.col("question_id") % 7 == 0, "refusal").otherwise("end_turn")
    done = ids.select("question_id", F.lit(10**6 + 1).cast("long").alias("seq"), F.lit("finished").alias("type"), F.lit(0).cast("long").alias("block"), null.alias("text"), F.lit(False).alias("valid"), stop.alias("stop_reason"))
    rows = J.answers(staged(spark, texts.unionByName(cited).unionByName(done), "events"))
    return J.available_now(rows, *folders(spark, "answers"), conf=J.APPENDED_STATE).select("question_id", "status", "answer", "citations")
