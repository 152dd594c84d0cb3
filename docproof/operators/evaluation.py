"""The golden set, hits of retrieval and citation, and totals. A null hit is not a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.functions import text as T


def validate_golden(golden: DataFrame, documents: DataFrame, portfolios: DataFrame) -> DataFrame:
    """``golden`` (eval_id, question, answerable, expected_document_id, expected_pages, portfolio_id) with
    pages sorted and distinct, and a ``reason`` where it cannot be used."""
    known = documents.select(F.col("document_id").alias("expected_document_id"), F.lit(True).alias("doc"))
    scope = portfolios.select("portfolio_id", F.lit(True).alias("scope"))
    n = F.length(T.strip(F.col("question")))
    reason = (
        F.when((n < 3) | (n > 2000), "length").when(F.col("answerable") & F.col("expected_document_id").isNull(), "needs_document")
        .when(F.col("expected_document_id").isNotNull() & F.col("doc").isNull(), "unknown_document").when(F.col("portfolio_id").isNotNull() & F.col("scope").isNull(), "unknown_portfolio")
    )
    rows = golden.join(known, "expected_document_id", "left").join(scope, "portfolio_id", "left")
    return rows.withColumn("expected_pages", F.array_sort(F.array_distinct("expected_pages"))).withColumn("reason", reason).drop("doc", "scope")


def promote_feedback(citations: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, portfolio_id, expected_document_id, expected_pages: an asked question as a golden one,
    from the document cited first and the pages cited in it."""
    rows = citations.join(chunks.select("chunk_id", "document_id", "page_number"), "chunk_id")
    first = rows.groupBy("question_id").agg(F.min_by("document_id", "ordinal").alias("document_id"))
    pages = rows.join(first, ["question_id", "document_id"]).groupBy("question_id", "document_id").agg(F.sort_array(F.collect_set("page_number")).alias("expected_pages"))
    return questions.select("question_id", "portfolio_id").join(pages.withColumnRenamed("document_id", "expected_document_id"), "question_id")


def locate_expected_pages(sentences: DataFrame, pages: DataFrame) -> DataFrame:
    """eval_id, document_id, pages that hold a known sentence of theirs.

    ``sentences``: eval_id, document_id, sentence: joined on the document, then looked for."""
    hits = sentences.join(pages, "document_id").filter(F.contains("text", "sentence"))
    return hits.groupBy("eval_id", "document_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))


def active_questions(golden: DataFrame, most: int | None = None) -> DataFrame:
    """Active ones, oldest first; ``most`` takes a stable prefix."""
    rows = golden.filter("active").orderBy("created_at", "eval_id")
    return rows.limit(most) if most else rows


def resume_run(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Questions that the run has not measured yet."""
    return golden.join(results.select("eval_id"), "eval_id", "left_anti")


def rank_hits(golden: DataFrame, sources: DataFrame) -> DataFrame:
    """eval_id, doc_hit, page_hit, hit_rank. All null if unanswerable or without a document; page_hit
    null without expected pages. The rank is the first on an expected page, else in the document.

    ``sources``: eval_id, rank (from 1), document_id, page_number."""
    rows = golden.join(sources, "eval_id", "left")
    in_doc = F.col("document_id") == F.col("expected_document_id")
    on_page = in_doc & F.array_contains("expected_pages", F.col("page_number"))
    found = rows.groupBy("eval_id").agg(F.min(F.when(in_doc, F.col("rank"))).alias("doc_rank"), F.min(F.when(on_page, F.col("rank"))).alias("page_rank"))
    measured = F.col("answerable") & F.col("expected_document_id").isNotNull()
    paged = measured & (F.coalesce(F.size("expected_pages"), F.lit(0)) > 0)
    return golden.join(found, "eval_id").select("eval_id", F.when(measured, F.col("doc_rank").isNotNull()).alias("doc_hit"), F.when(paged, F.col("page_rank").isNotNull()).alias("page_hit"), F.when(measured, F.coalesce("page_rank", "doc_rank")).alias("hit_rank"))


def citation_hits(golden: DataFrame, cited: DataFrame) -> DataFrame:
    """eval_id, cited_doc_hit, cited_page_hit, nulls as in :func:`rank_hits`; nothing cited is a miss."""
    rows = golden.join(cited, "eval_id", "left")
    in_doc = F.col("document_id") == F.col("expected_document_id")
    found = rows.groupBy("eval_id").agg(F.coalesce(F.bool_or(in_doc), F.lit(False)).alias("d"), F.coalesce(F.bool_or(in_doc & F.array_contains("expected_pages", F.col("page_number"))), F.lit(False)).alias("p"))
    measured = F.col("answerable") & F.col("expected_document_id").isNotNull()
    paged = measured & (F.coalesce(F.size("expected_pages"), F.lit(0)) > 0)
    return golden.join(found, "eval_id").select("eval_id", F.when(measured, F.col("d")).alias("cited_doc_hit"), F.when(paged, F.col("p")).alias("cited_page_hit"))


def refused_correctly(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """eval_id, refused: of unanswerable questions, whether they stayed unanswered (a failure is no refusal)."""
    return golden.join(answers, "eval_id").select("eval_id", F.when(~F.col("answerable"), F.col("status") == "unanswered").alias("refused"))


def _rate(c: str):
    return F.avg(F.when(F.col(c), 1.0).when(~F.col(c), 0.0))


def retrieval_totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """questions, answerable, unanswerable, doc_hit_rate, page_hit_rate, mrr (a miss is 0) per ``by``."""
    mrr = F.avg(F.when(F.col("doc_hit").isNotNull(), F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))))
    return results.groupBy(*(by or [])).agg(F.count("*").alias("questions"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"), _rate("doc_hit").alias("doc_hit_rate"), _rate("page_hit").alias("page_hit_rate"), mrr.alias("mrr"))


def end_to_end_totals(results: DataFrame) -> DataFrame:
    """Answer, citation, refusal and false-answer rates, cost, and the median latency as a whole number.

    A false answer is one to an unanswerable question, or one that does not cite the right document."""
    only = lambda flag, c: F.avg(F.when(F.col("answerable") == flag, F.when(F.col(c), 1.0).otherwise(0.0)))
    false = F.avg(F.when(F.col("answered") & (~F.col("answerable") | (F.col("cited_doc_hit") == F.lit(False))), 1.0).otherwise(0.0))
    return results.agg(
        F.count("*").alias("questions"), only(True, "answered").alias("answer_rate"), _rate("cited_doc_hit").alias("citation_doc_rate"), _rate("cited_page_hit").alias("citation_page_rate"),
        _rate("refused_correctly").alias("correct_refusal_rate"), false.alias("false_answer_rate"), F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(20,6)").alias("cost_usd"),
        F.percentile("latency_ms", 0.5).cast("int").alias("latency_p50_ms"),
    )


def run_results(results: DataFrame, golden: DataFrame, documents: DataFrame) -> DataFrame:
    """Results in question order with the expected document's title."""
    titles = documents.select(F.col("document_id").alias("expected_document_id"), F.col("title").alias("expected_title"))
    return results.join(golden.select("eval_id", "created_at", "expected_document_id"), "eval_id").join(titles, "expected_document_id", "left").orderBy("created_at", "eval_id")


def compare_runs(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Runs, newest first, with the change of each metric since the run of the same mode before."""
    before = W.partitionBy("mode").orderBy("started_at", "run_id")
    return runs.select("*", *[(F.col(m) - F.lag(m).over(before)).alias(f"{m}_change") for m in metrics]).orderBy(F.desc("started_at"), "run_id")
