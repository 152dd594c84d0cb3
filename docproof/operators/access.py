"""Who sees what, and listings over what they see."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.session import every_pair


def visible_portfolios(users: DataFrame, members: DataFrame, portfolios: DataFrame) -> DataFrame:
    """user_id, portfolio_id: a director sees every portfolio, others what they are members of."""
    directors = users.filter("role = 'director'").select("user_id")
    everything = every_pair(directors, portfolios.select("portfolio_id"))
    others = members.join(directors, "user_id", "left_anti").select("user_id", "portfolio_id")
    return everything.unionByName(others).distinct()


def scoped_chunks(chunks: DataFrame, documents: DataFrame, visible: DataFrame, portfolio_id: str | None = None, focus: DataFrame | None = None) -> DataFrame:
    """``chunks`` of ready documents in a visible portfolio, in the one asked for and among the
    focused documents; every condition holds together, so an unseen scope gives nothing."""
    docs = documents.filter("status = 'ready'").select("document_id", "portfolio_id")
    if portfolio_id is not None:
        docs = docs.filter(F.col("portfolio_id") == portfolio_id)
    docs = docs.join(visible.select("portfolio_id").distinct(), "portfolio_id", "left_semi")
    if focus is not None:
        docs = docs.join(focus.select("document_id"), "document_id", "left_semi")
    return chunks.join(docs, "document_id")


def list_documents(documents: DataFrame, visible: DataFrame, text: str | None = None, status: str | None = None, portfolio_id: str | None = None) -> DataFrame:
    """Visible documents with ``total`` and ``position`` (newest first, then title). ``text`` is a
    literal part of the title or file name in any case; pages are ranges of ``position``."""
    rows = documents.join(visible.select("portfolio_id").distinct(), "portfolio_id", "left_semi")
    if text:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("filename"), F.lit(text.lower())))
    if status:
        rows = rows.filter(F.col("status") == status)
    if portfolio_id:
        rows = rows.filter(F.col("portfolio_id") == portfolio_id)
    return rows.orderBy(F.desc("created_at"), "title", "document_id")


def page_of(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of ordered ``rows`` with the total beside each row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def document_overview(documents: DataFrame, portfolios: DataFrame, extractions: DataFrame, pending: DataFrame) -> DataFrame:
    """Documents with their portfolio's name, the status of their latest extraction ('none' without
    one) and the number of pending values. ``pending``: document_id, one row a value."""
    latest = extractions.groupBy("document_id").agg(F.max_by("status", F.struct("created_at", "extraction_id")).alias("extraction_status"))
    count = pending.groupBy("document_id").agg(F.count("*").alias("pending_values"))
    rows = documents.join(portfolios.select("portfolio_id", F.col("name").alias("portfolio_name")), "portfolio_id", "left").join(latest, "document_id", "left").join(count, "document_id", "left")
    return rows.withColumns({"extraction_status": F.coalesce("extraction_status", F.lit("none")), "pending_values": F.coalesce("pending_values", F.lit(0))})


def portfolio_counts(documents: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Documents and ready documents of each portfolio, 0 where there are none, by name."""
    n = documents.groupBy("portfolio_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"))
    rows = portfolios.join(n, "portfolio_id", "left")
    return rows.select("portfolio_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("ready", F.lit(0)).alias("ready")).orderBy("name")


def status_counts(rows: DataFrame, states: list[str]) -> DataFrame:
    """status, n for each of ``states``, 0 where there are none."""
    all_ = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("status"))
    return all_.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def human_questions(questions: DataFrame, eval_results: DataFrame) -> DataFrame:
    """Questions that no evaluation asked."""
    return questions.join(eval_results.filter("question_id is not null").select("question_id"), "question_id", "left_anti")


def evidence_visible_questions(questions: DataFrame, sources: DataFrame, viewers: DataFrame, visible: DataFrame) -> DataFrame:
    """user_id, question_id: one's own questions, while every source passage is in a portfolio one sees.

    ``sources``: question_id, portfolio_id (of each passage). Directors see every question. What
    each question rests on is found once, then held against its asker's portfolios."""
    everyone = viewers.filter("role = 'director'").select(F.col("user_id").alias("viewer"))
    rests_on = sources.select("question_id", "portfolio_id").distinct()
    own = questions.join(viewers.filter("role <> 'director'").select("user_id"), "user_id", "left_semi").select("user_id", "question_id")
    unseen = own.join(rests_on, "question_id").join(visible, ["user_id", "portfolio_id"], "left_anti").select("question_id").distinct()
    seen = own.join(unseen, "question_id", "left_anti")
    directors = every_pair(questions.select("question_id"), everyone)
    return seen.unionByName(directors.select(F.col("viewer").alias("user_id"), "question_id"))


def question_history(questions: DataFrame) -> DataFrame:
    """Newest first, then id."""
    return questions.orderBy(F.desc("created_at"), "question_id")


def document_questions(citations: DataFrame, chunks: DataFrame, questions: DataFrame, most: int = 20) -> DataFrame:
    """document_id, question_id, place, labels: the newest ``most`` questions that cite a document,
    with the labels of their citations into it, in order."""
    into = citations.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("document_id", "question_id").agg(F.array_sort(F.collect_set("ordinal")).alias("labels"))
    newest = W.partitionBy("document_id").orderBy(F.desc("created_at"), "question_id")
    return into.join(questions.select("question_id", "created_at"), "question_id").withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most).drop("created_at")


def cited_pages(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, document_id, pages: the distinct pages that an answer cites, in order."""
    return citations.join(chunks.select("chunk_id", "document_id", "page_number"), "chunk_id").groupBy("question_id", "document_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))


def corpus_summary(documents: DataFrame, pages: DataFrame, chunks: DataFrame, golden: DataFrame, values: DataFrame, questions: DataFrame, feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """what, value, n: the totals of a corpus as one long table.

    Documents by status, pages, chunks, golden questions by answerable, extracted values by review
    status, questions by status, feedback by verdict, and the questions of the latest run (ties to
    the larger id) under its id. Each table is counted where it is; only counts meet."""

    def by(what: str, rows: DataFrame, value) -> DataFrame:
        return rows.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")

    latest = runs.agg(F.max(F.struct("started_at", "run_id", "questions")).alias("l")).filter("l is not null")
    parts = [
        by("documents", documents, F.col("status")), pages.agg(F.count("*").alias("n")).select(F.lit("pages").alias("what"), F.lit("all").alias("value"), "n"),
        chunks.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), F.lit("all").alias("value"), "n"), by("golden", golden, F.col("answerable")),
        by("values", values, F.col("review_status")), by("questions", questions, F.col("status")), by("feedback", feedback, F.col("verdict")),
        latest.select(F.lit("latest_run").alias("what"), F.col("l.run_id").cast("string").alias("value"), F.col("l.questions").cast("long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
