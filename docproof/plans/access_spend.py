"""Queries of access, listings, spend and the work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from docproof.operators import access as A, jobs as J, spend as S
from docproof.plans import domain as D
from docproof.plans.domain import sql
from docproof.plans.registry import query
from docproof.session import table

V_VISIBLE = "SELECT user_id, portfolio_id FROM v_member WHERE user_id IN (SELECT user_id FROM v_user WHERE role <> 'director') UNION SELECT user_id, portfolio_id FROM v_user, v_portfolio WHERE role = 'director'"
V_CITATION = "SELECT question_id, ((question_id * 7) % (SELECT count(*) FROM documents)) * 1000000 + 1 AS chunk_id, 1 AS ordinal FROM v_question UNION ALL SELECT question_id, ((question_id * 11) % (SELECT count(*) FROM documents)) * 1000000 + 1, 2 FROM v_question WHERE question_id % 3 = 0"
COST = " + ".join(f"u.{n} * coalesce(p.{c}, 0)" for n, c in S.TOKENS)
V_MATCH = "SELECT m.model, (SELECT price_model FROM v_price WHERE starts_with(m.model, price_model) ORDER BY length(price_model) DESC LIMIT 1) AS price_model FROM (SELECT DISTINCT model FROM v_usage) m"
V_UNITS = f"SELECT u.*, (({COST}) * 10000)::HUGEINT AS units FROM v_usage u JOIN v_match m ON m.model = u.model LEFT JOIN v_price p ON p.price_model = m.price_model"
V_PRICED = "SELECT * EXCLUDE (units), ((units // 10000 + CASE WHEN units % 10000 > 5000 OR units % 10000 = 5000 AND units // 10000 % 2 = 1 THEN 1 ELSE 0 END) / 1000000.0)::DECIMAL(10,6) AS cost_usd FROM v_units"
ACCESS = {"v_visible": V_VISIBLE, "v_citation": V_CITATION, "v_match": V_MATCH, "v_units": V_UNITS, "v_priced": V_PRICED}


def visible(spark, d):
    return A.visible_portfolios(D.users(spark, d), D.members(spark, d), D.portfolios(spark, d))


def citations(spark, d):
    """Each question cites the first page of one document, every third that of a second one."""
    q = D.questions(spark, d)
    n = table(spark, d, "documents").count()
    chunk = lambda k: ((F.col("question_id") * k) % n) * D.WIDE + 1
    return q.select("question_id", chunk(7).alias("chunk_id"), F.lit(1).alias("ordinal")).unionByName(q.filter("question_id % 3 = 0").select("question_id", chunk(11).alias("chunk_id"), F.lit(2).alias("ordinal")))


def priced(spark, d):
    return S.price_calls(D.usage_events(spark, d), D.prices(spark))


@query("visible_portfolios", sql("SELECT * FROM v_visible", **ACCESS))
def visible_portfolios(spark, d):
    return visible(spark, d)


@query("scoped_chunks", sql("SELECT chunk_id, document_id, portfolio_id FROM v_chunk JOIN v_document USING (document_id) WHERE status = 'ready' AND portfolio_id IN (SELECT portfolio_id FROM v_visible WHERE user_id = 5) AND portfolio_id = 'src5'", **ACCESS))
def scoped_chunks(spark, d):
    return A.scoped_chunks(D.chunks(spark, d), D.documents(spark, d), visible(spark, d).filter("user_id = 5"), "src5").select("chunk_id", "document_id", "portfolio_id")


LISTED = "FROM v_document WHERE portfolio_id IN (SELECT portfolio_id FROM v_visible WHERE user_id = 0) AND (contains(lower(title), 'en src1') OR contains(lower(filename), 'en src1')) AND status = 'ready'"


@query("list_documents", sql(f"SELECT document_id, title, (SELECT count(*) {LISTED}) AS total {LISTED} ORDER BY created_at DESC, title, document_id LIMIT 25 OFFSET 10", **ACCESS))
def list_documents(spark, d):
    rows = A.list_documents(D.documents(spark, d), visible(spark, d).filter("user_id = 0"), "EN src1", "ready")
    return A.page_of(rows.select("document_id", "title"), 25, 10)


V_PENDING = "SELECT e.document_id FROM v_raw r JOIN v_extraction e USING (extraction_id) WHERE r.review_status = 'pending' AND e.status = 'done'"


@query("document_overview", sql("""SELECT d.document_id, p.name AS portfolio_name, coalesce((SELECT arg_max(status, {'c': created_at, 'i': extraction_id}) FROM v_extraction e WHERE e.document_id = d.document_id), 'none') AS extraction_status,
 coalesce(n.n, 0) AS pending_values FROM v_document d LEFT JOIN v_portfolio p USING (portfolio_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM v_pending GROUP BY 1) n USING (document_id)""", v_pending=V_PENDING))
def document_overview(spark, d):
    pending = D.raw_values(spark, d).filter("review_status = 'pending'").join(D.extractions(spark, d).filter("status = 'done'"), "extraction_id").select("document_id")
    return A.document_overview(D.documents(spark, d), D.portfolios(spark, d), D.extractions(spark, d), pending).select("document_id", "portfolio_name", "extraction_status", "pending_values")


@query("portfolio_counts", sql("SELECT portfolio_id, name, count(document_id) AS documents, count(document_id) FILTER (status = 'ready') AS ready FROM (SELECT * FROM v_portfolio UNION ALL SELECT 'none', 'Empty', false) LEFT JOIN v_document USING (portfolio_id) GROUP BY 1, 2"))
def portfolio_counts(spark, d):
    empty = spark.range(1).select(F.lit("none").alias("portfolio_id"), F.lit("Empty").alias("name"), F.lit(False).alias("confidential"))
    return A.portfolio_counts(D.documents(spark, d), D.portfolios(spark, d).unionByName(empty))


@query("status_counts", sql("SELECT s.status, count(d.document_id) AS n FROM (SELECT unnest(['queued', 'processing', 'ready', 'failed']) AS status) s LEFT JOIN v_document d USING (status) GROUP BY 1"))
def status_counts(spark, d):
    return A.status_counts(D.documents(spark, d), ["queued", "processing", "ready", "failed"])


@query("human_questions", sql("SELECT question_id FROM v_question WHERE question_id % 4 <> 0"))
def human_questions(spark, d):
    q = D.questions(spark, d)
    return A.human_questions(q, q.filter("question_id % 4 = 0").select("question_id")).select("question_id")


V_SOURCES = "SELECT c.question_id, d.source AS portfolio_id FROM v_citation c JOIN documents d ON d.doc_id = c.chunk_id // 1000000 WHERE c.question_id % 2 = 0"


@query("evidence_visible_questions", sql("""SELECT q.user_id, q.question_id FROM v_question q JOIN v_user u USING (user_id) WHERE u.role <> 'director' AND NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.question_id = q.question_id AND (q.user_id, s.portfolio_id) NOT IN (SELECT user_id, portfolio_id FROM v_visible))
 UNION ALL SELECT u.user_id, q.question_id FROM v_question q, v_user u WHERE u.role = 'director'""", v_sources=V_SOURCES, **ACCESS))
def evidence_visible_questions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("portfolio_id"))
    sources = citations(spark, d).filter("question_id % 2 = 0").join(docs, F.floor(F.col("chunk_id") / D.WIDE) == F.col("doc_id")).select("question_id", "portfolio_id")
    return A.evidence_visible_questions(D.questions(spark, d), sources, D.users(spark, d), visible(spark, d))


@query("question_history", sql("SELECT question_id, text, (SELECT count(*) FROM v_question WHERE portfolio_id = 'src2') AS total FROM v_question WHERE portfolio_id = 'src2' ORDER BY created_at DESC, question_id LIMIT 20"))
def question_history(spark, d):
    return A.page_of(A.question_history(D.questions(spark, d).filter("portfolio_id = 'src2'").select("question_id", "text", "created_at")), 20, 0).drop("created_at")


V_INTO = "SELECT c.question_id, k.document_id, list_sort(list(DISTINCT c.ordinal)) AS labels FROM v_citation c JOIN v_chunk k USING (chunk_id) GROUP BY 1, 2"


@query("document_questions", sql("SELECT * FROM (SELECT i.document_id, i.question_id, labels, row_number() OVER (PARTITION BY i.document_id ORDER BY q.created_at DESC, i.question_id)::INT AS place FROM v_into i JOIN v_question q USING (question_id)) WHERE place <= 2", v_into=V_INTO, **ACCESS))
def document_questions(spark, d):
    return A.document_questions(citations(spark, d), D.chunks(spark, d), D.questions(spark, d), 2)


@query("cited_pages", sql("SELECT question_id, document_id, list_sort(list(DISTINCT page_number)) AS pages FROM v_citation JOIN v_chunk USING (chunk_id) GROUP BY 1, 2", **ACCESS))
def cited_pages(spark, d):
    return A.cited_pages(citations(spark, d), D.chunks(spark, d))


@query("match_price", sql("SELECT * FROM v_match", **ACCESS))
def match_price(spark, d):
    return S.match_price(D.usage_events(spark, d), D.prices(spark))


@query("price_calls", sql("SELECT event_id, cost_usd FROM v_priced", **ACCESS))
def price_calls(spark, d):
    return priced(spark, d).select("event_id", "cost_usd")


@query("unpriced_models", sql("SELECT model FROM v_match WHERE price_model IS NULL", **ACCESS))
def unpriced_models(spark, d):
    return S.unpriced_models(D.usage_events(spark, d), D.prices(spark))


@query("spent_on_day", sql("SELECT coalesce(sum(cost_usd), 0)::DECIMAL(12,6) AS spent FROM v_priced WHERE created_at::DATE = DATE '2024-01-05'", **ACCESS))
def spent_on_day(spark, d):
    return S.spent_on_day(priced(spark, d), "2024-01-05")


BUDGET = "1.50"


@query("budget_status", sql(f"SELECT created_at::DATE AS day, sum(cost_usd)::DECIMAL(12,6) AS spent, greatest(0::DECIMAL(12,6), ({BUDGET}::DECIMAL(10,2) - sum(cost_usd))::DECIMAL(12,6)) AS remaining, sum(cost_usd) >= {BUDGET}::DECIMAL(10,2) AS exhausted FROM v_priced GROUP BY 1", **ACCESS))
def budget_status(spark, d):
    return S.budget_status(priced(spark, d), BUDGET)


@query("budget_replay", sql(f"SELECT event_id, created_at::DATE AS day, coalesce(sum(cost_usd) OVER (PARTITION BY created_at::DATE ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {BUDGET}::DECIMAL(10,2) AS refused FROM v_priced", **ACCESS))
def budget_replay(spark, d):
    return S.budget_replay(priced(spark, d), BUDGET)


@query("spend_by_day", sql("SELECT g.day::DATE AS day, coalesce(sum(cost_usd), 0)::DECIMAL(12,6) AS cost, count(event_id) AS calls FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS day) g LEFT JOIN v_priced p ON p.created_at::DATE = g.day::DATE GROUP BY 1", **ACCESS))
def spend_by_day(spark, d):
    return S.spend_by_day(priced(spark, d), "2024-02-05", 17)


@query("spend_by_kind", sql("SELECT kind, sum(cost_usd)::DECIMAL(14,6) AS cost, count(*) AS calls FROM v_priced GROUP BY 1", **ACCESS))
def spend_by_kind(spark, d):
    return S.spend_by_kind(priced(spark, d))


@query("spend_by_user", sql("SELECT p.user_id, u.full_name, sum(cost_usd)::DECIMAL(14,6) AS cost, count(*) AS calls FROM v_priced p LEFT JOIN v_user u USING (user_id) GROUP BY 1, 2", **ACCESS))
def spend_by_user(spark, d):
    return S.spend_by_user(priced(spark, d), D.users(spark, d))


@query("spend_share", sql("SELECT kind, round(cost::DOUBLE / nullif(sum(cost::DOUBLE) OVER (), 0), 9) AS share FROM (SELECT kind, sum(cost_usd)::DECIMAL(14,6) AS cost FROM v_priced GROUP BY 1)", **ACCESS))
def spend_share(spark, d):
    return S.spend_share(S.spend_by_kind(priced(spark, d))).select("kind", F.round("share", 9).alias("share"))


@query("job_outcomes", sql("""SELECT job_id, CASE WHEN last = 'done' THEN 'done' WHEN NOT terminal AND attempts < 50 THEN 'queued' ELSE 'failed' END AS status, attempts, last_error
 FROM (SELECT job_id, arg_max(outcome, seq) AS last, count(*) FILTER (outcome = 'failed') AS attempts, coalesce(bool_or(terminal AND outcome = 'failed'), false) AS terminal, arg_max(error, seq) FILTER (error IS NOT NULL) AS last_error FROM v_attempt GROUP BY 1)"""))
def job_outcomes(spark, d):
    return J.job_outcomes(D.job_attempts(spark, d), 50)


@query("stranded_jobs", sql("""SELECT seq AS job_id, CASE WHEN outcome = 'running' AND "at" < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE THEN 'queued' ELSE outcome END AS status FROM v_attempt"""))
def stranded_jobs(spark, d):
    jobs = D.job_attempts(spark, d).select(F.col("seq").alias("job_id"), F.col("outcome").alias("status"), F.col("at").alias("claimed_at"), F.col("seq").alias("document_id"))
    docs = D.documents(spark, d).select("document_id", F.lit("processing").alias("status"))
    return J.stranded_jobs(jobs, docs, F.lit("2024-01-20 00:00:00").cast("timestamp"))[0].select("job_id", "status")


@query("stranded_documents", sql("""SELECT document_id, CASE WHEN document_id IN (SELECT seq FROM v_attempt WHERE outcome = 'running' AND "at" < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE) THEN 'queued' ELSE 'processing' END AS status FROM v_document"""))
def stranded_documents(spark, d):
    jobs = D.job_attempts(spark, d).select(F.col("seq").alias("job_id"), F.col("outcome").alias("status"), F.col("at").alias("claimed_at"), F.col("seq").alias("document_id"))
    docs = D.documents(spark, d).select("document_id", F.lit("processing").alias("status"))
    return J.stranded_jobs(jobs, docs, F.lit("2024-01-20 00:00:00").cast("timestamp"))[1]
