"""Queries of answering and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docproof.functions import text as T
from docproof.operators import access as AC, answering as A, evaluation as E
from docproof.operators.holding import holding
from docproof.plans import domain as D
from docproof.plans.access_spend import ACCESS, citations
from docproof.plans.domain import sql
from docproof.plans.prepare import STOP
from docproof.plans.registry import query
from docproof.session import table, written

# A source of a question: the assistant turns of its conversation, their lines as blocks.
V_SHOWN = "SELECT q.question_id, (row_number() OVER (PARTITION BY q.question_id ORDER BY c.turn) - 1)::INT AS source_index, c.conv_id * 1000 + c.turn AS chunk_id, 'Title ' || c.conv_id AS title, string_split(c.text, '. ') AS blocks FROM v_question q JOIN conversations c ON c.conv_id = q.question_id // 1000 AND c.role = 'assistant'"
V_CITE = "SELECT question_id, i AS seq, ((question_id + i) % 4 - 1)::INT AS source_index, (i % 3)::INT AS block_start, (i % 3 + (question_id + i) % 3)::INT AS block_end, (i % 2)::INT AS answer_block FROM v_question, range(0, 6) t(i)"
V_VERIFIED = "SELECT c.*, s.chunk_id, coalesce(s.blocks IS NOT NULL AND block_start >= 0 AND block_start < block_end AND block_end <= len(s.blocks), false) AS valid FROM v_cite c LEFT JOIN v_shown s ON s.question_id = c.question_id AND s.source_index = c.source_index"
V_ORDINAL = "SELECT v.*, ordinal FROM v_verified v JOIN (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY min(seq))::INT AS ordinal FROM v_verified WHERE valid GROUP BY 1, 2) o USING (question_id, chunk_id) WHERE valid"
V_FINISH = "SELECT question_id, CASE question_id % 7 WHEN 0 THEN 'refusal' WHEN 1 THEN 'error' WHEN 2 THEN 'max_tokens' ELSE 'stop' END AS stop_reason FROM v_question WHERE question_id % 11 <> 0"
TOK = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t))"
MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in A.SYNONYMS.items()) + "}"
GEN = "[" + ", ".join(f"'{g}'" for g in A.GENERIC) + "]"
ORDERED = lambda x: f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"
V_TOKS = f"""SELECT question_id, text, titles, list_transform({TOK('text')}, lambda t: coalesce({MAP}[t], t)) AS toks0,
  list_concat(flatten(list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+')[2:], lambda w: w <> '' AND w[1] = upper(w[1]) AND lower(w[1]) <> w[1] AND w <> upper(w)), lambda w: {TOK('w')})), flatten(list_transform(titles, lambda s: {TOK('s')}))) AS names
  FROM v_question JOIN (SELECT question_id, list(DISTINCT title) AS titles FROM v_shown GROUP BY 1) USING (question_id)"""
V_TERMS = f"""SELECT question_id, CASE WHEN len(list_filter(remaining, lambda t: NOT list_contains({GEN}, t))) > 0 THEN list_filter(remaining, lambda t: NOT list_contains({GEN}, t)) WHEN len(remaining) > 0 THEN remaining ELSE toks END AS terms
  FROM (SELECT question_id, toks, list_filter(toks, lambda t: NOT list_contains(names, t)) AS remaining FROM (SELECT question_id, names, {ORDERED('toks0')} AS toks FROM v_toks))"""
V_BLOCK = "SELECT question_id, source_index, i - 1 AS block, blocks[i] AS text FROM v_shown, unnest(generate_series(1, len(blocks))) t(i)"
V_BSCORE = f"""SELECT b.question_id, source_index, block, text, len(terms) AS n, len(list_filter(terms, lambda t: list_contains(toks, t) OR length(t) >= 5 AND list_contains(list_transform(list_filter(toks, lambda x: length(x) >= 5), lambda x: left(x, 5)), left(t, 5)))) AS score
  FROM (SELECT *, {TOK('text')} AS toks FROM v_block) b JOIN v_terms USING (question_id)"""
V_BEST = """SELECT question_id, source_index, block, text, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_index) - 1 AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source_index ORDER BY score DESC, block) AS rn FROM v_bscore) WHERE rn = 1 AND score >= CASE WHEN n < 3 THEN 1 ELSE greatest(2, ceil(n * 0.5)) END"""
V_ANSWER = f"""SELECT q.question_id, CASE WHEN a.answer IS NOT NULL THEN 'answered' ELSE 'unanswered' END AS status, coalesce(a.answer, CASE WHEN EXISTS (SELECT 1 FROM v_shown s WHERE s.question_id = q.question_id) THEN '{A.REFUSAL.replace("'", "''")}' ELSE '{A.NO_SOURCES}' END) AS answer, coalesce(a.cited, []) AS cited
  FROM v_question q LEFT JOIN (SELECT question_id, string_agg(text, chr(10) ORDER BY place) AS answer, list(source_index ORDER BY place) AS cited FROM v_best WHERE place < 3 GROUP BY 1) a USING (question_id)"""
# Golden questions: benchmark items in the documents that hold them.
V_GOLD = """SELECT item_id AS eval_id, left(text, 2000) AS question, doc_id IS NOT NULL AS answerable, doc_id AS expected_document_id, CASE WHEN item_id % 4 = 0 THEN [] ELSE [1, 3] END AS expected_pages,
  TIMESTAMP '2024-03-01' + to_minutes(item_id * 37 % 101) AS created_at, item_id % 5 <> 0 AS active FROM benchmark LEFT JOIN (SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1) USING (item_id)"""
V_RANKED = "SELECT eval_id, i AS rank, CASE WHEN (eval_id + i) % 3 = 0 THEN expected_document_id ELSE i END AS document_id, (i + eval_id) % 4 + 1 AS page_number FROM v_gold, range(1, 9) t(i) WHERE eval_id % 9 <> 0"
V_HITS = """SELECT g.eval_id, answerable, CASE WHEN m THEN d IS NOT NULL END AS doc_hit, CASE WHEN m AND len(expected_pages) > 0 THEN p IS NOT NULL END AS page_hit, CASE WHEN m THEN coalesce(p, d) END AS hit_rank
  FROM (SELECT g.*, answerable AND expected_document_id IS NOT NULL AS m FROM v_gold g) g JOIN (SELECT g.eval_id, min(rank) FILTER (document_id = expected_document_id) AS d, min(rank) FILTER (document_id = expected_document_id AND list_contains(expected_pages, page_number)) AS p FROM v_gold g LEFT JOIN v_ranked r USING (eval_id) GROUP BY 1) USING (eval_id)"""
V_CHIT = """SELECT eval_id, CASE WHEN m THEN d END AS cited_doc_hit, CASE WHEN m AND len(expected_pages) > 0 THEN p END AS cited_page_hit FROM (SELECT g.*, answerable AND expected_document_id IS NOT NULL AS m FROM v_gold g)
  JOIN (SELECT g.eval_id, coalesce(bool_or(document_id = expected_document_id), false) AS d, coalesce(bool_or(document_id = expected_document_id AND list_contains(expected_pages, page_number)), false) AS p FROM v_gold g LEFT JOIN (SELECT * FROM v_ranked WHERE rank <= 2) USING (eval_id) GROUP BY 1) USING (eval_id)"""
V_RESULT = """SELECT user_id AS run_user, event_id AS eval_id, event_id % 5 <> 0 AS answerable, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 = 0 END AS doc_hit, CASE WHEN event_id % 5 <> 0 AND event_id % 4 <> 0 THEN event_id % 6 = 0 END AS page_hit, CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN 1 + event_id % 8 END AS hit_rank,
  event_id % 2 = 0 AS answered, CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 1 END AS refused_correctly, (event_id % 1000) AS latency_ms, ((event_id % 100) / 1000.0)::DECIMAL(10,6) AS cost_usd FROM events"""
VIEWS = {**ACCESS, "v_shown": V_SHOWN, "v_cite": V_CITE, "v_verified": V_VERIFIED, "v_ordinal": V_ORDINAL, "v_finish": V_FINISH, "v_toks": V_TOKS, "v_terms": V_TERMS, "v_block": V_BLOCK, "v_bscore": V_BSCORE, "v_best": V_BEST, "v_answer": V_ANSWER, "v_gold": V_GOLD, "v_ranked": V_RANKED, "v_hits": V_HITS, "v_chit": V_CHIT, "v_result": V_RESULT}


def q(body: str, **more: str) -> str:
    return sql(body, **VIEWS, **more)


def shown(spark, d):
    from pyspark.sql.window import Window as W

    c = table(spark, d, "conversations").filter("role = 'assistant'")
    rows = D.questions(spark, d).join(c.select("conv_id", "turn", F.col("text").alias("said")), F.floor(F.col("question_id") / 1000) == F.col("conv_id"))
    order = W.partitionBy("question_id").orderBy("turn")
    return rows.select("question_id", (F.row_number().over(order) - 1).alias("source_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.concat(F.lit("Title "), F.col("conv_id").cast("string")).alias("title"), F.split("said", r"\. ", -1).alias("blocks"))


def cites(spark, d):
    rows = D.questions(spark, d).select("question_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i"))
    return rows.select("question_id", F.col("i").alias("seq"), ((F.col("question_id") + F.col("i")) % 4 - 1).cast("int").alias("source_index"), (F.col("i") % 3).cast("int").alias("block_start"), (F.col("i") % 3 + (F.col("question_id") + F.col("i")) % 3).cast("int").alias("block_end"), (F.col("i") % 2).cast("int").alias("answer_block"))


def verified(spark, d):
    return A.verify_citations(cites(spark, d), shown(spark, d))


@query("validate_questions", q("SELECT question_id, CASE WHEN length(trim(t)) < 3 THEN 'too_short' WHEN length(trim(t)) > 2000 THEN 'too_long' END AS reason FROM (SELECT question_id, CASE question_id % 5 WHEN 0 THEN ' a ' WHEN 1 THEN repeat(text, 30) ELSE text END AS t FROM v_question)"))
def validate_questions(spark, d):
    text = F.when(F.col("question_id") % 5 == 0, " a ").when(F.col("question_id") % 5 == 1, F.repeat("text", 30)).otherwise(F.col("text"))
    return A.validate_questions(D.questions(spark, d).withColumn("text", text)).select("question_id", "reason")


@query("question_terms", q("SELECT question_id, terms FROM v_terms"))
def question_terms(spark, d):
    titles = shown(spark, d).groupBy("question_id").agg(F.collect_set("title").alias("titles"))
    return D.questions(spark, d).join(titles, "question_id").select("question_id", A.question_terms(F.col("text"), F.col("titles")).alias("terms"))


@query("match_score", q("SELECT question_id, source_index, block::INT AS block, score::INT AS score FROM v_bscore"))
def match_score(spark, d):
    blocks = shown(spark, d).select("question_id", "source_index", F.posexplode("blocks").alias("block", "text"))
    return blocks.join(question_terms(spark, d), "question_id").select("question_id", "source_index", "block", A.match_score(F.col("terms"), F.col("text")).alias("score"))


@query("extractive_answers", q("SELECT * FROM v_answer"))
def extractive_answers(spark, d):
    return A.extractive_answers(D.questions(spark, d), shown(spark, d))


@query("estimate_usage", q("SELECT a.question_id, coalesce((SELECT sum(length(text)) // 4 FROM v_block b WHERE b.question_id = a.question_id), 0)::BIGINT AS input_tokens, (length(answer) // 4)::BIGINT AS output_tokens FROM v_answer a"))
def estimate_usage(spark, d):
    return A.estimate_usage(shown(spark, d), extractive_answers(spark, d))


@query("verify_citations", q("SELECT question_id, seq, valid FROM v_verified"))
def verify_citations(spark, d):
    return verified(spark, d).select("question_id", "seq", "valid")


@query("citation_ordinals", q("SELECT question_id, seq, ordinal FROM v_ordinal"))
def citation_ordinals(spark, d):
    return A.citation_ordinals(verified(spark, d)).select("question_id", "seq", "ordinal")


@query("block_labels", q("SELECT question_id, answer_block, list(ordinal ORDER BY first) AS labels FROM (SELECT question_id, answer_block, ordinal, min(seq) AS first FROM v_ordinal GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def block_labels(spark, d):
    return A.block_labels(A.citation_ordinals(verified(spark, d)))


@query("dropped_counts", q("SELECT question_id, count(*) FILTER (NOT valid) AS dropped FROM v_verified GROUP BY 1"))
def dropped_counts(spark, d):
    return A.dropped_counts(verified(spark, d))


@query("answer_outcome", q("SELECT question_id, CASE WHEN stop_reason IS NULL OR stop_reason IN ('refusal', 'error') THEN 'failed' WHEN EXISTS (SELECT 1 FROM v_verified v WHERE v.question_id = q.question_id AND valid) THEN 'answered' ELSE 'unanswered' END AS status FROM v_question q LEFT JOIN v_finish USING (question_id)"))
def answer_outcome(spark, d):
    stop = F.when(F.col("question_id") % 7 == 0, "refusal").when(F.col("question_id") % 7 == 1, "error").when(F.col("question_id") % 7 == 2, "max_tokens").otherwise("stop")
    finished = D.questions(spark, d).filter("question_id % 11 <> 0").select("question_id", stop.alias("stop_reason"))
    return A.answer_outcome(finished, verified(spark, d), D.questions(spark, d))


@query("answer_text", q("SELECT question_id, nullif(array_to_string(list_filter(list(t ORDER BY first), lambda x: x <> ''), chr(10)), '') AS answer FROM (SELECT question_id, trim(string_agg(text, '' ORDER BY seq)) AS t, min(seq) AS first FROM (SELECT question_id, source_index * 100 + block AS seq, block % 3 AS block, text || ' ' AS text FROM v_block) GROUP BY question_id, block) GROUP BY 1"))
def answer_text(spark, d):
    pieces = shown(spark, d).select("question_id", "source_index", F.posexplode("blocks").alias("b", "t"))
    return A.answer_text(pieces.select("question_id", (F.col("source_index") * 100 + F.col("b")).alias("seq"), (F.col("b") % 3).alias("block"), F.concat("t", F.lit(" ")).alias("text")))


@query("merge_usage", q("SELECT user_id AS call_id, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(cache_read_tokens) AS cache_read_tokens, max(cache_write_tokens) AS cache_write_tokens FROM v_usage GROUP BY 1"))
def merge_usage(spark, d):
    return A.merge_usage(D.usage_events(spark, d).withColumnRenamed("user_id", "call_id"))


@query("cited_sources", q("SELECT question_id, source_index, (question_id, chunk_id) IN (SELECT question_id, chunk_id FROM v_ordinal) AS cited FROM v_shown"))
def cited_sources(spark, d):
    return A.cited_sources(shown(spark, d), A.citation_ordinals(verified(spark, d))).select("question_id", "source_index", "cited")


@query("latest_feedback", "SELECT doc_id % 100 AS question_id, quality * 2 + toxic AS user_id, arg_max(CASE WHEN doc_id % 3 = 0 THEN 'up' ELSE 'down' END, doc_id) AS verdict FROM labels GROUP BY 1, 2")
def latest_feedback(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 100).alias("question_id"), (F.col("quality") * 2 + F.col("toxic")).alias("user_id"), F.when(F.col("doc_id") % 3 == 0, "up").otherwise("down").alias("verdict"), F.col("doc_id").alias("created_at"))
    return A.latest_feedback(rows)


def golden(spark, d):
    """Which document holds which item: the first of those that :func:`holding` finds, written once."""
    b = table(spark, d, "benchmark")
    held = written(holding(b, table(spark, d, "documents")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id")))
    pages = F.when(F.col("item_id") % 4 == 0, F.expr("cast(array() as array<int>)")).otherwise(F.array(F.lit(1), F.lit(3)))
    at = F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("item_id") * 37 % 101).cast("int"))
    return b.join(held, "item_id", "left").select(F.col("item_id").alias("eval_id"), F.substring("text", 1, 2000).alias("question"), F.col("doc_id").isNotNull().alias("answerable"), F.col("doc_id").alias("expected_document_id"), pages.alias("expected_pages"), at.alias("created_at"), (F.col("item_id") % 5 != 0).alias("active"))


def ranked(golden):
    g = golden.filter("eval_id % 9 <> 0").select("eval_id", "expected_document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("i"))
    return g.select("eval_id", F.col("i").alias("rank"), F.when((F.col("eval_id") + F.col("i")) % 3 == 0, F.col("expected_document_id")).otherwise(F.col("i")).alias("document_id"), ((F.col("i") + F.col("eval_id")) % 4 + 1).cast("int").alias("page_number"))


@query("validate_golden", q("SELECT eval_id, CASE WHEN answerable AND expected_document_id IS NULL THEN 'needs_document' WHEN eval_id % 6 = 1 THEN 'unknown_document' WHEN eval_id % 6 = 2 THEN 'unknown_portfolio' END AS reason FROM v_gold"))
def validate_golden(spark, d):
    g = golden(spark, d).withColumn("expected_document_id", F.when(F.col("eval_id") % 6 == 1, F.lit(-5).cast("long")).otherwise(F.col("expected_document_id"))).withColumn("portfolio_id", F.when(F.col("eval_id") % 6 == 2, F.lit("nowhere")))
    return E.validate_golden(g, D.documents(spark, d), D.portfolios(spark, d)).select("eval_id", "reason")


@query("promote_feedback", q("SELECT q.question_id, q.portfolio_id, f.document_id AS expected_document_id, list_sort(list(DISTINCT k.page_number)) AS expected_pages FROM v_question q JOIN (SELECT question_id, arg_min(document_id, v_citation.ordinal) AS document_id FROM v_citation JOIN v_chunk USING (chunk_id) GROUP BY 1) f USING (question_id) JOIN v_citation c USING (question_id) JOIN v_chunk k ON k.chunk_id = c.chunk_id AND k.document_id = f.document_id GROUP BY 1, 2, 3"))
def promote_feedback(spark, d):
    return E.promote_feedback(citations(spark, d), D.chunks(spark, d), D.questions(spark, d))


@query("locate_expected_pages", q("SELECT eval_id, document_id, list_sort(list(page_number)) AS pages FROM (SELECT item_id AS eval_id, text FROM benchmark) b JOIN v_gold g USING (eval_id) JOIN v_page p ON p.document_id = g.expected_document_id AND contains(p.text, regexp_extract(b.text, '[A-Z][^.]*[.]')) GROUP BY 1, 2"))
def locate_expected_pages(spark, d):
    sentences = golden(spark, d).filter("answerable").select("eval_id", F.col("expected_document_id").alias("document_id"), F.regexp_extract("question", "[A-Z][^.]*[.]", 0).alias("sentence"))
    return E.locate_expected_pages(sentences, D.pages(spark, d))


@query("active_questions", q("SELECT eval_id FROM v_gold WHERE active ORDER BY created_at, eval_id LIMIT 12"))
def active_questions(spark, d):
    return E.active_questions(golden(spark, d), 12).select("eval_id")


@query("resume_run", q("SELECT eval_id FROM v_gold WHERE eval_id % 3 <> 0"))
def resume_run(spark, d):
    g = golden(spark, d)
    return E.resume_run(g, g.filter("eval_id % 3 = 0")).select("eval_id")


@query("rank_hits", q("SELECT eval_id, doc_hit, page_hit, hit_rank FROM v_hits"))
def rank_hits(spark, d):
    g = golden(spark, d)
    return E.rank_hits(g, ranked(g))


@query("citation_hits", q("SELECT eval_id, cited_doc_hit, cited_page_hit FROM v_chit"))
def citation_hits(spark, d):
    g = golden(spark, d)
    return E.citation_hits(g, ranked(g).filter("rank <= 2"))


@query("refused_correctly", q("SELECT eval_id, CASE WHEN NOT answerable THEN eval_id % 3 = 0 END AS refused FROM v_gold"))
def refused_correctly(spark, d):
    status = F.when(F.col("eval_id") % 3 == 0, "unanswered").when(F.col("eval_id") % 3 == 1, "failed").otherwise("answered")
    g = golden(spark, d)
    return E.refused_correctly(g, g.select("eval_id", status.alias("status")))


def results(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    ok = i % 5 != 0
    return e.select(
        F.col("user_id").alias("run_user"), i.alias("eval_id"), ok.alias("answerable"), F.when(ok, i % 3 == 0).alias("doc_hit"), F.when(ok & (i % 4 != 0), i % 6 == 0).alias("page_hit"), F.when(ok & (i % 3 == 0), 1 + i % 8).alias("hit_rank"),
        (i % 2 == 0).alias("answered"), F.when(ok, i % 3 == 0).alias("cited_doc_hit"), F.when(ok & (i % 4 != 0), i % 6 == 0).alias("cited_page_hit"), F.when(~ok, i % 2 == 1).alias("refused_correctly"), (i % 1000).alias("latency_ms"), ((i % 100).cast("decimal(10,0)") / F.lit(1000).cast("decimal(10,0)")).cast("decimal(10,6)").alias("cost_usd"),
    )


RATES = "round(avg(CASE WHEN doc_hit THEN 1.0 WHEN NOT doc_hit THEN 0.0 END), 9) AS {0}, round(avg(CASE WHEN page_hit THEN 1.0 WHEN NOT page_hit THEN 0.0 END), 9) AS {1}"
TOTALS = "count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable, " + RATES.format("doc_hit_rate", "page_hit_rate") + ", round(avg(CASE WHEN doc_hit IS NOT NULL THEN coalesce(1.0::DOUBLE / hit_rank, 0) END), 9) AS mrr"


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("retrieval_totals", q(f"SELECT run_user, {TOTALS} FROM v_result GROUP BY 1"))
def retrieval_totals(spark, d):
    return rounded(E.retrieval_totals(results(spark, d), ["run_user"]))


@query("end_to_end_totals", q("SELECT count(*) AS questions, round(avg(CASE WHEN answerable THEN CASE WHEN answered THEN 1.0 ELSE 0.0 END END), 9) AS answer_rate, " + RATES.format("citation_doc_rate", "citation_page_rate") + ", round(avg(CASE WHEN refused_correctly THEN 1.0 WHEN NOT refused_correctly THEN 0.0 END), 9) AS correct_refusal_rate, round(avg(CASE WHEN answered AND (NOT answerable OR doc_hit IS NOT DISTINCT FROM false) THEN 1.0 ELSE 0.0 END), 9) AS false_answer_rate, sum(cost_usd)::DECIMAL(20,6) AS cost_usd, trunc(quantile_cont(latency_ms, 0.5))::INT AS latency_p50_ms FROM v_result"))
def end_to_end_totals(spark, d):
    return rounded(E.end_to_end_totals(results(spark, d)))


@query("run_results", q("SELECT h.eval_id, doc_hit, d.title AS expected_title FROM v_hits h JOIN v_gold g USING (eval_id) LEFT JOIN v_document d ON d.document_id = g.expected_document_id"))
def run_results(spark, d):
    g = golden(spark, d)
    return E.run_results(E.rank_hits(g, ranked(g)), g, D.documents(spark, d)).select("eval_id", "doc_hit", "expected_title")


@query("compare_runs", q(f"SELECT run_user AS run_id, round(doc_hit_rate - lag(doc_hit_rate) OVER w, 9) AS doc_hit_rate_change, round(mrr - lag(mrr) OVER w, 9) AS mrr_change FROM (SELECT run_user, {TOTALS} FROM v_result GROUP BY 1) WINDOW w AS (PARTITION BY run_user % 2 ORDER BY run_user)"))
def compare_runs(spark, d):
    runs = retrieval_totals(spark, d).withColumnRenamed("run_user", "run_id").withColumns({"mode": F.col("run_id") % 2, "started_at": F.col("run_id")})
    return rounded(E.compare_runs(runs, ["doc_hit_rate", "mrr"]).select("run_id", "doc_hit_rate_change", "mrr_change"))


SUMMARY = """SELECT 'documents' AS what, status AS value, count(*) AS n FROM v_document GROUP BY 2 UNION ALL SELECT 'pages', 'all', count(*) FROM v_page UNION ALL SELECT 'chunks', 'all', count(*) FROM v_chunk
 UNION ALL SELECT 'golden', answerable::VARCHAR, count(*) FROM v_gold GROUP BY 2 UNION ALL SELECT 'values', review_status, count(*) FROM v_raw GROUP BY 2 UNION ALL SELECT 'questions', status, count(*) FROM v_answer GROUP BY 2
 UNION ALL SELECT 'feedback', CASE WHEN doc_id % 3 = 0 THEN 'up' ELSE 'down' END, count(*) FROM labels GROUP BY 2 UNION ALL SELECT 'latest_run', max(run_user)::VARCHAR, count(*) FROM v_result WHERE run_user = (SELECT max(run_user) FROM v_result)"""


@query("corpus_summary", q(SUMMARY))
def corpus_summary(spark, d):
    runs = results(spark, d).groupBy(F.col("run_user").alias("run_id")).agg(F.count("*").alias("questions")).withColumn("started_at", F.col("run_id"))
    feedback = table(spark, d, "labels").select(F.when(F.col("doc_id") % 3 == 0, "up").otherwise("down").alias("verdict"))
    return AC.corpus_summary(D.documents(spark, d), D.pages(spark, d), D.chunks(spark, d), golden(spark, d), D.raw_values(spark, d), extractive_answers(spark, d), feedback, runs)
