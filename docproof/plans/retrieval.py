"""Queries of hybrid retrieval. Questions are the benchmark items, asked of one portfolio each or, every
second one, of all; passages are the chunks of ready documents, kept in a passage store that the first query of a
session over the tables fills.

Embeddings of the registered queries hash their features with MD5, which SQL has too."""

from __future__ import annotations

from pyspark.sql import functions as F

from docproof.functions import text as T
from docproof.operators import prepare as P, retrieval as R
from docproof.plans import domain as D
from docproof.plans.domain import sql
from docproof.plans.prepare import SENTENCES, STOP
from docproof.plans.registry import query
from docproof.session import every_pair, shared_path, table, written
from docproof.sources.passages import PassageStore

QTEXT = "SELECT item_id AS question_id, concat_ws(' ', 'en src' || (item_id % 20), text) AS text FROM benchmark"
V_WORD = "SELECT question_id, i - 1 AS place, words[i] AS word FROM (SELECT question_id, regexp_extract_all(text, '[A-Za-z0-9£][A-Za-z0-9£'',.\\-]*') AS words FROM v_ask), unnest(generate_series(1, len(words))) t(i)"
V_WLEX = f"SELECT question_id, place, word, lexeme FROM (SELECT question_id, place, word, unnest(regexp_extract_all(lower(word), '[a-z0-9]+')) AS lexeme FROM v_word) WHERE NOT list_contains({STOP}, lexeme)"
V_QLEX = "SELECT question_id, lexeme, first FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM (SELECT question_id, lexeme, min(place) AS first FROM v_wlex GROUP BY 1, 2)) WHERE n >= 2"
LEX = lambda c: f"unnest(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
V_IDENT = f"""SELECT document_id, portfolio_id, lexeme, bool_or(named) AS named FROM (
  SELECT document_id, portfolio_id, {LEX("title || ' ' || lang")} AS lexeme, true AS named FROM v_docs
  UNION ALL SELECT document_id, portfolio_id, {LEX("left(p.text, 600)")}, false FROM v_docs JOIN v_page p USING (document_id) WHERE page_number = 1) WHERE NOT list_contains({STOP}, lexeme) GROUP BY 1, 2, 3"""
V_ASKED = "SELECT question_id, portfolio_id FROM v_ask, v_portfolio WHERE question_id % 2 = 0 OR portfolio_id = 'src' || (question_id % 20)"
V_SIZE = "SELECT question_id, count(*) AS docs FROM v_asked JOIN v_docs USING (portfolio_id) GROUP BY 1"
V_TERM = "SELECT question_id, lexeme FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM (SELECT q.question_id, q.lexeme, count(*) AS df FROM v_qlex q JOIN v_asked a USING (question_id) JOIN v_ident i ON i.portfolio_id = a.portfolio_id AND i.lexeme = q.lexeme GROUP BY 1, 2) JOIN v_size USING (question_id) WHERE df <= greatest(1, floor(docs * 0.34))) WHERE n >= 2"
V_SCORE = "SELECT t.question_id, i.document_id, sum(CASE WHEN named THEN 2 ELSE 1 END)::BIGINT AS score FROM v_term t JOIN v_ident i USING (lexeme) JOIN v_asked a ON a.question_id = t.question_id AND a.portfolio_id = i.portfolio_id GROUP BY 1, 2"
V_FOCUS = "SELECT question_id, document_id, score FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM v_score) WHERE score = best AND best >= 2) JOIN v_size USING (question_id) WHERE n <= 4 AND n < docs"
V_MATCHED = "SELECT DISTINCT f.question_id, i.lexeme FROM v_focus f JOIN v_ident i USING (document_id) JOIN v_term t ON t.question_id = f.question_id AND t.lexeme = i.lexeme WHERE i.named"
V_GONE = "SELECT l.question_id, l.place, bool_and(m.lexeme IS NOT NULL) AS gone FROM v_wlex l LEFT JOIN v_matched m ON m.question_id = l.question_id AND m.lexeme = l.lexeme GROUP BY 1, 2"
V_REST = "SELECT w.question_id, string_agg(w.word, ' ' ORDER BY w.place) AS rest FROM v_word w LEFT JOIN v_gone g ON g.question_id = w.question_id AND g.place = w.place WHERE NOT coalesce(gone, false) AND w.question_id IN (SELECT question_id FROM v_focus) GROUP BY 1"
V_QUERY = "SELECT a.question_id, coalesce(nullif(r.rest, ''), a.text) AS query FROM v_ask a LEFT JOIN v_rest r USING (question_id)"
V_LEXICAL = f"""SELECT * FROM (SELECT question_id, chunk_id, n * 0.1::DOUBLE AS score, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, chunk_id)::INT AS lexical_rank
  FROM (SELECT q.question_id, l.chunk_id, count(*) AS n FROM (SELECT DISTINCT question_id, {LEX('query')} AS lexeme FROM v_query) q JOIN v_lexeme l USING (lexeme) GROUP BY 1, 2)) WHERE lexical_rank <= 30"""
V_NEAR = """SELECT * FROM (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), c.vec_id)::INT AS vector_rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE vector_rank <= 30"""
V_LEG2 = "SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY (chunk_id * 7919) % 1009, chunk_id)::INT AS lexical_rank FROM v_near WHERE vector_rank % 2 = 0 UNION ALL SELECT question_id, 900000 + question_id * 10 + i, 15 + i FROM (SELECT DISTINCT question_id FROM v_near), range(1, 6) t(i)"
V_FUSED = """SELECT * FROM (SELECT question_id, chunk_id, vector_rank, lexical_rank, fused_score, (row_number() OVER (PARTITION BY question_id ORDER BY fused_score DESC, vector_rank ASC NULLS LAST, chunk_id) - 1)::INT AS source_index
  FROM (SELECT coalesce(v.question_id, l.question_id) AS question_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id, vector_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS fused_score
        FROM v_near v FULL JOIN v_leg2 l ON l.question_id = v.question_id AND l.chunk_id = v.chunk_id)) WHERE source_index < 8"""
# Hybrid: what each question may see, and both legs over it. A feature's weight is spread by its MD5 digest.
V_PASSAGE = f"SELECT c.document_id * {D.WIDE} + row_number() OVER (PARTITION BY document_id ORDER BY page_number, ordinal_in_page) AS chunk_id, document_id, d.portfolio_id, c.page_number, c.text FROM v_packed c JOIN v_docs d USING (document_id)"
V_LEXEME = f"SELECT * FROM (SELECT chunk_id, document_id, portfolio_id, {LEX('text')} AS lexeme FROM v_passage) WHERE NOT list_contains({STOP}, lexeme)"
V_ALLOWED = "SELECT a.question_id, d.document_id FROM v_asked a JOIN v_docs d USING (portfolio_id) WHERE a.question_id NOT IN (SELECT question_id FROM v_focus) UNION ALL SELECT f.question_id, f.document_id FROM v_focus f JOIN v_docs d USING (document_id) JOIN v_asked a ON a.question_id = f.question_id AND a.portfolio_id = d.portfolio_id"
TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t))"
V_TOKEN = f"SELECT 'c' AS side, chunk_id AS id, {TOKENS.format('text')} AS tokens FROM v_passage UNION ALL SELECT 'q', question_id, {TOKENS.format('query')} FROM v_query"
V_FEATURE = """SELECT side, id, h % 384 AS place, sum(CASE WHEN h >= 9223372036854775808 THEN w ELSE -w END) AS v FROM (SELECT side, id, w, ('0x' || substr(md5(f), 1, 16))::UBIGINT AS h FROM (
  SELECT side, id, unnest(tokens) AS f, 1.0::DOUBLE AS w FROM v_token UNION ALL SELECT side, id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])), 0.5::DOUBLE FROM v_token)) GROUP BY ALL"""
V_NORM = "SELECT side, id, coalesce(sqrt(sum(v * v)), 0) AS norm FROM v_token LEFT JOIN v_feature USING (side, id) GROUP BY ALL"
V_VECTOR = "SELECT side, id, place, (v / norm)::FLOAT::DOUBLE AS v FROM v_feature JOIN v_norm USING (side, id) WHERE norm > 0 AND v <> 0 UNION ALL SELECT side, id, 0, 1.0 FROM v_norm WHERE norm = 0"
V_UNIT = "SELECT side, id, place, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM v_vector"
V_DOT = "SELECT q.id AS question_id, c.id AS chunk_id, sum(q.v * c.v) AS dot FROM v_unit q JOIN v_unit c ON q.place = c.place WHERE q.side = 'q' AND c.side = 'c' GROUP BY 1, 2"
V_VLEG = """SELECT question_id, chunk_id, vector_rank FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id)::INT AS vector_rank FROM (
  SELECT a.question_id, p.chunk_id, round(1 - coalesce(d.dot, 0), 9) AS distance FROM v_allowed a JOIN v_passage p USING (document_id) LEFT JOIN v_dot d ON d.question_id = a.question_id AND d.chunk_id = p.chunk_id)) WHERE vector_rank <= 30"""
V_LLEG = f"""SELECT question_id, chunk_id, lexical_rank FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, chunk_id)::INT AS lexical_rank FROM (
  SELECT w.question_id, l.chunk_id, count(*) AS n FROM (SELECT DISTINCT question_id, {LEX('query')} AS lexeme FROM v_query) w JOIN v_lexeme l USING (lexeme) JOIN v_allowed a ON a.question_id = w.question_id AND a.document_id = l.document_id GROUP BY 1, 2)) WHERE lexical_rank <= 30"""
V_HYBRID = V_FUSED.replace("v_near", "v_vleg").replace("v_leg2", "v_lleg")
VIEWS = {**SENTENCES, "v_ask": QTEXT, "v_word": V_WORD, "v_wlex": V_WLEX, "v_qlex": V_QLEX, "v_docs": "SELECT * FROM v_document WHERE status = 'ready'", "v_ident": V_IDENT, "v_asked": V_ASKED, "v_size": V_SIZE, "v_term": V_TERM, "v_score": V_SCORE, "v_focus": V_FOCUS, "v_matched": V_MATCHED, "v_gone": V_GONE, "v_rest": V_REST, "v_query": V_QUERY, "v_lexeme": V_LEXEME, "v_lexical": V_LEXICAL, "v_near": V_NEAR, "v_leg2": V_LEG2, "v_fused": V_FUSED, "v_passage": V_PASSAGE, "v_allowed": V_ALLOWED, "v_token": V_TOKEN, "v_feature": V_FEATURE, "v_norm": V_NORM, "v_vector": V_VECTOR, "v_unit": V_UNIT, "v_dot": V_DOT, "v_vleg": V_VLEG, "v_lleg": V_LLEG, "v_hybrid": V_HYBRID}


def q(body: str) -> str:
    return sql(body, **VIEWS)


def asks(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.concat_ws(" ", F.concat(F.lit("en src"), (F.col("item_id") % 20).cast("string")), "text").alias("text"))


def docs(spark, d):
    return D.documents(spark, d).filter("status = 'ready'").withColumn("metadata", F.col("lang"))


def asked(spark, d):
    """What each question is asked of: every second one of all portfolios."""
    questions, portfolios = asks(spark, d).select("question_id"), D.portfolios(spark, d).select("portfolio_id")
    one = questions.filter("question_id % 2 = 1").withColumn("portfolio_id", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")))
    return every_pair(questions.filter("question_id % 2 = 0"), portfolios).unionByName(one.join(portfolios, "portfolio_id", "left_semi"))


def parts(spark, d):
    words = R.question_words(asks(spark, d))
    ident, sees, known = written(R.document_identities(docs(spark, d), D.pages(spark, d))), written(asked(spark, d)), written(docs(spark, d).select("document_id", "portfolio_id"))
    terms = written(R.identifying_terms(R.query_lexemes(words), ident, known, sees))
    return words, ident, terms, R.focus_documents(terms, ident, known, sees)


@query("question_words", q("SELECT question_id, place::INT AS place, word FROM v_word"))
def question_words(spark, d):
    return R.question_words(asks(spark, d))


@query("query_lexemes", q("SELECT question_id, lexeme, first::INT AS first FROM v_qlex"))
def query_lexemes(spark, d):
    return R.query_lexemes(R.question_words(asks(spark, d)))


@query("document_identities", q("SELECT * FROM v_ident"))
def document_identities(spark, d):
    return R.document_identities(docs(spark, d), D.pages(spark, d))


@query("identifying_terms", q("SELECT question_id, lexeme FROM v_term"))
def identifying_terms(spark, d):
    words, ident = R.question_words(asks(spark, d)), R.document_identities(docs(spark, d), D.pages(spark, d))
    return R.identifying_terms(R.query_lexemes(words), ident, docs(spark, d), asked(spark, d)).select("question_id", "lexeme")


@query("focus_documents", q("SELECT question_id, document_id, score FROM v_focus"))
def focus_documents(spark, d):
    return parts(spark, d)[3]


def queries_of(spark, d):
    words, ident, terms, focus = parts(spark, d)
    return R.passage_query(asks(spark, d), words, terms, focus, ident)


@query("passage_query", q("SELECT question_id, query FROM v_query"))
def passage_query(spark, d):
    return queries_of(spark, d)


def vectors(spark, d):
    """Every fiftieth vector asks all of them."""
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")


@query("vector_top_n", q("SELECT question_id, chunk_id, distance, vector_rank FROM v_near"))
def vector_top_n(spark, d):
    return R.vector_top_n(*vectors(spark, d))


@query("vector_top_n_focused", q("SELECT * FROM (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), c.vec_id)::INT AS vector_rank FROM embeddings q JOIN embeddings c ON c.label = q.label WHERE q.vec_id % 50 = 0) WHERE vector_rank <= 30"))
def vector_top_n_focused(spark, d):
    """The focus of a question is the label of its vector."""
    questions, chunks = vectors(spark, d)
    focus = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").alias("document_id"))
    return R.vector_top_n_focused(questions, focus, chunks)


_STORES: dict[tuple[str, str], PassageStore] = {}


def passages(spark, d):
    """The chunks of ready documents."""
    cut = P.chunk_ordinals(P.chunk_pages(D.pages(spark, d)))
    rows = cut.withColumn("chunk_id", F.col("document_id") * D.WIDE + F.col("ordinal") + 1).join(docs(spark, d).select("document_id", "portfolio_id"), "document_id")
    return rows.select("chunk_id", "document_id", "portfolio_id", "page_number", "ordinal", "text")


def filled(spark, d):
    """A new passage store of all ready documents."""
    store = PassageStore(spark, shared_path(spark, "passages"), digest="md5")
    store.replace(docs(spark, d), passages(spark, d), R.document_identities(docs(spark, d), D.pages(spark, d)))
    return store


def store(spark, d):
    """The session's store of the tables in ``d``, filled by the first who asks."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        _STORES[key] = filled(spark, d)
    return _STORES[key]


def batch(spark, d):
    """What each question may see, which documents it names and what is looked up for it; each is written once."""
    words, sees = R.question_words(asks(spark, d)), written(asked(spark, d))
    ident, known = store(spark, d).identities(), written(docs(spark, d).select("document_id", "portfolio_id"))
    lexemes = written(R.query_lexemes(words))
    terms = written(R.identifying_terms(lexemes, ident, known, sees))
    focus = written(R.focus_documents(terms, ident, known, sees).select("question_id", "document_id"))
    return sees, focus, written(R.passage_query(asks(spark, d), words, terms, focus, ident))


@query("passage_store", q("SELECT p.chunk_id, p.document_id, p.portfolio_id, p.page_number::INT AS page_number, md5(p.text) AS digest, count(l.lexeme)::BIGINT AS tokens FROM v_passage p LEFT JOIN v_lexeme l USING (chunk_id) GROUP BY ALL"))
def passage_store(spark, d):
    """A store filled from the tables, and its passages that have vectors."""
    _STORES[spark.sparkContext.applicationId, d] = held = filled(spark, d)
    rows = held.passages().join(held.vectors().select("chunk_id"), "chunk_id")
    return rows.select("chunk_id", "document_id", "portfolio_id", "page_number", F.md5("text").alias("digest"), F.size("tokens").cast("long").alias("tokens"))


@query("passage_vectors", q("SELECT id AS chunk_id, count(*)::INT AS places, sum(place)::BIGINT AS place_sum, (count(*) FILTER (v > 0))::INT AS positive FROM v_vector WHERE side = 'c' GROUP BY 1"))
def passage_vectors(spark, d):
    """Which axes the store's vectors use."""
    axes = F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    total = F.aggregate("axes", F.lit(0).cast("long"), lambda a, i: a + i)
    rows = store(spark, d).vectors().select("chunk_id", axes.alias("axes"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))
    return rows.select("chunk_id", F.size("axes").alias("places"), total.alias("place_sum"), "positive")


@query("postings_index", q("SELECT lexeme, portfolio_id, count(*)::BIGINT AS passages, sum(tf)::BIGINT AS places, max(tf)::INT AS most FROM (SELECT lexeme, portfolio_id, chunk_id, count(*) AS tf FROM v_lexeme GROUP BY ALL) GROUP BY ALL"))
def postings_index(spark, d):
    """The store's inverted index, its blocks added up again."""
    rows = store(spark, d).tables.segments_of("postings")
    places = F.aggregate("postings", F.lit(0).cast("long"), lambda a, x: a + x["tf"])
    return rows.groupBy("lexeme", "portfolio_id").agg(F.sum(F.size("postings")).alias("passages"), F.sum(places).alias("places"), F.max("max_tf").alias("most"))


@query("lexical_top_n", q("SELECT question_id, chunk_id, round(score, 9) AS score, lexical_rank FROM v_lexical"))
def lexical_top_n(spark, d):
    return R.lexical_top_n_indexed(batch(spark, d)[2], store(spark, d).tables.segments_of("postings")).withColumn("score", F.round("score", 9))


@query("rrf_fuse", q("SELECT question_id, chunk_id, source_index, round(fused_score, 9) AS fused_score, vector_rank, lexical_rank FROM v_fused"))
def rrf_fuse(spark, d):
    """The vector leg of the embeddings, fused with half of it in another order and some passages of its own."""
    from pyspark.sql.window import Window as W

    near = R.vector_top_n(*vectors(spark, d))
    order = W.partitionBy("question_id").orderBy((F.col("chunk_id") * 7919) % 1009, "chunk_id")
    half = near.filter("vector_rank % 2 = 0").select("question_id", "chunk_id", F.row_number().over(order).alias("lexical_rank"))
    own = near.select("question_id").distinct().select("question_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).select("question_id", (F.lit(900000) + F.col("question_id") * 10 + F.col("i")).alias("chunk_id"), (F.col("i") + 15).alias("lexical_rank"))
    return R.rrf_fuse(near, half.unionByName(own)).withColumn("fused_score", F.round("fused_score", 9))


def hybrid(spark, d):
    """A batch of all questions, asked of the store."""
    sees, focus, queries = batch(spark, d)
    return store(spark, d).ask(queries, sees, focus)


@query("hybrid_search", q("SELECT question_id, chunk_id, source_index, round(fused_score, 9) AS fused_score, 8 AS k FROM v_hybrid"))
def hybrid_search(spark, d):
    return hybrid(spark, d).select("question_id", "chunk_id", "source_index", F.round("fused_score", 9).alias("fused_score"), F.col("settings.k").alias("k"))


@query("hydrate_sources", q("SELECT h.question_id, h.source_index, c.chunk_id, c.document_id, d.title, c.page_number::INT AS page_number, left(trim(c.text), 240) AS snippet FROM v_hybrid h JOIN v_passage c USING (chunk_id) JOIN v_document d ON d.document_id = c.document_id"))
def hydrate_sources(spark, d):
    return R.hydrate_sources(hybrid(spark, d).select("question_id", "chunk_id", "source_index"), store(spark, d).passages(), D.documents(spark, d)).drop("blocks")
