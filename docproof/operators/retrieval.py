"""Hybrid retrieval for a whole batch of questions: focus, vector and lexical legs, fusion, hydration.

Lexical rank is a tenth of the number of places in a passage that hold a lexeme of the question:
what cover density gives for a disjunction. Words are their alphanumeric parts, in the 'simple'
configuration (no stemming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.functions import text as T
from docproof.operators import nearest, postings
from docproof.session import broadcast_if_small, written

WORD = "[A-Za-z0-9£][A-Za-z0-9£',.\\-]*"
#: Rarest share of documents, least terms of a name, most documents of a focus, head of page one.
COMMON_SHARE, LEAST_TERMS, MOST_FOCUS, HEAD = 0.34, 2, 4, 600
#: Least score of a focus; documents of a rare term; parts that a frequent one is followed in; rows of a plain join.
LEAST_SCORE, RARE, SALTS, DIRECT = 2, 64, 32, 4_000_000


def question_words(questions: DataFrame) -> DataFrame:
    """question_id, place (from 0), word."""
    return questions.select("question_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("place", "word"))


def word_lexemes(words: DataFrame) -> DataFrame:
    """question_id, place, word, lexeme: one row for each lexeme of a word; words without one are left out."""
    return words.select("question_id", "place", "word", F.explode(F.transform(T.lexemes(F.col("word")), lambda p: p["lexeme"])).alias("lexeme"))


def query_lexemes(words: DataFrame) -> DataFrame:
    """question_id, lexeme, first (the place of the first word with it), in questions with at least two."""
    rows = word_lexemes(words).groupBy("question_id", "lexeme").agg(F.min("place").alias("first"))
    return rows.withColumn("n", F.count("*").over(W.partitionBy("question_id"))).filter(F.col("n") >= LEAST_TERMS).drop("n")


def document_identities(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, portfolio_id, lexeme, named: the lexemes of a document's title and metadata (named)
    and of the head of its first page."""
    named = documents.select("document_id", "portfolio_id", F.explode(F.transform(T.lexemes(F.concat_ws(" ", "title", "metadata")), lambda p: p["lexeme"])).alias("lexeme"), F.lit(True).alias("named"))
    first = pages.filter("page_number = 1").select("document_id", F.substring("text", 1, HEAD).alias("head")).join(documents.select("document_id", "portfolio_id"), "document_id")
    head = first.select("document_id", "portfolio_id", F.explode(F.transform(T.lexemes(F.col("head")), lambda p: p["lexeme"])).alias("lexeme"), F.lit(False).alias("named"))
    return named.unionByName(head).groupBy("document_id", "portfolio_id", "lexeme").agg(F.bool_or("named").alias("named"))


def identifying_terms(lexemes: DataFrame, identities: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    """question_id, lexeme, df, ceiling: the question's lexemes that few of the documents its asker sees are known by,
    in how many of them, and the most that one can score by it (2 where any is named so, else 1).

    ``asked``: question_id, portfolio_id of every portfolio in view. Frequencies are counted per
    portfolio once and summed over those in view, as a document is in one portfolio. They are counted before they
    meet the questions, so a lexeme of every document moves as one row a portfolio and map task."""
    df = identities.groupBy("portfolio_id", "lexeme").agg(F.count("*").alias("df"), F.max(weight()).alias("ceiling"))
    df = df.join(broadcast_if_small(lexemes.select("lexeme").distinct()), "lexeme", "left_semi")
    seen = documents_seen(documents, asked)
    rows = lexemes.join(asked, "question_id").join(df, ["portfolio_id", "lexeme"]).groupBy("question_id", "lexeme").agg(F.sum("df").alias("df"), F.max("ceiling").alias("ceiling")).join(seen, "question_id")
    few = rows.filter(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("docs") * COMMON_SHARE)))
    return few.withColumn("n", F.count("*").over(W.partitionBy("question_id"))).filter(F.col("n") >= LEAST_TERMS).select("question_id", "lexeme", "df", "ceiling")


def weight() -> Column:
    """What a lexeme of a document's identity adds to its score."""
    return F.when(F.col("named"), 2).otherwise(1)


def documents_seen(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """question_id, docs: how many documents are in view."""
    size = documents.groupBy("portfolio_id").agg(F.count("*").alias("docs"))
    return asked.join(size, "portfolio_id").groupBy("question_id").agg(F.sum("docs").alias("docs"))


def focus_documents(terms: DataFrame, identities: DataFrame, documents: DataFrame, asked: DataFrame, rare: int = RARE, salts: int = SALTS, direct: int = DIRECT) -> DataFrame:
    """question_id, document_id, score: the documents that a question names.

    Two for a term of the name, one for one on the first page only; all at the best score, which is
    two at least; none if more than four tie, or all in view.

    ``terms``: as of :func:`identifying_terms`. A document scores no more than the ceilings of its rarest term and of
    those more frequent. Terms of at most ``rare`` documents are followed first, and the best of what they lead to is a
    bar; a more frequent term is followed only if it and those above it can reach the bar, in ``salts`` parts, and
    otherwise looked up for documents already found. So a lexeme of very many documents is joined to them only where
    nothing rarer decides. No group of a question's documents comes to one task. Where all terms together lead to no
    more than ``direct`` rows, which their frequencies tell, all are followed at once, to the same result."""
    by = W.partitionBy("question_id").orderBy(F.desc("df"), F.desc("lexeme")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = written(terms.withColumn("rest", F.sum("ceiling").over(by)))
    known = identities.select("document_id", "portfolio_id", "lexeme", weight().alias("w"))
    rows = ranked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    score = _led(ranked, known, asked).withColumnRenamed("part", "score") if rows <= direct else _scored(ranked, known, asked, rare, salts)
    score = written(score.filter(F.col("score") >= LEAST_SCORE))
    ties = score.groupBy("question_id", "score").agg(F.count("*").alias("n")).groupBy("question_id").agg(F.max(F.struct("score", "n")).alias("top"))
    few = ties.filter(F.col("top.n") <= MOST_FOCUS).join(documents_seen(documents, asked), "question_id").filter(F.col("top.n") < F.col("docs"))
    return score.join(few.select("question_id", "top.score"), ["question_id", "score"]).select("question_id", "document_id", "score")


def _led(terms: DataFrame, known: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """question_id, document_id, part: the documents in view that ``terms`` lead to, and what they score by them."""
    hits = terms.join(asked, "question_id").join(known, ["lexeme", "portfolio_id", *more])
    return hits.groupBy("question_id", "document_id").agg(F.sum("w").alias("part"))


def _scored(ranked: DataFrame, known: DataFrame, asked: DataFrame, rare: int, salts: int) -> DataFrame:
    """question_id, document_id, score of all documents that can be a question's best."""
    # Rare terms lead to candidates, whose other terms are looked up.
    often = ranked.filter(F.col("df") > rare)
    first = written(_looked_up(_led(ranked.filter(F.col("df") <= rare), known, asked), often, known))
    bar = first.groupBy("question_id").agg(F.max("score").alias("bar"))
    # Frequent ones, where a document without any rare term could still reach the bar.
    more = often.join(bar, "question_id", "left").withColumn("follow", F.col("rest") >= F.greatest("bar", F.lit(LEAST_SCORE)))
    copies = more.filter("follow").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("document_id"), F.lit(salts)).cast("int"))
    found = written(_led(copies, dealt, asked, "salt").join(first, ["question_id", "document_id"], "left_anti"))
    left = more.filter(~F.col("follow")).groupBy("question_id").agg(F.max("rest").alias("left"))
    reach = found.groupBy("question_id").agg(F.max("part").alias("reach")).join(bar, "question_id", "left").join(left, "question_id", "left")
    near = found.join(reach, "question_id").filter(F.col("part") + F.coalesce("left", F.lit(0)) >= F.greatest("bar", "reach", F.lit(LEAST_SCORE)))
    second = _looked_up(near.select("question_id", "document_id", "part"), more.filter(~F.col("follow")), known)
    return first.join(bar, "question_id").filter("score = bar").select("question_id", "document_id", "score").unionByName(second)


def _looked_up(found: DataFrame, terms: DataFrame, known: DataFrame) -> DataFrame:
    """question_id, document_id, score: ``part`` and the weights of those ``terms`` that the document is known by."""
    asks = found.join(terms.select("question_id", "lexeme"), "question_id").join(known.select("document_id", "lexeme", "w"), ["document_id", "lexeme"])
    both = found.select("question_id", "document_id", F.col("part").cast("long").alias("w")).unionByName(asks.select("question_id", "document_id", F.col("w").cast("long").alias("w")))
    return both.groupBy("question_id", "document_id").agg(F.sum("w").alias("score"))


def passage_query(questions: DataFrame, words: DataFrame, terms: DataFrame, focus: DataFrame, identities: DataFrame) -> DataFrame:
    """question_id, query: a focused question without the words whose lexemes are all identifying ones
    that name a focused document; as it is if it is not focused or nothing would be left."""
    named = focus.join(identities.filter("named"), "document_id").select("question_id", "lexeme").distinct()
    matched = named.join(terms, ["question_id", "lexeme"], "left_semi").withColumn("matched", F.lit(True))
    of = word_lexemes(words).join(matched, ["question_id", "lexeme"], "left").groupBy("question_id", "place").agg(F.bool_and(F.coalesce("matched", F.lit(False))).alias("gone"))
    kept = words.join(focus.select("question_id").distinct(), "question_id", "left_semi").join(of, ["question_id", "place"], "left").filter(~F.coalesce("gone", F.lit(False)))
    rest = kept.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("rest"))
    return questions.join(rest, "question_id", "left").select("question_id", F.coalesce(F.nullif("rest", F.lit("")), "text").alias("query"))


def vector_top_n(questions: DataFrame, chunks: DataFrame, n: int = 30, scope: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, distance, vector_rank: the ``n`` nearest by cosine distance, ties to the
    smaller chunk_id; null vectors are skipped.

    Both: id and ``embedding``. With ``scope`` (question_id, portfolio_id) a question sees the passages
    (portfolio_id) of its portfolios only, and none without one. Blocks of questions and blocks of
    passages meet in tiles (:mod:`nearest`): passages are read once, and neither side comes to the
    driver. Distances are rounded to nine places before they are compared."""
    rows = questions.filter("embedding is not null").select("question_id", "embedding")
    if scope is not None:
        own = scope.groupBy("question_id").agg(F.collect_set("portfolio_id").alias("portfolios"))
        rows = rows.join(own, "question_id")
    else:
        rows = rows.withColumn("portfolios", F.lit(None).cast("array<string>"))
    best = W.partitionBy("question_id").orderBy("distance", "chunk_id")
    near = nearest.nearest(rows, chunks.filter("embedding is not null"), n, scope is not None)
    return near.withColumn("vector_rank", F.row_number().over(best)).filter(F.col("vector_rank") <= n)


def vector_top_n_focused(questions: DataFrame, focus: DataFrame, chunks: DataFrame, n: int = 30, on: list[str] | None = None) -> DataFrame:
    """As :func:`vector_top_n`, among the passages of each question's focused documents: both sides meet ``on``
    the document (and what else ``focus`` says of it), in tiles of bounded size. Vectors of no length are skipped."""
    near = nearest.nearest_focused(questions, focus, chunks, n, on or ["document_id"]).withColumn("distance", F.round("distance", 9))
    best = W.partitionBy("question_id").orderBy("distance", "chunk_id")
    return near.withColumn("vector_rank", F.row_number().over(best)).filter(F.col("vector_rank") <= n)


def lexical_top_n(queries: DataFrame, words: DataFrame, n: int = 30, scope: DataFrame | None = None, focus: DataFrame | None = None, focused_only: bool = False) -> DataFrame:
    """question_id, chunk_id, score, lexical_rank: passages with any lexeme of the query, best first.

    ``queries``: question_id, query; ``words``: chunk_id, lexeme, one row for each place of a lexeme. With
    ``scope`` (question_id, portfolio_id) and ``focus`` (question_id, document_id) a question sees the
    passages (portfolio_id, document_id) of its portfolios, and of its focused documents if it has
    any (``focused_only``: and the others see none). Words that no question has go before anything is
    shuffled, hits are counted before the shuffle, and only counts move. Where passages are searched
    more than once, :func:`lexical_top_n_indexed` reads a stored index instead."""
    wanted = queries.select("question_id", F.explode(F.array_distinct(F.transform(T.lexemes(F.col("query")), lambda p: p["lexeme"]))).alias("lexeme"))
    if scope is None:
        hits = words.select("chunk_id", "lexeme").join(wanted, "lexeme")
    else:
        words = words.select("chunk_id", "document_id", "portfolio_id", "lexeme").join(wanted.select("lexeme").distinct(), "lexeme", "left_semi")
        hits = None
        if not focused_only:
            free = wanted if focus is None else wanted.join(focus, "question_id", "left_anti")
            hits = words.join(free.join(scope.select("question_id", "portfolio_id").distinct(), "question_id"), ["lexeme", "portfolio_id"]).select("question_id", "chunk_id")
        if focus is not None:
            named = wanted.join(focus.select("question_id", "document_id"), "question_id").join(scope.select("question_id", "portfolio_id").distinct(), "question_id")
            own = words.join(named, ["lexeme", "document_id", "portfolio_id"]).select("question_id", "chunk_id")
            hits = own if hits is None else hits.unionByName(own)
    score = hits.groupBy("question_id", "chunk_id").agg((F.count("*") * F.lit(0.1)).alias("score"))
    best = W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return score.withColumn("lexical_rank", F.row_number().over(best)).filter(F.col("lexical_rank") <= n)


def lexical_top_n_indexed(queries: DataFrame, index: DataFrame, n: int = 30, scope: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """As :func:`lexical_top_n` without a focus, from a stored index (:func:`postings.index_blocks`): only the folders of
    wanted lexemes are opened, and of the postings only those of ranges that can hold a result.

    Without ``scope`` every question sees all passages."""
    asked = postings.wanted_lexemes(queries)
    if scope is None:
        index, asked = index.withColumn("portfolio_id", F.lit("")), asked.withColumn("portfolio_id", F.lit(""))
    else:
        asked = asked.join(scope.select("question_id", "portfolio_id").distinct(), "question_id")
    found = postings.search(asked, index, n, gone)
    return found.select("question_id", "chunk_id", (F.col("n") * F.lit(0.1)).alias("score"), "lexical_rank")


def rrf_fuse(vector: DataFrame, lexical: DataFrame, k: int = 8, rrf_k: int = 60) -> DataFrame:
    """question_id, chunk_id, source_index, fused_score, vector_rank, lexical_rank: reciprocal rank
    fusion; ties to the better vector rank (none is last), then the smaller chunk_id."""
    both = vector.select("question_id", "chunk_id", "vector_rank").join(lexical.select("question_id", "chunk_id", "lexical_rank"), ["question_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    rows = both.withColumn("fused_score", part("vector_rank") + part("lexical_rank"))
    order = W.partitionBy("question_id").orderBy(F.desc("fused_score"), F.asc_nulls_last("vector_rank"), "chunk_id")
    return rows.withColumn("source_index", F.row_number().over(order) - 1).filter(F.col("source_index") < k)


def hybrid_search(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, words: DataFrame, scope: DataFrame, focus: DataFrame, k: int = 8, candidates: int = 30, rrf_k: int = 60, embedding: str = "hashed features") -> DataFrame:
    """The fused sources of every question, with the settings in force beside them.

    ``queries``: question_id, query; ``vectors``: question_id, embedding of the query; ``chunks``:
    chunk_id, document_id, portfolio_id, embedding of the passages of ready documents; ``words``: their
    lexemes. Both legs search what a question's asker sees (``scope``) and, if it names documents
    (``focus``), these alone. A blank question has no sources."""
    asked = queries.filter(T.strip(F.col("query")) != "")
    vectors = vectors.join(asked.select("question_id"), "question_id", "left_semi")
    return hybrid_fused(vectors, chunks, lexical_top_n(asked, words, candidates, scope, focus), scope, focus, k, candidates, rrf_k, embedding)


def hybrid_fused(vectors: DataFrame, chunks: DataFrame, lexical: DataFrame, scope: DataFrame, focus: DataFrame, k: int = 8, candidates: int = 30, rrf_k: int = 60, embedding: str = "hashed features") -> DataFrame:
    """The vector leg of ``vectors`` (question_id, embedding), fused with a ``lexical`` leg."""
    free = vector_top_n(vectors.join(focus.select("question_id").distinct(), "question_id", "left_anti"), chunks, candidates, scope)
    named = focus.select("question_id", "document_id").join(scope.select("question_id", "portfolio_id").distinct(), "question_id")
    own = vector_top_n_focused(vectors, named, chunks, candidates, ["document_id", "portfolio_id"])
    fused = rrf_fuse(free.unionByName(own), lexical, k, rrf_k)
    limits = F.struct(F.lit(LEAST_TERMS).alias("min_terms"), F.lit(COMMON_SHARE).alias("common_share"), F.lit(MOST_FOCUS).alias("max_documents"))
    settings = F.struct(F.lit(k).alias("k"), F.lit(candidates).alias("candidates"), F.lit(rrf_k).alias("rrf_k"), F.lit(embedding).alias("embedding"), limits.alias("focus"))
    return fused.withColumn("settings", settings)


def hydrate_sources(sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources with document, title, page, sentence blocks and a snippet. The sources are few rows, so
    they travel to the passages and not the other way."""
    rows = chunks.join(sources, "chunk_id").join(documents.select("document_id", "title"), "document_id")
    return rows.select("question_id", "source_index", "chunk_id", "document_id", "title", "page_number", T.split_sentences(F.col("text")).alias("blocks"), F.substring(T.strip(F.col("text")), 1, 240).alias("snippet"))
