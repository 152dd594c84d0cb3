"""Queries of sources and document preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docproof.functions import text as T
from docproof.operators import prepare as P
from docproof.plans import domain as D
from docproof.plans.domain import sql
from docproof.plans.registry import query
from docproof.session import shared_path, table
from docproof.sources import uploads as U

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
SPLIT = r"""regexp_replace(line, '([.!?;:])\s+([A-Z0-9(£"''“‘])', '\1' || chr(1) || '\2', 'g')"""
V_LINE = r"SELECT document_id, page_number, line_no, trim(regexp_replace(unnest_line, '[ \t\f\x0B\x{00A0}]+', ' ', 'g')) AS line FROM (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS unnest_line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM v_page)"

# A label on its own goes to the piece after it, be that a label too, or stays if it is last in its line.
V_LABEL = rf"SELECT *, regexp_matches(piece, '{T.LABEL_ONLY}') AS label FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number, line_no ORDER BY n) AS i FROM (SELECT document_id, page_number, line_no, trim(p) AS piece, n FROM (SELECT document_id, page_number, line_no, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS n FROM (SELECT document_id, page_number, line_no, string_split({SPLIT}, chr(1)) AS pieces FROM v_line WHERE line <> ''))) WHERE piece <> '')"
V_RUN = "SELECT *, row_number() OVER (PARTITION BY document_id, page_number, line_no, label, i - k ORDER BY i) AS r FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number, line_no, label ORDER BY i) AS k FROM v_label)"
V_START = "SELECT *, CASE WHEN label THEN r % 2 = 1 ELSE NOT coalesce(lag(label AND r % 2 = 1) OVER w, false) END AS starts FROM v_run WINDOW w AS (PARTITION BY document_id, page_number, line_no ORDER BY i)"
V_SENTENCE = "SELECT document_id, page_number, line_no, block, string_agg(piece, ' ' ORDER BY i) AS sentence FROM (SELECT *, sum(starts::INT) OVER (PARTITION BY document_id, page_number, line_no ORDER BY i) AS block FROM v_start) GROUP BY ALL"
# Chunks of whole sentences: how far one that begins with sentence i goes, which begins are taken, where sentences stand.
V_SENT = "SELECT document_id, page_number, sentence, row_number() OVER w AS i, sum(length(sentence) + 1) OVER w AS total, count(*) OVER (PARTITION BY document_id, page_number) AS n FROM v_sentence WINDOW w AS (PARTITION BY document_id, page_number ORDER BY line_no, block)"
V_FIT = "SELECT a.document_id, a.page_number, a.i, a.n, greatest(a.i, coalesce(max(b.i), 0)) AS e FROM v_sent a LEFT JOIN v_sent b ON b.document_id = a.document_id AND b.page_number = a.page_number AND b.i >= a.i AND b.total - a.total + length(a.sentence) <= 1100 GROUP BY 1, 2, 3, 4"
V_TAKEN = "SELECT document_id, page_number, i, e, n, 0 AS ordinal_in_page FROM v_fit WHERE i = 1 UNION ALL SELECT f.document_id, f.page_number, f.i, f.e, f.n, t.ordinal_in_page + 1 FROM v_taken t JOIN v_fit f ON f.document_id = t.document_id AND f.page_number = t.page_number AND f.i = greatest(t.e, t.i + 1) WHERE t.e < t.n"
V_PLACED = """SELECT s.document_id, s.page_number, s.i, greatest(strpos(p.text, s.sentence), 1) AS b, length(s.sentence) AS size FROM v_sent s JOIN v_page p ON p.document_id = s.document_id AND p.page_number = s.page_number WHERE s.i = 1
  UNION ALL SELECT s.document_id, s.page_number, s.i, d.b + d.size + greatest(strpos(substr(p.text, d.b + d.size), s.sentence), 1) - 1, length(s.sentence) FROM v_placed d JOIN v_sent s ON s.document_id = d.document_id AND s.page_number = d.page_number AND s.i = d.i + 1 JOIN v_page p ON p.document_id = s.document_id AND p.page_number = s.page_number"""
V_PACKED = "SELECT t.document_id, t.page_number, t.ordinal_in_page, string_agg(s.sentence, chr(10) ORDER BY s.i) AS text, min(d.b) FILTER (s.i = t.i) - 1 AS char_start, max(d.b + d.size) FILTER (s.i = t.e) - 1 AS char_end FROM v_taken t JOIN v_sent s ON s.document_id = t.document_id AND s.page_number = t.page_number AND s.i BETWEEN t.i AND t.e JOIN v_placed d ON d.document_id = s.document_id AND d.page_number = s.page_number AND d.i = s.i GROUP BY 1, 2, 3"
SENTENCES = {"v_sent": V_SENT, "v_fit": V_FIT, "v_taken": V_TAKEN, "v_placed": V_PLACED, "v_packed": V_PACKED, "v_line": V_LINE, "v_label": V_LABEL, "v_run": V_RUN, "v_start": V_START, "v_sentence": V_SENTENCE}


@query("read_uploads")
def read_uploads(spark, d):
    """The part files of the documents table as blobs."""
    return U.read_uploads(spark, f"{d}/documents.parquet").select(F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("admit_uploads", "SELECT page_id, CASE WHEN strlen(html) > 2000 THEN 'too_large' WHEN html IS NULL OR NOT starts_with(html, '<!DOCTYPE') THEN 'not_supported' END AS reason FROM pages")
def admit_uploads(spark, d):
    files = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return U.admit_uploads(files, "<!DOCTYPE", 2000).select("page_id", "reason")


@query("page_table_io", sql("SELECT p.document_id, page_number, md5(p.text) AS digest, length(d.text) AS chars FROM v_page p JOIN documents d ON d.doc_id = p.document_id"))
def page_table_io(spark, d):
    """Pages and documents written in buckets by document, and joined again without a shuffle."""
    path, name = shared_path(spark, "pages"), f"pages_{uuid.uuid4().hex}"
    pages = U.write_bucketed(D.pages(spark, d), name, f"{path}/pages", order=("page_number",), buckets=16)
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.length("text").cast("long").alias("chars"))
    held = U.write_bucketed(sizes, f"{name}_chars", f"{path}/chars", buckets=16)
    return pages.join(held.hint("merge"), "document_id").select("document_id", "page_number", F.md5("text").alias("digest"), "chars")


@query("request_payloads", sql("""SELECT d.document_id AS question_id, md5(string_agg(title || ' — page ' || page_number || chr(10) || (page_number - 1) || ' ' || chunk_id || ' ' || page_number || chr(10) || c.text, chr(10) || chr(10) ORDER BY page_number)) AS documents_md5, count(*)::BIGINT AS sources, min(filename) AS question
 FROM v_chunk c JOIN v_document d USING (document_id) GROUP BY d.document_id"""))
def request_payloads(spark, d):
    """The pages of each document as its sources, their lines as blocks; read back from the payload."""
    docs = D.documents(spark, d)
    rows = D.chunks(spark, d).join(docs.select("document_id", "title"), "document_id")
    sources = rows.select(F.col("document_id").alias("question_id"), F.col("ordinal").alias("source_index"), "chunk_id", "title", "page_number", F.split("text", "\n", -1).alias("blocks"))
    made = F.from_json("payload", "struct<documents:array<struct<type:string,source:struct<type:string,content:array<struct<type:string,text:string>>>,title:string,context:string,citations:struct<enabled:boolean>>>,question:string>")
    p = U.request_payloads(sources, docs.select(F.col("document_id").alias("question_id"), F.col("filename").alias("text"))).select("question_id", made.alias("p"))

    def told(x):
        at = F.from_json(x["context"], "struct<source_index:int,chunk_id:string,page:int>")
        lines = F.array_join(F.transform(x["source"]["content"], lambda b: b["text"]), "\n")
        return F.concat(x["title"], F.lit("\n"), F.concat_ws(" ", at["source_index"].cast("string"), at["chunk_id"], at["page"].cast("string")), F.lit("\n"), lines)

    return p.select("question_id", F.md5(F.array_join(F.transform("p.documents", told), "\n\n")).alias("documents_md5"), F.size("p.documents").cast("long").alias("sources"), F.col("p.question").alias("question"))


@query("extraction_payloads", sql("""SELECT document_id, string_agg('[chunk ' || chunk_id || '] (page ' || page_number || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal)
 || chr(10) || chr(10) || 'Fields:' || chr(10) || '- tenant_name (text)' || chr(10) || '- term_end (date)' AS payload FROM v_chunk GROUP BY document_id"""))
def extraction_payloads(spark, d):
    return U.extraction_payloads(D.chunks(spark, d), [("tenant_name", "text"), ("term_end", "date")])


@query("normalise_text", r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B\x{00A0}]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\n{2,}'),
  lambda p: array_to_string(list_filter(string_split(p, chr(10)), lambda x: x <> ''), ' ')), lambda p: p <> ''), chr(10)) AS text FROM documents""")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))


@query("reject_empty", sql("SELECT document_id, 'no_text_layer' AS reason FROM (SELECT document_id, CASE WHEN document_id % 10 = 0 THEN '  ' ELSE text END AS text FROM v_page) GROUP BY document_id HAVING NOT bool_or(trim(text) <> '')"))
def reject_empty(spark, d):
    """Every tenth document is given blank pages to be rejected."""
    return P.reject_empty(D.pages(spark, d).withColumn("text", F.when(F.col("document_id") % 10 == 0, "  ").otherwise(F.col("text"))))


@query("explode_pages", sql("SELECT document_id, page_number::INT AS page_number, length(text)::BIGINT AS chars FROM v_page"))
def explode_pages(spark, d):
    arrays = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n", -1).alias("l"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 10).cast("int")), lambda p: F.array_join(F.slice("l", p * 10 + 1, F.lit(10)), "\n"))
    return P.explode_pages(arrays.select("document_id", cut.alias("pages"))).select("document_id", "page_number", F.length("text").cast("long").alias("chars"))


@query("split_sentences", sql("SELECT p.document_id, p.page_number::INT AS page_number, count(sentence)::BIGINT AS sentences, md5(coalesce(string_agg(sentence, chr(10) ORDER BY line_no, block), '')) AS digest FROM v_page p LEFT JOIN v_sentence s ON s.document_id = p.document_id AND s.page_number = p.page_number GROUP BY 1, 2", **SENTENCES))
def split_sentences(spark, d):
    blocks = T.split_sentences(F.col("text"))
    return D.pages(spark, d).select("document_id", "page_number", blocks.alias("blocks")).select("document_id", "page_number", F.size("blocks").cast("long").alias("sentences"), F.md5(F.array_join("blocks", "\n")).alias("digest"))


@query("fold_labels", sql("SELECT p.document_id, p.page_number::INT AS page_number, coalesce(list(sentence ORDER BY line_no, block) FILTER (sentence IS NOT NULL), []) AS blocks FROM v_page p LEFT JOIN v_sentence s ON s.document_id = p.document_id AND s.page_number = p.page_number GROUP BY 1, 2", **SENTENCES))
def fold_labels(spark, d):
    """Sentence blocks after labels are joined to what they number."""
    return D.pages(spark, d).select("document_id", "page_number", T.split_sentences(F.col("text")).alias("blocks"))


@query("chunk_pages", sql("""SELECT document_id, page_number::INT AS page_number, (row_number() OVER (PARTITION BY document_id ORDER BY page_number, ordinal_in_page) - 1)::INT AS ordinal, char_start::INT AS char_start, char_end::INT AS char_end, greatest(1, length(text) // 4)::INT AS token_estimate, md5(text) AS digest FROM v_packed""", **SENTENCES))
def chunk_pages(spark, d):
    return P.chunk_ordinals(P.chunk_pages(D.pages(spark, d))).select("document_id", "page_number", "ordinal", "char_start", "char_end", "token_estimate", F.md5("text").alias("digest"))


@query("chunk_ordinals", sql("SELECT document_id, page_number::INT AS page_number, line_no::INT AS ordinal_in_page, (row_number() OVER (PARTITION BY document_id ORDER BY page_number, line_no) - 1)::INT AS ordinal FROM v_line WHERE line <> ''", v_line=V_LINE))
def chunk_ordinals(spark, d):
    lines = D.pages(spark, d).select("document_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    lines = lines.filter(F.trim(F.regexp_replace("line", T.SPACES, " ")) != "").select("document_id", "page_number", (F.col("n") + 1).alias("ordinal_in_page"))
    return P.chunk_ordinals(lines)


@query("token_estimate", sql("SELECT chunk_id, greatest(1, length(text) // 4)::INT AS tokens FROM v_chunk"))
def token_estimate(spark, d):
    return D.chunks(spark, d).select("chunk_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("document_counts", sql("SELECT p.document_id, p.n AS page_count, coalesce(c.n, 0) AS chunk_count FROM (SELECT document_id, count(*) AS n FROM v_page GROUP BY 1) p LEFT JOIN (SELECT document_id, count(*) AS n FROM v_packed GROUP BY 1) c USING (document_id)", **SENTENCES))
def document_counts(spark, d):
    pages = D.pages(spark, d)
    return P.document_counts(pages, P.chunk_pages(pages))


@query("content_dedup", sql("SELECT seq, portfolio_id, sha256(content) AS sha256, min(seq) OVER w AS document_seq, seq = min(seq) OVER w AS created FROM v_upload WINDOW w AS (PARTITION BY portfolio_id, sha256(content))"))
def content_dedup(spark, d):
    return P.content_dedup(D.uploads(spark, d))


@query("retry_failed_duplicates", sql("SELECT document_id FROM v_document d JOIN documents t ON t.doc_id = d.document_id WHERE status = 'failed' AND (d.portfolio_id, sha256(t.text)) IN (SELECT portfolio_id, sha256(content) FROM v_upload WHERE seq % 3 = 0)"))
def retry_failed_duplicates(spark, d):
    """Every third upload comes again."""
    hashed = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256"))
    return P.retry_failed_duplicates(D.uploads(spark, d).filter("seq % 3 = 0"), D.documents(spark, d).join(hashed, "document_id"))


TITLE = r"""SELECT document_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(stem, '([\w])[-_]+([\w])', '\1 \2', 'g'), '([\w])[-_]+([\w])', '\1 \2', 'g'), ' '), lambda w: w <> ''),
  lambda w: CASE WHEN w = lower(w) AND upper(w) <> w THEN upper(w[1]) || w[2:] ELSE w END), ' ') AS title FROM (SELECT document_id, regexp_replace(filename, '\.[^.]*$', '') AS stem FROM v_document)"""


@query("title_from_filename", sql(TITLE))
def title_from_filename(spark, d):
    return D.documents(spark, d).select("document_id", T.title_from_filename(F.concat(F.lit("/up/loads\\"), "filename")).alias("title"))


@query("rebuild_derived", sql("SELECT document_id, page_number::INT AS page_number, CASE WHEN document_id % 4 = 0 THEN 'again' ELSE md5(text) END AS digest FROM v_page"))
def rebuild_derived(spark, d):
    pages = D.pages(spark, d).select("document_id", "page_number", F.md5("text").alias("digest"))
    return P.rebuild_derived(pages, pages.filter("document_id % 4 = 0").withColumn("digest", F.lit("again")))


@query("cascade_delete", sql("SELECT 'pages' AS child, count(*)::BIGINT AS n FROM v_page WHERE document_id NOT IN (SELECT document_id FROM v_document WHERE status = 'failed') UNION ALL SELECT 'extractions', count(*)::BIGINT FROM v_extraction WHERE document_id NOT IN (SELECT document_id FROM v_document WHERE status = 'failed')"))
def cascade_delete(spark, d):
    left = P.cascade_delete({"pages": D.pages(spark, d), "extractions": D.extractions(spark, d)}, D.documents(spark, d).filter("status = 'failed'"))
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, x in left.items()]
    return counts[0].unionByName(counts[1])


@query("content_tokens", f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t)) AS tokens FROM documents")
def content_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("tokens"))


@query("hashed_embeddings")
def hashed_embeddings(spark, d):
    return P.hashed_embeddings(D.chunks(spark, d), "chunk_id")


V_LEXEME = f"SELECT chunk_id, lexeme, position FROM (SELECT chunk_id, unnest(words) AS lexeme, generate_subscripts(words, 1)::INT AS position FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM v_chunk)) WHERE NOT list_contains({STOP}, lexeme)"


@query("lexemes", sql("SELECT chunk_id, lexeme, list(position ORDER BY position) AS positions FROM v_lexeme GROUP BY 1, 2", v_lexeme=V_LEXEME))
def lexemes(spark, d):
    return P.postings(D.chunks(spark, d))


@query("lexemes_english")
def lexemes_english(spark, d):
    return P.stemmed_postings(D.chunks(spark, d))
