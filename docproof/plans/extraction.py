"""Queries of extraction, evidence, reviews and the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from docproof.functions import parsing as V, text as T
from docproof.operators import evidence as E, register as R
from docproof.plans import domain as D
from docproof.plans.domain import sql
from docproof.plans.registry import query
from docproof.session import table

KEYS = [f[0] for f in D.FIELDS]
#: Patterns for the prose of the given documents: a word after a common one, and a license line.
REGISTRY = [("licence", r"Licensed under the ([A-Z][a-z]+) License"), ("mail", r"[A-Za-z0-9._]+@[a-z.]+"), ("the_word", r"[Tt]he ([a-z]+) ")]

# Reading the values of the raw table: text is clean, dates are day first, sums carry a sign.
READ = """CASE field_type WHEN 'text' THEN value_text WHEN 'date' THEN strftime(strptime(value_text, '%d/%m/%Y'), '%Y-%m-%d')
  WHEN 'money' THEN replace(value_text, '£', '')::DECIMAL(20,2)::VARCHAR ELSE regexp_extract(value_text, '^[0-9]+') END"""
V_FIRST = "SELECT *, row_number() OVER (PARTITION BY extraction_id, field_key ORDER BY l_partkey, l_suppkey, price, quantity, field_type, value_text, review_status) AS rn FROM v_raw"
V_VALUE = f"SELECT extraction_id, field_key, field_type, value_text, review_status, {READ} AS value, CASE WHEN review_status = 'corrected' THEN 'X' || ({READ}) END AS corrected, CASE WHEN l_partkey % 6 = 0 THEN 'quote_not_found' END AS issue FROM v_first WHERE rn = 1"
V_LATEST = "SELECT document_id, arg_max(extraction_id, {'c': created_at, 'i': extraction_id}) AS extraction_id FROM v_extraction WHERE status = 'done' GROUP BY 1"
V_READY = "SELECT document_id, title, portfolio_id AS portfolio_name FROM v_document WHERE status = 'ready'"
CELLS = lambda states: ", ".join(f"max(CASE WHEN field_key = '{k}' AND review_status IN ({states}) THEN coalesce(corrected, value) END) AS {k}" for k in KEYS)
COUNTS = ", ".join(f"count(*) FILTER (review_status = '{s}') AS n_{s}" for s in R.STATES)
WIDE = lambda states: f"SELECT d.document_id, portfolio_name, title, {CELLS(states)}, {COUNTS}, NOT coalesce(bool_or(review_status = 'pending' AND value IS NOT NULL), false) AS complete FROM v_ready d JOIN v_latest l ON l.document_id = d.document_id JOIN v_value v ON v.extraction_id = l.extraction_id GROUP BY 1, 2, 3"
VIEWS = {"v_first": V_FIRST, "v_value": V_VALUE, "v_latest": V_LATEST, "v_ready": V_READY, "v_register": WIDE("'confirmed', 'corrected'"), "v_everything": WIDE("'confirmed', 'corrected', 'pending'")}


def q(body: str, **more: str) -> str:
    return sql(body, **VIEWS, **more)


def values(spark, d):
    raw = D.raw_values(spark, d)
    first = E.first_answer_per_field(raw, KEYS, ["l_partkey", "l_suppkey", "price", "quantity", "field_type", "value_text", "review_status"]).filter("value_text is not null")
    value = V.parse_value(F.col("field_type"), F.col("value_text"))
    rows = first.withColumn("value", value).withColumn("corrected", F.when(F.col("review_status") == "corrected", F.concat(F.lit("X"), "value")))
    return rows.withColumn("issue", F.when(F.col("l_partkey") % 6 == 0, "quote_not_found"))


def ready(spark, d):
    return D.documents(spark, d).filter("status = 'ready'").select("document_id", "title", F.col("portfolio_id").alias("portfolio_name"))


def register(spark, d, include=False):
    return R.register(values(spark, d), D.extractions(spark, d), ready(spark, d), KEYS, include)


FIRST_MATCH = lambda k, p, g: f"SELECT document_id, '{k}' AS field_key, arg_min(regexp_extract(text, '{p}', {g}), ordinal) AS value_text, arg_min(chunk_id, ordinal) AS chunk_id FROM v_flat WHERE regexp_matches(text, '{p}') GROUP BY 1"
V_FLAT = "SELECT chunk_id, document_id, ordinal, replace(text, chr(10), ' ') AS text FROM v_chunk"


def flat_chunks(spark, d):
    return D.chunks(spark, d).withColumn("blocks", F.split("text", "\n", -1))


@query("extract_fields", q("SELECT e.document_id, e.field_key, m.value_text, m.chunk_id, CASE WHEN m.chunk_id IS NULL THEN 'low' ELSE 'high' END AS confidence FROM (SELECT DISTINCT document_id, unnest(['licence', 'mail', 'the_word']) AS field_key FROM v_chunk) e LEFT JOIN v_match3 m USING (document_id, field_key)",
    v_flat=V_FLAT, v_match3=" UNION ALL ".join(FIRST_MATCH(k, p, 1 if "(" in p else 0) for k, p in REGISTRY)))
def extract_fields(spark, d):
    return E.extract_fields(flat_chunks(spark, d), REGISTRY).drop("quote")


@query("quote_for_match", q("SELECT document_id, line AS quote FROM (SELECT document_id, line, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, i) AS rn FROM (SELECT document_id, ordinal, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM v_chunk) WHERE regexp_matches(line, 'Licensed under the ([A-Z][a-z]+) License')) WHERE rn = 1"))
def quote_for_match(spark, d):
    return E.extract_fields(flat_chunks(spark, d), REGISTRY[:1]).filter("quote is not null").select("document_id", "quote")


@query("first_answer_per_field", q(f"SELECT e.extraction_id, e.field_key, f.value_text FROM (SELECT DISTINCT extraction_id, unnest([{', '.join(repr(k) for k in KEYS)}]) AS field_key FROM v_raw) e LEFT JOIN (SELECT * FROM v_first WHERE rn = 1) f USING (extraction_id, field_key)"))
def first_answer_per_field(spark, d):
    return E.first_answer_per_field(D.raw_values(spark, d), KEYS, ["l_partkey", "l_suppkey", "price", "quantity", "field_type", "value_text", "review_status"]).select("extraction_id", "field_key", "value_text")


V_QUOTED = """SELECT chunk_id AS value_id, document_id, CASE WHEN chunk_id % 11 = 0 THEN NULL WHEN chunk_id % 7 = 0 THEN chunk_id + 1000000000 ELSE chunk_id END AS chunk_id,
  CASE WHEN chunk_id % 13 = 0 THEN '' ELSE 'Tenant ' || document_id END AS value_text, CASE WHEN chunk_id % 5 = 0 THEN 'zz not here' ELSE translate(string_split(text, chr(10))[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS quote FROM v_chunk"""


def shouted(c):
    """ASCII letters as capitals."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def quoted(spark, d):
    c = D.chunks(spark, d)
    wanted = F.when(F.col("chunk_id") % 11 == 0, F.lit(None).cast("long")).when(F.col("chunk_id") % 7 == 0, F.col("chunk_id") + 1000000000).otherwise(F.col("chunk_id"))
    return c.select(
        F.col("chunk_id").alias("value_id"), "document_id", wanted.alias("chunk_id"), F.lit("text").alias("field_type"),
        F.when(F.col("chunk_id") % 13 == 0, "").otherwise(F.concat(F.lit("Tenant "), F.col("document_id").cast("string"))).alias("value_text"),
        F.when(F.col("chunk_id") % 5 == 0, "zz not here").otherwise(shouted(F.element_at(F.split("text", "\n"), 1))).alias("quote"),
    )


FOLD = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


@query("check_evidence", q(f"""SELECT value_id, CASE WHEN e.chunk_id % 7 = 0 AND false OR k.chunk_id IS NULL THEN NULL ELSE e.chunk_id END AS chunk_id, CASE WHEN value_text = '' THEN 'no_evidence' WHEN e.chunk_id IS NOT NULL AND k.chunk_id IS NULL THEN 'invalid_chunk' WHEN e.chunk_id IS NULL THEN 'no_evidence'
 WHEN NOT contains({FOLD('k.text')}, {FOLD("trim(quote, ' ''“”‘’' || chr(34))")}) THEN 'quote_not_found' END AS issue FROM v_quoted e LEFT JOIN v_chunk k ON k.document_id = e.document_id AND k.chunk_id = e.chunk_id""", v_quoted=V_QUOTED))
def check_evidence(spark, d):
    return E.check_evidence(quoted(spark, d), D.chunks(spark, d)).select("value_id", "chunk_id", "issue")


@query("quote_contains", q(f"SELECT value_id, contains({FOLD('k.text')}, {FOLD('quote')}) AS held FROM v_quoted e JOIN v_chunk k ON k.chunk_id = e.value_id", v_quoted=V_QUOTED.replace("translate(string_split(text, chr(10))[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')", "'  ' || replace(translate(left(text, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', '   ')")))
def quote_contains(spark, d):
    c = D.chunks(spark, d)
    quote = F.when(F.col("chunk_id") % 5 == 0, "zz not here").otherwise(F.concat(F.lit("  "), F.replace(shouted(F.substring("text", 1, 30)), F.lit(" "), F.lit("   "))))
    return c.select(F.col("chunk_id").alias("value_id"), E.quote_contains(F.col("text"), quote).alias("held"))


@query("highlight_range", q("SELECT chunk_id, strpos(text, string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3]) - 1 AS begin_at FROM v_chunk WHERE regexp_matches(text, '^[A-Za-z]+ [a-z]{4,} [a-z]{4,}[ .]')"))
def highlight_range(spark, d):
    c = D.chunks(spark, d).filter(F.col("text").rlike("^[A-Za-z]+ [a-z]{4,} [a-z]{4,}[ .]"))
    w = F.split("text", " ")
    return c.select("chunk_id", E.highlight_range(F.col("text"), F.concat(F.element_at(w, 2), F.lit("  \n"), F.element_at(w, 3)))["begin"].cast("long").alias("begin_at"))


def parsed(kind):
    def run(spark, d):
        rows = D.raw_values(spark, d).filter(F.col("field_type") == kind).select("value_text").distinct()
        read = {"text": V.parse_text, "date": V.parse_date, "money": V.parse_money, "integer": V.parse_integer}[kind]
        return rows.select("value_text", read(F.concat(F.lit(' "'), "value_text", F.lit('". '))).alias("value"))

    return run


SAYS = "SELECT DISTINCT value_text, {} AS value FROM v_raw WHERE field_type = '{}'"
query("parse_text", q(SAYS.format("value_text", "text")))(parsed("text"))
query("parse_date", q(SAYS.format("strptime(value_text, '%d/%m/%Y')::DATE", "date")))(parsed("date"))
query("parse_money", q(SAYS.format("replace(value_text, '£', '')::DOUBLE", "money")))(parsed("money"))
query("parse_integer", q(SAYS.format("regexp_extract(value_text, '^[0-9]+')::BIGINT", "integer")))(parsed("integer"))


SAID = lambda words: ", ".join(f"'{w}'" for w in words)


@query("parse_bool", f"""SELECT said, CASE WHEN k IN ({SAID(V.TRUE)}) THEN true WHEN k IN ({SAID(V.FALSE)}) THEN false END AS value
 FROM (SELECT said, lower(regexp_replace(said, '^["''“”‘’. ]+|["''“”‘’. ]+$', '', 'g')) AS k FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\r\n\f\x0B]+')) AS said FROM documents))""")
def parse_bool(spark, d):
    """Each word of the documents, read as yes or no."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0))).alias("said")).distinct()
    return words.select("said", V.parse_bool(F.col("said")).alias("value"))


PRIORITIES = ("1_urgent", "4_not_specified", "5_low")


@query("parse_enum", f"SELECT o_orderkey, CASE WHEN k IN ({SAID(PRIORITIES)}) THEN k END AS value FROM (SELECT o_orderkey, replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') AS k FROM orders)")
def parse_enum(spark, d):
    """The priority of each order, read as one of three listed values."""
    allowed = F.array(*[F.lit(x) for x in PRIORITIES])
    return table(spark, d, "orders").select("o_orderkey", V.parse_enum(F.col("o_orderpriority"), allowed).alias("value"))


@query("parse_values", q(f"SELECT extraction_id, field_key, {READ} AS value FROM v_raw"))
def parse_values(spark, d):
    return D.raw_values(spark, d).select("extraction_id", "field_key", V.parse_value(F.col("field_type"), F.col("value_text")).alias("value"))


V_EVENT = f"SELECT extraction_id, field_key, field_type, extraction_id % 3 = 0 AS rejected, extraction_id % 2 = 0 AS corrected_, NOT (extraction_id % 5 = 0 AND field_type <> 'text') AS readable FROM v_first WHERE rn = 1"
#: What a reviewer types for a field of each type, and how it reads.
TYPED = {"text": ("Plot  9", "Plot 9"), "date": ("2 May 2025", "2025-05-02"), "money": ("£1,000", "1000.00"), "integer": ("18 months", "18")}


def reviewed(spark, d):
    """Each value of every field is confirmed, then every second corrected, then every third rejected; every
    fifth correction is none that the field's type can read (text is always read)."""
    rows = values(spark, d).select(F.struct("extraction_id", "field_key").alias("value_id"), "extraction_id", "field_type", "value")
    ev = lambda seq, action, text, cond: rows.filter(cond).select("value_id", F.lit(seq).alias("seq"), F.lit(action).alias("action"), text.alias("corrected_text"), F.lit("r").alias("reviewer"))
    none = F.lit(None).cast("string")
    typed = F.create_map(*[F.lit(x) for k, (said, _) in TYPED.items() for x in (k, said)])
    text = F.when(F.col("extraction_id") % 5 == 0, "TBC").otherwise(typed[F.col("field_type")])
    events = ev(1, "confirm", none, "true").unionByName(ev(2, "correct", text, "extraction_id % 2 = 0")).unionByName(ev(3, "reject", none, "extraction_id % 3 = 0"))
    return E.apply_reviews(rows, events)


READS = "CASE WHEN field_type = 'text' AND extraction_id % 5 = 0 THEN 'TBC' " + " ".join(f"WHEN field_type = '{k}' THEN '{v}'" for k, (_, v) in TYPED.items()) + " END"


@query("apply_reviews", q(f"SELECT extraction_id, field_key, CASE WHEN rejected THEN 'rejected' WHEN corrected_ AND readable THEN 'corrected' ELSE 'confirmed' END AS review_status, CASE WHEN NOT rejected AND corrected_ AND readable THEN {READS} END AS corrected FROM v_event", v_event=V_EVENT))
def apply_reviews(spark, d):
    return reviewed(spark, d)[0].select("value_id.extraction_id", "value_id.field_key", "review_status", "corrected")


@query("refused_reviews", q("SELECT extraction_id, field_key, 2 AS seq, 'unparseable' AS reason FROM v_event WHERE corrected_ AND NOT readable", v_event=V_EVENT))
def refused_reviews(spark, d):
    return reviewed(spark, d)[1].select("value_id.extraction_id", "value_id.field_key", "seq", "reason")


@query("latest_extraction", q("SELECT * FROM v_latest"))
def latest_extraction(spark, d):
    return R.latest_extraction(D.extractions(spark, d))


@query("effective_value", q("SELECT extraction_id, field_key, coalesce(corrected, value) AS effective FROM v_value"))
def effective_value(spark, d):
    return values(spark, d).select("extraction_id", "field_key", E.effective_value(F.col("value"), F.col("corrected")).alias("effective"))


@query("shown_value", q("SELECT extraction_id, field_key, CASE WHEN review_status IN ('confirmed', 'corrected') THEN coalesce(corrected, value) END AS shown FROM v_value"))
def shown_value(spark, d):
    return values(spark, d).select("extraction_id", "field_key", E.shown_value(F.col("review_status"), F.col("value"), F.col("corrected"), False).alias("shown"))


@query("register", q("SELECT * FROM v_register"))
def register_rows(spark, d):
    return register(spark, d)


@query("register_complete", q("SELECT document_id, complete FROM v_register"))
def register_complete(spark, d):
    return register(spark, d).select("document_id", "complete")


@query("register_expiring", q("SELECT document_id, term_end FROM v_register WHERE TRY_CAST(term_end AS DATE) < DATE '1996-01-01'"))
def register_expiring(spark, d):
    return R.register_expiring(register(spark, d), "1996-01-01").select("document_id", "term_end")


@query("register_has_break", q("SELECT document_id FROM v_register WHERE break_date IS NOT NULL"))
def register_has_break(spark, d):
    return R.register_has_break(register(spark, d), True).select("document_id")


@query("register_totals", q("SELECT count(*) AS documents, count(*) FILTER (complete) AS complete, coalesce(sum(n_pending), 0)::BIGINT AS pending_values FROM v_register"))
def register_totals(spark, d):
    return R.register_totals(register(spark, d))


@query("register_by_term_end", q("SELECT document_id, term_end, row_number() OVER (ORDER BY term_end ASC NULLS LAST, title, document_id) AS place FROM v_register ORDER BY place LIMIT 50"))
def register_by_term_end(spark, d):
    """The first fifty of the view, with their places (a top-k report)."""
    top = R.register_by_term_end(register(spark, d)).limit(50)
    from pyspark.sql.window import Window as W

    return top.select("document_id", "term_end", F.row_number().over(W.orderBy(F.asc_nulls_last("term_end"), "title", "document_id")).cast("long").alias("place"))


@query("unreviewed_cells", q("SELECT document_id, list_filter([" + ", ".join(f"CASE WHEN e.{k} IS NOT NULL AND r.{k} IS NULL THEN '{k}' END" for k in KEYS) + "], lambda x: x IS NOT NULL) AS cells FROM v_everything e JOIN v_register r USING (document_id)"))
def unreviewed_cells(spark, d):
    return R.unreviewed_cells(register(spark, d), register(spark, d, True), KEYS)


V_QUEUE = "SELECT d.document_id, d.title, count(*) AS pending, count(*) FILTER (issue IS NOT NULL) AS issues FROM v_ready d JOIN v_latest l ON l.document_id = d.document_id JOIN v_value v ON v.extraction_id = l.extraction_id WHERE review_status = 'pending' GROUP BY 1, 2"


@query("review_queue", q("SELECT * FROM v_queue", v_queue=V_QUEUE))
def review_queue(spark, d):
    return R.review_queue(values(spark, d), D.extractions(spark, d), ready(spark, d))


@query("review_totals", q("SELECT count(*) AS documents, coalesce(sum(pending), 0)::BIGINT AS pending, coalesce(sum(issues), 0)::BIGINT AS issues FROM v_queue", v_queue=V_QUEUE))
def review_totals(spark, d):
    return R.review_totals(review_queue(spark, d))


@query("pending_extraction_requests", q("SELECT document_id FROM v_document WHERE status = 'ready' AND document_id NOT IN (SELECT document_id FROM v_extraction WHERE status IN ('queued', 'running'))"))
def pending_extraction_requests(spark, d):
    return R.pending_extraction_requests(D.documents(spark, d), D.extractions(spark, d)).select("document_id")


@query("register_csv", q("SELECT title, CASE WHEN regexp_matches(coalesce(tenant, ''), '^[=+@\t\r\n-]') THEN '''' || tenant ELSE coalesce(tenant, '') END AS tenant_name, coalesce(TRY_CAST(annual_rent_gbp AS DECIMAL(20,2))::VARCHAR, '') AS annual_rent_gbp, CASE WHEN complete THEN 'yes' ELSE 'no' END AS complete FROM (SELECT *, CASE WHEN document_id % 3 = 0 THEN '=' || tenant_name WHEN document_id % 3 = 1 THEN chr(10) || tenant_name ELSE tenant_name END AS tenant FROM v_register)"))
def register_csv(spark, d):
    rows = register(spark, d).withColumn("tenant_name", F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("="), "tenant_name")).when(F.col("document_id") % 3 == 1, F.concat(F.lit("\n"), "tenant_name")).otherwise(F.col("tenant_name")))
    return R.register_csv(rows, ["title", "tenant_name"], ["annual_rent_gbp"], ["complete"])
