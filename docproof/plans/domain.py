"""The given parquet tables seen as the library's domain tables, in Spark and as SQL views.

Queries run on the Spark frames; the SQL they are held against uses :func:`sql`, which puts the
same views before it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from docproof.session import table

#: Ids of passages leave so many places for those of one document.
WIDE = 1_000_000
MODELS = ("alpha-large", "alpha-small", "beta-mini", "alpha-large-20260401", "gamma-next")
#: model, and USD per million input, output, cache-read and cache-written tokens.
PRICES = (("alpha-large", "5.00", "25.00", "0.50", "6.25"), ("alpha-small", "1.00", "5.00", "0.10", "1.25"), ("alpha", "2.00", "10.00", "0.20", "2.50"), ("beta-mini", "0.25", "1.25", "0.03", "0.30"))


def portfolios(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.col("source").alias("portfolio_id")).distinct()
    return names.select("portfolio_id", F.concat(F.lit("Portfolio "), "portfolio_id").alias("name"), (F.col("portfolio_id") == "src3").alias("confidential"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("portfolio_id"),
        F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string")).alias("title"),
        F.concat("source", F.lit("-"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("toxic") == 1, "failed").otherwise("ready").alias("status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
        "lang",
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """document_id, page_number from 1, text: ten lines a page; no shuffle, a document is one row."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n", -1).alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 10).cast("int")), lambda p: F.array_join(F.slice("lines", p * 10 + 1, F.lit(10)), "\n"))
    return lines.select("document_id", F.posexplode(cut).alias("p", "text")).select("document_id", (F.col("p") + 1).alias("page_number"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Passages for the queries that join them: one a page."""
    return pages(spark, d).select((F.col("document_id") * WIDE + F.col("page_number")).alias("chunk_id"), "document_id", "page_number", (F.col("page_number") - 1).alias("ordinal"), "text")


def users(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select("user_id").distinct()
    return ids.select("user_id", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("full_name"), F.when(F.col("user_id") == 0, "director").otherwise("manager").alias("role"))


def members(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d).filter("role <> 'director'").select("user_id")
    src = lambda n: F.concat(F.lit("src"), ((F.col("user_id") + n) % 20).cast("string"))
    return u.select("user_id", F.explode(F.array_distinct(F.array(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")), F.concat(F.lit("src"), ((F.col("user_id") + 7) % 20).cast("string"))))).alias("portfolio_id"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("portfolio_id"), F.concat("source", F.lit("-"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.encode("text", "UTF-8").alias("content"))


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("kind"), model.alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        (F.col("event_id") % 1000).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def prices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("price_model"), *[F.lit(v).cast("decimal(10,4)").alias(n) for n, v in zip(("p_in", "p_out", "p_read", "p_write"), p, strict=True)]) for m, *p in PRICES]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def job_attempts(spark: SparkSession, d: str) -> DataFrame:
    """job_id, seq, outcome (done, failed, running, queued), terminal, error."""
    e = table(spark, d, "events").filter("event_type in ('signup', 'view', 'purchase', 'error')")
    outcome = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), outcome.alias("outcome"), (F.col("event_id") % 97 == 0).alias("terminal"), F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"), F.col("ts").cast("timestamp").alias("at"))


def extractions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("extraction_id"), F.col("o_custkey").alias("document_id"), status.alias("status"), F.col("o_orderdate").cast("date").alias("created_at"))


#: Field of each lineitem line number, its type and the values of an enumeration.
FIELDS = (("tenant_name", "text", ()), ("unit", "text", ()), ("term_start", "date", ()), ("term_end", "date", ()), ("annual_rent_gbp", "money", ()), ("break_date", "date", ()), ("break_notice_months", "integer", ()))


def raw_values(spark: SparkSession, d: str) -> DataFrame:
    """value_id, extraction_id, seq, field_key, field_type, value_text, review_status: what an extractor said, repeats included."""
    li = table(spark, d, "lineitem")
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FIELDS]), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    day = F.date_format(F.col("l_shipdate").cast("date"), "dd/MM/yyyy")
    text = (
        F.when(F.col("key") == "tenant_name", F.concat(F.lit("Tenant "), F.col("l_suppkey").cast("string"), F.lit(" Limited")))
        .when(F.col("key") == "unit", F.concat(F.lit("Unit "), F.col("l_suppkey").cast("string")))
        .when(F.col("key").isin("term_start", "term_end", "break_date"), day)
        .when(F.col("key") == "annual_rent_gbp", F.concat(F.lit("£"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")))
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" months")))
    )
    review = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "corrected").when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending")
    return li.withColumn("key", pick(0)).select(
        F.col("l_orderkey").alias("extraction_id"), F.col("key").alias("field_key"), pick(1).alias("field_type"), text.alias("value_text"), review.alias("review_status"),
        "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_quantity").cast("int").alias("quantity"),
    )


def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """question_id, user_id, text, created_at: the user turns."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    qid = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(qid.alias("question_id"), (F.col("conv_id") % 40).alias("user_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("portfolio_id"), "text", (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(qid % 40000).cast("int"))).alias("created_at"))


_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
_KEYS = "[" + ", ".join(f"'{f[0]}'" for f in FIELDS) + "]"
_TYPES = "[" + ", ".join(f"'{f[1]}'" for f in FIELDS) + "]"

SQL = {
    "v_portfolio": "SELECT DISTINCT source AS portfolio_id, 'Portfolio ' || source AS name, source = 'src3' AS confidential FROM documents",
    "v_document": """SELECT d.doc_id AS document_id, d.source AS portfolio_id, concat_ws(' ', d.lang, d.source, d.doc_id::VARCHAR) AS title,
        d.source || '-' || d.lang || '_' || d.doc_id || '.pdf' AS filename, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'ready' END AS status,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at, d.lang
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_page": """SELECT document_id, p + 1 AS page_number, array_to_string(lines[p * 10 + 1 : p * 10 + 10], chr(10)) AS text
        FROM (SELECT document_id, lines, unnest(range(0, (len(lines) - 1) // 10 + 1)) AS p
              FROM (SELECT doc_id AS document_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "v_chunk": f"SELECT document_id * {WIDE} + page_number AS chunk_id, document_id, page_number, page_number - 1 AS ordinal, text FROM v_page",
    "v_user": "SELECT user_id, 'User ' || user_id AS full_name, CASE WHEN user_id = 0 THEN 'director' ELSE 'manager' END AS role FROM (SELECT DISTINCT user_id FROM events)",
    "v_member": """SELECT DISTINCT user_id, unnest(['src' || (user_id % 20), 'src' || ((user_id + 7) % 20)]) AS portfolio_id FROM v_user WHERE role <> 'director'""",
    "v_upload": "SELECT doc_id AS seq, source AS portfolio_id, source || '-' || lang || '_' || doc_id || '.pdf' AS filename, text AS content FROM documents",
    "v_usage": f"""SELECT event_id, user_id, event_type AS kind, ({_MODEL_LIST})[(user_id % 5 + 1)::INT] AS model, floor(value * 100)::BIGINT AS input_tokens,
        floor(value * 10)::BIGINT AS output_tokens, (event_id % 1000)::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens, ts::TIMESTAMP AS created_at FROM events""",
    "v_price": "SELECT * FROM (VALUES " + ", ".join("('" + p[0] + "', " + ", ".join(f"{x}::DECIMAL(10,4)" for x in p[1:]) + ")" for p in PRICES) + ") t(price_model, p_in, p_out, p_read, p_write)",
    "v_attempt": """SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS outcome,
        event_id % 97 = 0 AS terminal, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error, ts::TIMESTAMP AS "at"
        FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error')""",
    "v_extraction": "SELECT o_orderkey AS extraction_id, o_custkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate::DATE AS created_at FROM orders",
    "v_raw": f"""SELECT extraction_id, field_key, field_type,
        CASE WHEN field_key = 'tenant_name' THEN 'Tenant ' || l_suppkey || ' Limited' WHEN field_key = 'unit' THEN 'Unit ' || l_suppkey
             WHEN field_key IN ('term_start', 'term_end', 'break_date') THEN strftime(l_shipdate::DATE, '%d/%m/%Y')
             WHEN field_key = 'annual_rent_gbp' THEN '£' || price ELSE quantity || ' months' END AS value_text,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'corrected' WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'pending' END AS review_status,
        l_partkey, l_suppkey, price, quantity
        FROM (SELECT *, l_orderkey AS extraction_id, ({_KEYS})[((l_linenumber - 1) % 7 + 1)::INT] AS field_key, ({_TYPES})[((l_linenumber - 1) % 7 + 1)::INT] AS field_type,
              l_extendedprice::DECIMAL(12,2) AS price, l_quantity::INT AS quantity FROM lineitem)""",
    "v_question": """SELECT conv_id * 1000 + turn AS question_id, conv_id % 40 AS user_id, 'src' || (conv_id % 20) AS portfolio_id, text,
        TIMESTAMP '2024-02-01 00:00:00' + to_minutes((conv_id * 1000 + turn) % 40000) AS created_at FROM conversations WHERE role = 'user'""",
}


def sql(body: str, **more: str) -> str:
    """``body`` with the views it uses (and ``more``) before it."""
    views = {**SQL, **more}
    used: list[str] = []
    begun: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in views and name not in begun:  # a view may read itself
                begun.add(name)
                need(views[name])
                used.append(name)

    need(body)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({views[n]})" for n in used) + "\n" if used else "") + body
