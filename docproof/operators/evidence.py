"""Extraction of typed fields, their evidence, and what reviewers made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docproof.functions import text as T
from docproof.functions.parsing import parse_value


def extract_fields(chunks: DataFrame, registry: list[tuple[str, str]]) -> DataFrame:
    """document_id, field_key, value_text, quote, chunk_id, confidence: one row for each document and field.

    ``chunks``: document_id, chunk_id, ordinal, blocks. ``registry``: (field_key, pattern with its value
    as group 1, or without a group). The first chunk by ordinal that matches gives the value; every
    document is read once for all fields, and only the matches are shuffled."""
    joined = F.array_join("blocks", " ")
    rows = chunks.withColumn("__t", joined)
    found = F.array(*[F.struct(F.lit(k).alias("field_key"), F.lit(p).alias("pattern"), F.regexp_extract("__t", p, 1 if "(" in p.replace("(?:", "").replace("\\(", "") else 0).alias("value"), F.regexp_extract("__t", p, 0).alias("whole")) for k, p in registry])
    hits = rows.select("document_id", "chunk_id", "ordinal", "blocks", "__t", F.explode(F.filter(found, lambda f: f["whole"] != "")).alias("f"))
    best = hits.groupBy("document_id", "f.field_key").agg(F.min_by(F.struct("chunk_id", F.col("f.value").alias("value"), F.col("f.whole").alias("whole"), "blocks", "__t"), "ordinal").alias("b"))
    keys = F.array(*[F.lit(k) for k, _ in registry])
    every = chunks.select("document_id").distinct().select("document_id", F.explode(keys).alias("field_key"))
    start = F.instr("b.__t", F.col("b.whole"))
    return every.join(best, ["document_id", "field_key"], "left").select(
        "document_id", "field_key", T.strip(F.col("b.value")).alias("value_text"), quote_for_match(F.col("b.blocks"), start, F.length("b.whole")).alias("quote"),
        F.col("b.chunk_id").alias("chunk_id"), F.when(F.col("b").isNotNull(), "high").otherwise("low").alias("confidence"),
    )


def quote_for_match(blocks: Column, start: Column, length: Column) -> Column:
    """The blocks (joined by one space each) that a match at the 1-based ``start`` covers."""
    first = F.struct(F.lit(1).alias("at"), F.expr(T.EMPTY).alias("hit"))

    def step(acc: Column, b: Column) -> Column:
        end = acc["at"] + F.length(b)
        covered = (end > start) & (acc["at"] < start + length)
        return F.struct((end + 1).alias("at"), F.when(covered, F.concat(acc["hit"], F.array(b))).otherwise(acc["hit"]).alias("hit"))

    return F.array_join(F.aggregate(blocks, first, step, lambda a: a["hit"]), " ")


def first_answer_per_field(raw: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """One row for each extraction and field: the first answer by ``order``, or nulls where there is none."""
    rest = [c for c in raw.columns if c not in ("extraction_id", "field_key")]
    best = raw.groupBy("extraction_id", "field_key").agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("b"))
    every = raw.select("extraction_id").distinct().select("extraction_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_key"))
    return every.join(best, ["extraction_id", "field_key"], "left").select("extraction_id", "field_key", *[F.col(f"b.{c}").alias(c) for c in rest])


def quote_contains(chunk: Column, quote: Column) -> Column:
    """Whether the chunk holds the quote, whatever the case and white space; an empty quote is held."""
    q = T.fold(T.unquoted(F.coalesce(quote, F.lit(""))))
    return (q == "") | F.contains(T.fold(chunk), q)


def check_evidence(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """``values`` (document_id, chunk_id, value_text, quote, field_type) with ``issue`` and ``parsed``.

    The first that holds: no value, or a value without a chunk: no_evidence; a chunk that is not the
    document's: invalid_chunk, and the id goes; a quote that is not in the chunk: quote_not_found; a
    value that cannot be read: unparseable."""
    known = chunks.select("document_id", F.col("chunk_id"), F.col("text").alias("__chunk"), F.lit(True).alias("__known"))
    rows = values.join(known, ["document_id", "chunk_id"], "left").withColumn("parsed", parse_value(F.col("field_type"), F.col("value_text")))
    has = T.strip(F.coalesce("value_text", F.lit(""))) != ""
    foreign = F.col("chunk_id").isNotNull() & F.col("__known").isNull()
    issue = (
        F.when(~has, "no_evidence").when(foreign, "invalid_chunk").when(F.col("chunk_id").isNull(), "no_evidence")
        .when(~quote_contains(F.col("__chunk"), F.col("quote")), "quote_not_found").when(F.col("parsed").isNull(), "unparseable")
    )
    return rows.withColumn("issue", issue).withColumn("chunk_id", F.when(~foreign, F.col("chunk_id"))).drop("__chunk", "__known")


def highlight_range(text: Column, quote: Column) -> Column:
    """begin and end (0-based, end exclusive) of the first place where the quote stands in the text,
    whatever the case and white space; null where it does not."""
    words = F.filter(F.split(F.trim(quote), r"(?U)\s+"), lambda w: w != "")
    quoted = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|])", r"\\$1")), r"\s+")
    found = F.regexp_substr(text, F.concat(F.lit("(?iU)"), quoted))
    begin = F.instr(text, found) - 1
    return F.when((F.size(words) > 0) & found.isNotNull(), F.struct(begin.alias("begin"), (begin + F.length(found)).alias("end")))


def apply_reviews(values: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``values`` with review_status, corrected, reviewer after the latest review of each, and the rejected reviews.

    ``reviews``: value_id, seq, action (confirm, correct, reject), corrected_text, reviewer. A
    correction must read as the field's type; one that does not is a reject and changes nothing.
    Confirming or rejecting clears an earlier correction."""
    typed = reviews.join(values.select("value_id", "field_type"), "value_id").withColumn("corrected", F.when(F.col("action") == "correct", parse_value(F.col("field_type"), F.col("corrected_text"))))
    known = F.col("action").isin("confirm", "correct", "reject")
    bad = ~known | ((F.col("action") == "correct") & F.col("corrected").isNull())
    refused = typed.filter(bad).select("value_id", "seq", F.when(known, "unparseable").otherwise("unknown_action").alias("reason"))
    latest = typed.filter(~bad).groupBy("value_id").agg(F.max_by(F.struct("action", "corrected", "reviewer"), "seq").alias("r"))
    status = F.when(F.col("r.action") == "confirm", "confirmed").when(F.col("r.action") == "correct", "corrected").when(F.col("r.action") == "reject", "rejected").otherwise("pending")
    out = values.join(latest, "value_id", "left").withColumns({"review_status": status, "corrected": F.col("r.corrected"), "reviewer": F.col("r.reviewer")}).drop("r")
    return out, refused


def effective_value(extracted: Column, corrected: Column) -> Column:
    return F.coalesce(corrected, extracted)


def shown_value(status: Column, extracted: Column, corrected: Column, include_unreviewed: bool) -> Column:
    """What a reader sees: reviewed values; pending ones only when asked for; rejected ones never."""
    value = effective_value(extracted, corrected)
    seen = F.when(status.isin("confirmed", "corrected"), value)
    return seen.when(status == "pending", value) if include_unreviewed else seen
