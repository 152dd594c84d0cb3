"""Extracted values read as their types, as column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUOTES = "\"'“”‘’. "
# Noise around sums, and the words for yes and no.
MONEY_NOISE = r"(?i)\b(?:per annum|per year|per month|a year|p\.a\.|pa|pcm|plus vat|exclusive of vat|excluding vat|ex vat|exc vat|pounds|sterling|gbp)\b\.?"
INTEGER = r"(?i)^(\d+)\s*(?:calendar\s+)?(?:years?|yrs?|months?|mths?|weeks?|days?)?['’]?$"
TRUE = ("yes", "y", "true", "elected", "opted", "opted to tax", "has elected", "1")
FALSE = ("no", "n", "false", "not elected", "not opted", "has not elected", "0", "none")
#: Written forms of dates; in numbers alone the day comes before the month.
DATE_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d")


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; keeps plans small."""
    return F.transform(F.array(c), f)[0]


def clean(c: Column) -> Column:
    """White space folded; quotation marks, full stops and spaces taken off both ends; null if nothing is left."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    return F.nullif(F.regexp_replace(text, "^[\"'“”‘’. ]+|[\"'“”‘’. ]+$", ""), F.lit(""))


def parse_text(c: Column) -> Column:
    return clean(c)


def parse_date(c: Column) -> Column:
    """A date: an ISO prefix, else one of the day-first forms."""
    shape = (r"^\d{1,2} [A-Za-z]+ \d{4}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^[A-Za-z]+ \d{1,2} \d{4}$", r"^[A-Za-z]{3} \d{1,2} \d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$")

    def day_first(text: Column) -> Column:
        t = F.regexp_replace(text, r"(?i)(?<=\d)(?:st|nd|rd|th)\b", "")
        t = F.trim(F.regexp_replace(F.replace(t, F.lit(","), F.lit(" ")), r"(?U)\s+", " "))
        t = F.regexp_replace(F.regexp_replace(t, "(?i)^on ", ""), "(?i)^the ", "")
        # the shape decides the form, so the parser is only asked what it can read
        return let(F.initcap(F.lower(t)), lambda n: F.coalesce(*[F.when(n.rlike(s), F.try_to_date(n, f)) for s, f in zip(shape, DATE_FORMATS, strict=True)]))

    def read(text: Column) -> Column:
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}") & (F.length(text) >= 10), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        return F.coalesce(iso, day_first(text))

    return let(clean(c), read)


def parse_money(c: Column) -> Column:
    """One full number after the currency sign and the noise words are gone."""
    t = F.regexp_replace(F.replace(clean(c), F.lit("£"), F.lit(" ")), MONEY_NOISE, " ")
    t = F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), "^[ .]+|[ .]+$", "")
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))


def parse_integer(c: Column) -> Column:
    found = F.regexp_extract(clean(c), INTEGER, 1)
    return F.when(found != "", found.try_cast("long"))


def parse_bool(c: Column) -> Column:
    key = F.lower(clean(c))
    return F.when(key.isin(*TRUE), True).when(key.isin(*FALSE), False)


def parse_enum(c: Column, values: Column) -> Column:
    """The listed value that the text spells, with spaces, hyphens and slashes as underscores."""
    key = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), r"[\s\-/]+", "_"), "^_+|_+$", "")
    return F.when(F.array_contains(values, key), key)


def parse_value(kind: Column, c: Column, values: Column | None = None) -> Column:
    """The value of a field of type ``kind`` in canonical text: ISO dates, plain numbers, true/false."""
    enum = parse_enum(c, values) if values is not None else F.lit(None).cast("string")
    return (
        F.when(kind == "text", parse_text(c))
        .when(kind == "date", F.date_format(parse_date(c), "yyyy-MM-dd"))
        .when(kind == "money", parse_money(c).cast("decimal(20,2)").cast("string"))
        .when(kind == "integer", parse_integer(c).cast("string"))
        .when(kind == "bool", parse_bool(c).cast("string"))
        .when(kind == "enum", enum)
    )
