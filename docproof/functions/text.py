"""Text functions as column expressions: whitespace, sentences, tokens, lexemes, folding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The words that carry no content.
STOPWORDS = """
    a about above after again all also am an and any are as at be because been
    before being below between both but by can could d did do does doing down
    during each few for from further had has have having he her here hers him
    his how i if in into is it its itself just ll m may me more most must my no
    nor not of off on once only or other our ours out over own re s same shall
    she should so some such t than that the their theirs them then there these
    they this those through to too under until up ve very was we were what when
    where which while who whom why will with would you your yours
""".split()

# White space within a line, where a sentence ends, and what is a label alone.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "[ \\t\\f\\x0B\\u00A0]+"
BOUNDARY = "(?<=[.!?;:])(?U)\\s+(?=[A-Z0-9(£\"'“‘])"
LABEL = r"(?:\(?\d+(?:\.\d+)*[.)]?|\([a-z]{1,4}\)|[A-Za-z][.)])"
LABEL_ONLY = f"^{LABEL}$"
EMPTY = "cast(array() as array<string>)"


def strip(c: Column) -> Column:
    """Without white space of any alphabet at both ends."""
    return F.btrim(c, F.lit(WHITE))


def normalise(text: Column) -> Column:
    """Lines joined into paragraphs by spaces, paragraphs (set apart by blank lines) by one line feed."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), SPACES, " ")
    lines = F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")
    paragraphs = F.filter(F.split(lines, "\n{2,}", -1), lambda p: p != "")
    whole = F.transform(paragraphs, lambda p: F.array_join(F.filter(F.split(p, "\n", -1), lambda x: x != ""), " "))
    return F.array_join(F.filter(whole, lambda p: p != ""), "\n")


def split_sentences(text: Column) -> Column:
    """Sentence blocks; a label on its own goes to the piece after it in its line, or stays if it is last."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")

    # Lines hold no line feed, so one can mark where a piece ends; a mark behind a label goes again.
    def pieces(line: Column) -> Column:
        marked = F.regexp_replace(line, BOUNDARY, "\n")
        return F.split(F.regexp_replace(marked, f"(^|\n)({LABEL})\n", "$1$2 "), "\n", -1)

    return F.flatten(F.transform(lines, pieces))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def content_tokens(text: Column) -> Column:
    """Lower-cased words and numbers without stop words, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def lexemes(text: Column) -> Column:
    """array<struct<lexeme, position>> of the 'simple' configuration: positions count every word from 1."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    placed = F.transform(found, lambda t, i: F.struct(t.alias("lexeme"), (i + 1).cast("int").alias("position")))
    return F.filter(placed, lambda p: ~p["lexeme"].isin(STOPWORDS))


def fold(text: Column) -> Column:
    """For comparison: lower case, runs of white space as one space."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def unquoted(text: Column) -> Column:
    """Without quotation marks and white space around."""
    return F.regexp_replace(text, "^[\\s\"'“”‘’]+|[\\s\"'“”‘’]+$", "")


def title_from_filename(filename: Column) -> Column:
    """A readable title: base name without its last extension, joining - and _ as spaces, lower-case words capitalised."""
    name = F.regexp_replace(F.regexp_replace(filename, r"[/\\]+$", ""), r"^.*[/\\]", "")
    stem = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    parts = F.filter(F.split(F.regexp_replace(stem, r"(?U)(?<=\w)[-_]+(?=\w)", " "), r"(?U)\s+", -1), lambda w: w != "")
    lower = lambda w: (w == F.lower(w)) & (F.upper(w) != w)
    titled = F.array_join(F.transform(parts, lambda w: F.when(lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)), " ")
    return F.substring(F.coalesce(F.nullif(titled, F.lit("")), F.nullif(name, F.lit("")), F.lit("Untitled")), 1, 255)
