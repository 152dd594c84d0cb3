"""Postings of stems."""

import random

from pyspark.sql import functions as F

from docproof.functions.stem import stem
from docproof.functions.text import STOPWORDS
from docproof.operators import prepare as P
from docproof.plans import domain, prepare  # noqa: F401
from docproof.plans.registry import QUERIES


def test_stemmed_postings_by_definition(spark, monkeypatch):
    """Rows that share an id, also none, are one chunk; texts may be empty or missing."""
    monkeypatch.setattr(P, "STEMMED", 7)
    monkeypatch.setattr(P, "KNOWN", 10)
    draw = random.Random(3)
    words = "the lease leases leased Leasing tenant tenants of rent rented renting 12 a hopping hopped nationalities".split()
    rows = [(draw.choice((None, 1, 2, *range(3, 60))), draw.choice((None, "", " ".join(draw.choices(words, k=draw.randrange(40)))))) for _ in range(90)]
    want: dict = {}
    for i, t in rows:
        for at, w in enumerate((t or "").lower().split(), 1):
            if w not in STOPWORDS:
                want.setdefault((i, stem(w)), set()).add(at)
    got = P.stemmed_postings(spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)).collect()
    assert sorted(((r.chunk_id, r.lexeme), tuple(r.positions)) for r in got if r.chunk_id is not None) == sorted((k, tuple(sorted(v))) for k, v in want.items() if k[0] is not None)
    assert {r.lexeme: set(r.positions) for r in got if r.chunk_id is None} == {k[1]: v for k, v in want.items() if k[0] is None}


def test_lexemes_english_shuffles_no_postings(spark, monkeypatch):
    """Postings are aggregated in the branch of chunks that share an id only."""
    rows = spark.range(2000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id").cast("string")) for w in ("lease", "tenant", "renting")]).alias("text"))
    monkeypatch.setattr(domain, "chunks", lambda spark, d: rows)
    found = QUERIES["lexemes_english"](spark, "none")
    assert found.count() == 6000
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1
