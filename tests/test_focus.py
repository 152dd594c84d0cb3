"""Focus of questions: against its definition with lexemes of any frequency, and what frequent ones cost."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docproof.operators import retrieval as R

IDENTITY = "document_id long, portfolio_id string, lexeme string, named boolean"


def by_definition(lexemes, identities, documents, asked):
    terms, focus = set(), set()
    for q in {q for q, _, _ in lexemes}:
        view = {p for k, p in asked if k == q}
        docs = sum(p in view for _, p in documents)
        df = Counter(x for _, p, x, _ in identities if p in view)
        own = {x for k, x, _ in lexemes if k == q and 0 < df[x] <= max(1, int(docs * 0.34))}
        if len(own) < 2:
            continue
        terms |= {(q, x) for x in own}
        score = Counter()
        for d, p, x, named in identities:
            if p in view and x in own:
                score[d] += 2 if named else 1
        best = max(score.values(), default=0)
        top = [d for d in score if score[d] == best]
        if best >= 2 and len(top) <= 4 and len(top) < docs:
            focus |= {(q, d, best) for d in top}
    return terms, focus


def frames(spark, lexemes, identities, documents, asked):
    return (
        spark.createDataFrame(lexemes, "question_id long, lexeme string, first int"),
        spark.createDataFrame(identities, IDENTITY),
        spark.createDataFrame(documents, "document_id long, portfolio_id string"),
        spark.createDataFrame(asked, "question_id long, portfolio_id string"),
    )


@pytest.mark.parametrize("rare,salts,direct", [(0, 3, 0), (2, 1, 0), (5, 4, 0), (64, 32, 10_000)])
def test_focus_by_definition(spark, rare, salts, direct):
    r = random.Random(rare)
    documents = [(d, f"p{d % 3}") for d in range(90)]
    identities = sorted({(d, p, f"w{int(r.paretovariate(0.5))}"): r.random() < 0.4 for d, p in documents for _ in range(8)}.items())
    identities = [(*k, named) for k, named in identities] + [(d, p, "all", True) for d, p in documents] + [(d, p, "third", d % 2 == 0) for d, p in documents if d % 3 == 1 or d < 6]
    words = ["all", "third", *(f"w{i}" for i in range(1, 40))]
    lexemes = [(q, x, i) for q in range(60) for i, x in enumerate(r.sample(words, r.randint(1, 9)))]
    asked = [(q, f"p{i}") for q in range(60) for i in range(3) if q % 4 or i == q % 3]
    some = frames(spark, lexemes, identities, documents, asked)
    want_terms, want = by_definition(lexemes, identities, documents, asked)
    terms = R.identifying_terms(*some).cache()
    assert {(t.question_id, t.lexeme) for t in terms.collect()} == want_terms
    got = [tuple(x) for x in R.focus_documents(terms, *some[1:], rare=rare, salts=salts, direct=direct).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_frequent_lexemes_are_not_joined_where_rarer_ones_decide(spark, monkeypatch):
    """A third of 3,000 documents begins with 'lease'; 200 questions ask for the lease of one document each."""
    documents = [(d, "p") for d in range(3000)]
    identities = [(d, "p", f"n{d}", True) for d in range(3000)] + [(d, "p", f"m{d // 3}", False) for d in range(3000)] + [(d, "p", "lease", False) for d in range(1000)] + [(d, "p", "file", True) for d in range(3000)]
    lexemes = [(q, x, i) for q in range(200) for i, x in enumerate(["lease", "file", f"n{q * 7}", f"m{q * 7 // 3}"])]
    some = frames(spark, lexemes, identities, documents, [(q, "p") for q in range(200)])
    terms, rows, write = R.identifying_terms(*some), [], R.written
    assert terms.filter("lexeme = 'file'").isEmpty() and terms.filter("lexeme = 'lease'").count() == 200

    def counted(df):
        rows.append((out := write(df)).count())
        return out

    monkeypatch.setattr(R, "written", counted)
    focus = R.focus_documents(terms, *some[1:], direct=0)
    assert {(f.question_id, f.document_id) for f in focus.collect()} == {(q, q * 7) for q in range(200)}
    assert focus.agg(F.min("score")).first()[0] >= 3
    assert max(rows) <= 800  # the terms; joined as it is, 'lease' alone gives 200,000 rows


def test_focus_of_nothing(spark):
    some = frames(spark, [], [], [], [])
    assert R.focus_documents(R.identifying_terms(*some), *some[1:]).isEmpty()
