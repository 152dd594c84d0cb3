"""Items are found wherever their whole text stands."""

import random

from docproof.operators import holding as H
from docproof.plans import catalog


def test_golden_items_stand_anywhere(spark, tmp_path):
    """In the middle of a sentence, without any long clause, in one word of the document, or nowhere."""
    items = [(1, "An item that stands in the middle of a sentence of its document"), (2, "one, two. three"), (3, "tem"), (4, "not there at all, whatever one reads")]
    docs = [(7, "Here begins what goes on to An item that stands in the middle of a sentence of its document and does not end"), (8, "twenty-one, two. threefold"), (9, "nothing")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(*x, "en", "src1", len(x[1])) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.eval_id: r.refused for r in catalog.QUERIES["refused_correctly"](spark, str(tmp_path)).collect()}
    assert found == {1: None, 2: None, 3: None, 4: False}
    ranks = {r.eval_id: r.doc_hit for r in catalog.QUERIES["rank_hits"](spark, str(tmp_path)).collect()}
    assert ranks == {1: True, 2: True, 3: True, 4: None}


def test_holding_by_definition(spark, monkeypatch):
    """Texts of all lengths, of few letters and of several bytes each, over pieces that end within them."""
    monkeypatch.setattr(H, "PIECE", 1 << 10)
    draw = random.Random(5)
    docs = [(i, "".join(draw.choice("abä漢 .\n") for _ in range(draw.choice((0, 1, 3, 40, 900, 5000))))) for i in range(60)] + [(60, None), (61, "")]
    items = [(0, ""), (1, None), (2, "zz"), (3, "a" * 70)]
    for i in range(4, 120):
        whole = draw.choice([t for _, t in docs if t])
        at = draw.randrange(len(whole))
        items.append((i, whole[at : at + draw.choice((1, 2, 3, 5, 20, 70, 300, 2000))]))
    rows = H.holding(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted((i, d) for i, t in items for d, whole in docs if t is not None and whole is not None and t in whole)
