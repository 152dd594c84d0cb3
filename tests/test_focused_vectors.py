"""Nearest passages among those of a question's documents."""

import numpy as np
from pyspark.sql import functions as F

from docproof.operators import nearest as N, retrieval as R


def test_focused_by_definition(spark, monkeypatch):
    """Parts of a document, documents of several questions, ties, vectors missing, of no length and of another size."""
    monkeypatch.setattr(N, "FOCUSED", 3)
    monkeypatch.setattr(N, "HELD", 20)
    draw = np.random.default_rng(4)
    vec = lambda: [float(x) for x in draw.integers(-3, 4, 4)]
    asked = [(i, None if i == 5 else [0.0] * 4 if i == 6 else vec()) for i in range(24)]
    focus = [(i, d) for i in range(24) for d in {int(x) for x in draw.integers(0, 4, 2)}]
    held = [(1000 + i, int(draw.integers(0, 6)), None if i % 50 == 3 else [0.0] * 4 if i % 50 == 4 else [1.0] * 3 if i % 50 == 5 else vec()) for i in range(400)]
    rows = R.vector_top_n_focused(
        spark.createDataFrame(asked, "question_id long, embedding array<float>"), spark.createDataFrame(focus, "question_id long, document_id long"),
        spark.createDataFrame(held, "chunk_id long, document_id long, embedding array<float>"), 7,
    )
    want = []
    for i, q in asked:
        near = [(float(np.round(1 - np.dot(q, v) / np.sqrt(np.dot(q, q) * np.dot(v, v)), 9)), c) for c, d, v in held if (i, d) in set(focus) and q and any(q) and v and any(v) and len(v) == 4]
        want += [(i, c, d, r) for r, (d, c) in enumerate(sorted(near)[:7], 1)]
    assert sorted((r.question_id, r.chunk_id, r.distance, r.vector_rank) for r in rows.collect()) == sorted(want)


def test_focused_pairs_are_no_rows(spark):
    """Four million pairs of one document, with another column to meet on."""
    rows = spark.range(4000).select(F.col("id").alias("chunk_id"), F.lit(1).alias("document_id"), F.lit("p").alias("portfolio_id"), F.array(*[F.cos(F.col("id") * (i + 1)).cast("float") for i in range(16)]).alias("embedding"))
    asked = rows.filter("chunk_id < 1000").select(F.col("chunk_id").alias("question_id"), "embedding")
    focus = asked.select("question_id", F.lit(1).alias("document_id"), F.lit("p").alias("portfolio_id"))
    found = R.vector_top_n_focused(asked, focus, rows, 1, ["document_id", "portfolio_id"])
    assert "CoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 1000
