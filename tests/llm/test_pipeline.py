"""Each stage of the corpus pipeline against a brute-force version of what it is given."""

import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from docproof.llm import mixing, packing, quality

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def first_of_copies(rows):
    """Ids that stay: the smallest of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {i for i, r in root.items() if i == r}


def without_repeats(rows, length=100):
    """Texts without the characters all of whose bytes are in a string that starts earlier too."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        kept, at = [], 0
        for c in r.text or "":
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept.append(c)
            at += size
        out[r.doc_id] = "".join(kept)
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, columns = spark.read.parquet(f"{SF}/labels.parquet"), docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeats", "mix", "pack"]

    good = stages["quality"](spark, docs, SF).cache()
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5} and good.count() < docs.count()

    first = stages["near_copies"](spark, good, SF).cache()
    want, kept = first_of_copies(good.collect()), {r.doc_id for r in first.collect()}
    assert want <= kept and len(kept - want) <= 0.1 * (good.count() - len(want)) and first.count() < good.count()

    cut = stages["repeats"](spark, first, SF).cache()
    assert {r.doc_id: r.text for r in cut.collect()} == without_repeats(first.collect())

    mixed = stages["mix"](spark, cut, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.plan(cut).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    packed = stages["pack"](spark, mixed, SF)
    rows = packed.collect()
    sizes = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == sizes
    lengths, counts = np.unique([n for (_, n), c in sizes.items() for _ in range(c)], return_counts=True)
    bounds = packing.boundaries(lengths, counts, 8)
    assert all(r.pad_to == min(b for b in bounds if b >= r.n_tokens) for r in rows)
    assert all(docs_.columns == columns for docs_ in (good, first, cut, mixed))
