"""The source audit against brute force, its transducers against sorted lists, edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docproof.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, block int"
UNIT = 1_000_000_000


def brute(rows, least=3, most=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for text, lang, source in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in docs:
        df[lang].update(set(found))
        count[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = {}
        for s in sources:
            n = sum(count[lang, s][t] for t in kept)
            share[s] = {t: 1 + UNIT * (count[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        total = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        n = sum(total.values())
        whole = {t: 1 + UNIT * (total[t] + 1) // (n + len(kept)) for t in kept}
        for s in sources:
            f = lambda p, q: (p - q) * (p - q) // q
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            told = sorted((-f(share[s][t], whole[t]), t.encode()) for t in kept if count[lang, s][t] and share[s][t] > whole[t])[:most]
            for part, found in (("pair", pairs), ("term", told)):
                out += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def fixture(seed):
    r = random.Random(seed)
    words = ["été", "Éa", "naïve", "ünder", "日本語", "𝔘𝔫", "a", "A", "aB", "ab", "abc", "abd", "b", "zz", "don't", "x1y2", "q" * 300] + ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(150)]
    rows = []
    for _ in range(240):
        own = r.sample(words, 40)
        text = r.choice([" ", "\n", "1", "_", "\x00", ", "]).join(r.choice(own) for _ in range(r.randint(0, 60)))
        rows.append((text, r.choice(["en", "en", "en", "fr", None, "日"]), r.choice(["s1", "s1", "s1", "S2", "s3", "é", "", None, "s4", "s5", "s6"])))
    rows += [rows[0]] * 30 + [(None, "en", "nothing"), (None, None, None), ("", "xx", "alone"), ("one two", "yy", "a"), ("two", "yy", "b"), (" ".join(words * 40), "en", "long")]
    return rows


@pytest.mark.parametrize("small", [{}, {"shard": 13, "block": 7, "tile": 2}])
def test_audit_matches_brute_force(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(divergence, "PASS", 2)
    rows = fixture(3)
    df = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = divergence.audit(df, **small)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows)
    assert {x[2] for x in want} == {"pair", "term"} and sorted(tuple(x) for x in got.collect()) == want


def test_few_ranks_and_rare_terms(spark):
    rows = fixture(4)
    df = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(rows)], SCHEMA)
    assert sorted(tuple(x) for x in divergence.audit(df, least=20, most=3).collect()) == brute(rows, 20, 3)


def test_no_rows_and_no_terms(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", "en", "x", "", 1, 1), (None, None, "en", "y", "", 1, 1)], SCHEMA)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_transducer_gives_places_and_is_minimal():
    r = random.Random(1)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(300)})
    made = divergence.minimal(words)
    asked = words + [b"", b"abcabca", b"d", b"ab\xff"] + [w + b"c" for w in words]
    a = pa.array(asked, pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[: len(asked) + 1]
    got = divergence.walked(made, np.frombuffer(a.buffers()[2], np.uint8), off[:-1], np.diff(off)).tolist()
    assert got == [words.index(w) if w in words else -1 for w in asked]
    # Minimal: as many states as there are different sets of what may follow a prefix.
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(made[3]) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
