"""Nulls, empty tables, repeated rows, ties and clashing columns for every operator and stage."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docproof.llm import chat, embeddings, labelled, mixing, neighbours, packing, passages, quality, simhash, suffixes, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, __h int, size string, component string"
random.seed(4)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"]


def prose(n):
    return " ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(n))


LONG = prose(3000)
PASSAGE = prose(80)
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "  \n ", None, "b", 4), (4, LONG, "en", "a", len(LONG)), (5, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "a", len(LONG)), (None, prose(30), "en", "b", 9), (None, None, None, None, None), (6, PASSAGE + " " + prose(40), "en", "b", 1),
    (7, prose(20) + " " + PASSAGE, "en", "c", 1), (8, "é" * 150, "fr", "c", 150), (9, "é" * 150 + "x", "fr", "c", 151), (10, "one", "en", "a", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, i, "s", "c") for i, r in enumerate(ROWS)], DOC)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(docs, none):
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = [fingerprint(r[1]) for r in ROWS]
    assert sorted((i or -1, f) for i, f, _ in got) == sorted((r[0] or -1, f) for r, f in zip(ROWS, fps))
    comp = {}
    for r, f in zip(ROWS, fps):
        near = {g for g in fps if (f ^ g).bit_count() <= 4}
        comp[f] = min(q[0] for q, g in zip(ROWS, fps) if g in near and q[0] is not None) if any(g in near and q[0] for q, g in zip(ROWS, fps)) else None
    assert all(c == comp[f] for _, f, c in got)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 6, 7, None} and 5 not in {r.doc_id for r in kept.collect()}


def near_sets(text, k=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("bucket", [2048, 16])
def test_keep_first_matches_brute_force(spark, bucket, monkeypatch):
    # near copies of several similarities, a family of texts from one template, one large group of copies
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    word = lambda: f"{rng.choice(WORDS)}{rng.randrange(300)}"
    rows, frame = [], [word() for _ in range(60)]
    for i in range(60):
        base = [word() for _ in range(rng.randrange(40, 200))]
        rows.append((len(rows), " ".join(base)))
        for share in (0.01, 0.03, 0.12):
            rows.append((len(rows), " ".join(word() if rng.random() < share else w for w in base)))
    rows += [(len(rows) + i, " ".join(frame[:40] + [word() for _ in range(25)])) for i in range(40)]
    rows += [(500 + i, " ".join([*frame, f"tail{i}"])) for i in range(60)] + [(900, None), (901, ""), (None, rows[0][1]), (902, "one two"), (903, "One  two"), (904, "one two three")]
    sets = {i: near_sets(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    want = {i for i, r in root.items() if i == r}
    kept = [r.doc_id for r in simhash.keep_first(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, id string").repartition(5)).collect()]
    assert kept.count(None) == 1 and len(kept) == len(set(kept))
    kept = set(kept) - {None}
    gone, expected = set(sets) - kept, set(sets) - want
    assert gone <= expected and len(gone) >= 0.9 * len(expected), (len(gone), len(expected))


@pytest.mark.parametrize("bucket", [2048, 4])
def test_keep_first_joins_groups_through_later_texts(spark, bucket, monkeypatch):
    # the last text of a family is like four texts that are alike, and like one more that is like no other
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    if bucket < 16:  # one bucket that holds all nodes
        monkeypatch.setattr(simhash, "sampled_tables", lambda n: (0, np.arange(64)[None, :]))
        monkeypatch.setattr(simhash, "TILE", 16)
    rng, rows = random.Random(5), []
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    for k in range(30):
        text, end = fresh(150), fresh(6)
        rows.append((10 * k, fresh(11) + text[11:]))
        rows += [(10 * k + 1 + i, text[: 144 - i] + fresh(i) + end) for i in range(4)]
        rows.append((10 * k + 9, text))
    sets = {i: {tuple(w[x : x + 5]) for x in range(len(w) - 4)} for i, w in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    kept = [r.doc_id for r in simhash.keep_first(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()]
    assert set(root.values()) == {10 * k for k in range(30)} and sorted(kept) == sorted(set(root.values()))


@pytest.mark.parametrize("tile", [512, 32])
def test_a_large_group_of_candidates_gives_few_rows(spark, tile, monkeypatch):
    # 300 texts whose fingerprints are near and whose shingles are not near enough, and 60 pairs among them that are
    monkeypatch.setattr(simhash, "CLOSE", tile)
    monkeypatch.setattr(simhash, "TILE", 4 * tile)
    rng, made, settled = random.Random(8), [], simhash.settled
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    frame = fresh(110)
    rows = [(i, frame + fresh(16)) for i in range(300)]
    rows += [(1000 + i, [*w[:-3], *fresh(3)]) for i, w in rows[:60]]
    sets = {i: near_sets(" ".join(w)) for i, w in rows}
    near = {b for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near == set(range(1000, 1060))

    def counted(df):
        made.append(settled(df))
        return made[-1]

    monkeypatch.setattr(simhash, "nearest", lambda buckets, radius, most: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(simhash, "settled", counted)
    monkeypatch.setattr(simhash, "dropped", lambda *tables: None)
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(6)).collect()}
    assert set(range(300)) <= kept and len(kept) <= 303
    assert max(t.count() for t in made) <= 30 * len(rows)


def test_close_pairs_match_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fp = np.concatenate([base[rng.integers(0, 20, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), rng.integers(0, 2**63, 200, dtype=np.uint64)])
    rng.shuffle(fp)
    starts = np.array([0, 1, 70, 130, 400])
    asks = rng.random(400) < 0.3
    want = {(i, j) for a, b in zip(starts, starts[1:]) for i in range(a, b) for j in range(i + 1, b) if asks[j] and int(fp[i] ^ fp[j]).bit_count() <= 14}
    assert {p for i, j in simhash.close_pairs(fp, starts, 14, asks) for p in zip(i.tolist(), j.tolist())} == want
    for radius in (0, 3, 4, 7, 12):
        got = {p for i, j in simhash.close_pairs(fp, starts, radius) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for a, b in zip(starts, starts[1:]) for i in range(a, b) for j in range(i + 1, b) if int(fp[i] ^ fp[j]).bit_count() <= radius}


def removed(rows, length=100):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        d = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(b), int(gone.sum()), int((d == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [16384, 5])
def test_suffixes_match_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    parts = [prose(random.randint(15, 50)) for _ in range(6)]
    rows = [(i, " ".join(random.choice(parts)[random.randint(0, 30) :] + " " + prose(random.randint(0, 8)) for _ in range(random.randint(0, 4)))) for i in range(80)]
    rows += [(80, "ab" * 200), (81, "a" * 99), (82, "a" * 100), (83, "a" * 300), (84, "é" * 120), (85, None), (86, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == removed(rows)


def test_rows_without_id_are_told_apart(spark):
    # a text with a passage of another document and one of its own, whose hashes agree in their last 20 bits
    tail = lambda x: xxhash.xxh64_intdigest(x.encode(), 42) % (1 << 20)
    shared, own = prose(60), prose(120)
    one = {tail(x): x for x in (f"{i} {shared}" for i in range(5000))}
    other = next(x for x in (f"{i} {own}" for i in range(5000)) if tail(x) in one)
    rows = [(1, shared + " end"), (None, one[tail(other)]), (None, other)]
    got = {r.kept_sha256: r.n_removed for r in suffixes.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[hashlib.sha256(other.encode()).hexdigest()] == 0 and sorted(got.values())[-1] >= len(shared)


def test_many_rows_without_id_lose_nothing_of_their_own(spark):
    rng = random.Random(8)
    rows = [(None, " ".join(f"w{rng.randrange(10**9)}" for _ in range(14))) for _ in range(4000)]
    rows += [(None, rows[0][1])] * 3  # equal texts are one document
    out = suffixes.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert out.filter("n_removed > 0").count() == 0 and out.count() == len(rows)


@pytest.mark.parametrize("shard", [16384, 4])
def test_suffixes_of_a_hot_gram_match_brute_force(spark, shard, monkeypatch):
    # one line in every text, in unlike and in shared surroundings, some of it in a row without its own id
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "CUT", 50)
    rng = random.Random(9)
    word = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    line, around = "the same line stands in each and every one of these texts", [word(12) for _ in range(5)]
    rows = [(i, f"{word(5)} {rng.choice(around)[: rng.randrange(90)]} {line} {rng.choice(around)[: rng.randrange(90)]} {word(4)}") for i in range(150)]
    rows += [(200, line * 4), (201, f"{around[0]} {line}\0{line} {around[0]}"), (202, "\0" * 250)]
    found = suffixes.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == removed(rows)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = prose(60), prose(60)
    rows = [(1, a), (1, b), (1, a), (2, a + " " + b), (None, "x" + a)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, len(a)] == 0 and got[1, len(b)] == 0 and got[2, len(a) + len(b) + 1] >= len(a) + len(b) and got[None, len(a) + 1] == len(a)


def test_suffix_edges(docs, none):
    rows = suffixes.removal(docs).collect()
    assert len(rows) == len(ROWS)
    five = [r for r in rows if r.doc_id == 5]
    assert len(five) == 2 and all(r.n_removed == r.n_bytes for r in five)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    nine = next(r for r in out.collect() if r.doc_id == 9)
    assert set(nine.text) <= {"é", "x"} and nine.n_chars == len(nine.text)
    assert suffixes.without_repeats(none).count() == 0 and suffixes.removal(none).count() == 0


def test_passages(docs, none):
    rows = passages.classes(passages.near_passages(docs)).collect()
    pairs = {(r.doc_id, r.match_id) for r in rows}
    assert (5, 4) in pairs and (7, 6) in pairs and not any(1 in p or 2 in p or 3 in p for p in pairs)
    assert passages.classes(passages.near_passages(none)).count() == 0


@pytest.mark.parametrize("many", [16, 2])
def test_equal_passages_match_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(passages, "MANY", many)
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, copied = fresh(12), [fresh(60) + " " for _ in range(4)]
    # a frequent line in unlike texts, and passages around the line that only some later texts share
    rows = [(0, f"{fresh(70)} {line} {fresh(70)} {copied[0]}{line} {copied[1]} {fresh(30)}")]
    for i in range(1, 60):
        inner = f"{copied[i % 4]}{line} {copied[(i + 1) % 4]}" if i % 3 == 0 else f"{fresh(50)} {line} {fresh(50)}"
        rows.append((i, f"{fresh(rng.randrange(60))} {inner} {fresh(rng.randrange(60))} {copied[i % 4] if i % 7 == 0 else ''}"))
    seen, want = set(), {}
    for i, text in rows:
        w = text.split()
        grams = [" ".join(w[p : p + 50]) for p in range(len(w) - 49)]
        want[i] = {p for p, g in enumerate(grams) if g in seen}
        seen |= set(grams)
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert all(r.match_id < r.doc_id for r in found) and sum(map(len, want.values())) > 500
    for i, places in want.items():
        mine = [(r.first_word, r.last_word) for r in found if r.doc_id == i]
        assert all(any(a <= p and p + 49 <= b for a, b in mine) for p in places), i
    text = dict((i, t.split()) for i, t in rows)
    for r in found:
        if r.similarity == 1.0 and r.last_word - r.first_word == r.match_last_word - r.match_first_word:
            assert text[r.doc_id][r.first_word : r.last_word + 1] == text[r.match_id][r.match_first_word : r.match_last_word + 1]


def jaccard(a, b, size=5):
    a, b = ({tuple(x[i : i + size]) for i in range(len(x) - size + 1)} for x in (a, b))
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("edits", [0, 1])
def test_passages_of_common_sentences_are_found(spark, edits):
    # 150 pairs of texts share a passage, with an edit or none, of sentences that all texts draw from
    rng = random.Random(3 + edits)
    pool = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.randrange(9, 15))) for _ in range(30)]
    fresh = lambda n: " ".join(f"u{rng.randrange(10**7)}" for _ in range(n))
    rows, pairs = [], []
    for i in range(150):
        passage = " ".join(rng.sample(pool, 7)).split()[:84]
        other = list(passage)
        for _ in range(edits):
            other[rng.randrange(10, 74)] = f"edit{i}"
        pairs.append((2 * i, 2 * i + 1))
        rows += [(j, f"{fresh(30)} {' '.join(rng.sample(pool, 2))} {fresh(9)} {' '.join(p)} {fresh(40)}") for j, p in zip(pairs[-1], (passage, other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in passages.near_passages(df.repartition(1)).collect()]
    hit = {(r[1], r[0]) for r in found if r[3] - r[2] >= 49}
    assert sum(p in hit for p in pairs) >= (150 if not edits else 135)
    text = {i: t.split() for i, t in rows}
    for doc, match, a, b, c, d, s in found:
        assert match < doc and b - a >= 49 and jaccard(text[doc][a : b + 1], text[match][c : d + 1]) >= 0.8 - 1e-9
    for parts in (8, 40):
        assert sorted(found) == sorted(tuple(r) for r in passages.near_passages(df.repartition(parts)).collect())


def test_edited_passages_around_a_very_common_stretch_are_found(spark, monkeypatch):
    # 46 words that all texts have are no passage; with fresh words on either side that two texts share they are,
    # and an early edit leaves what is beside most least shingles the same in all texts
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    common, rows, sides = fresh(46), [(i, fresh(20)) for i in range(100)], {}
    rows = [(i, " ".join(w + common + fresh(30))) for i, w in rows]
    for i in range(100, 260, 2):
        passage = fresh(4) + common + fresh(4)
        other = [*passage[:6], f"edit{i}", *passage[7:]]
        sides[i] = passage, other
        rows += [(i + k, " ".join([*fresh(25), *p, *fresh(35)])) for k, p in enumerate(sides[i])]
    salt = np.random.default_rng(5).integers(1, 1 << 63, 1, dtype=np.uint64)[0]

    def least_hash(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return int(passages.mixed(passages.shingles(data, np.array([0, len(data)]), 5)[0] ^ salt).min())

    agree = {i for i, (p, q) in sides.items() if least_hash(p) == least_hash(q)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in passages.near_passages(df.repartition(7), hashes=1).collect()]
    hit = {(r[1], r[0]) for r in found if r[3] - r[2] >= 52}
    assert len(agree) > 50 and all((i, i + 1) in hit for i in agree)
    assert all(m >= 100 and d == m + 1 and s >= 0.8 for d, m, *_, s in found)
    monkeypatch.setattr(passages, "TILE", 16)
    assert sorted(found) == sorted(tuple(r) for r in passages.near_passages(df, hashes=1).collect())


def test_classes_of_near_passages_that_many_texts_have_come_without_all_pairs(spark, monkeypatch):
    # three passages, each in 40 texts with a word of its own in the middle, so no 50 words of two texts are equal
    rng = random.Random(17)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    sources = [fresh(60) for _ in range(3)]
    rows = [(i, " ".join(fresh(20) + sources[i % 3][:30] + fresh(1) + sources[i % 3][31:] + fresh(20))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.classes(passages.near_passages(df)).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i % 3 for i in range(3, 120)}
    assert len({(r.doc_id, r.match_id) for r in found}) <= 6 * len(rows)  # of 2340
    # what the first candidates of each window do not connect is compared in all pairs
    monkeypatch.setattr(passages, "_first_candidates", lambda near: near.select(*passages._names(passages.CANDIDATES)).limit(0))
    found = passages.classes(passages.near_passages(df)).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i % 3 for i in range(3, 120)}


def test_copies_of_passages_and_shared_ids(spark):
    p, q = prose(90), prose(90)
    rows = [(3, p), (1, p), (2, p), (2, q), (4, q + " " + prose(20)), (None, p), (5, "a " * 400), (6, "a " * 400 + "b")]
    found = {(r.doc_id, r.match_id, r.similarity) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(2, 1, 1.0), (3, 1, 1.0), (4, 2, 1.0), (6, 5, 1.0)} <= found and all(a != b for a, b, _ in found)


def test_a_stretch_of_a_candidate_is_compared_once(monkeypatch):
    # 40 candidates have 60 shingles of the other text, which has as many others among them
    rng, compared, jaccard_of = np.random.default_rng(3), [], passages._jaccard
    whole = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    whole[50:170:2] = whole[200:260]  # so the other side is twice as long as what it has in common
    mine = [np.concatenate([rng.integers(0, 1 << 32, 20, dtype=np.uint32), whole[50:170:2]]) for _ in range(40)]
    near = np.concatenate([whole[2:35], rng.integers(0, 1 << 32, 3, dtype=np.uint32), whole[38:50]])
    rows = [(0, 0, 0, 0, -1, 0, 0, 0, 0, 0, whole)] + [(0, 0, 0, 1, 1 + i, 30, 60, 0, 0, 80, x) for i, x in enumerate(mine)] + [(0, 0, 0, 1, 90, 2, 0, 0, 0, 48, near)]
    columns = list(zip(*[(*r[:-1], r[-1].tobytes()) for r in rows]))
    kinds = ("int64", "int64", "int32", "int32", "int64", *["int32"] * 5, "binary")
    t = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in passages.PIECES.split(", ")])
    monkeypatch.setattr(passages, "_jaccard", lambda *x: compared.append(1) or jaccard_of(*x))
    found = [r for b in passages._verified(5, 50, 0.8)(t, np.array([0, len(rows)])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["first_word"], r["last_word"], r["match_first_word"], r["match_last_word"]) for r in found] == [(90, 0, 51, 2, 53)]
    assert 40 <= len(compared) <= 7 * 41

    own = [rng.integers(0, 9, n, dtype=np.uint32) for n in (5, 0, 30)]
    other, begin, end = rng.integers(0, 20, 25, dtype=np.uint32), np.array([3, 0, 24]), np.array([9, 25, 60])
    match, cut = passages._known(own, other, begin, end)
    assert match.tolist() == [x in other[a:b] for o, a, b in zip(own, begin, end) for x in o] and cut.tolist() == [0, 5, 5, 35]


def test_compact_windows_partition_all_stretches():
    for t in range(60):
        n, least = random.randint(0, 40), random.randint(1, 6)
        h, cut = np.array([random.randint(0, 9) for _ in range(n)], np.uint64), sorted({0, n, random.randint(0, n)})
        w = list(zip(*passages.compact_windows(h, np.array(cut), least)))
        for a, b in zip(cut, cut[1:]):
            for x in range(a, b):
                for y in range(x + least - 1, b):
                    cover = [c for lo, c, hi in w if lo <= x <= c <= y <= hi]
                    assert len(cover) == 1 and h[cover[0]] == h[x : y + 1].min()


def test_mixing(docs, none, spark):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(ROWS) and all(r.copies <= 2 for r in rows)
    total = sum(len(re.findall(r"\S+", r[1] or "")) for r in ROWS)
    per = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in per.values()) - 1.5 * total) < 1e-6 * max(total, 1) and all(t <= 2 * s + 1e-9 for t, s in per.values())
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in rows)
    assert mixing.plan(none).count() == 0 and mixing.emit(none).count() == 0
    clash = docs.withColumns({"copies": F.lit("x"), "copy": F.lit("y"), "__copies": F.lit("z")})
    assert mixing.emit(clash).columns == clash.columns and mixing.emit(clash).count() == emitted.count()
    want, cap = {"a": 0.0}, {r.source: 2.0 * r.source_size for r in mixing.plan(docs).select("source", "source_size").distinct().collect()}
    weight, stopped = dict(zip(sorted(cap, key=lambda s: (s is None, s or "")), [5, 2, 1, 5])), set()
    while True:  # shares by weight, what is above a limit goes to the others
        level = (1.5 * total - sum(cap[s] for s in stopped)) / sum(w for s, w in weight.items() if s not in stopped)
        more = {s for s in cap if s not in stopped and weight[s] * level > cap[s]}
        if not more:
            break
        stopped |= more
    want = {s: cap[s] if s in stopped else weight[s] * level for s in cap}
    assert all(abs(want[s] - t) < 1e-9 for s, (t, _) in per.items())
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), 20).alias("text"))
    for r in mixing.plan(even).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect():
        assert abs(r.n / r.t - 1) < 0.1


def test_packing(docs, none):
    clash = docs.withColumns({"batch": F.lit("kept"), "h": F.lit(1), "Slot": F.lit(2), "n_tokens": F.lit(3)})
    out = packing.pack_documents(clash, buckets=3, budget=64)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {"__h", "h", "input_batch", "input_Slot", "input_n_tokens", "size"} <= set(out.columns)
    assert all((r.input_batch, r.h, r.input_Slot, r.input_n_tokens) == ("kept", 1, 2, 3) for r in rows)
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS)
    assert sorted(r.n_tokens for r in rows) == sizes and {r.pad_to for r in rows} <= set(sizes)
    for b in {r.bucket for r in rows}:  # every batch but the last is full
        own = [r for r in rows if r.bucket == b]
        fits = max(1, 64 // max(own[0].pad_to, 1))
        assert max(r.batch for r in own) == (len(own) - 1) // fits
    for r in rows:
        assert r.n_tokens <= r.pad_to
    held = {}
    for r in rows:
        held.setdefault((r.bucket, r.batch), []).append(r)
    for batch in held.values():
        assert len(batch) == 1 or len(batch) * batch[0].pad_to <= 64 or batch[0].pad_to == 0
        assert sorted(r.slot for r in batch) == list(range(len(batch)))
    assert packing.pack_documents(none).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    for _ in range(60):
        m = random.randint(1, 8)
        sizes, counts, k = sorted(random.sample(range(30), m)), [random.randint(1, 9) for _ in range(m)], random.randint(1, 4)
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(sizes, counts))
        best = min(cost([*b, sizes[-1]]) for r in range(min(k, m)) for b in combinations(sizes[:-1], r))
        assert cost(packing.boundaries(np.array(sizes), np.array(counts), k)) == best


def test_one_long_text_leaves_other_lengths_apart(spark):
    sizes = [*range(1, 151), 10_000_000]
    rows = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n long"), F.col("n"), ["doc_id"]).collect()
    best = packing.boundaries(np.array(sizes), np.ones(len(sizes), np.int64), 8)
    assert len(rows) == len(sizes) and {r.pad_to for r in rows} == set(best)
    assert all(r.pad_to == min(b for b in best if b >= r.n_tokens) for r in rows)


def test_more_lengths_than_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS", 64)
    sizes = [*range(30), *(1000 + 37 * i for i in range(500))]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")
    bins = packing.length_histogram(df)
    assert len(bins) <= 64 and sum(r.c for r in bins) == len(sizes) and {r.n for r in bins} <= set(sizes) and max(sizes) == bins[-1].n
    rows = packing.pack(df, F.col("n_tokens"), ["doc_id"]).collect()
    assert len(rows) == len(sizes) and all(r.n_tokens <= r.pad_to for r in rows) and all(max(q.n_tokens for q in rows if q.bucket == r.bucket) == r.pad_to for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(docs, none, spark, module):
    name = "quality" if module is quality else "toxic"
    rows = module.score(docs, module.fit(docs, labels(spark, [(4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (4, 1, 0)]))).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.score == 0.5 for r in module.score(docs, module.fit(docs, labels(spark))).collect()), name
    assert module.score(none, module.fit(none, labels(spark))).count() == 0


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(2)
    texts = [(np.sort(rng.choice(40, rng.integers(1, 8), replace=False)) + 1, int(rng.integers(2))) for _ in range(60)]
    values = [rng.random(len(a)).astype(np.float32) for a, _ in texts]
    import pyarrow as pa

    sizes = [len(a) for a, _ in texts]
    t = pa.table({"label": [y for _, y in texts], "slots": labelled.lists(np.concatenate([a for a, _ in texts]).astype(np.int32), np.array(sizes), pa.int32()), "values": labelled.lists(np.concatenate(values), np.array(sizes), pa.float32())})
    z, n = quality._learn([np.zeros(64), np.zeros(64)], t)
    w = lambda a, b: 0.0 if abs(a) <= quality.L1 else (math.copysign(quality.L1, a) - a) / ((quality.BETA + math.sqrt(b)) / quality.ALPHA + quality.L2)
    pz, pn = [0.0] * 64, [0.0] * 64
    for (at, y), x in zip(texts, values):
        row = [*zip(at.tolist(), x.astype(float).tolist()), (0, 1.0)]
        own = {i: w(pz[i], pn[i]) for i, _ in row}
        p = 1 / (1 + math.exp(-sum(own[i] * v for i, v in row)))
        for i, v in row:
            g = (p - y) * v
            pz[i] += g - (math.sqrt(pn[i] + g * g) - math.sqrt(pn[i])) / quality.ALPHA * own[i]
            pn[i] += g * g
    assert np.allclose(z, pz) and np.allclose(n, pn)


def auc(rows):
    rows = sorted((r.score, y) for r, y in rows)
    pos = sum(y for _, y in rows)
    return sum(i for i, (_, y) in enumerate(rows) if y) / max(1, pos * (len(rows) - pos)) - (pos - 1) / 2 / max(1, len(rows) - pos)


def test_toxicity_learns_what_a_pair_of_terms_means(spark):
    # neither word tells anything alone: label 1 if exactly one of two kinds of words is there
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        said = [f"w{rng.randrange(30)}x" for _ in range(6)] + (["mugwump"] if insult else []) + (["zorblat"] if group else [])
        rng.shuffle(said)
        rows.append((i, " ".join(said), int(insult != group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))).collect()
    assert auc([(r, rows[r.doc_id][2]) for r in found if r.held_out]) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_hold_on_what_they_have_not_seen(spark, module):
    label = "quality" if module is quality else "toxic"
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[label] for r in known.collect()}
    rows = [(r, truth[r.doc_id]) for r in module.score(docs, module.fit(docs, known)).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(rows) > 50 and auc(rows) > 0.9


def test_one_id_with_many_texts_is_learnt_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    sample = labelled.training_sample(docs, labels(spark, [(1, 1, 0), (2, 0, 1)]), "quality", 5, 99, 100)
    assert sample.count() == 2


def test_quality_stage_keeps_columns(docs, spark):
    assert quality.keep_good(docs, labels(spark)).columns == docs.columns


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.05
    x[200:220] = x[1]
    rows = [(i, [float(v) for v in x[i]], i % 2 if i < 100 else 0) for i in range(300)]
    rows += [(310, [1.0, 2.0], 0), (311, [2.0, 4.0], 0), (312, [1.0, 2.0], 0), (300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, [1.0], 0), (305, rows[5][1], None), (306, [], 0), (None, rows[7][1], 1)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, node string")


def test_embeddings_match_brute_force(spark):
    rows, df = vectors(spark)
    ok = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) == 16 and all(v is not None and v == v for v in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok], dtype=np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    lab = np.array([r[2] for r in ok])
    link = (x @ x.T / np.outer(n, n) >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    for i, r in enumerate(ok):
        assert by[r[0]].n_links == link[i].sum()
    assert all(by[i].n_links == 0 and by[i].kept for i in range(300, 307))
    assert all(by[i].n_links == 2 and by[i].component_id == 310 for i in (310, 311, 312))  # vectors of another size link with their like
    assert by[219].component_id == 200 and embeddings.near_duplicates(df.filter("false")).count() == 0


@pytest.mark.parametrize("tile", [4096, 100])
def test_links_do_not_depend_on_how_many_vectors_a_label_has(spark, tile, monkeypatch):
    # 8,000 pairs of one label at a cosine just above 0.98, most of which agree on few blocks of their codes
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(3)
    x, turn = rng.normal(size=(2, 8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn *= math.tan(math.acos(0.9801)) / np.linalg.norm(turn, axis=1, keepdims=True)
    rows = [(2 * i + k, v.tolist(), 1) for i, p in enumerate(zip(x, x + turn)) for k, v in enumerate(p)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, i - i % 2) for i in range(16000)}


def test_neighbours_match_brute_force(spark):
    rows, df = vectors(spark)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    ok = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 16 and all(v is not None and v == v for v in r[1]) and any(r[1])]
    x, ids = np.array([r[1] for r in ok], dtype=np.float32).astype(float), np.array([r[0] for r in ok])
    hit = 0
    queries = [i for i in ids if i % 20 == 0]
    for q in queries:
        s = x @ x[ids == q][0]
        want = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in mine)
        hit += len({r.vec_id for r in mine} & set(want))
    assert hit / (20 * len(queries)) >= 0.9
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3


def test_nodes_alone_in_their_blocks_are_found(spark, monkeypatch):
    # blocks of a few nodes: most have no neighbour to start from but those dealt at random
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    monkeypatch.setattr(neighbours, "NEIGHBOURS", 6)
    x = np.random.default_rng(4).normal(size=(60, 12)) * np.linspace(0.2, 3, 60)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in (0, 20, 40) for k in range(1, 21)}


def test_exact_search_for_what_walks_miss(spark):
    x = np.random.default_rng(5).normal(size=(50, 8)).astype(np.float32)
    nodes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node long, embedding array<float>")
    short = spark.createDataFrame([(3,), (7,)], "q long")
    got = {(r.q, r.node) for r in neighbours._exact(short, neighbours.lifted(nodes), 5, 1).collect()}
    assert got == {(q, int(j)) for q in (3, 7) for j in np.argsort(-(x @ x[q]))[:5]}


def test_chat_tree_and_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", r"<\|x <\\| <|", "", None, "a\nb", "é<|im_end|>\n"]
    # a root with two branches; the better one is scored higher; a cycle and a repeated row take no part twice
    rows = [(1, 1, None, 0.0, "user", said[0]), (1, 2, 1, 1.0, "assistant", said[1]), (1, 3, 1, 5.0, "assistant|\\n\n", said[5]), (1, 4, 3, 0.5, "user", said[3]), (1, 5, 2, 0.1, "assistant", said[4]), (1, 5, 2, 0.1, "assistant", said[4]),
            (2, 8, 9, 1.0, "user", "x"), (2, 9, 8, 1.0, "user", "y"), (None, 1, None, None, None, said[2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "tree_id long, message_id long, parent_id long, score double, role string, text string, depth string")
    out = {r.tree_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in out[1].read_turns] == [("user", said[0]), ("assistant|\\n\n", said[5]), ("user", "")]
    assert out[1].path_score == 5.5 and 2 not in out and [tuple(t) for t in out[None].read_turns] == [("", "")]
    both = chat.read_back(chat.format_conversations(df, 2)).filter("tree_id = 1 and path_rank = 2").first()
    assert [t.text for t in both.read_turns] == [said[0], said[1], said[4]] and both.loss_text == said[1] + said[4]
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_deep_chain(spark):
    turns = spark.range(70).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.read_back(chat.format_conversations(chat.chained(turns))).first()
    assert [t.text for t in row.read_turns] == [str(i) for i in range(70)]


def edited(rng: random.Random, passage: list[str], low: float, high: float, span: int) -> list[str]:
    """``passage`` with words replaced, added and left out, ``span`` at a time, down to a similarity of low to high."""
    out = list(passage)
    while True:
        at, n = rng.randrange(3, len(out) - span - 3), rng.randrange(1, span + 1)
        trial = list(out)
        trial[at : at + n * (rng.random() < 0.7)] = [f"n{rng.randrange(10**7)}" for _ in range(n * (rng.random() < 0.7))]
        score = jaccard(passage, trial)
        if score >= low:
            out = trial
            if score <= high:
                return out


@pytest.mark.parametrize("span", [1, 20])
def test_long_edited_passages_are_found_whole(spark, span):
    rng = random.Random(7 + span)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    rows, places = [], {}
    for i in range(160):
        passage = fresh(rng.randrange(100, 700))
        before, other = fresh(rng.randrange(80)), edited(rng, passage, 0.80, 0.85, span)
        rows += [(2 * i, " ".join(fresh(30) + passage + fresh(rng.randrange(80)))), (2 * i + 1, " ".join(before + other + fresh(50)))]
        places[2 * i + 1] = (len(before), len(before) + len(other))
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    seen = {d: set() for d in places}
    for r in found:
        assert r.match_id == r.doc_id - 1
        seen[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    cover = {d: len(seen[d] & set(range(a, b))) for d, (a, b) in places.items()}
    assert sum(cover[d] >= 0.9 * (b - a) for d, (a, b) in places.items()) >= 0.9 * len(places)
    assert sum(cover.values()) >= 0.9 * sum(b - a for a, b in places.values())
