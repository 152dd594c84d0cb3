"""Personal data: fixed forms against plain patterns, contexts learnt over two rounds, edge cases."""

import hashlib
import random
import re

import pytest

from docproof.llm import private

SCHEMA = "doc_id long, text string, base string, rid int, learnt int"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(s):
    n = [int(c) for c in s[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(n)) % 10 == 0


def brute(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and check_digit(digits), "phone": 10 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_fixed_forms_match_plain_patterns(seed):
    r = random.Random(seed)
    pieces = ["a", "b.c", "@", "@", ".", "..", "-", "+", "%", " ", "\n", "é", "0", "12", "255", "256", "1.2.3.4", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 010-9999", "+44", "(", ")", "x@y.zz", "00001.2.3.4", "日本"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert private.base_spans(text) == brute(text), text


def test_long_runs_end_soon():
    for text in ("1" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" + " " * 100_000, "0" * 9000 + ".1.1.1", "a" * 200_000 + "@b.c"):
        private.base_spans(text)


def phones(r):
    return f"+44 {r.randint(1000, 9999)} {r.randint(100, 999)} {r.randint(100, 999)}"


def corpus():
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet elit sed do at on call the of".split()) for _ in range(n))
    texts = [f"{filler(20)} Please ring us on {phones(r)} {filler(9)}" for _ in range(40)]
    # Unseen ones after the same words, which also teach a pattern that has no seed of its own.
    unseen = [f"0{r.randint(200, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}" for _ in range(9)]
    texts += [f"{filler(5)} please ring us on {u}, {filler(5)}" for u in unseen]
    texts += [f"{filler(5)} night desk line: {u} {filler(3)}" for u in unseen]
    texts += [f"é𝔘 {filler(5)} night desk line: 0999 888 7777. {filler(3)}", f"{filler(4)} night desk line: soon {filler(3)}"]
    # Common words before a few seeds, and numbers elsewhere, teach nothing.
    texts += [f"{filler(8)} of {phones(r)} {filler(5)}" for _ in range(6)] + [f"{filler(9)} of {r.randint(1000000, 9999999)} {filler(3)}" for _ in range(30)]
    texts += [f"{filler(5)} copied text with {phones(r)} {filler(3)}"] * 40 + [f"copied text with {r.randint(10**7, 10**8)} {filler(3)}"]
    return [(i, t) for i, t in enumerate(texts)]


def test_contexts_are_learnt_over_rounds(spark):
    rows = corpus() + [(None, None), (500, ""), (501, "  \n"), (502, "0123 456 7890"), (7, corpus()[7][1]), (None, "ring 192.168.0.1 now")]
    df = spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA).repartition(6)
    got = private.personal_data(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    extracted = []
    for r in got:
        match = [t for t in texts[r.doc_id] if brute(t) == [tuple(x) for x in r.base]]
        assert match
        names = list(FORMS)
        told = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(told(brute(match[0])).encode()).hexdigest()
        assert r.spans == told(sorted([tuple(x) for x in r.base] + [tuple(x) for x in r.learnt])) and r.n_learnt == len(r.learnt)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in r.base) for k in range(4)]
        extracted += [(r.doc_id, match[0][x.start : x.end], names[x.kind]) for x in r.learnt]
    want = [(i, re.search(r"(?:ring us on|desk line:) (0[0-9 ]+[0-9])", t)[1], "phone") for i, t in rows if t and re.search(r"(?:ring us on|desk line:) 0", t)]
    assert len(want) == 19 and sorted(extracted) == sorted(want)


def test_no_rows(spark):
    assert private.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_candidates_and_looks():
    assert [private.looks_like(x) for x in ("john.smith42", "fe80::1", "4111 1111 1111 1", "x9", "a@b")] == [1, 2, 12, 0, 1]
    assert private.instance("0999 888") == private.instance("(0999) 888") != private.instance("0999 889")
