"""Hand-built truth tables on tiny frames."""

import datetime
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docproof.functions import parsing as V, text as T
from docproof.operators import access as A, answering as Q, evaluation as E, evidence as X, jobs as J, nearest, prepare as P, retrieval as R, spend as S
from docproof.sources import uploads as U


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text,want", [
    ("See (item two.) Then go on.", ["See (item two.) Then go on."]),
    ("About 7.25 km, viz. near the old mill. nobody knows", ["About 7.25 km, viz. near the old mill. nobody knows"]),
    ("upper row\n\n \t lower  row \nlast", ["upper row", "lower row", "last"]),
    ("9. Birds. 9.2 Crows nest early. (c) and so on. B) Ducks follow.", ["9. Birds.", "9.2 Crows nest early.", "(c) and so on.", "B) Ducks follow."]),
    ("12)", ["12)"]),
    ("One; Two: Three? Four! \"Five\" six.", ["One;", "Two:", "Three?", "Four!", "\"Five\" six."]),
])
def test_sentences(spark, text, want):
    got = one(spark, text, T.split_sentences)
    assert got == want and one(spark, "\n".join(got), T.split_sentences) == want


def test_normalise_and_titles(spark):
    assert one(spark, "a\r\nb \t c\r\r\n \n d ", T.normalise) == "a b c\nd"
    assert one(spark, "/x/irwell-bank_house-4B HP-CC-0007.old.pdf", T.title_from_filename) == "Irwell Bank House 4B HP CC 0007.old"
    assert one(spark, "", T.title_from_filename) == "Untitled"


def test_chunks(spark):
    page = "\n".join(f"Sentence number {i} of the page says something." for i in range(60))
    rows = P.chunk_ordinals(P.chunk_pages(spark.createDataFrame([(1, 1, page), (1, 2, "x" * 3000), (1, 3, "")], "document_id int, page_number int, text string"), 200)).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and all(len(r.text) <= 200 or len(r.sentences) == 1 for r in rows)
    first = [r for r in rows if r.page_number == 1]
    assert all(b.sentences[0] == a.sentences[-1] for a, b in zip(first, first[1:])) and all(page[r.char_start : r.char_end].startswith(r.sentences[0]) for r in first)


def packed(text, sentences, target, overlap):
    """Chunks by the definition: the longest run from each start that fits, the next start before its end."""
    spans, at = [], 0
    for x in sentences:
        place = max(text.find(x, at), at) if x in text[at:] else at
        spans.append((place, place + len(x)))
        at = place + len(x)
    out, i = [], 0
    while i < len(sentences):
        j = max(j for j in range(i + 1, len(sentences) + 1) if j == i + 1 or len("\n".join(sentences[i:j])) <= target)
        out.append((sentences[i:j], spans[i][0], spans[j - 1][1]))
        i = len(sentences) if j == len(sentences) else max(j - overlap, i + 1)
    return out


@pytest.mark.parametrize("target,overlap", [(60, 1), (25, 2), (1, 0), (1000, 3), (90, 0)])
def test_chunks_by_definition(spark, target, overlap):
    texts = ["", "One. Two is here; And three:  Four? 5. Five again.\nSix\n\nSeven! One. One. One.", "x" * 120 + "\nshort. Tail.", "3. A. (b) B goes on and on. Longer sentences follow here, as they must. End."]
    rows = P.chunk_pages(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(9, 1, None)], "document_id int, page_number int, text string"), target, overlap).collect()
    for i, t in enumerate(texts):
        want = packed(t, one(spark, t, T.split_sentences), target, overlap)
        got = [(r.sentences, r.char_start, r.char_end) for r in sorted(rows, key=lambda r: r.ordinal_in_page) if r.document_id == i]
        assert got == want, t
    assert not [r for r in rows if r.document_id == 9]


def test_chunks_of_long_pages_take_linear_time(spark):
    """Sentences of one line as well as lines: eight times the sentences must not take anything like the square."""

    def took(n):
        df = spark.createDataFrame([(1, 1, " ".join(f"Sentence {i} of the table has some words in it." for i in range(n)) + "\n" + "Row;\n" * n)], "document_id int, page_number int, text string")
        times = []
        for _ in range(2):
            began = time.monotonic()
            assert P.chunk_pages(df).count() > n // 40
            times.append(time.monotonic() - began)
        return min(times)

    took(200)
    assert took(32_000) < 12 * max(took(4_000), 0.5)


@pytest.mark.parametrize("digest", ["blake2b", "md5"])
def test_hash_features_by_definition(spark, digest):
    texts = ["break notice and rent review", "rent", "the of", None, "rent rent review rent"]
    rows = {r.k: r for r in P.hashed_embeddings(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "k int, text string, other string"), "k", "other", dims=16, digest=digest).collect()}
    for i, t in enumerate(texts):
        tokens = [w for w in (t or "").split() if w not in T.STOPWORDS]
        v = [0.0] * 16
        for name, weight in [(w, 1.0) for w in tokens] + [(f"{a} {b}", 0.5) for a, b in zip(tokens, tokens[1:])]:
            h = int.from_bytes(P.DIGESTS[digest](name.encode())[:8], "big")
            v[h % 16] += weight if h >> 63 else -weight
        norm = sum(x * x for x in v) ** 0.5
        want = [x / norm for x in v] if norm else [1.0] + [0.0] * 15
        assert rows[i].other == "z" and all(abs(a - b) < 1e-6 for a, b in zip(rows[i].embedding, want))


def test_passage_query(spark):
    # "lease" and "mill" are in the name of the focused document too, but too common to identify it
    questions = spark.createDataFrame([(1, "does the Alder Beacon lease at the Mill allow a break?"), (2, "What is the rent (per annum)?"), (3, "Alder Beacon")], "question_id int, text string")
    terms = spark.createDataFrame([(1, "alder"), (1, "beacon"), (3, "alder"), (3, "beacon")], "question_id int, lexeme string")
    focus = spark.createDataFrame([(1, 7), (3, 7)], "question_id int, document_id int")
    identities = spark.createDataFrame([(7, "p", w, w != "break") for w in ("alder", "beacon", "lease", "mill", "break")], "document_id int, portfolio_id string, lexeme string, named boolean")
    rows = {r.question_id: r.query for r in R.passage_query(questions, R.question_words(questions), terms, focus, identities).collect()}
    assert rows == {1: "does the lease at the Mill allow a break", 2: "What is the rent (per annum)?", 3: "Alder Beacon"}


def test_hybrid_search_keeps_to_what_is_visible(spark):
    chunks = spark.createDataFrame([(1, 10, "a", [1.0, 0.0]), (2, 11, "a", [0.0, 1.0]), (3, 20, "b", [1.0, 0.1]), (4, 21, "b", None)], "chunk_id long, document_id int, portfolio_id string, embedding array<float>")
    words = spark.createDataFrame([(2, 11, "a", "rent"), (3, 20, "b", "rent"), (3, 20, "b", "rent"), (4, 21, "b", "rent")], "chunk_id long, document_id int, portfolio_id string, lexeme string")
    queries = spark.createDataFrame([(1, "rent"), (2, "rent"), (3, "rent"), (4, "  "), (5, "rent")], "question_id long, query string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1, 6)], "question_id long, embedding array<float>")
    scope = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "a"), (5, "nowhere")], "question_id long, portfolio_id string")
    focus = spark.createDataFrame([(3, 11), (1, 20)], "question_id long, document_id int")
    rows = R.hybrid_search(queries, vectors, chunks, words, scope, focus, k=3).collect()
    by = {q: [r.chunk_id for r in sorted(rows, key=lambda r: r.source_index) if r.question_id == q] for q in range(1, 6)}
    # 2 sees all, and the vector leg alone finds 1; 3 names document 11; 1 names a document that it does not see
    assert by == {1: [], 2: [3, 2, 1], 3: [2], 4: [], 5: []} and rows[0].settings.focus.max_documents == 4


def test_vector_blocks_agree(spark, monkeypatch):
    import random

    rng = random.Random(2)
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)], "question_id long, embedding array<float>")
    c = spark.createDataFrame([(i, [float(rng.randrange(-2, 3)) or 1.0 for _ in range(6)], f"p{i % 3}") for i in range(300)], "chunk_id long, embedding array<float>, portfolio_id string")
    scope = q.select("question_id", F.concat(F.lit("p"), (F.col("question_id") % 4).cast("string")).alias("portfolio_id"))
    whole = [sorted(map(tuple, R.vector_top_n(q, c, 5, s).collect())) for s in (None, scope)]
    monkeypatch.setattr(nearest, "QUESTIONS", 7)
    monkeypatch.setattr(nearest, "PASSAGES", 11)
    assert [sorted(map(tuple, R.vector_top_n(q, c.repartition(5), 5, s).collect())) for s in (None, scope)] == whole
    assert len(whole[0]) == 200 and {x[0] % 4 for x in whole[1]} == {0, 1, 2}


def test_request_payloads(spark):
    import json

    sources = spark.createDataFrame([(1, 1, 5, "B", 3, []), (1, 0, 4, "A", 2, ["x.", "y."])], "question_id int, source_index int, chunk_id int, title string, page_number int, blocks array<string>")
    made = json.loads(U.request_payloads(sources, spark.createDataFrame([(1, "Why?")], "question_id int, text string")).first().payload)
    assert made["question"] == "Why?" and [x["title"] for x in made["documents"]] == ["A — page 2", "B — page 3"]
    assert [[b["text"] for b in x["source"]["content"]] for x in made["documents"]] == [["x.", "y."], ["(no text)"]]
    assert json.loads(made["documents"][0]["context"]) == {"source_index": 0, "chunk_id": "4", "page": 2}


def test_stream_ingest_equals_batch(spark, tmp_path):
    from docproof.streaming import jobs as J2

    pages = spark.createDataFrame([(i, p, f"Page {p} of {i}. It says more; Much more is said. " * (12 * i + 1)) for i in range(4) for p in (1, 2)], "document_id int, page_number int, text string")
    for part in range(2):
        pages.filter(F.col("document_id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
    found = J2.ingest(J2.stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"))
    chunks = P.chunk_pages(pages).withColumn("key", F.concat_ws("/", "document_id", "page_number", "ordinal_in_page"))
    batch = chunks.join(P.hashed_embeddings(chunks, "key"), "key")
    columns = ["key", "text", "char_start", "char_end", "embedding"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect())) and batch.count() > 8


def test_embeddings(spark):
    rows = {r.k: r.embedding for r in P.hashed_embeddings(spark.createDataFrame([(1, "break notice"), (2, "the of"), (3, "break notice"), (4, None)], "k int, text string"), "k").collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and rows[1] == rows[3] and rows[2][0] == 1 and rows[4][0] == 1 and len(rows[1]) == 384


@pytest.mark.parametrize("said,want", [
    ("2nd May 1999", "1999-05-02"), ("03/09/2011", "2011-09-03"), ("3.9.2011", "2011-09-03"), ("2011-09-03 18:30", "2011-09-03"), ("July 14, 1789", "1789-07-14"), ("7 Dec 2030", "2030-12-07"),
    ("on the 7th December 2030", "2030-12-07"), ("12/01/2020", "2020-01-12"), ("40/01/2020", None), ("31 June 2021", None), ("1999", None), ("in a while", None),
])
def test_dates(spark, said, want):
    got = one(spark, said, V.parse_date)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("kind,said,want", [
    ("money", "£8,100", "8100.00"), ("money", "8,100.5 per year", "8100.50"), ("money", "£990 exclusive of VAT", "990.00"), ("money", "GBP 77 pcm", "77.00"), ("money", "£", None), ("money", "free", None), ("money", "£10 or £20", None),
    ("integer", "31", "31"), ("integer", "9 weeks'", "9"), ("integer", "4 calendar months", "4"), ("integer", "2.75", None), ("integer", "nine", None), ("integer", "1 or 2 years", None),
    ("bool", "YES.", "true"), ("bool", "opted to tax", "true"), ("bool", "has not elected", "false"), ("bool", "perhaps", None), ("bool", "to tax opted", None),
    ("enum", "dark-blue", "dark_blue"), ("enum", "DARK_BLUE", "dark_blue"), ("enum", "pale / green.", "pale_green"), ("enum", "blue", None),
    ("text", '"Harbour Works".', "Harbour Works"), ("text", "Shed   12", "Shed 12"), ("text", " \t ", None), ("text", None, None),
])
def test_values(spark, kind, said, want):
    allowed = F.array(F.lit("dark_blue"), F.lit("pale_green"))
    assert one(spark, said, lambda c: V.parse_value(F.lit(kind), c, allowed)) == want


def test_fusion(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (2, "a", 1), (2, "b", 2)], "question_id int, chunk_id string, vector_rank int")
    x = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "b", 1), (2, "a", 2)], "question_id int, chunk_id string, lexical_rank int")
    rows = R.rrf_fuse(v, x).orderBy("question_id", "source_index").collect()
    assert [r.chunk_id for r in rows if r.question_id == 1] == ["c", "a", "b"] and abs(rows[0].fused_score - 2 / 62) < 1e-12
    assert [r.chunk_id for r in rows if r.question_id == 2] == ["a", "b"]


def test_citation_events(spark):
    sources = spark.createDataFrame([(1, 0, "X", ["s"]), (1, 1, "Y", ["s", "t"])], "question_id int, source_index int, chunk_id string, blocks array<string>")
    cites = spark.createDataFrame([(1, 0, 99, 0, 1, 0), (1, 1, 0, 0, 50, 0), (1, 2, 0, 0, 1, 0), (1, 3, 1, 1, 2, 1), (1, 4, 0, 0, 1, 1), (1, 5, 0, 1, 1, 0)], "question_id int, seq int, source_index int, block_start int, block_end int, answer_block int")
    v = Q.verify_citations(cites, sources)
    assert Q.dropped_counts(v).first().dropped == 3
    labels = {r.answer_block: r.labels for r in Q.block_labels(Q.citation_ordinals(v)).collect()}
    assert labels == {0: [1], 1: [2, 1]}


GOLD = "eval_id int, answerable boolean, expected_document_id string, expected_pages array<int>"


@pytest.mark.parametrize("gold,ranked,want", [
    ((True, "D", [4, 5]), [("D", 2), ("O", 4), ("D", 5)], (True, True, 3)), ((True, "D", [4, 5]), [("O", 1), ("D", 9)], (True, False, 2)), ((True, "D", [4, 5]), [("O", 4)], (False, False, None)),
    ((True, "D", [4, 5]), [], (False, False, None)), ((True, "D", []), [("O", 1), ("D", 1)], (True, None, 2)), ((False, None, []), [("D", 1)], (None, None, None)), ((True, None, [1]), [("D", 1)], (None, None, None)),
])
def test_rank_hits(spark, gold, ranked, want):
    g = spark.createDataFrame([(1, *gold)], GOLD)
    s = spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(ranked)], "eval_id int, rank int, document_id string, page_number int")
    r = E.rank_hits(g, s).first()
    assert (r.doc_hit, r.page_hit, r.hit_rank) == want


def test_totals(spark):
    D = Decimal
    schema = "answerable boolean, latency_ms int, cost_usd decimal(10,6), doc_hit boolean, page_hit boolean, hit_rank int, answered boolean, cited_doc_hit boolean, cited_page_hit boolean, refused_correctly boolean"
    rows = [(True, 100, D("0.001"), True, True, 1, True, True, True, None), (True, 300, D("0.002"), True, False, 4, True, False, False, None), (True, 200, D("0.0005"), False, False, None, False, False, False, None), (False, 50, D(0), None, None, None, False, None, None, True), (False, 1000, D("0.0015"), None, None, None, True, None, None, False)]
    df = spark.createDataFrame(rows, schema)
    r, e = E.retrieval_totals(df).first(), E.end_to_end_totals(df).first()
    assert (round(r.doc_hit_rate, 9), round(r.page_hit_rate, 9), round(r.mrr, 9)) == (round(2 / 3, 9), round(1 / 3, 9), round(1.25 / 3, 9))
    assert (round(e.answer_rate, 9), e.correct_refusal_rate, e.false_answer_rate, e.cost_usd, e.latency_p50_ms) == (round(2 / 3, 9), 0.5, 0.4, D("0.005000"), 200)
    empty = E.end_to_end_totals(df.filter("false")).first()
    assert empty.answer_rate is None and empty.cost_usd == 0


def test_evidence(spark):
    chunks = spark.createDataFrame([("d", 1, "The Tenant is  Acme\nLimited."), ("e", 2, "other")], "document_id string, chunk_id int, text string")
    values = spark.createDataFrame([("d", 2, "v", "x", "text"), ("d", 1, "v", "absent", "text"), ("d", 1, "v", "the TENANT is acme limited", "text"), ("d", 2, None, None, "text"), ("d", 1, "soon", "", "date"), ("d", None, "v", None, "text")], "document_id string, chunk_id int, value_text string, quote string, field_type string")
    got = sorted((r.issue or "", r.chunk_id or 0) for r in X.check_evidence(values, chunks).collect())
    assert got == sorted([("invalid_chunk", 0), ("quote_not_found", 1), ("", 1), ("no_evidence", 0), ("unparseable", 1), ("no_evidence", 0)])


def test_extraction_quotes_sentences(spark):
    chunks = spark.createDataFrame([("d", 1, 0, ["Cover.", "The Tenant is Acme", "Limited, a company."]), ("e", 2, 0, ["none"])], "document_id string, chunk_id int, ordinal int, blocks array<string>")
    rows = {(r.document_id, r.field_key): r for r in X.extract_fields(chunks, [("tenant", r"The Tenant is ([^,]+), a company")]).collect()}
    assert rows["d", "tenant"].value_text == "Acme Limited" and rows["d", "tenant"].quote == "The Tenant is Acme Limited, a company." and rows["e", "tenant"].confidence == "low"


def test_spend(spark):
    prices = spark.createDataFrame([("a-large", Decimal("2"), Decimal("10"), Decimal("0.2"), Decimal("2.5"))], "price_model string, p_in decimal(10,4), p_out decimal(10,4), p_read decimal(10,4), p_write decimal(10,4)")
    calls = spark.createDataFrame([(1, 1, "a-large-20260401", 10**6, 0, 10**6, 0, datetime.datetime(2024, 1, 2, 3)), (2, None, "b", 5, 5, 5, 5, datetime.datetime(2024, 1, 2, 4))], "event_id int, user_id int, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, created_at timestamp")
    rows = {r.event_id: r.cost_usd for r in S.price_calls(calls, prices).collect()}
    assert rows == {1: Decimal("2.200000"), 2: Decimal(0)} and [r.model for r in S.unpriced_models(calls, prices).collect()] == ["b"]
    priced = S.price_calls(calls, prices)
    assert S.budget_status(priced, "2.20").first().exhausted and {r.event_id: r.refused for r in S.budget_replay(priced, "2.20").collect()} == {1: False, 2: True}
    assert [r.calls for r in S.spend_by_day(priced, "2024-01-03", 3).collect()] == [0, 2, 0]


def test_visible_sets(spark):
    users = spark.createDataFrame([("director", "director"), ("manager", "manager"), ("viewer", "viewer"), ("nobody", "viewer")], "user_id string, role string")
    members = spark.createDataFrame([("manager", "city"), ("manager", "north"), ("viewer", "city")], "user_id string, portfolio_id string")
    portfolios = spark.createDataFrame([("city",), ("north",), ("riverside",)], "portfolio_id string")
    got = sorted(tuple(r) for r in A.visible_portfolios(users, members, portfolios).collect())
    assert got == [("director", "city"), ("director", "north"), ("director", "riverside"), ("manager", "city"), ("manager", "north"), ("viewer", "city")]
    docs = spark.createDataFrame([("city", "100% done", "a", "ready", 1, 1), ("city", "100 done", "b", "ready", 2, 2)], "portfolio_id string, title string, filename string, status string, created_at int, document_id int")
    assert [r.title for r in A.list_documents(docs, portfolios, "0% D").collect()] == ["100% done"]


def test_queue_and_uploads(spark):
    log = spark.createDataFrame([(1, i, "failed", False, f"e{i}") for i in range(3)] + [(2, 1, "failed", False, "x"), (3, 1, "failed", True, "y"), (4, 1, "failed", False, "z"), (4, 2, "done", False, None)], "job_id int, seq int, outcome string, terminal boolean, error string")
    assert {r.job_id: (r.status, r.last_error) for r in J.job_outcomes(log).collect()} == {1: ("failed", "e2"), 2: ("queued", "x"), 3: ("failed", "y"), 4: ("done", "z")}
    up = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"GIF"),), (bytearray(b"%PDF" + b"x" * 100),), (bytearray(b""),)], "content binary")
    assert [r.reason for r in U.admit_uploads(up, "%PDF", 50).collect()] == [None, "not_supported", "too_large", "not_supported"]
    assert [one(spark, v, U.csv_safe) for v in ("=1+1", "-x", "ok", None, "\n=cmd()", "a\n=b")] == ["'=1+1", "'-x", "ok", "", "'\n=cmd()", "a\n=b"]


def test_answers(spark):
    questions = spark.createDataFrame([(1, "When does the term end at Meridian House?"), (2, "Zebra crossing colours?"), (3, "No sources here")], "question_id int, text string")
    sources = spark.createDataFrame([(1, 0, "Lease of Meridian House", ["Rent is paid.", "The Term shall expire on 1 April."]), (2, 0, "Lease", ["Rent."])], "question_id int, source_index int, title string, blocks array<string>")
    rows = {r.question_id: r for r in Q.extractive_answers(questions, sources).collect()}
    assert rows[1].status == "answered" and rows[1].answer == "The Term shall expire on 1 April." and rows[1].cited == [0]
    assert rows[2].answer == Q.REFUSAL and rows[3].answer == Q.NO_SOURCES


@pytest.mark.parametrize("word,want", [
    ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consistency", "consist"), ("consolation", "consol"), ("knightly", "knight"), ("kneel", "kneel"), ("knotty", "knotti"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"),
    ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("agreed", "agre"), ("feed", "feed"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriating", "luxuri"), ("falling", "fall"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("generate", "generat"),
    ("generously", "generous"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("radically", "radic"), ("hopefulness", "hope"), ("formative", "format"), ("formalize", "formal"), ("adjustment", "adjust"), ("adoption", "adopt"),
    ("controlling", "control"), ("rolling", "roll"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("proceed", "proceed"), ("landlords", "landlord"), ("expiry", "expiri"), ("leases", "leas"), ("4b", "4b"),
])
def test_stems(word, want):
    from docproof.functions.stem import stem

    assert stem(word) == want
