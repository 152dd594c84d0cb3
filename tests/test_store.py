"""The passage store: bounded search against counting, versions, vectors that are kept, writers that die."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docproof.operators import postings as I, prepare as P, retrieval as R
from docproof.session import shared_path
from docproof.sources.passages import PassageStore
from docproof.sources.versioned import VersionedTables

PASSAGE = "chunk_id long, document_id int, portfolio_id string, page_number int, ordinal int, text string"


def corpus(seed, documents=60):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = []
    for d in range(documents):
        for o in range(40 if d == 3 else r.randint(1, 4)):
            rows.append((d * 1000 + o, d, f"p{d % 3}" if d % 7 else "p0", 1, o, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))))
    return rows


def counted(rows, queries, scope, n):
    """By definition: places of a question's words in each passage it sees."""
    out = []
    for q, text in queries:
        wanted = set(text.lower().split())
        hits = Counter()
        for c, d, p, _, _, t in rows:
            if scope is None or (q, p) in scope:
                hits[c] = sum(w in wanted for w in t.split())
        best = sorted((-k, c) for c, k in hits.items() if k)[:n]
        out += [(q, c, round(-k * 0.1, 6), i + 1) for i, (k, c) in enumerate(best)]
    return sorted(out)


def told(df):
    return sorted((r.question_id, r.chunk_id, round(r.score, 6), r.lexical_rank) for r in df.collect())


@pytest.mark.parametrize("size,first", [(8, 2), (1, 1), (10_000, 4)])
def test_bounded_search_matches_counting(spark, monkeypatch, size, first):
    monkeypatch.setattr(I, "RANGE", size)
    monkeypatch.setattr(I, "FIRST", first)
    rows = corpus(1)
    passages = spark.createDataFrame(rows, PASSAGE).withColumn("tokens", P.T.content_tokens(F.col("text")))
    index = I.index_blocks(passages.repartition(5), len(rows))
    path = shared_path(spark, "index")
    I.write_index(index, path)
    held = spark.read.parquet(path)
    assert held.selectExpr("sum(size(postings))").first()[0] == sum(len(set(r[5].split())) for r in rows)
    assert held.groupBy("lexeme", "portfolio_id", "range").count().filter("count > 1").isEmpty()
    queries = [(1, "w1 w2 w3"), (2, "W5 w900 nothing"), (3, "unseen"), (4, ""), (5, " ".join(f"w{i}" for i in range(40))), (6, "w1")]
    scope = {(1, "p0"), (1, "p1"), (2, "p2"), (5, "p0"), (5, "p1"), (5, "p2"), (6, "nowhere")}
    asked = spark.createDataFrame(queries, "question_id long, query string")
    seen = spark.createDataFrame(sorted(scope), "question_id long, portfolio_id string")
    assert told(R.lexical_top_n_indexed(asked, held, 7)) == counted(rows, queries, None, 7)
    assert told(R.lexical_top_n_indexed(asked, held, 7, seen)) == counted(rows, queries, scope, 7)


def test_bars_close_ranges_and_only_wanted_folders_are_opened(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 4)
    monkeypatch.setattr(I, "FIRST", 1)
    # One document says the words often, hundreds say one of them once.
    rows = [(i, i, "p", 1, 0, "rent " * 9 if i < 6 else "rent filler") for i in range(400)]
    passages = spark.createDataFrame(rows, PASSAGE).withColumn("tokens", P.T.content_tokens(F.col("text")))
    path = shared_path(spark, "index")
    I.write_index(I.index_blocks(passages, len(rows)), path)
    index = spark.read.parquet(path)
    opened = []
    closing = I.open_ranges
    monkeypatch.setattr(I, "open_ranges", lambda limits, *rest: opened.append((limits.count(), closing(limits, *rest).count())) or closing(limits, *rest))
    asked = spark.createDataFrame([(1, "rent")], "question_id long, query string")
    assert [r.chunk_id for r in R.lexical_top_n_indexed(asked, index, 1).collect()] == [0]
    assert opened[0][0] > 50 and opened[0][1] <= 6
    plan = I.only_wanted(index, I.wanted_lexemes(asked))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def identities(spark, rows):
    return spark.createDataFrame(sorted({(d, p, f"name{d}", True) for _, d, p, *_ in rows}), "document_id int, portfolio_id string, lexeme string, named boolean")


def put(spark, store, rows, documents):
    return store.replace(spark.createDataFrame([(d,) for d in documents], "document_id int"), spark.createDataFrame(rows, PASSAGE), identities(spark, rows or [(0, 0, "", 0, 0, "")]).filter(F.lit(bool(rows))))


def test_store_answers_as_the_operators_do_while_documents_change(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 16)
    rows = corpus(2, 40)
    store = PassageStore(spark, shared_path(spark, "store"), digest="md5")
    put(spark, store, rows, range(40))
    fresh = [(d * 1000 + o, d, "p1", 1, o, f"w1 w2 changed{d} {o}") for d in range(0, 40, 5) for o in range(2)]
    put(spark, store, fresh, range(0, 40, 5))
    put(spark, store, [], [7])
    live = [r for r in rows if r[1] % 5 and r[1] != 7] + fresh
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w9 changed5"), (3, "  "), (4, "w1 w4")], "question_id long, query string")
    scope = spark.createDataFrame([(q, p) for q in (1, 2, 3, 4) for p in ("p0", "p1", "p2") if q != 4 or p == "p1"], "question_id long, portfolio_id string")
    focus = spark.createDataFrame([(4, 10), (4, 16), (1, 11)], "question_id long, document_id int")

    def same():
        assert sorted((r.chunk_id, r.text) for r in store.passages().collect()) == sorted((r[0], r[5]) for r in live)
        got = store.ask(queries, scope, focus)
        texts = spark.createDataFrame(live, PASSAGE)
        vectors = P.hashed_embeddings(queries.withColumnRenamed("query", "text"), "question_id", digest="md5")
        held = P.hashed_embeddings(texts, "chunk_id", "document_id", "portfolio_id", digest="md5")
        want = R.hybrid_search(queries, vectors, held, P.lexeme_places(texts, "document_id", "portfolio_id"), scope, focus)
        rows_of = lambda df: sorted((r.question_id, r.source_index, r.chunk_id, r.vector_rank or 0, r.lexical_rank or 0) for r in df.collect())
        assert rows_of(got) == rows_of(want) and rows_of(got)

    same()
    store.merge()
    assert len(store.tables.current()["segments"]) == 1
    same()


def test_known_texts_keep_their_vectors_and_questions_get_an_instruction(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t)), float("for search: " in t), 1.0] for t in texts]

    store = PassageStore(spark, shared_path(spark, "store"), embed=embed)
    rows = [(i, i // 2, "p", 1, i % 2, f"text number {i}") for i in range(20)]
    put(spark, store, rows, range(10))
    assert calls.value == 20
    # Document 1 gets one text anew, document 4 one that document 8 has, document 10 is new.
    again = [(2, 1, "p", 1, 0, "text number 2"), (3, 1, "p", 1, 1, "another text"), (8, 4, "p", 1, 0, "text number 17"), (20, 10, "p", 1, 0, "quite new")]
    put(spark, store, again, [1, 4, 10])
    assert calls.value == 22
    found = {r.chunk_id: r.embedding for r in store.vectors().collect()}
    assert len(found) == 20 and found[8] == [14.0, 0.0, 1.0] and found[3] == [12.0, 0.0, 1.0]
    store.merge()
    assert calls.value == 22 and {r.chunk_id: r.embedding for r in store.vectors().collect()} == found
    queries = spark.createDataFrame([(1, "text")], "question_id long, query string")
    scope = spark.createDataFrame([(1, "p")], "question_id long, portfolio_id string")
    nothing = spark.createDataFrame([], "question_id long, document_id int")
    plain = [r.chunk_id for r in store.ask(queries, scope, nothing, k=3).orderBy("source_index").collect()]
    told = store.ask(queries, scope, nothing, k=3, instruction="for search: ").orderBy("source_index").collect()
    assert len(told) == 3 and plain and calls.value >= 24


def test_embed_missing_embeds_null_vectors_only(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(1, "a", [5.0]), (2, "b", None), (3, None, None)], "k int, text string, embedding array<float>")
    assert sorted((r.k, r.embedding[0]) for r in P.embed_missing(rows, "k", embed=embed).collect()) == [(1, 5.0), (2, 1.0), (3, 1.0)] and calls.value == 2


def test_readers_see_a_change_whole_or_not_at_all(spark):
    tables = VersionedTables(spark, shared_path(spark, "tables"))
    pages = lambda d, text: spark.createDataFrame([(i, text) for i in d], "document_id int, text string")
    see = lambda: sorted((r.document_id, r.text) for r in tables.read("pages").collect())
    tables.replace(pages(range(4), ""), pages=pages(range(4), "old"))
    before = see()

    def boom(rows):
        raise RuntimeError("executor and driver are lost")
        yield rows

    with pytest.raises(Exception):  # noqa: B017  after the ids are written, and before the rows are
        tables.replace(pages([1, 2], ""), pages=pages([1, 2], "half").mapInPandas(boom, "document_id int, text string"))
    assert see() == before
    tables.replace(pages([1, 2, 9], ""), pages=pages([2, 9], "new"))
    assert see() == [(0, "old"), (2, "new"), (3, "old"), (9, "new")]
    # A writer that began from an older version may not switch.
    was, segment = tables.begin()
    tables.replace(pages([0], ""), pages=pages([0], "newest"))
    with pytest.raises(RuntimeError):
        tables.switch(was, [*was["segments"], segment], was["gone"], {})
    assert see() == [(0, "newest"), (2, "new"), (3, "old"), (9, "new")]


def test_bucketed_tables_join_without_a_shuffle(spark):
    from docproof.sources import uploads as U

    path = shared_path(spark, "buckets")
    rows = [(d, p, f"{d}/{p}") for d in range(300) for p in range(3)]
    pages = U.write_bucketed(spark.createDataFrame(rows, "document_id int, page_number int, text string"), "t_pages", f"{path}/pages", order=("page_number",), buckets=4)
    chunks = U.write_bucketed(spark.createDataFrame([(d, d * 2) for d in range(0, 300, 2)], "document_id int, n int"), "t_chunks", f"{path}/chunks", buckets=4)
    spark.sql("DROP TABLE t_chunks")
    chunks = U.attach_bucketed(spark, "t_chunks", f"{path}/chunks", buckets=4)
    joined = pages.join(chunks.hint("merge"), "document_id").groupBy("document_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, joined.collect())) == [(d, 3) for d in range(0, 300, 2)]
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_uploads_become_chunks_after_a_batch_was_half_written(spark, tmp_path):
    from docproof.sources import uploads as U
    from docproof.streaming import jobs as J

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"u{i}.pdf").write_bytes(b"%PDF" + "\f".join(f"Page {p} of {i}. It says é things. " * 30 for p in range(3)).encode())
    (folder / "bad.pdf").write_bytes(b"%PDF\xff\xfe\xfd")
    (folder / "other.pdf").write_bytes(b"GIF89a")
    (folder / "blank.pdf").write_bytes(b"%PDF \f ")
    (folder / "large.pdf").write_bytes(b"%PDF" + b"x" * 9000)
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "notes.txt").write_bytes(b"%PDFtext")

    def parse(blob):
        return blob[4:].decode("utf-8").split("\f")

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    files = lambda: U.stream_uploads(spark, str(folder), "*.pdf", 4)
    whole = J.uploaded_chunks

    def dies(df, batch):
        whole(df, parse, "%PDF", 8000).limit(2).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        raise RuntimeError("lost")

    with pytest.raises(Exception):  # noqa: B017
        files().writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(dies).start().awaitTermination()
    rows = J.ingest_uploads(files(), parse, out, state, "%PDF", 8000)
    told = lambda df: sorted((r.path.rsplit("/", 1)[1], r.document_id, r.reason or "", r.page_number or 0, r.ordinal_in_page or 0, r.text or "", [round(x, 6) for x in r.embedding or []]) for r in df.collect())
    want = told(whole(U.read_uploads(spark, str(folder), "*.pdf"), parse, "%PDF", 8000))
    assert told(rows) == want and len(want) > 15
    assert {w[0]: w[2] for w in want if w[2]} == {"bad.pdf": "unreadable", "other.pdf": "not_supported", "blank.pdf": "no_text_layer", "large.pdf": "too_large"}
    # What comes later is read, what is known is not read again.
    (folder / "u9.pdf").write_bytes(b"%PDFNew one. Here.")
    assert len(told(J.ingest_uploads(files(), parse, out, state, "%PDF", 8000))) == len(want) + 1
