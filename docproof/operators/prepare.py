"""Document preparation: pages, chunks, counts, duplicates, rebuilding and deleting derived rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.functions import text as T
from docproof.session import broadcast_if_small, written


def explode_pages(documents: DataFrame) -> DataFrame:
    """document_id, page_number (from 1), text, of ``documents`` (document_id, pages array)."""
    return documents.select("document_id", F.posexplode("pages").alias("p", "text")).select("document_id", (F.col("p") + 1).alias("page_number"), "text")


def reject_empty(pages: DataFrame) -> DataFrame:
    """document_id, reason of documents all of whose pages are blank."""
    any_text = F.max(F.coalesce(T.strip(F.col("text")) != "", F.lit(False)))
    return pages.groupBy("document_id").agg(any_text.alias("t")).filter("not t").select("document_id", F.lit("no_text_layer").alias("reason"))


def chunk_pages(pages: DataFrame, target_chars: int = 1100, overlap: int = 1) -> DataFrame:
    """document_id, page_number, ordinal_in_page, sentences, text, char_start, char_end, token_estimate.

    A chunk holds as many whole sentences as fit ``target_chars`` when joined by a character, one at
    least; the next begins ``overlap`` sentences before its end. A sentence is looked for in the page after
    the one before it, and where it is not found as it stands it is put there. The work on a page grows
    with its sentences: see :func:`_ends` and :func:`_taken`."""
    target, overlap = max(1, target_chars), max(0, overlap)
    rows = pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("page"))
    rows = rows.withColumn("sentences", T.split_sentences(F.col("page")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES):
                part = batch.slice(lo, PAGES)
                column = part.column("sentences")
                flat = column.flatten()
                begins = column.offsets.to_numpy() - column.offsets[0].as_py()
                end = _ends(pc.utf8_length(flat).to_numpy(), begins, target)
                page, b = _taken(end, begins, overlap)
                e = end[b]
                start, stop = _places(part.column("page").to_pylist(), flat.to_pylist(), begins)
                n = e - b + 1
                cut = np.append(0, np.cumsum(n))
                held = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat.take(pa.array(np.repeat(b - cut[:-1], n) + np.arange(cut[-1]))))
                yield pa.record_batch({
                    "document_id": part.column("document_id").take(pa.array(page)), "page_number": part.column("page_number").take(pa.array(page)),
                    "ordinal_in_page": pa.array(np.arange(len(page)) - np.searchsorted(page, page), pa.int32()), "sentences": held,
                    "text": pc.binary_join(held, "\n"), "char_start": pa.array(start[b], pa.int32()), "char_end": pa.array(stop[e], pa.int32()),
                })

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("document_id", "page_number"))
    whole = rows.mapInArrow(packed, f"{kinds}, ordinal_in_page int, sentences array<string>, text string, char_start int, char_end int")
    return whole.withColumn("token_estimate", T.token_estimate(F.col("text")))


#: Pages packed at a time.
PAGES = 256


def _ends(sizes: np.ndarray, begins: np.ndarray, target: int) -> np.ndarray:
    """For each sentence the last of the chunk that would begin with it: one sorted search in the running totals."""
    total = np.append(0, np.cumsum(sizes + 1))
    last = np.repeat(begins[1:], np.diff(begins)) - 1
    fits = np.searchsorted(total, total[:-1] + target + 1, "right") - 2
    return np.maximum(np.arange(len(sizes)), np.minimum(fits, last))


def _taken(end: np.ndarray, begins: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Page and first sentence of each chunk, in order: from each page's first sentence on to where the next begins."""
    page = np.flatnonzero(np.diff(begins))
    at, out = begins[page], [(page[:0], begins[:0])]
    while len(at):
        out.append((page, at))
        on = end[at] + 1 < begins[page + 1]
        page, at = page[on], np.maximum(end[at[on]] + 1 - overlap, at[on] + 1)
    page, at = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((at, page))
    return page[order], at[order]


def _places(pages: list[str], sentences: list[str], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence begins and ends in its page."""
    start, size = np.zeros(len(sentences), np.int64), np.array([len(s) for s in sentences], np.int64)
    for page, lo, hi in zip(pages, begins.tolist(), begins[1:].tolist(), strict=False):
        at = 0
        for i in range(lo, hi):
            found = page.find(sentences[i], at)
            at = at if found < 0 else found
            start[i] = at
            at += len(sentences[i])
    return start, start + size


def chunk_ordinals(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``ordinal``: the place in the document, from 0."""
    order = W.partitionBy("document_id").orderBy("page_number", "ordinal_in_page")
    return chunks.withColumn("ordinal", F.row_number().over(order) - 1)


def document_counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, page_count, chunk_count; a document without chunks has 0."""
    rows = pages.select("document_id", F.lit(1).alias("p"), F.lit(0).alias("c")).unionAll(chunks.select("document_id", F.lit(0), F.lit(1)))
    return rows.groupBy("document_id").agg(F.sum("p").alias("page_count"), F.sum("c").alias("chunk_count"))


def content_dedup(uploads: DataFrame) -> DataFrame:
    """seq, portfolio_id, sha256, document_seq, created: the same bytes in one portfolio are one
    document, the first; only hashes and ids are shuffled."""
    hashed = uploads.select("seq", "portfolio_id", F.sha2("content", 256).alias("sha256"))
    first = F.min("seq").over(W.partitionBy("portfolio_id", "sha256"))
    return hashed.withColumn("document_seq", first).withColumn("created", F.col("seq") == F.col("document_seq"))


def retry_failed_duplicates(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that failed and whose bytes were uploaded again: document_id."""
    again = uploads.select("portfolio_id", F.sha2("content", 256).alias("content_sha256")).distinct()
    return documents.filter("status = 'failed'").join(again, ["portfolio_id", "content_sha256"], "left_semi").select("document_id")


def rebuild_derived(existing: DataFrame, rebuilt: DataFrame, key: str = "document_id") -> DataFrame:
    """Derived rows with those of the documents in ``rebuilt`` replaced; a retry gives the same rows."""
    return existing.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(rebuilt)


def cascade_delete(children: dict[str, DataFrame], deleted: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every child table without the rows of deleted documents."""
    gone = deleted.select(key).distinct()
    return {name: rows.join(gone, key, "left_anti") for name, rows in children.items()}


DIGESTS: dict[str, Callable[[bytes], bytes]] = {"blake2b": lambda x: hashlib.blake2b(x, digest_size=8).digest(), "md5": lambda x: hashlib.md5(x).digest()}


def hash_features(tokens: pa.Array, dims: int, digest: str) -> np.ndarray:
    """A unit vector for each list of ``tokens``: hashed words (weight 1) and neighbouring pairs (one half);
    the first axis where there are none. Each distinct word and pair of the batch is hashed once."""
    sizes = np.diff(tokens.offsets.to_numpy())
    words = tokens.flatten().dictionary_encode()
    row, code, known = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy(), words.dictionary.to_pylist()
    next_to = np.flatnonzero(row[1:] == row[:-1])
    pair, of = np.unique(code[next_to].astype(np.int64) * len(known) + code[next_to + 1], return_inverse=True)
    names = [*known, *(f"{known[p // len(known)]} {known[p % len(known)]}" for p in pair.tolist())]
    h = np.array([int.from_bytes(DIGESTS[digest](x.encode())[:8], "big") for x in names], np.uint64)
    place, sign = (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    feature, row = np.concatenate([code, len(known) + of]), np.concatenate([row, row[next_to]])
    weight = sign[feature] * np.where(feature < len(known), 1.0, 0.5)
    v = np.bincount(row * dims + place[feature], weights=weight, minlength=len(sizes) * dims).reshape(len(sizes), dims)
    norm = np.linalg.norm(v, axis=1)
    v[norm == 0, 0] = 1.0
    return v / np.where(norm == 0, 1.0, norm)[:, None]


def hashed_embeddings(texts: DataFrame, key: str, *carried: str, dims: int = 384, embed: Callable[[list[str]], list] | None = None, digest: str = "blake2b") -> DataFrame:
    """``key``, ``carried`` columns and ``embedding`` of each text; ``embed`` takes the place of feature hashing, 32 texts a call.

    ``digest`` names the hash of a feature: its first eight bytes, as a big-endian number, give the
    axis and the sign. ``tokens`` are taken as they are where ``texts`` has them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                tokens = pc.fill_null(part.column("tokens"), pa.scalar([], pa.list_(pa.string())))
                v = hash_features(tokens, dims, digest).astype(np.float32)
                yield pa.record_batch([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), pa.array(v.ravel()))], names=[key, *carried, "embedding"])

    @F.pandas_udf("array<float>")
    def called(text: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(text), 32):
            out += list(embed(text.iloc[i : i + 32].tolist()))
        return pd.Series(out)

    if embed:
        return texts.select(key, *carried, called("text").alias("embedding"))
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (key, *carried))
    tokens = F.col("tokens") if "tokens" in texts.columns else T.content_tokens(F.col("text"))
    return texts.select(key, *carried, tokens.alias("tokens")).mapInArrow(hashed, f"{kinds}, embedding array<float>")


def embed_missing(rows: DataFrame, key: str, *carried: str, embed: Callable[[list[str]], list] | None = None, digest: str = "blake2b") -> DataFrame:
    """As :func:`hashed_embeddings`, for rows that may have an ``embedding``: those keep it, and only the texts of the
    others (null: not embedded yet) are embedded."""
    known = rows.filter("embedding is not null").select(key, *carried, "embedding")
    return known.unionByName(hashed_embeddings(rows.filter("embedding is null").drop("embedding"), key, *carried, embed=embed, digest=digest))


def lexeme_places(chunks: DataFrame, *carried: str) -> DataFrame:
    """chunk_id, ``carried`` columns, lexeme, position: one row for each place of a lexeme; no shuffle."""
    return chunks.select("chunk_id", *carried, F.explode(T.lexemes(F.col("text"))).alias("l")).select("chunk_id", *carried, "l.lexeme", "l.position")


def token_places(passages: DataFrame, *carried: str) -> DataFrame:
    """chunk_id, ``carried`` columns, lexeme of passages whose ``tokens`` are kept: one row for each place."""
    return passages.select("chunk_id", *carried, F.explode("tokens").alias("lexeme"))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, lexeme, positions: one row for each lexeme of a chunk, made without a shuffle of texts."""
    each = chunks.select("chunk_id", F.explode(T.lexemes(F.col("text"))).alias("l"))
    return each.groupBy("chunk_id", "l.lexeme").agg(F.sort_array(F.collect_list("l.position")).alias("positions"))


#: Chunks that are stemmed at a time, and words whose stems a task keeps.
STEMMED, KNOWN = 500, 1 << 17


def stemmed_postings(chunks: DataFrame) -> DataFrame:
    """As :func:`postings` in the 'english' configuration: lexemes are stems, positions of one stem together.

    A chunk's postings are made where its row is, and nothing of a text is shuffled. Only where several rows have one
    chunk_id (ids alone are counted) are their postings brought together."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    several = written(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("chunk_id").alias("several"), F.lit(True).alias("again")))
    marked = chunks.select("chunk_id", "text").join(broadcast_if_small(several), F.col("chunk_id").eqNullSafe(F.col("several")), "left")
    made = lambda rows: rows.select("chunk_id", T.lexemes(F.col("text")).alias("l")).select("chunk_id", F.col("l.lexeme").alias("words"), F.col("l.position").alias("places")).filter("words is not null").mapInArrow(_stemmed, f"chunk_id {kind}, lexeme string, positions array<int>")
    again = made(marked.filter("again")).select("chunk_id", "lexeme", F.explode("positions").alias("position"))
    return made(marked.filter("again is null")).unionByName(again.groupBy("chunk_id", "lexeme").agg(F.sort_array(F.collect_set("position")).alias("positions")))


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, lexeme, positions of rows of chunk_id, words, places: each distinct word is stemmed once."""
    from docproof.functions.stem import stem

    known: dict[str, str] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, STEMMED):
            part = batch.slice(lo, STEMMED)
            column = part.column("words")
            words = column.flatten().dictionary_encode()
            if len(known) > KNOWN:
                known = {}
            stems = pa.array([known.get(w) or known.setdefault(w, stem(w)) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
            n = max(1, len(stems.dictionary))
            key = np.repeat(np.arange(part.num_rows), np.diff(column.offsets.to_numpy())) * n + stems.indices.to_numpy()[words.indices.to_numpy()]
            order = np.argsort(key, kind="stable")
            each, begin = np.unique(key[order], return_index=True)
            cut = np.append(begin, len(key)).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(cut), part.column("places").flatten().take(pa.array(order)))
            yield pa.record_batch([part.column("chunk_id").take(pa.array(each // n)), stems.dictionary.take(pa.array(each % n)), positions], names=["chunk_id", "lexeme", "positions"])
