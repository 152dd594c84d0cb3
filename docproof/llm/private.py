"""Personal data: identifiers by fixed form, and unseen ones by bootstrapped contextual extraction.

Identifiers of fixed form (the base: e-mail addresses, IP addresses, cards, phones) are the seeds. The one, two or
three words before an identifier are a lexical pattern. Patterns and the instances they stand before are a
graph: a pattern scores, for a kind, the confident instances it stands before as a share of all places where its
words occur, whatever follows; an instance is as confident as the best accepted pattern it follows. Scores go
to and fro until no further pattern is accepted (``SUPPORT`` distinct confident instances and a share of ``SCORE``).
What accepted patterns stand before and looks like their kind is extracted, though it has not the fixed form.

A candidate is a run of words with a digit or ``@`` in each, one blank between them, without those that base spans touch
and without punctuation at its ends. Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased, kept as 64-bit hashes; so are
instances, by their letters and digits. Base spans depend on no hash.

Cases: null text is empty and has no spans; offsets count code points; repeated rows are documents each, with or without
doc_id, and a repeated instance supports a pattern once; learnt spans meet neither base spans nor each other; the
better scored of two kinds wins, then the one listed first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docproof.llm.store import dropped, settled
from docproof.llm.textbytes import LOWER, hashed, mixed, positions, text_blocks, words

KINDS = ("email", "ip", "card", "phone")
#: Distinct confident instances that accept a pattern, its least score, and bits of the filter of pattern keys.
SUPPORT, SCORE, FILTER = 5, 0.5, 24
WORDS = 3
# Fixed forms. A run of digits is tried from its first digit only: what its other digits begin fails alike.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGE = " \t\r\n\v\f.,;:!?\"'()[]{}<>=/|«»“”„‘’"
NUMBER = np.zeros(256, bool)
NUMBER[48:58] = NUMBER[ord("@")] = True
SPAN = "array<struct<start:int,kind:int,end:int>>"
MENTION = "array<struct<kind:int,start:int,end:int,shape:int,instance:bigint,c1:bigint,c2:bigint,c3:bigint>>"


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    """Whether the last digit is the check digit of the others."""
    doubled = [2 * d - 9 if d > 4 else 2 * d for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers of fixed form, by start, then kind."""
    out, done = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            out.append((start, 0, done))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out)


def looks_like(s: str) -> int:
    """Bit k: the candidate could be of kind k."""
    n, letters = len(_digits(s)), any(c.isalpha() for c in s)
    email = "@" in s or letters and any(c in "._-+" for c in s)
    ip = sum(c in ".:" for c in s) >= 2 and all(c in "0123456789abcdefABCDEF.:%/" for c in s)
    return email | ip << 1 | (n >= 8 and not letters) << 2 | (7 <= n <= 15 and not letters) << 3


def instance(s: str) -> int:
    """64 bits of an identifier's letters and digits."""
    return xxhash.xxh64_intdigest("".join(c for c in s.lower() if c.isalnum()).encode("utf-8", "surrogatepass")) - (1 << 63)


def contexts(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(WORDS, n) keys of the last one, two, ... words up to each word, never 0; 0 where a text has not so many."""
    out, key = np.zeros((WORDS, len(h)), np.uint64), np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        if len(h) <= k:
            break
        key[k:] = mixed(key[k:] + h[: len(h) - k] * np.uint64(2 * k + 3)) | np.uint64(1)
        out[k, k:] = np.where(row[k:] == row[: len(h) - k], key[k:], 0)
    return out


def _mentions(text: str, starts: np.ndarray, ends: np.ndarray, numbered: np.ndarray, base: list[tuple]) -> list[tuple]:
    """(word before, kind, start, end) of the base spans (kind as it is) and candidates (-1) of a text, whose words are
    at ``starts`` and ``ends``; ``numbered`` are those with a digit or @."""
    out = [(int(np.searchsorted(ends, s, "right")) - 1, kind, s, e) for s, kind, e in base]
    free = np.ones(len(numbered), bool)
    first, last = starts[numbered], ends[numbered]
    for s, _, e in base:
        free[np.searchsorted(last, s, "right") : np.searchsorted(first, e)] = False
    own = numbered[free]
    if not len(own):
        return out
    blank = np.array([text[e : e + 1] == " " for e in ends[own].tolist()])
    apart = np.flatnonzero((own[1:] != own[:-1] + 1) | (starts[own[1:]] != ends[own[:-1]] + 1) | ~blank[:-1]) + 1
    for run in np.split(own, apart):
        s, e = int(starts[run[0]]), int(ends[run[-1]])
        inner = text[s:e].strip(EDGE)
        if inner:
            s += text[s:e].index(inner)
            out.append((int(run[0]) - 1, -1, s, s + len(inner)))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and mentions of each text; hashes are made of the words before a mention only."""
    for batch in batches:
        texts = batch.column("text")
        for lo, hi, data, offsets in text_blocks(batch, "text"):
            spans, told = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
            has = np.add.reduceat(np.append(NUMBER[data], False), offsets[:-1]) * (np.diff(offsets) > 0) if hi > lo else ()
            found = []
            if np.any(has):
                starts, ends, row = words(data, offsets)
                numbered = np.flatnonzero(np.add.reduceat(np.append(NUMBER[data], False), np.column_stack([starts, ends]).ravel())[::2])
                point = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                which = np.searchsorted(row[numbered], np.arange(hi - lo + 1))
                for r in np.flatnonzero(has).tolist():
                    text, a, b = texts[lo + r].as_py(), first[r], first[r + 1]
                    spans[r] = base_spans(text)
                    zero = point[offsets[r]]
                    for before, kind, s, e in _mentions(text, point[starts[a:b]] - zero, point[ends[a:b]] - zero, numbered[which[r] : which[r + 1]] - a, spans[r]):
                        s_text = text[s:e]
                        found.append((r, a + before if before >= 0 else -1, kind, s, e, 15 if kind >= 0 else looks_like(s_text), instance(s_text)))
            if found:
                need = sorted({w - k for _, w, *_ in found if w >= 0 for k in range(WORDS) if w >= k})
                keys = np.zeros((WORDS, 0), np.uint64)
                if need:
                    need = np.array(need)
                    at, place, begin = positions(starts[need], ends[need])
                    h = hashed(LOWER[data[at]], place, begin)
                    # Words that are not neighbours are kept apart as texts are.
                    keys = contexts(h, need - np.arange(len(need)) + row[need] * (len(starts) + 1))
                for r, w, kind, s, e, shape, known in found:
                    c = keys[:, np.searchsorted(need, w)].view(np.int64).tolist() if w >= 0 else [0] * WORDS
                    told[r].append({"kind": kind, "start": s, "end": e, "shape": shape, "instance": known, "c1": c[0], "c2": c[1], "c3": c[2]})
            # Every row of the block, those without spans too.
            yield pa.record_batch([
                batch.column("rid").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo),
                pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
                pa.array(told, pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "shape")] + [(n, pa.int64()) for n in ("instance", "c1", "c2", "c3")]))),
            ], names=["rid", "doc_id", "base", "mentions"])


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: all places where the words of a pattern occur and a word follows.

    The keys of ``patterns`` are sent as a filter of 2**FILTER bits whatever their number; what passes it is
    counted before the shuffle and joined with the keys."""
    slot = F.shiftrightunsigned("pattern", 64 - FILTER)
    bits = patterns.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pattern, {64 - FILTER}) & 63 as int))").alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**FILTER / 64 rows at most
    held = np.zeros(1 << FILTER - 6, np.uint64)
    held[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch, "text"):
                starts, ends, row = words(data, offsets)
                if not len(starts):
                    continue
                at, place, begin = positions(starts, ends)
                followed = np.append(row[1:] == row[:-1], False)
                keys = contexts(hashed(LOWER[data[at]], place, begin), row)[:, followed].ravel()
                slots = (keys >> np.uint64(64 - FILTER)).astype(np.int64)
                keys = keys[(shared.value[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & (keys != 0)]
                key, n = np.unique(keys, return_counts=True)
                yield pa.record_batch({"pattern": key.view(np.int64), "n": n})

    met = docs.select("text").mapInArrow(counted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return met.join(patterns.select("pattern"), "pattern")


def learnt_patterns(docs: DataFrame, found: DataFrame, support: int, least: float) -> DataFrame:
    """pattern, kind, score of the accepted patterns. ``found`` has the mentions of ``docs``."""
    said = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = said.select("kind", "shape", "instance", F.explode(F.array("c1", "c2", "c3")).alias("pattern")).filter("pattern <> 0")
    edges = settled(edges.groupBy("pattern", "instance", "kind", "shape").agg(F.count("*").alias("n")))
    # A pattern that stands before fewer different instances can never be accepted.
    once = edges.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("instances"))
    patterns = settled(_occurrences(docs, once.filter(F.col("instances") >= support)))
    edges = settled(edges.join(patterns.select("pattern"), "pattern", "left_semi"))
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct().withColumn("confidence", F.lit(1.0))
    confident, accepted, known = seeds, None, -1
    while True:
        told = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")).join(confident, "instance")
        score = told.groupBy("pattern", "kind").agg(F.sum(F.round(F.col("n") * F.col("confidence"), 6).cast("decimal(38,6)")).alias("sure"), F.count("*").alias("support"))
        score = score.join(patterns, "pattern").withColumn("score", F.col("sure").cast("double") / (F.col("total") + 1))
        now = settled(score.filter((F.col("support") >= support) & (F.col("score") >= least)).select("pattern", "kind", "score"))
        if accepted is not None:
            dropped(accepted)
        accepted, count = now, now.count()
        if count <= max(known, 0):
            return accepted
        known = count
        new = edges.filter("kind < 0").select("pattern", "instance", "shape").distinct().join(accepted, "pattern").filter(_possible("shape", "kind"))
        confident = seeds.unionByName(new.select("instance", "kind", F.col("score").alias("confidence"))).groupBy("instance", "kind").agg(F.max("confidence").alias("confidence"))


def _possible(shape: str, kind: str) -> Column:
    return F.expr(f"shiftright({shape}, {kind}) & 1 = 1")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, least: float = SCORE) -> DataFrame:
    """doc_id, base, learnt (arrays of start, kind, end), n_learnt and the counts and strings of both.

    ``docs``: doc_id, text. n_email, n_ip, n_card, n_phone count base spans; ``spans`` tells all of them."""
    texts = docs.select("doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text")
    found = settled(rows.mapInArrow(_read, f"rid long, doc_id {id_type}, base {SPAN}, mentions {MENTION}"))
    accepted = learnt_patterns(texts, found, support, least)
    open_ = found.select("rid", F.explode(F.filter("mentions", lambda m: m["kind"] < 0)).alias("m"))
    open_ = open_.select("rid", "m.start", "m.end", "m.shape", F.explode(F.array("m.c1", "m.c2", "m.c3")).alias("pattern"))
    best = open_.join(accepted, "pattern").filter(_possible("shape", "kind")).groupBy("rid", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("last"))).alias("b"))
    learnt = best.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.last")).alias("kind"), "end"))).alias("learnt"))
    out = found.select("rid", "doc_id", "base").join(learnt, "rid", "left").withColumn("learnt", F.coalesce("learnt", F.expr(f"cast(array() as {SPAN})")))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    spans = _told(F.array_sort(F.concat("base", "learnt")))
    return out.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("learnt").cast("long").alias("n_learnt"), "base", "learnt")
