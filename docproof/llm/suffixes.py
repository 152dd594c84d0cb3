"""Removal of byte strings that already occur earlier, with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with
a smaller id, or earlier in the same one. Every such string holds an anchor, a 32-byte gram whose
hash is the least of its neighbourhood; which gram that is depends on the string alone, so equal
strings have equal anchors. The context of an anchor holds all strings of ``length`` bytes around
it. The work is

1. anchors of all texts, as hashes (no text is moved). Grams that occur once need no further look:
   no string around them can occur twice;
2. the contexts around all other anchors are cut out of the texts and dealt into shards by gram.
   What is the same byte for byte is one string of the shard's text, the first of its kind stays.
   Over the strings of each gram that has several a suffix array is built by Larsson-Sadakane
   refinement in numpy, Kasai's recurrence gives the common prefixes, and of the suffixes that share
   ``length`` bytes all but the first are gone;
3. where a gram has more contexts than a shard takes, they go to several shards by what they hold,
   and the sorted strings that each shard has kept are merged: each shard's are looked up in those
   of the shards before it by binary search;
4. the removed intervals meet their text once, where they are cut out.

Hashes only choose who meets whom. What is removed is decided on the bytes.

Cases: a null text is empty; documents without an id (a whole number) come after all others, in an
order of two hashes of their texts, 128 bits in all, and those with equal texts count as one;
repeated rows are one document and each gets its result; rows that share an id but not the text are
documents of their own, told apart and ordered by 64 bits of a hash of their texts; matches never
cross documents; texts shorter than ``length`` lose nothing; a text is read whole, and a task needs
some 60 times the bytes of the longest; an empty table gives no rows; further columns, whatever
their names, are carried by :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docproof.llm.columns import free
from docproof.llm.store import dropped, settled
from docproof.llm.textbytes import mixed, text_blocks
from docproof.llm.tiles import by_group

LENGTH, GRAM = 100, 32
#: Contexts of one gram that a shard takes; a gram with more is dealt to several shards.
SHARD = 16384
#: Rows whose contexts are cut out and compared at a time.
CUT = 100_000
#: Bytes that are copied at a time.
GATHERED = 1 << 20
#: Up to so many grams with more contexts than a shard takes are sent to every task; beyond, a shuffle join is used.
BROADCAST_GRAMS = 20_000

#: An odd base, its inverse modulo 2**64, and a symbol for each byte, for hashes of substrings.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


class Substrings:
    """Hashes of any substrings of ``data``, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, symbols: np.ndarray):
        n = len(data)
        power = np.full(n, np.uint64(_BASE))
        power[:1] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols[data] * power, out=self.sums[1:])
        back = np.full(n + 1, np.uint64(_BACK))
        back[:1] = 1
        self.back = np.cumprod(back)

    def grams(self, size: int) -> np.ndarray:
        return _spread((self.sums[size:] - self.sums[:-size]) * self.back[:-size])


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of a block: row, place in the block, gram hash, begin and end of its context.

    The context is what the strings cover whose least gram (the first, of equals) the anchor is."""
    none = np.zeros(0, np.int64)
    n, w = len(data), length - GRAM + 1
    if n < length:
        return none, none, none.view(np.uint64), none, none
    gram = Substrings(data, _BYTE).grams(GRAM)
    order = np.maximum((gram >> np.uint64(32)).astype(np.uint32), 1)
    least = _sliding(order, w, np.minimum)
    change = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    change[offsets[long]] += 1
    change[offsets[long + 1] - length + 1] -= 1
    least[np.cumsum(change[: len(least)], dtype=np.int8) == 0] = 0  # strings that would cross documents
    edge = np.zeros(w - 1, np.uint32)
    most = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    spots = np.flatnonzero((most == order) & (most > 0))
    # strings one after another with the same least hash are a run; the first gram with that hash
    # owns the run up to itself, and if the run goes on, the next such gram owns the rest
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    lo, hi = cut, np.append(cut[1:], len(least)) - 1
    some = least[lo] > 0
    lo, hi = lo[some], hi[some]
    value, rank, owned = order[spots], np.searchsorted(spots, lo), []
    while len(lo):
        off = np.flatnonzero(value[rank] != least[lo])
        while len(off):
            rank[off] += 1
            off = off[value[rank[off]] != least[lo[off]]]
        at = spots[rank]
        owned.append((at, lo, np.minimum(at, hi)))
        on = hi > at
        lo, hi, rank = at[on] + 1, hi[on], rank[on] + 1
    if not owned:
        return none, none, none.view(np.uint64), none, none
    at, first, last = (np.concatenate(x) for x in zip(*owned, strict=True))
    return np.searchsorted(offsets, at, "right") - 1, at, gram[at], first, last + length


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Start of each suffix in order, for strings put end to end (a suffix ends where its string does,
    ``ends`` says where for each place). Larsson-Sadakane: sorted by eight bytes first, then only
    groups that are still equal are refined by the ranks of what follows, twice as far each time."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + 1  # 0 is past the end; 9 bits a symbol, 7 symbols a key
    key = np.zeros(n, np.uint64)
    place = np.arange(n)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(place + k < ends, padded[k : n + k], np.uint64(0))
    order = np.argsort(key)
    return _refined(order, key[order], ends, 7)


def _refined(order: np.ndarray, sorted_key: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = head
    rank[n] = -1
    longest = int((ends - np.arange(n)).max()) if n else 0
    open_ = np.flatnonzero(~new | np.append(~new[1:], False))  # places in groups of several
    while depth < longest and len(open_):
        s = order[open_]
        follow = np.where(s + depth < ends[s], rank[np.minimum(s + depth, n)], -1)
        group = head[open_]
        by = np.argsort(group * (n + 2) + follow + 1)
        order[open_] = s[by]
        follow = follow[by]
        split = np.ones(len(by), bool)
        split[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        head[open_] = open_[np.maximum.accumulate(np.where(split, np.arange(len(by)), 0))]
        rank[order[open_]] = head[open_]
        alone = split & np.append(split[1:], True)
        open_ = open_[~alone]
        depth *= 2
    if len(open_):  # equal to their ends: by place
        order[open_] = order[open_][np.argsort(head[open_] * n + order[open_])]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of at least ``most`` bytes shares with the one before it in ``order``, up to ``most``.

    Kasai's recurrence: a suffix shares at most one byte less than the suffix one place before it.
    All strings are walked side by side, so a step is a few operations on arrays."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    stop = ends
    shared = np.zeros(n, np.int64)
    at, last = begins.copy(), ends[begins] - most + 1
    at, last = at[last > at], last[last > at]
    have = np.zeros(len(at), np.int64)
    while len(at):
        j = before[at]
        have = np.where(j < 0, 0, np.maximum(have - 1, 0))
        room = np.minimum(np.minimum(stop[at] - at, np.where(j < 0, 0, stop[np.maximum(j, 0)] - j)), most)
        have = np.minimum(have, room)
        grow = np.flatnonzero(have < room)
        while len(grow):
            same = text[at[grow] + have[grow]] == text[j[grow] + have[grow]]
            grow = grow[same]
            have[grow] += 1
            grow = grow[have[grow] < room[grow]]
        shared[at] = have
        at = at + 1
        going = at < last
        if not going.all():
            at, last, have = at[going], last[going], have[going]
    return shared[order]


WHO = ("none", "doc", "tag")


def _differ(who: tuple[np.ndarray, ...], i, j) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for x in who:
        out |= x[i] != x[j]
    return out


def _spans(who: tuple[np.ndarray, ...], lo: np.ndarray, hi: np.ndarray) -> dict:
    """Intervals of each document, joined where they touch."""
    order = np.lexsort((lo, *who[::-1]))
    who, lo, hi = tuple(x[order] for x in who), lo[order], hi[order]
    if len(lo):
        other = np.append(True, _differ(who, np.arange(1, len(lo)), np.arange(len(lo) - 1)))
        base = np.cumsum(other) * (np.int64(1) << 33)  # intervals of different documents never touch
        reach = np.maximum.accumulate(hi + base)
        cut = np.flatnonzero(np.append(True, (lo + base)[1:] > reach[:-1]))
        last = np.append(cut[1:], len(lo)) - 1
        who, lo, hi = tuple(x[cut] for x in who), lo[cut], (reach - base)[last]
    return {"none": who[0].astype(np.int32), "doc": who[1], "tag": who[2], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}


ANCHORS = "deal long, kind int, none int, doc long, tag long, lo int, hi int, more binary"
SINGLE, KNOWN, NOTICE = 0, 1, 2
_PLACE = np.dtype([("gram", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def _anchor_rows(length: int):
    """A row for each anchor whose gram the batch has once, dealt by gram. Of the others each document
    has one row with all its places, dealt by document, and each gram a notice of how many there are,
    so a gram that very many texts hold is a few rows of its own task."""

    def run(batches):
        for batch in batches:
            parts, who = [], tuple(batch.column(c).to_numpy() for c in WHO)
            for lo, _, data, offsets in text_blocks(batch, "text"):
                row, _, gram, begin, end = anchors(data, offsets, length)
                parts.append((gram.view(np.int64), lo + row, begin - offsets[row], end - offsets[row]))
            if not parts:
                continue
            gram, row, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            kinds, at, count = np.unique(gram, return_inverse=True, return_counts=True)
            once = count[at] == 1
            single = np.flatnonzero(once)
            n = len(single)
            yield pa.record_batch({
                "deal": gram[single], "kind": np.full(n, SINGLE, np.int32), **{c: x[row[single]] for c, x in zip(WHO, who, strict=True)},
                "lo": begin[single].astype(np.int32), "hi": end[single].astype(np.int32), "more": pa.nulls(n, pa.binary()),
            })
            known = np.flatnonzero(~once)
            known = known[np.argsort(row[known], kind="stable")]
            places = np.empty(len(known), _PLACE)
            places["gram"], places["lo"], places["hi"] = gram[known], begin[known], end[known]
            rows, first = np.unique(row[known], return_index=True)
            cut = np.append(first, len(known)) * _PLACE.itemsize
            n = len(rows)
            yield pa.record_batch({
                "deal": mixed(who[1][rows].view(np.uint64) + who[2][rows].view(np.uint64)).view(np.int64), "kind": np.full(n, KNOWN, np.int32), **{c: x[rows] for c, x in zip(WHO, who, strict=True)},
                "lo": np.zeros(n, np.int32), "hi": np.zeros(n, np.int32), "more": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(places.tobytes())]),
            })
            told, size = kinds[count > 1], count[count > 1]
            n, zero = len(told), np.zeros(len(told), np.int64)
            yield pa.record_batch({
                "deal": told, "kind": np.full(n, NOTICE, np.int32), "none": zero.astype(np.int32), "doc": zero, "tag": zero,
                "lo": zero.astype(np.int32), "hi": np.minimum(size, 1 << 30).astype(np.int32), "more": pa.nulls(n, pa.binary()),
            })

    return run


#: kind SINGLE: an anchor whose gram (deal) occurs again; KNOWN: many of one document; NOTICE: a gram, with its count in doc.
LOOK = "kind int, deal long, none int, doc long, tag long, lo int, hi int, more binary"


def _repeated(t: pa.Table, _):
    """The anchors whose gram occurs more than once, and how often, if that is more than a shard takes."""
    kind, deal, hi = (t.column(c).to_numpy() for c in ("kind", "deal", "hi"))
    mine = np.flatnonzero(kind != KNOWN)
    start = np.flatnonzero(np.append(True, deal[mine][1:] != deal[mine][:-1])) if len(mine) else mine
    weight = np.where(kind[mine] == NOTICE, hi[mine], 1).astype(np.int64)
    total = np.add.reduceat(weight, start) if len(mine) else weight
    often = np.repeat(total, np.diff(np.append(start, len(mine))))
    look = np.sort(np.concatenate([mine[(often > 1) & (kind[mine] == SINGLE)], np.flatnonzero(kind == KNOWN)]))
    yield from t.select([c.split()[0] for c in LOOK.split(", ")]).take(pa.array(look)).to_batches()
    large = start[total > SHARD]
    n, zero = len(large), np.zeros(len(large), np.int64)
    yield pa.record_batch({"kind": np.full(n, NOTICE, np.int32), "deal": deal[mine[large]], "none": zero.astype(np.int32), "doc": total[total > SHARD], "tag": zero, "lo": zero.astype(np.int32), "hi": zero.astype(np.int32), "more": pa.nulls(n, pa.binary())})


CONTEXTS = "gone int, deal long, none int, doc long, tag long, lo int, hi int, bytes binary"


def _gathered(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data[lo:hi]`` of all intervals put end to end, and where each begins (and the end)."""
    size = hi - lo
    cut = np.append(0, np.cumsum(size))
    out, a = np.empty(int(cut[-1]), np.uint8), 0
    while a < len(size):  # some at a time, as each byte takes two places in the index
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + GATHERED, "right")) - 1)
        out[cut[a] : cut[b]] = data[np.arange(cut[a], cut[b]) - np.repeat(cut[a:b] - lo[a:b], size[a:b])]
        a = b
    return out, cut


def _kinds(gram: np.ndarray, held: pa.Array, who: tuple[np.ndarray, ...], lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of a gram: those that are the first of what is the same byte for byte, and for each
    context that first one."""
    code = held.dictionary_encode().indices.to_numpy()
    order = np.lexsort((lo, *who[::-1], code, gram))
    new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (code[order][1:] != code[order][:-1]))[: len(order)]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return order[new], first


def _contexts(t: pa.Table, starts: np.ndarray):
    """Each document's contexts, cut out of its text (the first row of its group). Of equal ones only the
    first goes on, the others are gone."""
    kind = t.column("kind").to_numpy()
    group = np.repeat(starts[:-1], np.diff(starts))  # the row with the text
    texts = t.column("text").combine_chunks().cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    known = np.flatnonzero(kind == 1 + KNOWN)
    blobs = t.column("more").combine_chunks().take(pa.array(known))
    sizes = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(known) + 1]) // _PLACE.itemsize if len(known) else known
    places = np.frombuffer(b"".join(blobs.to_pylist()), _PLACE)
    single = np.flatnonzero(kind == 1 + SINGLE)
    row = np.concatenate([single, np.repeat(known, sizes)])
    gram = np.concatenate([t.column("deal").to_numpy()[single], places["gram"]])
    lo = np.concatenate([t.column("lo").to_numpy()[single], places["lo"]]).astype(np.int64)
    hi = np.concatenate([t.column("hi").to_numpy()[single], places["hi"]]).astype(np.int64)
    if not len(row):
        return
    who = tuple(t.column(c).to_numpy()[row] for c in WHO)
    begin = offsets[group[row]]
    raw, cut = _gathered(data, begin + lo, begin + hi)
    held = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
    keep, first = _kinds(gram, held, who, lo)
    gone = np.flatnonzero(_differ((*who, lo), np.arange(len(row)), first))
    spans = _spans(tuple(x[gone] for x in who), lo[gone], hi[gone])
    n = len(spans["lo"])
    yield pa.record_batch({"gone": np.ones(n, np.int32), "deal": mixed(spans["doc"].view(np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64), **spans, "bytes": pa.nulls(n, pa.binary())})
    n = len(keep)
    yield pa.record_batch({
        "gone": np.zeros(n, np.int32), "deal": gram[keep], **{c: x[keep] for c, x in zip(WHO, who, strict=True)}, "lo": lo[keep].astype(np.int32), "hi": hi[keep].astype(np.int32),
        "bytes": held.take(pa.array(keep)).cast(pa.binary()),
    })


#: kind 1: an interval that is gone; 3: a string that a shard of a shared gram has kept.
SHARDED = "kind int, none int, doc long, tag long, lo int, hi int, gram long, part int, parts int, string binary"


def _shard(length: int):
    """Suffix arrays of the contexts of a shard; what a shared gram's shard keeps is told (kind 3)."""

    def work(t: pa.Table, _):
        done = t.column("gone").to_numpy() > 0
        who = tuple(t.column(c).to_numpy() for c in WHO)
        gram, lo, hi, part, parts = (t.column(c).to_numpy().astype(np.int64) for c in ("deal", "lo", "hi", "part", "parts"))
        live = np.flatnonzero(~done)
        held = t.column("bytes").combine_chunks().take(pa.array(live)).cast(pa.large_binary())
        mine = tuple(x[live] for x in who)
        keep, first = _kinds(gram[live], held, mine, lo[live])
        gone = live[_differ((*mine, lo[live]), np.arange(len(live)), first)]
        over = [np.flatnonzero(done), gone]
        # distinct contexts: those of a gram that has several, or whose gram other shards have too
        keep = keep[np.argsort(gram[live[keep]], kind="stable")]
        g = gram[live[keep]]
        kin = g[1:] == g[:-1]
        look = keep[np.append(False, kin)[: len(keep)] | np.append(kin, False)[: len(keep)] | (parts[live[keep]] > 1)]
        raw = held.take(pa.array(look))
        cut = np.frombuffer(raw.buffers()[1], np.int64)[: len(look) + 1] if len(look) else np.zeros(1, np.int64)
        text = np.frombuffer(raw.buffers()[2], np.uint8)[cut[0] : cut[-1]] if len(look) else np.zeros(0, np.uint8)
        sizes, begins = np.diff(cut), cut[:-1] - cut[0]
        ends = np.repeat(begins + sizes, sizes)
        order = suffix_array(text, ends)
        shared = common_prefixes(text, order, begins, ends, length)
        group = np.cumsum(shared < length)
        able = ends[order] - order >= length
        s, group = order[able], group[able]
        of = np.repeat(np.arange(len(look)), sizes)[s] if len(s) else s
        at = live[look[of]]
        start = lo[at] + s - begins[of]
        by = np.lexsort((start, *(x[at] for x in who[::-1]), group))
        s, group, at, start = s[by], group[by], at[by], start[by]
        head = np.append(True, group[1:] != group[:-1])[: len(group)]
        to = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else group
        again = _differ((*(x[at] for x in who), start), np.arange(len(group)), to)
        whole = np.concatenate(over)
        spans = _spans(
            tuple(np.concatenate([x[whole], x[at[again]]]) for x in who),
            np.concatenate([lo[whole], start[again]]), np.concatenate([hi[whole], start[again] + length]),
        )
        n = len(spans["lo"])
        none, zero = pa.nulls(n, pa.binary()), np.zeros(n, np.int64)
        yield pa.record_batch({"kind": np.ones(n, np.int32), **spans, "gram": zero, "part": zero.astype(np.int32), "parts": zero.astype(np.int32), "string": none})
        tell = np.flatnonzero(head & (parts[at] > 1))
        n = len(tell)
        if n:
            at, start, s = at[tell], start[tell], s[tell]
            raw = text[s[:, None] + np.arange(length)]
            yield pa.record_batch({
                "kind": np.full(n, 3, np.int32), **{c: x[at] for c, x in zip(WHO, who, strict=True)}, "lo": start.astype(np.int32), "hi": (start + length).astype(np.int32),
                "gram": gram[at], "part": part[at].astype(np.int32), "parts": parts[at].astype(np.int32),
                "string": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * length).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]),
            })

    return work


def _merge(length: int):
    """The sorted strings of several shards of one gram merged: each shard's are looked up in those of
    the shards before it by binary search; of equal strings all but the first are gone."""

    def work(t: pa.Table, starts: np.ndarray):
        who = (*(t.column(c).to_numpy() for c in WHO), t.column("lo").to_numpy().astype(np.int64))
        part = t.column("part").to_numpy()
        gone = [np.zeros(0, np.int64)]
        for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            string = np.frombuffer(b"".join(t.column("string").slice(a, b - a).to_pylist()), f"S{length}")  # all of one size, so padding never matters
            runs = np.flatnonzero(np.append(True, part[a + 1 : b] != part[a : b - 1]))
            known, owner = string[:0], np.zeros(0, np.int64)
            for lo, hi in zip(runs.tolist(), [*runs[1:].tolist(), b - a], strict=True):
                run, mine = string[lo:hi], a + np.arange(lo, hi)
                at = np.searchsorted(known, run)
                met = np.flatnonzero(at < len(known))
                met = met[known[at[met]] == run[met]]
                theirs = owner[at[met]]
                # the earlier of the two stays, and stands for both
                both = np.lexsort((np.tile([0, 1], len(met)), *(np.stack([x[theirs], x[mine[met]]], 1).ravel() for x in who[::-1]), np.repeat(np.arange(len(met)), 2))).reshape(-1, 2)
                second = both[:, 0] % 2 == 1
                gone.append(np.where(second, theirs, mine[met]))
                owner[at[met]] = np.where(second, mine[met], theirs)
                new = np.ones(len(run), bool)
                new[met] = False
                known, owner = np.insert(known, at[new], run[new]), np.insert(owner, at[new], mine[new])
        gone = np.concatenate(gone)
        spans = _spans(tuple(x[gone] for x in who[:3]), who[3][gone], who[3][gone] + length)
        yield pa.record_batch(spans)

    return work


GONE = "none int, doc long, tag long, lo int, hi int"


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with who a row is, as columns ``names``: none (1 without an id), doc, tag, and the text."""
    text, number = F.coalesce("text", F.lit("")), F.col("doc_id").try_cast("long")
    none, doc, tag, whole = names
    return docs.withColumns({none: number.isNull().cast("int"), doc: F.coalesce(number, F.xxhash64(F.lit(99), text)), tag: F.xxhash64(text), whole: text})


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """none, doc, tag, spans (begin and end in bytes, in order; they may overlap)."""
    texts = _keyed(docs.select("doc_id", "text"), ["none", "doc", "tag", "whole"]).select(*WHO, F.col("whole").alias("text"))
    rows = texts.mapInArrow(_anchor_rows(length), ANCHORS)
    look = settled(rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(by_group(["deal"], _repeated), LOOK))

    nothing = lambda kind: F.lit(None).cast(kind)
    whole = texts.select(*WHO, F.lit(0).alias("kind"), nothing("long").alias("deal"), nothing("int").alias("lo"), nothing("int").alias("hi"), nothing("binary").alias("more"), "text")
    seen = look.filter(F.col("kind") != NOTICE).select(*WHO, (F.col("kind") + 1).alias("kind"), "deal", "lo", "hi", "more", nothing("string").alias("text"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("deal", "lo", "hi")}
    both = whole.unionByName(seen).withColumns(zero).repartition(*WHO).sortWithinPartitions(*WHO, "kind")
    cut = both.mapInArrow(by_group(list(WHO), _contexts, CUT), CONTEXTS)
    many = look.filter(F.col("kind") == NOTICE).select("deal", F.col("doc").alias("n"))
    parts = many.count()
    if parts:
        cut = cut.join(F.broadcast(many) if parts <= BROADCAST_GRAMS else many, "deal", "left")
        cut = cut.withColumn("parts", F.coalesce(F.ceil(F.col("n") / SHARD), F.lit(1)).cast("int")).withColumn("part", F.pmod(F.xxhash64("bytes"), "parts").cast("int"))
    else:
        cut = cut.withColumns({"part": F.lit(0), "parts": F.lit(1)})
    dealt = cut.select("deal", "part", "parts", "gone", *WHO, "lo", "hi", "bytes").repartition("deal", "part").sortWithinPartitions("deal", "part")
    shards = settled(dealt.mapInArrow(by_group(["deal", "part"], _shard(length), 10_000), SHARDED))
    dropped(look)

    gone = shards.filter("kind = 1").select(*WHO, "lo", "hi")
    if parts:
        kept = shards.filter("kind = 3").withColumn("slice", F.pmod(F.xxhash64("string"), F.col("parts")).cast("int"))
        kept = kept.select("gram", "slice", "part", "string", *WHO, "lo").repartition("gram", "slice").sortWithinPartitions("gram", "slice", "part", "string")
        gone = gone.unionByName(kept.mapInArrow(by_group(["gram", "slice"], _merge(length)), GONE))
    out = gone.groupBy(*WHO).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return out


def _runs(los: np.ndarray, his: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals as maximal runs."""
    reach = np.maximum.accumulate(his)
    new = np.append(True, los[1:] > reach[:-1])
    cut = np.flatnonzero(new)
    return los[cut], reach[np.append(cut[1:], len(los)) - 1]


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with the text (null as empty) and the begins and ends of what is gone, and the names of these three."""
    none, doc, tag, whole, lo, hi = names = free(docs.columns, "none", "doc", "tag", "whole", "los", "his")
    spans = repeats(docs, length).select(F.col("none").alias(none), F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans.lo").alias(lo), F.col("spans.hi").alias(hi))
    rows = _keyed(docs, names[:4]).join(spans, [none, doc, tag], "left")
    return rows.select(*[F.col(f"`{c}`") for c in [*docs.columns, whole, lo, hi]]), [whole, lo, hi]


def removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            los, his = batch.column("los"), batch.column("his")
            out = []
            for i, text in enumerate(batch.column("whole")):
                raw, removed, spans = text.as_py().encode(), 0, 0
                if los[i].is_valid:
                    lo, hi = _runs(los[i].values.to_numpy(), his[i].values.to_numpy())
                    removed, spans = int((hi - lo).sum()), len(lo)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                else:
                    kept = raw
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            n_bytes, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_spans(docs.select("doc_id", "text"), length)[0].drop("text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts; a character of which only some
    bytes are covered stays whole. n_chars, where there is one, follows the text; null texts and
    texts without repeats stay as they are, and so do all other columns."""

    rows, (whole, lo_name, hi_name) = _with_spans(docs, length)
    text_name = next(c for c in docs.columns if c.lower() == "text")

    def run(batches):
        for batch in batches:
            texts, los, his = batch.column(text_name), batch.column(lo_name), batch.column(hi_name)
            out = []
            for i, text in enumerate(texts):
                raw = text.as_py()
                if raw is not None and los[i].is_valid:
                    data = raw.encode()
                    tail = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80  # bytes within a character
                    lo, hi = _runs(los[i].values.to_numpy(), his[i].values.to_numpy())
                    pieces, at = [], 0
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        while a < len(data) and tail[a]:
                            a += 1
                        while b < len(data) and b > a and tail[b]:
                            b -= 1
                        pieces.append(data[at:a] if a > at else b"")
                        at = max(at, b)
                    raw = b"".join([*pieces, data[at:]]).decode()
                out.append(raw)
            i = batch.schema.get_field_index(text_name)
            yield batch.set_column(i, text_name, pa.array(out, texts.type)).drop_columns([lo_name, hi_name])

    out = rows.drop(whole).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
