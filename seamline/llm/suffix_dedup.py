"""Repeated substrings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Every window of LENGTH bytes has one anchor, the
K-byte string in it whose hash is least, so equal windows have equal anchors in equal places: only windows whose anchors occur
twice need a comparison. Those are dealt out by anchor and sorted in a mergesort that compares suffixes through prefix
polynomial hashes: binary search finds the common extension of two suffixes, the byte after it their order. Neighbours that
share LENGTH bytes form a class, confirmed byte by byte; all but the first member are repeats. Anchors that agree in the hash
of their whole context, too, need no sort: those that meet in one batch are compared byte by byte, others only on demand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.bytesets import chunks, mix, prefix_hashes, range_hash, utf8
from seamline.session import Scratch, shuffle_partitions

LENGTH, K = 100, 24
_W = LENGTH - K + 1  # anchors to choose from in a window
_POS = np.uint64((1 << 30) - 1)
#: A context of an anchor: what all windows that have it lie in.
_LEFT = LENGTH - K
#: Packed place of an anchor: 36 bits of offset, 7 each of the least and largest distance to a window's start; above them the mark of a known repeat.
_KNOWN, _OFF, _LO = 50, 14, 7
_WIDTH = _LEFT + LENGTH
_NULL = -(1 << 63)


def window_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first start, last start, anchor hash, context hash) for each run of windows with one anchor; rows don't mix."""
    n = len(data)
    zero = np.zeros(0, np.int64)
    starts = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    starts[offsets[:-1][long]] += 1
    np.subtract.at(starts, offsets[1:][long] - LENGTH + 1, 1)
    s = np.flatnonzero(np.cumsum(starts[:n]))
    if not len(s):
        return zero, zero, zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(n - K + 1)
    gram = mix(range_hash(prefix, at, at + K))
    v = (gram & ~_POS) | at.astype(np.uint64)
    pad = -len(v) % _W + _W
    v = np.concatenate([v, np.full(pad, ~np.uint64(0), np.uint64)]).reshape(-1, _W)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[s], ahead[s + _W - 1]) & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)]))
    first, last, anchor = s[new], s[np.append(new[1:], len(s)) - 1], anchor[new]
    row = np.searchsorted(offsets, anchor, side="right") - 1
    # rows of no bytes share an offset: the one that holds the anchor is the last of them
    lo, hi = np.maximum(anchor - _LEFT, offsets[row]), np.minimum(anchor + LENGTH, offsets[row + 1])
    context = mix(range_hash(prefix, lo, hi) + mix((anchor - lo).astype(np.uint64) << np.uint64(8) | (hi - lo).astype(np.uint64)))
    return row, anchor, first, last, gram[anchor], context


def _extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length, up to LENGTH, that the suffixes at a and b have in common by their hashes: a binary search of all pairs at once."""
    out = np.full(len(a), LENGTH, np.int64)
    rest = np.flatnonzero(range_hash(prefix, a, a + LENGTH) != range_hash(prefix, b, b + LENGTH))
    lo, hi, x, y = np.zeros(len(rest), np.int64), np.full(len(rest), LENGTH - 1), a[rest], b[rest]
    for _ in range(LENGTH.bit_length()):
        mid = (lo + hi + 1) >> 1
        same = range_hash(prefix, x, x + mid) == range_hash(prefix, y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, 0))
    out[rest] = lo
    return out


def _compare(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the LENGTH bytes at a come before, with or after those at b."""
    n = _extension(prefix, a, b)
    short = n < LENGTH
    i = np.minimum(n, LENGTH - 1)
    return np.where(short, np.sign(data[a + i].astype(np.int64) - data[b + i]), 0)


def suffix_sort(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Stable order of suffixes within their segments (equal values stand together): a bottom-up mergesort.

    Runs of all segments are merged together; a suffix finds its place in the partner run by binary search.
    """
    n = len(start)
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base, length = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(n)
    width = 1
    while n and width < size.max():
        p = np.flatnonzero(length > width)
        q = p - base[p]
        run = q // width
        partner = base[p] + (run ^ 1) * width
        plen = np.clip(length[p] - (run ^ 1) * width, 0, width)
        right = (run & 1) == 1
        lo, hi = np.zeros(len(p), np.int64), plen.copy()
        own = start[order[p]]
        for _ in range(width.bit_length() + 1):
            k = np.flatnonzero(lo < hi)
            if not len(k):
                break
            mid = (lo[k] + hi[k]) >> 1
            c = _compare(data, prefix, start[order[partner[k] + mid]], own[k])
            before = (c < 0) | (right[k] & (c == 0))
            lo[k] = np.where(before, mid + 1, lo[k])
            hi[k] = np.where(before, hi[k], mid)
        to = base[p] + (run & ~1) * width + (q - run * width) + lo
        merged = order.copy()
        merged[to] = order[p]
        order = merged
        width *= 2
    return order


def _rows_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = np.arange(LENGTH)
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
        out[i : i + (1 << 14)] = (data[x[:, None] + step] == data[y[:, None] + step]).all(axis=1)
    return out


def repeats(data: np.ndarray, start: np.ndarray, segment: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows equal one of a smaller rank in their segment; ``segment`` is sorted."""
    prefix = prefix_hashes(data)
    order = suffix_sort(data, prefix, start, segment)
    s, g = start[order], segment[order]
    joined = np.zeros(len(s), bool)
    near = np.flatnonzero(g[1:] == g[:-1]) + 1
    near = near[_extension(prefix, s[near - 1], s[near]) == LENGTH]
    real = _rows_equal(data, s[near - 1], s[near])
    joined[near[real]] = True
    group = np.cumsum(~joined) - 1
    if not real.all():  # two strings of one hash: settle their segments on the bytes
        bad = np.isin(g, g[near[~real]])
        rows = np.concatenate([g[bad].astype(np.int64).view(np.uint8).reshape(-1, 8), data[s[bad][:, None] + np.arange(LENGTH)]], axis=1)
        group[bad] = np.unique(rows, axis=0, return_inverse=True)[1].ravel() + len(s)
        group = np.unique(group, return_inverse=True)[1]
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank[order])
    out = np.zeros(len(s), bool)
    out[order] = rank[order] > least[group]
    return out


#: Rows of one anchor that are held to see how many contexts it has; of an anchor with more contexts than HOT each window is dealt out by itself.
_HELD, HOT = 1 << 16, 20_000
#: Distance in the place of a window that travels by itself: its context is the window.
_ALONE = 127
_ANCHOR = "anchor long, context long, doc long, u long, place long"
_MARK = "doc long, u long, first long, last long"


def _documents(docs: DataFrame) -> DataFrame:
    """(doc, u, text): null ids as the least number; u, a hash of the text, tells texts of one id apart (0 where an id is one row's own)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    again = rows.where("id is not null").groupBy("id").count().where("count > 1")
    u = F.xxhash64("text") if not again.isEmpty() else F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.select(F.coalesce("id", F.lit(_NULL)).alias("doc"), u.alias("u"), "text")


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where rows sorted by ``keys`` begin a new value."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _begins(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last row marked ``new``."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether data[a:a_end] equals data[b:b_end], row by row, for ranges of up to _WIDTH bytes."""
    out = (a_end - a) == (b_end - b)
    step = np.arange(_WIDTH)
    for i in range(0, len(a), 1 << 14):
        s = slice(i, i + (1 << 14))
        x, y = a[s, None] + step, b[s, None] + step
        inside = step < (a_end[s] - a[s])[:, None]
        last = len(data) - 1
        out[s] &= ((data[np.minimum(x, last)] == data[np.minimum(y, last)]) | ~inside).all(axis=1)
    return out


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in names.split(", ")])


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by _ANCHOR. Of equal contexts in a batch (equal in hash and bytes) only the first goes on; the others are known repeats (place has _KNOWN set)."""
    for b in batches:
        data, offsets = utf8(b.column("text"))
        doc, u = b.column("doc").to_numpy(), b.column("u").to_numpy()
        parts = []
        for i, j in chunks(offsets):
            o = offsets[i : j + 1] - offsets[i]
            row, anchor, first, last, h, c = window_anchors(data[offsets[i] : offsets[j]], o)
            place = (anchor - o[row]) << _OFF | (anchor - last) << _LO | (anchor - first)
            parts.append((h.astype(np.int64), c.astype(np.int64), row + i, place))
        h, c, r, p = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((p, u[r], doc[r], c, h))
        h, c, r, p = h[order], c[order], r[order], p[order]
        d, v = doc[r], u[r]
        new = _firsts(h, c)
        begin = _begins(new)
        at = np.flatnonzero(~new & ((d != d[begin]) | (v != v[begin]) | (p != p[begin])))
        anchor = offsets[r] + (p >> _OFF)
        lo, hi = np.maximum(anchor - _LEFT, offsets[r]), np.minimum(anchor + LENGTH, offsets[r + 1])
        at = at[_same_bytes(data, lo[at], hi[at], lo[begin[at]], hi[begin[at]])]
        h[at] = (mix(d[at].astype(np.uint64) + mix(p[at].astype(np.uint64)))).astype(np.int64)
        p[at] |= 1 << _KNOWN
        yield _batch(_ANCHOR, h, c, d, v, p)


_FOUND = "anchor long, context long, doc long, u long, place long, kind int"
#: Kinds of found anchors: a known repeat; the first of a context; the same of a hot anchor, window by window; one whose context
#: has the hash of an earlier one; the first of such a class under a hot anchor, for comparison only.
REPEAT, FIRST, HOT_FIRST, AGAIN, MODEL = range(5)


def _sift(batches: Iterator[pa.RecordBatch], most: int, hold: int, by_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context, doc, u, place: those that can take part in a repeat, by kind. An anchor of more than
    ``most`` contexts or ``hold`` rows is hot. Columns that nothing needs any more are 0."""
    held, giant = (np.zeros(0, np.int64),) * 5, None

    def told(h, c, d, u, p, going_on: bool = False) -> pa.RecordBatch:
        new, start = _firsts(h, c), _firsts(h)
        begin = _begins(new)
        again = ~new & ((d != d[begin]) | (u != u[begin]) | (p != p[begin]))
        run = np.cumsum(start) - 1
        contexts, size = np.bincount(run, new)[run], np.bincount(run)[run]
        hot = (contexts > most) | (size > hold) | (h == giant if giant is not None else False)
        shared = np.zeros(len(h), bool)
        if by_bytes:
            shared[begin[again]] = True
            shared[begin[-1]] |= going_on  # more rows of the last context may follow
        first = new & ((contexts > 1) | hot | shared)
        rows = np.concatenate([np.flatnonzero(first), np.flatnonzero(again), np.flatnonzero(new & hot & shared)])
        kind = np.concatenate([np.where(hot[first], HOT_FIRST, FIRST), np.full(again.sum(), AGAIN if by_bytes else REPEAT), np.full((new & hot & shared).sum(), MODEL)]).astype(np.int32)
        return _batch(_FOUND, np.where(kind == REPEAT, 0, h[rows]), c[rows] if by_bytes else np.zeros(len(rows), np.int64), d[rows], u[rows], p[rows], kind)

    for b in batches:
        new = [b.column(x.split()[0]).to_numpy(zero_copy_only=False) for x in _ANCHOR.split(", ")]
        known = (new[4] >> _KNOWN) == 1
        if known.any():
            place = new[4][known] & ((1 << _KNOWN) - 1)
            none = np.zeros(len(place), np.int64)
            yield _batch(_FOUND, none, none, *(x[known] for x in new[2:4]), place, np.full(len(place), REPEAT, np.int32))
        h, c, d, u, p = (np.concatenate([x, y[~known]]) for x, y in zip(held, new, strict=True))
        if not len(h):
            continue
        begin = int(np.searchsorted(h, h[-1]))
        if begin:
            yield told(h[:begin], c[:begin], d[:begin], u[:begin], p[:begin])
        if len(h) - begin > hold or h[-1] == giant and len(h) - begin > 1:
            giant = h[-1]
            yield told(h[begin:], c[begin:], d[begin:], u[begin:], p[begin:], going_on=True)
            begin += int(np.searchsorted(c[begin:], c[-1]))  # its first row stands for its context from here on
            held = tuple(x[begin : begin + 1] for x in (h, c, d, u, p))
        else:
            held = (h[begin:], c[begin:], d[begin:], u[begin:], p[begin:])
    if len(held[0]):
        yield told(*held)


_CONTEXT = "anchor long, class long, doc long, u long, place long, kind int, context binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each anchor; of a hot anchor's first contexts each window by itself, under a key of its own bytes."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=[x.split()[0] for x in _CONTEXT.split(", ")])

    for b in batches:
        data, offsets = utf8(b.column("text"))
        rows: list[tuple] = []
        for r, (doc, u, found) in enumerate(zip(b.column("doc").to_pylist(), b.column("u").to_pylist(), b.column("found").to_pylist(), strict=True)):
            text = data[offsets[r] : offsets[r + 1]].tobytes()
            for x in found:
                p, kind = x["place"], x["kind"]
                off = p >> _OFF
                if kind != HOT_FIRST:
                    rows.append((x["anchor"], x["context"], doc, u, p, kind, text[max(0, off - _LEFT) : off + LENGTH]))
                    continue
                for d in range((p >> _LO) & 127, (p & 127) + 1):
                    w = text[off - d : off - d + LENGTH]
                    key = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)
                    rows.append((key, 0, doc, u, (off - d) << _OFF | _ALONE << _LO | _ALONE, HOT_FIRST, w))
            if len(rows) > 50_000:
                yield out(rows)
                rows = []
        yield out(rows)


def _judge(key: np.ndarray, doc: np.ndarray, u: np.ndarray, place: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Marks of repeated windows among contexts, data[at:], sorted by key, doc, u, place."""
    off, lo, hi = place >> _OFF, (place >> _LO) & 127, place & 127
    count = hi - lo + 1
    run = _firsts(key)
    rank = np.cumsum(_firsts(key, doc, u, place))
    group = np.cumsum(run)
    i = np.repeat(np.arange(len(key)), count)
    d = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + lo[i]
    order = np.argsort(group[i] * 128 + d, kind="stable")
    i, d = i[order], d[order]
    start = at[i] + np.where(d == _ALONE, 0, np.minimum(off[i], _LEFT) - d)
    hit = repeats(data, start, group[i] * 128 + d, rank[i])
    i, s = i[hit], off[i[hit]] - np.where(d[hit] == _ALONE, 0, d[hit])
    order = np.lexsort((s, i))
    i, s = i[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1] + 1)])) if len(i) else np.zeros(0, np.int64)
    last = s[np.append(new[1:], len(s)) - 1] if len(i) else s
    return _batch(_MARK, doc[i[new]], u[i[new]], s[new], last)


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from contexts sorted by anchor, again, doc, u, place, a few thousand at a time, whole anchors together.

    Contexts with the hash of an earlier one are compared with it byte by byte; those that aren't equal are sorted with the firsts.
    """
    held: pa.Table | None = None

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cls, doc, u, place, kind = (t.column(c).to_numpy() for c in ("anchor", "class", "doc", "u", "place", "kind"))
        column = t.column("context").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        again = kind == AGAIN
        order = np.lexsort((place, u, doc, again, cls, key))
        begin = _begins(_firsts(key[order], cls[order]))
        at = np.flatnonzero(again[order])
        x, y = order[at], order[begin[at]]
        equal = _same_bytes(data, offsets[x], offsets[x + 1], offsets[y], offsets[y + 1]) & ~again[y]
        x = x[equal]
        off = place[x] >> _OFF
        yield _batch(_MARK, doc[x], u[x], off - (place[x] & 127), off - ((place[x] >> _LO) & 127))
        rest = np.ones(len(key), bool)
        rest[x] = False
        lone = again & rest  # of one hash with another context but not of its bytes: sorted like any other, and so is its class
        if not lone.any():
            rest &= kind != MODEL
        order = np.lexsort((place, u, doc, key))
        order = order[rest[order]]
        t_key, key = key, key[order]
        edges = np.append(np.flatnonzero(_firsts(key)), len(key)) if len(key) else np.zeros(1, np.int64)
        size = np.bincount(np.cumsum(_firsts(key)) - 1) if len(key) else np.zeros(0, np.int64)
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + 4000, side="right")) - 1)
            one = order[edges[i] : edges[j]][np.repeat(size[i:j] > 1, size[i:j])]  # nothing to sort where one context is left
            if len(one):
                yield _judge(t_key[one], doc[one], u[one], place[one], data, offsets[one])
            i = j

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not len(t):
            continue
        key = t.column("anchor").to_numpy()
        begin = int(np.searchsorted(key, key[-1]))
        if len(key) - begin > 4 * HOT:  # what very many texts hold: the first rows of its classes stand for all from here on
            yield from done(t)
            kind = t.column("kind").to_numpy()[begin:]
            stay = (kind != AGAIN) & (kind != HOT_FIRST)
            stay[:1] = True
            held = t.slice(begin).filter(pa.array(stay))
            continue
        if begin:
            yield from done(t.slice(0, begin))
        held = t.slice(begin)
    if held is not None and len(held):
        yield from done(held)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(marks: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of the bytes that windows with starts first to last cover."""
    out: list[list[int]] = []
    for a, b in sorted(marks):
        b = min(b + LENGTH, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removals(docs: DataFrame, hot: int = HOT, hold: int = _HELD, by_bytes: bool = False) -> DataFrame:
    """(doc, u, text, marks): every row of ``docs`` with its repeated windows. See ``repeated_bytes``."""
    rows = _documents(docs)
    n = shuffle_partitions(docs.sparkSession)
    anchors = rows.mapInArrow(_find_anchors, _ANCHOR).repartition(n, "anchor").sortWithinPartitions("anchor", "context", "doc", "u", "place")
    found = Scratch(docs.sparkSession).keep(anchors.mapInArrow(lambda batches: _sift(batches, hot, hold, by_bytes), _FOUND))
    dealt = rows.repartition(n, "doc", "u")  # texts are dealt out once; both joins below read that exchange
    wanted = found.where(F.col("kind") != REPEAT).groupBy("doc", "u").agg(F.collect_list(F.struct("anchor", "context", "place", "kind")).alias("found"))
    contexts = dealt.join(wanted, ["doc", "u"]).select("doc", "u", "text", "found").mapInArrow(_cut_contexts, _CONTEXT)
    order = ["anchor", (F.col("kind") == AGAIN).alias("again"), "doc", "u", "place"]
    marks = contexts.repartition(n, "anchor").sortWithinPartitions(*order).mapInArrow(_sort_contexts, _MARK)
    off, lo, hi = (F.shiftright("place", _OFF), F.shiftright("place", _LO).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127)))
    whole = found.where(F.col("kind") == REPEAT).select("doc", "u", (off - hi).alias("first"), (off - lo).alias("last"))
    by_doc = marks.unionByName(whole).groupBy("doc", "u").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    return dealt.join(by_doc, ["doc", "u"], "left")


def repeated_bytes(docs: DataFrame, hot: int = HOT, hold: int = _HELD, by_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text; others are ignored).

    A null text is empty; texts shorter than LENGTH lose nothing; an empty table gives no rows. Rows that repeat both id and
    text are one document and get one result each; different texts under one id, null ids too, are told apart and ordered by a
    hash; null ids come first.
    Anchors travel as four numbers; repeats in one batch are settled before the shuffle, so a text that a third of all rows
    hold reaches it a few times a task. Contexts of an anchor meet in one task up to HOT; beyond that each window goes its own way.
    Anchors in different batches that agree in two 64-bit hashes, of the anchor and of its context, count as repeats;
    ``by_bytes`` compares their bytes, too, which writes up to twice the corpus more.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            cols: list[list] = [[], [], [], [], []]
            for r, (doc, marks) in enumerate(zip(b.column("doc").to_pylist(), b.column("marks").to_pylist(), strict=True)):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                spans = covered([(m["first"], m["last"]) for m in marks or ()], len(text))
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                for c, v in zip(cols, (None if doc == _NULL else doc, len(text), sum(e - s for s, e in spans), len(spans), kept.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=[x.split()[0] for x in _RESULT.split(", ")])

    return removals(docs, hot, hold, by_bytes).select("doc", "text", "marks").mapInArrow(apply, _RESULT)
