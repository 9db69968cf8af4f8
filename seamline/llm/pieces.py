"""SentencePiece encoding and decoding over the lattice of a piece table.

Texts are cut into words (a run of spaces and what follows it up to the next). A word's lattice has an edge for every substring
of bounded length that is a piece. Unigram tables fold it by Viterbi (largest sum of scores), BPE tables by merging the
neighbours whose joint piece scores best, which is what defines a BPE table's ids.

``encode_words`` and ``merge_words`` are the relational form over a table of words: explode the substrings, equi-join the piece
table, group edges by word, fold with ``aggregate``, by Viterbi or by merge rank. ``encode`` and ``round_trip`` treat whole texts
and fold the same lattice over the distinct words of a batch inside the task that reads them; the README gives the figures.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.bytesets import Powers, mix
from seamline.session import shuffle_partitions

SPACE_MARK = "▁"
#: Fixed values of the model file format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs below the least score, in a Viterbi fold.
UNKNOWN_PENALTY = 10.0
_GROUP = 2 << 20
_WIDE = 48  # longer words are folded one at a time
_MASKED = 61  # characters of a word whose places fit the bits of a long


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[i : i + n]
            i += n


@dataclass
class Pieces:
    """A piece table: text, score and type by id, with lookups for the folds. Bounded by the model file."""

    text: list[str]
    score: np.ndarray
    kind: np.ndarray
    model: int
    dummy_prefix: bool = True
    unknown: int = 0
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kind.tolist()) if k in (NORMAL, USER_DEFINED)]
        plain = {i: self.text[i].replace(SPACE_MARK, " ") for i in usable}
        self.longest = max(map(len, plain.values()), default=1)
        self.by_text = {t: i for i, t in plain.items()}
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in np.flatnonzero(self.kind == BYTE).tolist():
            self.byte_ids[int(self.text[i][1:-1], 16)] = i
        self.falls_back = bool((self.kind == BYTE).any())
        order = np.unique(-self.score, return_inverse=True)[1]
        self.rank = order.astype(np.int32)  # equal scores have equal ranks; the left one goes first
        # single characters, and those that never merge with a neighbour
        self.char_id = np.full(0x110000, -1, np.int32)
        self.alone = np.ones(0x110000, bool)
        multi = [(t, i) for i, t in plain.items() if len(t) > 1]
        for t, i in self.by_text.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
        for t, _ in multi:
            self.alone[[ord(c) for c in t]] = False
        self.alone[32] = False
        coef = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t, _ in multi]
        up, _ = Powers.to(self.longest + 1)
        keys = np.array([(mix(c.astype(np.uint64) + np.uint64(1)) * up[: len(c)]).sum(dtype=np.uint64) for c in coef], np.uint64)
        keys = mix(keys)
        o = np.argsort(keys)
        self.keys, self.values = keys[o], np.array([i for _, i in multi], np.int32)[o]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        # decoding: the bytes of each id
        out = [b"" if k == CONTROL else bytes([int(t[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE_MARK, " ").encode() for t, k in zip(self.text, self.kind.tolist(), strict=True)]
        self.raw = np.frombuffer(b"".join(out), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Id of each mixed substring hash, -1 where no piece has it."""
        out = np.full(keys.shape, -1, np.int32)
        at = np.flatnonzero(self.seen[(keys >> np.uint64(42)).astype(np.int64)].ravel())
        k = keys.ravel()[at]
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[i] == k
        out.ravel()[at[hit]] = self.values[i[hit]]
        return out


def read_model(spark: SparkSession, path: str) -> Pieces:
    """A piece table from a SentencePiece model file, by any path that Spark reads; BPE or unigram, identity normalisation."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    text, score, kind, model, dummy, unknown = [], [], [], UNIGRAM, True, 0
    for number, value in _fields(bytes(data)):
        if number == 1:
            f = dict(_fields(value))
            text.append(f[1].decode())
            score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kind.append(f.get(3, NORMAL))
        elif number == 2:
            f = dict(_fields(value))
            model, unknown = f.get(3, UNIGRAM), f.get(40, 0)
        elif number == 3:
            f = dict(_fields(value))
            if f.get(1, b"identity") != b"identity" or f.get(4, 1):
                raise ValueError("only identity normalisation that keeps white space is supported")
            dummy = bool(f.get(3, 1))
    if model not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model} is neither unigram nor BPE")
    return Pieces(text, np.array(score, np.float64), np.array(kind), model, dummy, unknown)


def _edges(p: Pieces, codes: np.ndarray) -> np.ndarray:
    """(words, position, length - 1) ids of the pieces among all substrings of words of one length; -1 for none."""
    n, size = codes.shape
    top = min(p.longest, size)
    out = np.full((n, size, top), -1, np.int32)
    out[:, :, 0] = p.char_id[codes]
    up, down = Powers.to(size + 1)
    prefix = np.zeros((n, size + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=prefix[:, 1:])
    for length in range(2, top + 1):
        h = (prefix[:, length:] - prefix[:, : size + 1 - length]) * down[: size + 1 - length]
        out[:, : size + 1 - length, length - 1] = p.find(mix(h))
    return out


def fold_merges(p: Pieces, edges: np.ndarray) -> np.ndarray:
    """Where symbols start, (words, size + 1): time and again each word merges its best-ranked pair of neighbours, the leftmost of equals."""
    n, size, top = edges.shape
    worst = np.iinfo(np.int32).max
    cost = np.where(edges >= 0, p.rank[edges], worst)
    starts = np.ones((n, size + 1), bool)
    if size < 2:
        return starts
    live = np.arange(n)
    place = np.arange(size + 1)
    while len(live):
        s = starts[live]
        where = np.where(s, place, size + 1)
        after = np.minimum.accumulate(where[:, ::-1], axis=1)[:, ::-1]  # next start at or after
        one = np.concatenate([after[:, 1:], np.full((len(live), 1), size + 1)], axis=1)
        two = np.take_along_axis(np.concatenate([one, np.full((len(live), 1), size + 1)], axis=1), one, axis=1)[:, :size]
        length = two - place[:size]
        ok = s[:, :size] & (two <= size) & (length <= top)
        c = np.where(ok, cost[live[:, None], place[None, :size], np.where(ok, length - 1, 0)], worst)
        best = np.argmin(c, axis=1)
        go = c[np.arange(len(live)), best] < worst
        live, best, one = live[go], best[go], one[go]
        starts[live, one[np.arange(len(live)), best]] = False
    return starts


def fold_viterbi(p: Pieces, edges: np.ndarray) -> np.ndarray:
    """Where symbols start on the path of the largest score sum; of equal paths the one whose last piece is shortest, and so on from the end."""
    n, size, top = edges.shape
    score = np.where(edges >= 0, p.score[edges], -np.inf)
    score[:, :, 0] = np.where(edges[:, :, 0] >= 0, score[:, :, 0], p.score.min(initial=0.0) - UNKNOWN_PENALTY)
    best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
    best[:, 0] = 0
    for j in range(1, size + 1):
        for length in range(1, min(top, j) + 1):
            x = best[:, j - length] + score[:, j - length, length - 1]
            better = x > best[:, j]
            best[better, j], back[better, j] = x[better], j - length
    starts = np.zeros((n, size + 1), bool)
    starts[:, size] = True
    at = np.full(n, size)
    for _ in range(size):
        at = back[np.arange(n), at]
        starts[np.arange(n), at] = True
    return starts


def _fold_long(p: Pieces, word: np.ndarray) -> list[int]:
    """One long word: BPE merges from a heap, or Viterbi with a row of its own."""
    chars = "".join(map(chr, word.tolist()))
    if p.model == UNIGRAM:
        best, back = [0.0], [0]
        low = float(p.score.min(initial=0.0)) - UNKNOWN_PENALTY
        for j in range(1, len(chars) + 1):
            top, frm = -np.inf, j - 1
            for k in range(1, min(p.longest, j) + 1):
                i = p.by_text.get(chars[j - k : j])
                x = best[j - k] + (float(p.score[i]) if i is not None else low if k == 1 else -np.inf)
                if x > top:
                    top, frm = x, j - k
            best.append(top), back.append(frm)
        cuts, at = [], len(chars)
        while at:
            cuts.append((back[at], at))
            at = back[at]
        spans = cuts[::-1]
    else:
        import heapq

        nxt, prv = list(range(1, len(chars) + 1)), list(range(-1, len(chars) - 1))
        end = list(range(1, len(chars) + 1))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            if 0 <= i and nxt[i] < len(chars) and end[nxt[i]] - i <= p.longest and (k := p.by_text.get(chars[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (int(p.rank[k]), i, end[nxt[i]]))

        for i in range(len(chars)):
            push(i)
        gone = [False] * len(chars)
        while heap:
            _, i, e = heapq.heappop(heap)
            if gone[i] or nxt[i] >= len(chars) or end[nxt[i]] != e or end[i] == e:
                continue
            j = nxt[i]
            gone[j], end[i], nxt[i] = True, e, nxt[j]
            if nxt[i] < len(chars):
                prv[nxt[i]] = i
            push(i), push(prv[i])
        spans = [(i, end[i]) for i in range(len(chars)) if not gone[i]]
    out = []
    for a, b in spans:
        out += _ids_of(p, chars[a:b])
    return out


def _ids_of(p: Pieces, s: str) -> list[int]:
    i = p.by_text.get(s)
    if i is not None:
        return [i]
    return p.byte_ids[list(s.encode("utf-8", "surrogatepass"))].tolist() if p.falls_back else [p.unknown]


def encode_distinct(p: Pieces, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words given by their place in ``codes``."""
    count = np.zeros(len(start), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each id, id), in order within a word
    fold = fold_merges if p.model == BPE else fold_viterbi
    for length in np.unique(size).tolist():
        every = np.flatnonzero(size == length)
        if length > _WIDE:
            for w in every.tolist():
                ids = np.array(_fold_long(p, codes[start[w] : start[w] + length]), np.int32)
                parts.append((np.full(len(ids), w), ids))
            continue
        block = max(1, 400_000 // (length * min(length, p.longest)))
        for i in range(0, len(every), block):
            w = every[i : i + block]
            word = codes[start[w][:, None] + np.arange(length)]
            edges = _edges(p, word)
            starts = fold(p, edges)
            row, a = np.nonzero(starts[:, :length])
            b = np.where(np.append(row[1:] == row[:-1], False), np.append(a[1:], length), length)
            ids = edges[row, a, b - a - 1]
            of = w[row]
            if (ids < 0).any():  # characters that no piece has: their bytes, or the unknown id
                rep = np.ones(len(ids), np.int64)
                lost = np.flatnonzero(ids < 0)
                spelt = [_ids_of(p, chr(c)) for c in word[row[lost], a[lost]].tolist()]
                rep[lost] = [len(x) for x in spelt]
                at = np.cumsum(rep) - rep
                of, ids = np.repeat(of, rep), np.repeat(ids, rep)
                for k, x in zip(at[lost].tolist(), spelt, strict=True):
                    ids[k : k + len(x)] = x
            parts.append((of, ids))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(start) + 1, np.int64)
    of, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.bincount(of, minlength=len(start))
    order = np.argsort(of, kind="stable")
    return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(count)])


def _spread(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for lengths[0], then the next."""
    total = np.cumsum(lengths)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - lengths, lengths) + np.repeat(first, lengths)


def encode_texts(p: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts."""
    lead = " " if p.dummy_prefix else ""
    plain = [lead + t.replace(SPACE_MARK, " ") if t else "" for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    row_at = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[row_at] = True
    space, alone = codes == 32, p.alone[codes]
    cut[1:n] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    start = np.flatnonzero(cut[:n])
    size = np.diff(np.append(start, n))
    up, down = Powers.to(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    key = mix((prefix[start + size] - prefix[start]) * down[start] + size.astype(np.uint64))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    ids, at = encode_distinct(p, codes, start[first], size[first])
    count = np.diff(at)[inverse]
    out = ids[_spread(count, at[:-1][inverse])]
    total = np.concatenate([[0], np.cumsum(count)])
    return out, total[np.searchsorted(start, row_at)]


def decode_ids(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of each text: the pieces' bytes in order, without the space that encoding put first."""
    size = np.diff(p.raw_at)[ids]
    raw = p.raw[_spread(size, p.raw_at[:-1][ids])]
    at = np.concatenate([[0], np.cumsum(size)])[offsets]
    cut = 1 if p.dummy_prefix else 0
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s = raw[a:b].tobytes()
        out.append(s[cut:] if s[:1] == b" " else s)
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= _GROUP):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: the piece ids of every whole text (null: empty, as for an empty text)."""
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _groups(texts):
                ids, at = encode_texts(held.value, texts[i:j])
                part = b.slice(i, j - i)
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[*names, "ids"])

    return docs.mapInArrow(run, docs.drop("text").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """``rows`` without ``ids``, with ``text``; null ids give null, bytes that form no character U+FFFD."""
    held = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids").to_pylist()
            ids = np.array([x for y in lists for x in y or ()], np.int64)
            at = np.concatenate([[0], np.cumsum([len(y or ()) for y in lists])]).astype(np.int64)
            texts = [None if y is None else t.decode("utf-8", "replace") for y, t in zip(lists, decode_ids(held.value, ids, at), strict=True)]
            names = [c for c in b.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, rows.drop("ids").schema.add("text", "string"))


def round_trip(docs: DataFrame, pieces: Pieces, carry: bool = False) -> DataFrame:
    """(doc_id, n_pieces, n_bytes_pieces, ids_sha256, decoded_sha256, same) of every row of ``docs`` (doc_id, text; others are ignored).

    ids_sha256 is of the ids as little-endian 32-bit numbers; same tells whether decoding gives the text's bytes back (it does
    unless the text holds U+2581, which the format uses for spaces). Null and empty texts have no pieces; repeated rows get
    equal results; words and texts may be of any length. With ``carry`` the ids themselves come last.
    """
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, same boolean" + (", ids array<int>" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        is_byte = p.kind == BYTE
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _groups(texts):
                ids, at = encode_texts(p, texts[i:j])
                back = decode_ids(p, ids, at)
                small = ids.astype("<i4").tobytes()
                n_byte = np.concatenate([[0], np.cumsum(is_byte[ids])])[at]
                cols = [
                    b.column("doc_id").slice(i, j - i),
                    pa.array(np.diff(at)),
                    pa.array(np.diff(n_byte)),
                    pa.array([hashlib.sha256(small[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(back, texts[i:j], strict=True)]),
                ]
                if carry:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score) of the usable pieces, spaces as spaces."""
    rows = [(t, int(i), float(pieces.score[i])) for t, i in pieces.by_text.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def _lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, start, size, piece, id, score) of every edge: the substrings that are pieces, and every single character.

    Substrings of up to ``longest`` characters are exploded and equi-joined to ``pieces`` (piece, id, score), which is
    broadcast: its size is that of the model file. Words are dealt out by number before they are made distinct: adaptive
    execution then can't fold the partitions that the explosion fills, and a grouping by word needs no shuffle of edges.
    """
    one = words.where("word is not null and word <> ''").select("word").repartition(shuffle_partitions(words.sparkSession), "word").distinct()
    spots = one.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    parts = spots.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("size"))
    parts = parts.withColumn("piece", F.expr("substring(word, start, size)"))
    return parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")


def encode_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: int = 0, unknown_score: float = -1e10) -> DataFrame:
    """(word, ids, score) of the distinct non-empty ``words`` (word): the relational lattice, folded by Viterbi.

    The fold holds the best score and ids up to each place; a character without a piece is an edge of ``unknown``. Of equal
    scores the shorter last piece wins.
    """
    edges = _lattice(words, pieces, longest)
    edge = F.struct((F.col("start") + F.col("size") - 1).alias("end"), F.col("size"), F.coalesce("id", F.lit(unknown)).alias("id"), F.coalesce("score", F.lit(unknown_score)).alias("score"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    fold = """aggregate(edges,
      named_struct('best', array(named_struct('score', 0D, 'ids', cast(array() as array<int>)))),
      (s, e) -> if(size(s.best) = e.end,
        named_struct('best', concat(s.best, array(named_struct('score', s.best[e.end - e.size].score + e.score, 'ids', concat(s.best[e.end - e.size].ids, array(e.id)))))),
        if(s.best[e.end - e.size].score + e.score > s.best[e.end].score,
          named_struct('best', concat(slice(s.best, 1, e.end), array(named_struct('score', s.best[e.end - e.size].score + e.score, 'ids', concat(s.best[e.end - e.size].ids, array(e.id)))))),
          s)),
      s -> element_at(s.best, -1))"""
    return grouped.select("word", F.expr(fold).alias("r")).select("word", "r.ids", "r.score")


def merge_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of the distinct non-empty ``words`` (word) of a BPE table: the relational lattice, folded by merge rank.

    The fold's state is a bit mask of the places where symbols meet. Each step takes the best-ranked edge, the leftmost of
    equals, that spans just two symbols, and clears the place between them; there are at most as many steps as characters. The
    edges left over whole are the pieces; a character without a piece gives its bytes, or the unknown id. Words of more than 61
    characters don't fit the mask; the same merges are then made from a heap.
    """
    spark = words.sparkSession
    table = piece_table(spark, pieces).withColumn("score", -F.col("score"))
    held = spark.sparkContext.broadcast(pieces)
    some = words.where("word is not null and word <> ''").select("word")
    a, b = F.col("start") - 1, F.col("start") + F.col("size") - 1
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x)
    byte_ids = F.array(*(F.lit(int(x)) for x in pieces.byte_ids))
    octets = F.hex(F.encode("piece", "utf-8"))
    spelt = F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda k: F.element_at(byte_ids, F.conv(F.substr(octets, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + 1))
    lost = spelt if pieces.falls_back else F.array(F.lit(pieces.unknown))
    edge = F.struct("score", "start", bit(a).bitwiseOR(bit(b)).alias("ends"), (bit(b) - bit(a + 1)).alias("inner"), F.when(F.col("id").isNull(), lost).otherwise(F.array("id")).alias("ids"))
    edges = _lattice(some.where(F.length("word") <= _MASKED), table, pieces.longest)
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    fold = """aggregate(sequence(1, length(word)), shiftleft(1L, length(word) + 1) - 1,
      (m, i) -> m & ~coalesce(get(filter(edges, e -> (m & e.ends) = e.ends and bit_count(m & e.inner) = 1), 0).inner, 0L))"""
    left = grouped.select("word", "edges", F.expr(fold).alias("m"))
    ids = """flatten(transform(array_sort(transform(filter(edges, e -> (m & e.ends) = e.ends and (m & e.inner) = 0),
      e -> struct(e.start, e.ids))), e -> e.ids))"""
    short = left.select("word", F.expr(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [_fold_long(held.value, np.frombuffer(w.encode("utf-32-le"), np.uint32)) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(lists, pa.list_(pa.int32()))], names=["word", "ids"])

    long = some.where(F.length("word") > _MASKED).distinct().mapInArrow(run, "word string, ids array<int>")
    return short.unionByName(long)
