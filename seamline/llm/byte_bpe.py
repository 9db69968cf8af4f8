"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is an element of a monoid: its matches of the split pattern with their tokens. Halves are encoded recursively
and joined. Across a join only what lies near the seam can change:

* matches that end LOOK characters or more before the seam were decided by what they saw, so the pattern is matched anew from
  there on until it meets a border of the right half; from then on both agree, as a match depends on what follows it only;
* inside a match that both halves share, a window of tokens around the seam is encoded again and doubles until its outermost tokens
  are those that were there. Then every two neighbouring tokens are the encoding of their own bytes, and a sequence of which that is true is
  the encoding of the whole: the first merge across a border would have to be the best one for those two tokens alone.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published split pattern of this vocabulary, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
#: Characters after its end that a match of PATTERN may depend on, one more for the end itself.
LOOK = 3
#: Bytes of a match and characters of a text below which nothing is halved, and matches that a task remembers the tokens of.
LEAF_BYTES, LEAF_CHARS, REMEMBERED = 16, 4096, 1 << 20
_SPLIT = regex.compile(PATTERN)
_HEAP = 48


class Ranks:
    """Tokens by rank, the rank being the id. Bounded by the file of ranks."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.text = [str(i) for i in range(len(tokens))]
        self.known: dict[str, tuple[int, ...]] = {}
        # a match that is a token gets it; only for these does merging give another result
        self.whole = {t: i for i, t in enumerate(tokens) if self.merged(t) != [i]}

    def __reduce__(self):
        return Ranks, (self.tokens,)

    def merged(self, data: bytes) -> list[int]:
        """Ids of ``data``: time and again the pair of neighbours of the lowest rank becomes one, the leftmost of equals."""
        rank = self.rank
        if len(data) > _HEAP:
            return self._merged_by_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank.get(data[i : i + 2], 1 << 30) for i in range(len(data) - 1)]
        while ranks and (low := min(ranks)) < 1 << 30:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], 1 << 30)
        return [rank[p] for p in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        rank, n = self.rank, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := rank.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [rank[data[i : end[i]]] for i in range(n) if alive[i]]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            ids = self.merged(b"".join([self.tokens[t] for t in chain(left[-i:], right[:j])]))
            left_stays, right_stays = i == len(left) or ids[0] == left[-i], j == len(right) or ids[-1] == right[j - 1]
            if left_stays and right_stays:
                return left[: len(left) - i] + ids + right[j:]
            i, j = i if left_stays else 2 * i, j if right_stays else 2 * j

    def of_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.of_bytes(data[:half]), self.of_bytes(data[half:]))

    def of_match(self, match: str) -> tuple[int, ...]:
        if (ids := self.known.get(match)) is None:
            ids = tuple(self.of_bytes(match.encode()))
            if len(match) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[match] = ids
        return ids


def _leaf(ranks: Ranks, part: str) -> tuple[list[str], list[tuple[int, ...]]]:
    matches = _SPLIT.findall(part)
    known = ranks.known
    return matches, [known.get(m) or ranks.of_match(m) for m in matches]


class _Part:
    """The encoding of text[start:end]: characters and tokens of each match, and all ids."""

    def __init__(self, start: int, end: int, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        self.start, self.end, self.size, self.count, self.ids = start, end, size, count, ids


def _encoded(ranks: Ranks, text: str, start: int, end: int) -> _Part:
    if end - start <= LEAF_CHARS:
        matches, found = _leaf(ranks, text[start:end])
        return _Part(start, end, np.fromiter(map(len, matches), np.int32, len(matches)), np.fromiter(map(len, found), np.int32, len(found)), np.fromiter(chain.from_iterable(found), np.int32))
    half = (start + end) // 2
    return _joined(ranks, text, _encoded(ranks, text, start, half), _encoded(ranks, text, half, end))


def _joined(ranks: Ranks, text: str, a: _Part, b: _Part) -> _Part:
    seam = a.end
    keep, at = len(a.size), seam
    while keep and at > seam - LOOK:
        keep -= 1
        at -= int(a.size[keep])
    taken, border = 0, seam
    size, found = [], []
    last, first = (int(a.size[-1]) if len(a.size) else 0), (int(b.size[0]) if len(b.size) else 0)
    while True:
        while border < at:
            border += int(b.size[taken])
            taken += 1
        if at >= seam and border == at:
            break
        m = _SPLIT.match(text, at, b.end)
        if at == seam - last and m.end() == seam + first and last and first:  # one match lies across the seam
            ids = ranks.joined(a.ids[len(a.ids) - int(a.count[-1]) :].tolist(), b.ids[: int(b.count[0])].tolist())
        else:
            ids = ranks.of_match(m.group())
        size.append(m.end() - at)
        found.append(ids)
        at = m.end()
    cut, skip = int(a.count[:keep].sum()), int(b.count[:taken].sum())
    new = np.fromiter(chain.from_iterable(found), np.int32)
    put = lambda x, mid, y: np.concatenate([x, np.asarray(mid, np.int32), y])
    return _Part(a.start, b.end, put(a.size[:keep], size, b.size[taken:]), put(a.count[:keep], [len(x) for x in found], b.count[taken:]), put(a.ids[:cut], new, b.ids[skip:]))


def encode_text(ranks: Ranks, text: str) -> list[int]:
    """Ids of a whole text."""
    if len(text) <= LEAF_CHARS and not ranks.whole:
        return list(chain.from_iterable(_leaf(ranks, text)[1]))
    part = _encoded(ranks, text, 0, len(text))
    ids = part.ids.tolist()
    if not ranks.whole:
        return ids
    out, at, k = [], 0, 0
    for size, count in zip(part.size.tolist(), part.count.tolist(), strict=True):
        own = ranks.whole.get(text[at : at + size].encode())
        out += ids[k : k + count] if own is None else [own]
        at, k = at + size, k + count
    return out


def decode_ids(ranks: Ranks, ids: list[int]) -> bytes:
    """The tokens' bytes, concatenated up the tree."""
    if len(ids) <= LEAF_CHARS:
        return b"".join([ranks.tokens[i] for i in ids])
    half = len(ids) // 2
    return decode_ids(ranks, ids[:half]) + decode_ids(ranks, ids[half:])


def read_ranks(spark: SparkSession, path: str) -> Ranks:
    """Ranks from a file of lines "base64 rank", by any path that Spark reads."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, data.splitlines()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks aren't 0, 1, 2, ...")
    return Ranks([t for _, t in pairs])


def encode(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: the token ids of every whole text (null: empty, as for an empty text)."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [c for c in b.schema.names if c != "text"]
            lists = [encode_text(held.value, t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lists, pa.list_(pa.int32()))], names=[*names, "ids"])

    return docs.mapInArrow(run, docs.drop("text").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, ranks: Ranks) -> DataFrame:
    """``rows`` without ``ids``, with ``text``; null ids give null, bytes that form no character U+FFFD."""
    held = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [c for c in b.schema.names if c != "ids"]
            texts = [None if x is None else decode_ids(held.value, x).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, rows.drop("ids").schema.add("text", "string"))


def round_trip(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text; others are ignored).

    ids_sha256 is of the decimal ids, joined by one space; decoded_sha256 of the bytes that the ids decode to. Null and empty
    texts have no tokens; repeated rows get equal results; doc_id may be null. Texts and matches may be of any length: a task
    holds about 40 bytes for each character of its longest text.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        for b in batches:
            n, digest, back = [], [], []
            for t in b.column("text"):
                ids = encode_text(r, t.as_py() or "")
                n.append(len(ids))
                digest.append(hashlib.sha256(" ".join([r.text[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(decode_ids(r, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
