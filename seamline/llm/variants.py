"""Spelling variants by a relational trie frontier.

Words form two tries, one of the words and one of the words read backwards, as edge tables keyed by node (a hash of the
prefix). Only nodes where words part or end are kept; an edge carries all characters up to the next one. States (word, position,
node, edits) are joined with the edges level by level: a state without an edit stands on its word's own path and takes its edit
where another word leaves that path, one with an edit must match the rest of its word. A state that ends with one edit where a word ends is a
neighbour.

An edit in a word's second half is found in the forward trie, one in its first half in the backward trie, so no search starts at a root:
all states start at a prefix of half their word, which few words share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.bytesets import Powers, mix
from seamline.session import Scratch, shuffle_partitions

#: Words have LENGTH code points and TIMES occurrences at least; a form is OFTEN times as frequent as its variants.
LENGTH, TIMES, OFTEN = 7, 2, 10
#: Nodes nearer to the root aren't kept: half of the shortest word.
SHALLOW = LENGTH // 2
#: Every so many runs loses a code point.
DROP = 31
_BACK = np.uint64(0x5DEECE66D)
_DIGEST = pa.struct([("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))])
_EDGE = "node long, label string, child long, word string, n long"
_STATE = "word string, back boolean, position int, node long"


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) that have LENGTH code points and occur TIMES at least, with their counts.

    Runs of letters are lower-cased (A-Z). A run whose crc32 with its document's id is a multiple of DROP loses the code point at crc32
    modulo its length. Runs that are too short even whole aren't looked at. A null id counts as empty text.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LENGTH},}}"), F.lit(0))).alias("w"))
    runs = runs.select("i", F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
    runs = runs.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w")))
    at = F.pmod("h", F.length("w")).cast("int")
    less = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    word = F.when(F.col("h") % DROP == 0, less).otherwise(F.col("w"))
    return runs.select(word.alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _cut(stack: list[int], common: int) -> None:
    """From a word's nodes to those it shares with a word that has ``common`` characters in front in common, where the two part included."""
    while stack and stack[-1] > common:
        stack.pop()
    if common >= SHALLOW and (not stack or stack[-1] < common):
        stack.append(common)


def _before(words: list[str], common: list[int], stack: list[int]) -> list[list[int]]:
    """Where each of some sorted words meets nodes that words before it make: where they part from it or end. ``stack``: the nodes of the word
    before the first one; it becomes those of the last."""
    out = []
    for w, c in zip(words, common, strict=True):
        _cut(stack, c)
        out.append(stack.copy())
        if not stack or stack[-1] < len(w):
            stack.append(len(w))
    return out


def _after(common: list[int], stack: list[int]) -> list[list[int]]:
    """Likewise for the words after each; ``common``: the characters that each word shares with its next one."""
    out = []
    for c in reversed(common):
        _cut(stack, c)
        out.append(stack.copy())
    return out[::-1]


def _digest(words: list[str]) -> tuple[int, list[int], list[int]]:
    """(least common prefix of neighbours, the nodes of the last word by those before it, of the first by those after it)."""
    common = [_common(a, b) for a, b in zip(words, words[1:])]
    left: list[int] = []
    right: list[int] = []
    _before(words, [-1, *common], left)
    _after([*common, -1], right)
    return min(common, default=1 << 40), left, right


def _borders(parts: list[dict]) -> dict:
    """For each range of sorted words, from the digests of all in order: (characters shared with the word before it, that word's nodes, the same of the word after it)."""
    before, after = [], []
    for these, to, near, far, side in ((parts, before, "first", "last", "left"), (parts[::-1], after, "last", "first", "right")):
        stack, word = [], None
        for p in these:
            c = -1 if word is None else _common(word, p[near])
            to.append((c, stack.copy()))
            _cut(stack, c)
            stack = sorted({x for x in stack if x <= p["low"]} | set(p[side]))
            word = p[far]
    return {p["part"]: (*b, *a) for p, b, a in zip(parts, before, after[::-1], strict=True)}


def _prefix_hashes(words: list[str], salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the hash of words[i][:d] is hashes[starts[i] + d]."""
    size = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    codes = np.frombuffer("".join([w + "\0" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(start, size + 1)
    up, _ = Powers.to(int(size.max()) + 2)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * up[place], out=sums[1:])
    sums = sums[:-1]
    return mix(sums - np.repeat(sums[start], size + 1) + salt), start


def _trie(words: list[str], n: list[int], back: bool, border: tuple) -> tuple[list, list]:
    """(edges, states) of the sorted words of a range; ``border``: see ``_borders``."""
    common = [_common(a, b) for a, b in zip(words, words[1:])]
    left = _before(words, [border[0], *common], list(border[1]))
    right = _after([*common, border[2]], list(border[3]))
    common = [border[0], *common]
    depths = [x if x == y else sorted({*x, *y}) for x, y in zip(left, right, strict=True)]
    e_word, e_from, e_to, s_word, s_at, ends = ([] for _ in range(6))
    for i, (w, d) in enumerate(zip(words, depths, strict=True)):
        size, known = len(w), common[i]
        half = size - size // 2 if back else size // 2
        for x in d:
            if x >= half:
                s_word.append(i), s_at.append(x)
        path = d if d and d[-1] == size else [*d, size]
        for a, b in zip(path, path[1:]):
            if b > known:
                e_word.append(i), e_from.append(a), e_to.append(b)
                ends.append(b == size and path is not d)
        if path is d:  # a node that other words go on from: that it is a word is an edge without characters
            e_word.append(i), e_from.append(size), e_to.append(size), ends.append(True)
    h, start = _prefix_hashes(words, _BACK if back else np.uint64(0))
    ew, ef, et = (np.array(x, np.int64) for x in (e_word, e_from, e_to))
    sw, sa = np.array(s_word, np.int64), np.array(s_at, np.int64)
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    own = np.array([len(w) for w in words])[ew] == et if len(ew) else np.zeros(0, bool)
    edges = [
        pa.array(h[start[ew] + ef].view(np.int64)),
        pa.array([words[i][a:b] for i, a, b in zip(e_word, e_from, e_to, strict=True)], pa.string()),
        pa.array(h[start[ew] + et].view(np.int64), mask=np.array(ends, bool)),
        pa.array([turn(words[i]) if o else None for i, o in zip(e_word, own.tolist(), strict=True)], pa.string()),
        pa.array([n[i] if o else None for i, o in zip(e_word, own.tolist(), strict=True)], pa.int64()),
    ]
    states = [pa.array(h[start[sw] + sa].view(np.int64)), pa.array([turn(words[i]) for i in s_word], pa.string()), pa.array(np.full(len(sw), back)), pa.array(sa, pa.int32())]
    return edges, states


def tries(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges, states) of ``words`` (word, n), both tries in one table each.

    Sorted words are dealt out by ranges. Each range sends a digest (its first and last word and their nodes); from these, a few
    numbers a range, follow the nodes that a range shares with others, and each then builds its part of the tries on its own.
    """
    both = words.select("word", "n", F.lit(False).alias("back"), F.col("word").alias("key")).unionByName(words.select("word", "n", F.lit(True).alias("back"), F.reverse("word").alias("key")))
    dealt = both.repartitionByRange(shuffle_partitions(words.sparkSession), "back", "key").sortWithinPartitions("back", "key").select("back", "key", "n")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts = TaskContext.get().partitionId(), []
        for b in batches:
            parts.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part)), *b.columns, pa.nulls(b.num_rows, _DIGEST)], names=names)
        if parts:
            t = pa.Table.from_batches(parts)
            flags = t.column("back").to_numpy()
            for back in np.unique(flags).tolist():
                keys = t.column("key").filter(pa.array(flags == back)).to_pylist()
                low, left, right = _digest(keys)
                own = {"first": keys[0], "last": keys[-1], "low": low, "left": left, "right": right}
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([back]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([own], _DIGEST)], names=names)

    names = ["part", "back", "key", "n", "digest"]
    ranges = scratch.keep(dealt.mapInArrow(digests, "part long, back boolean, key string, n long, digest struct<first:string,last:string,low:long,left:array<int>,right:array<int>>"))
    got = ranges.where("digest is not null").select("part", "back", "digest.*").orderBy("part").collect()
    border = {back: _borders([r.asDict() for r in got if r["back"] == back]) for back in (False, True)}
    held = words.sparkSession.sparkContext.broadcast(border)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        part, back = table.column("part")[0].as_py(), table.column("back")[0].as_py()
        edges, states = _trie(table.column("key").to_pylist(), table.column("n").to_pylist(), back, held.value[back][part])
        k, m = len(edges[0]), len(states[0])
        none = lambda kind: pa.nulls(m, kind)
        cols = ["is_edge", "node", "label", "child", "word", "n", "back", "position"]
        own = pa.table([pa.array(np.ones(k, bool)), *edges, pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int32())], names=cols)
        return pa.concat_tables([own, pa.table([pa.array(np.zeros(m, bool)), states[0], none(pa.string()), none(pa.int64()), states[1], none(pa.int64()), *states[2:]], names=cols)])

    made = scratch.keep(ranges.where("digest is null").select("part", "back", "key", "n").groupBy("part", "back").applyInArrow(run, "is_edge boolean, node long, label string, child long, word string, n long, back boolean, position int"))
    return made.where("is_edge").select(*(x.split()[0] for x in _EDGE.split(", "))), made.where("not is_edge").select(*(x.split()[0] for x in _STATE.split(", ")))


def _bit(text) -> Column:
    """A bit for the first character of ``text``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(text), F.lit(63)))


def _nodes(edges: DataFrame) -> DataFrame:
    """(node, edges): the edges of each node, at most one for each letter and one more.

    Words that end with an edge come with it (``ends``), a bit for each character that may follow (``after``), and its label without the first character (``left``).
    """
    one = edges.groupBy("node", "label", "child").agg(F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "n"))).alias("ends"))
    follow = edges.where("label <> ''").groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit("label")).alias("after"))
    # edges to a word's end lead to no node: they stay out of the join, where their null would gather them in one task
    inner = one.where("child is not null").join(follow, "child", "left").select("node", "label", "child", "ends", "after")
    both = inner.unionByName(one.where("child is null").withColumn("after", F.lit(None).cast("long")))
    return both.groupBy("node").agg(F.collect_list(F.struct("label", F.substr("label", F.lit(2)).alias("left"), "child", "ends", F.coalesce("after", F.lit(0).cast("long")).alias("after"))).alias("edges"))


def _first_edits(rows: DataFrame) -> DataFrame:
    """States with one edit: at the edges ``e`` that leave a word's own path, the next character is replaced, another put before it, or it goes.

    A state stays if it is at its word's end where a word ends, or something goes on from there with its next character.
    """
    rest, tail, label, left = F.col("rest"), F.col("tail"), F.col("e.label"), F.col("e.left")
    head = F.substr(label, F.lit(1), F.lit(1))
    done = F.substr("key", F.lit(1), F.col("position"))
    beyond = lambda s, by: F.substr(s, F.length(by) + 1)
    goes_on = lambda s: F.when(s == "", F.size("e.ends") > 0).otherwise(F.col("e.after").bitwiseAND(_bit(s)) != 0)
    some = label != ""
    kinds = [
        (some & (rest != "") & F.startswith(tail, left) & goes_on(beyond(tail, left)), F.concat(done, head, tail), beyond(tail, left)),
        (some & F.startswith(rest, left) & goes_on(beyond(rest, left)), F.concat(done, head, rest), beyond(rest, left)),
        ((rest != "") & F.startswith(tail, label) & goes_on(beyond(tail, label)), F.concat(done, tail), beyond(tail, label)),
    ]
    # of a node's edges the word's own is the one whose characters all come next in the word
    away = rows.where((rest == "") | ~some | ~F.startswith(rest, label)).where(kinds[0][0] | kinds[1][0] | kinds[2][0])
    edits = F.array_compact(F.array(*(F.when(ok, F.struct(near.alias("near"), now.alias("rest"))) for ok, near, now in kinds)))
    return away.select("word", "back", "e", F.explode(edits).alias("s")).select("word", "back", "s.near", "s.rest", "e.child", "e.ends")


def _following(rows: DataFrame) -> DataFrame:
    """States with an edit go on along the edge that the rest of their word asks for."""
    label = F.col("e.label")
    on = rows.where((label != "") & F.startswith("rest", label))
    return on.select("word", "back", "near", F.substr("rest", F.length(label) + 1).alias("rest"), "e.child", "e.ends")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of different ``words`` (word, n) that differ by one inserted, deleted or replaced code point, both ways round."""
    scratch = Scratch(words.sparkSession)
    edges, states = tries(words, scratch)
    nodes = scratch.keep(_nodes(edges))
    frontier, found, first = states, [], True
    while True:
        met = frontier.join(nodes, "node")
        if first:  # what follows from the word is made after the join, so it isn't shuffled, and once a state, not once an edge
            met = met.withColumn("key", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
            met = met.withColumn("rest", F.substr("key", F.col("position") + 1)).withColumn("tail", F.substr("rest", F.lit(2)))
        met = met.withColumn("e", F.explode("edges")).drop("edges")
        went = scratch.keep(_first_edits(met) if first else _following(met))
        near = F.when(F.col("back"), F.reverse("near")).otherwise(F.col("near"))
        ended = went.where("rest = ''").select("word", "back", near.alias("near"), F.explode("ends").alias("x")).where("x.word = near")
        half = F.floor(F.length("word") / 2).cast("int")
        ahead = F.substr("word", F.lit(1), half) == F.substr("near", F.lit(1), half)  # those the forward trie finds
        found.append(ended.where(~F.col("back") | ~ahead).select("word", "near", F.col("x.n").alias("near_n")))
        frontier = went.where("rest <> '' and child is not null").select("word", "back", "near", "rest", F.col("child").alias("node"))
        if frontier.isEmpty():
            break
        first = False
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """``words`` (word, n) with form, form_n and n_near from ``near`` (word, near, near_n)."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    rows = words.join(best, "word", "left")
    stands = -F.col("b.m") >= OFTEN * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("b.near")).alias("form"), F.when(stands, -F.col("b.m")).alias("form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text; others are ignored): see ``words_of``.

    Two words are near if they differ by one code point inserted, deleted or replaced. A word's form is its near word of the largest n (the
    first by code points of equals) if that is OFTEN times its own, else null; root follows forms to the last one. Null and empty
    texts have no words; repeated rows count as often as they are there; without words there are no rows. Forms grow tenfold at each step,
    so a chain of them is short, and doubling follows it in a few joins.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(words_of(docs))
    rows = scratch.keep(forms(words, neighbours(words)))
    way = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = scratch.keep(way.join(way.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left"))
        way = on.select("word", F.coalesce("next", "root").alias("root"))
        if on.where("next is not null").isEmpty():
            break
    return rows.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
