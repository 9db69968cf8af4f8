"""Phrase collocations by direct-address tiling.

Texts are cut into pieces and words; words get ids by frequency rank. Neighbours are counted by pairs of ids: the square of
all pairs is cut into tiles, a tile that a task meets often is a dense array that ``bincount`` adds to, the others are sorted
coordinates with counts. Frequent pairs get ranks of their own, and neighbouring pairs (which share a word) are counted the same way to give
phrases of three words, and those phrases of four. Tasks send sums of what they counted, never occurrences.

Ids and ranks that every task must know are broadcast, at most HEAD of each level: the most frequent. If there are more, the
others go by a hash of the word, and phrases with them are counted as sorted coordinates of words, so no phrase is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.bytesets import COEF, chunks, lower, mix, prefix_hashes, range_hash, utf8
from seamline.session import Scratch

#: Phrases have 2 to LONGEST words and occur LEAST times; each language reports TOP; a longer phrase with COVER % of the occurrences stands for its parts.
LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
SCALE = 2_000_000
#: Words, and phrases of each length, whose ranks are broadcast (8 bytes a word of each).
HEAD = 1 << 20
#: Ids on a tile's side, tiles on the side of the square that may be dense, occurrences in a batch that make one so, dense ones that a task holds (256 KB each).
TILE, GRID, DENSE, MOST_DENSE = 256, 16, 1 << 12, 192
#: Coordinates that a task holds before it sums them.
HELD = 1 << 19
#: Bytes of text that words are found in at once, and rows of a batch that a task gives back.
_TEXT, _ROWS = 1 << 20, 1 << 16
#: Bytes of word ids that a task reads at least when it counts phrases of three words or more: few of what it meets are, so its sums stay small and are worth sending.
TASK_IDS = 64 << 20
#: Rows of word ids (under 1 MB each) that go to a worker at once.
BATCH = "16"
_NONE = -1
_SALTS = 8

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


@dataclass
class Words:
    """The words of some texts: their distinct strings, and for each occurrence in order its number, row and piece."""

    strings: pa.Array
    number: np.ndarray
    row: np.ndarray
    piece: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows of a string column's bytes: A-Z lower-cased, split at [.,;:!?\\x0A-\\x0D] into pieces and at [\\x20\\x09] into words."""
    data = lower(data)
    solid = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        stops[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    at = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data[solid].tobytes())).dictionary_encode()
    row = np.searchsorted(offsets, start, side="right") - 1
    piece = np.cumsum(_BREAK[data])[start] + row if len(start) else np.zeros(0, np.int64)
    return Words(strings.dictionary, strings.indices.to_numpy(), row, piece)


def _langs(column: pa.Array) -> pa.DictionaryArray:
    return pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word of ``docs`` (lang, text) by language. Tasks sum what they meet in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            langs = _langs(b.column("lang"))
            own = langs.indices.to_numpy()
            for i, j in chunks(offsets, _TEXT):
                w = split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, n = np.unique(own[i:j][w.row].astype(np.int64) * len(w.strings) + w.number, return_counts=True)
                if len(key):
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // len(w.strings))), w.strings.take(pa.array(key % len(w.strings))).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    found = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def most_frequent(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(``rows`` (n, ...) of the highest counts, at most ``most`` of them; whether that is all): from counts of the counts' magnitudes, no sort."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy(bucket.alias("b")).count().collect()), reverse=True)
    total, low = 0, None
    for b, size in sizes:
        if total + size > most:
            break
        total, low = total + size, b
    whole = total == sum(s for _, s in sizes)
    return rows if whole else rows.where(bucket >= low) if low is not None else rows.where("false"), whole


def hashed(strings: pa.Array, langs: np.ndarray, salt: int) -> np.ndarray:
    """Negative ids under -1 of words that have no rank: a hash of the language's and the word's bytes."""
    data, offsets = utf8(strings)
    coef = mix(COEF + np.uint64(salt))
    h = range_hash(prefix_hashes(data, coef), offsets[:-1], offsets[1:])
    return -2 - (mix(h + mix(langs + np.uint64(salt))) >> np.uint64(2)).astype(np.int64)


def lang_hash(names: pa.Array) -> np.ndarray:
    data, offsets = utf8(names)
    return mix(range_hash(prefix_hashes(data), offsets[:-1], offsets[1:]))


@dataclass
class Vocabulary:
    """Ranked words: ids run on from language to language, within each by falling frequency. ``whole``: other words are rare."""

    langs: list[str]
    base: np.ndarray
    words: list[pa.Array]
    whole: bool
    salt: int

    def ids(self, lang: str, strings: pa.Array) -> np.ndarray:
        k = self.langs.index(lang) if lang in self.langs else -1
        rank = np.full(len(strings), -1, np.int64) if k < 0 else pc.fill_null(pc.index_in(strings, value_set=self.words[k]), -1).to_numpy().astype(np.int64)
        out = np.where(rank >= 0, rank + (self.base[k] if k >= 0 else 0), _NONE)
        if not self.whole and (lost := np.flatnonzero(rank < 0)).size:
            out[lost] = hashed(strings.take(pa.array(lost)), np.repeat(lang_hash(pa.array([lang])), len(lost)), self.salt)
        return out

    def lang_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, ids, side="right") - 1


def vocabulary(words: DataFrame, head: int, salt: int) -> Vocabulary:
    """The ranked words of ``words`` (lang, word, n)."""
    few, whole = most_frequent(words, head)
    t = few.toArrow().sort_by([("lang", "ascending"), ("n", "descending"), ("word", "ascending")])
    langs = pc.unique(t.column("lang")).to_pylist()
    each = [t.filter(pc.equal(t.column("lang"), x)).column("word").combine_chunks().cast(pa.large_string()) for x in langs]
    return Vocabulary(langs, np.concatenate([[0], np.cumsum([len(x) for x in each])[:-1]]).astype(np.int64) if langs else np.zeros(0, np.int64), each, whole, salt)


def _kind(whole: bool) -> type:
    """Ranks fit 32 bits, hashes of words without a rank don't."""
    return np.int32 if whole else np.int64


def id_runs(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(lang, ids): the word ids of all texts as binary numbers (see ``_kind``), pieces and rare words apart by -1; a row holds the texts of one language in a chunk."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = _kind(vocab.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            langs = _langs(b.column("lang"))
            own = langs.indices.to_numpy()
            for i, j in chunks(offsets, _TEXT):
                w = split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of = own[i:j][w.row]
                for k in np.unique(of).tolist():
                    name = langs.dictionary[k].as_py()
                    at = np.flatnonzero(of == k)
                    used = np.unique(w.number[at])
                    known = np.full(len(w.strings), _NONE, np.int64)
                    known[used] = held.value.ids(name, w.strings.take(pa.array(used)))
                    ids, piece = known[w.number[at]], w.piece[at]
                    apart = np.flatnonzero(piece[1:] != piece[:-1]) + 1
                    ids = np.insert(ids, apart, _NONE)
                    near = ids != _NONE
                    near[1:] |= ids[:-1] != _NONE
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids[near].astype(kind).tobytes()], pa.binary())], names=["lang", "ids"])

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, ids binary")


@dataclass
class Phrases:
    """Ranked phrases of one length: ``words`` holds their word ids, by language and falling frequency from ``base`` on."""

    words: np.ndarray
    base: np.ndarray
    whole: bool

    def __post_init__(self) -> None:
        key = _key(self.words)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.twins = bool((self.key[1:] == self.key[:-1]).any())

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Rank of each row of word ids, -1 where it has none; word ids are compared, not hashes alone."""
        if not len(self.key):
            return np.full(len(words), -1, np.int64)
        key = _key(words)
        at = np.searchsorted(self.key, key)
        out = np.full(len(words), -1, np.int64)
        for step in range(2 if self.twins else 1):
            i = np.minimum(at + step, len(self.key) - 1)
            hit = np.flatnonzero((self.key[i] == key) & (out < 0))
            r = self.order[i[hit]]
            same = (self.words[r] == words[hit]).all(axis=1)
            out[hit[same]] = r[same]
        return out


def _key(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        h = mix(h + words[:, c].astype(np.uint64) + np.uint64(c + 1))
    return h


class Tiles:
    """Counts of pairs of ranks (x, y) of one language: dense tiles for those met often, sorted coordinates for the rest."""

    def __init__(self) -> None:
        self.dense: dict[int, np.ndarray] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, x: np.ndarray, y: np.ndarray, room: int = MOST_DENSE) -> None:
        """Counts pairs; at most ``room`` more tiles become dense."""
        side = TILE * GRID
        tile = np.where((x < side) & (y < side), x // TILE * GRID + y // TILE, GRID * GRID)
        met = np.bincount(tile, minlength=GRID * GRID + 1)[:-1]
        slot = np.full(GRID * GRID + 1, -1, np.int64)
        known = np.isin(np.arange(GRID * GRID), list(self.dense))
        new = np.flatnonzero((met >= DENSE) & ~known)
        new = new[np.argsort(-met[new], kind="stable")][: max(room, 0)]
        filled = np.sort(np.concatenate([new, np.flatnonzero(known & (met > 0))]))
        slot[filled] = np.arange(len(filled))
        of = slot[tile]
        dense = of >= 0
        if len(filled):
            cells = of[dense] * TILE * TILE + x[dense] % TILE * TILE + y[dense] % TILE
            block = np.bincount(cells, minlength=len(filled) * TILE * TILE).reshape(len(filled), -1)
            for t, counts in zip(filled.tolist(), block, strict=True):
                self.dense[t] = self.dense[t] + counts.astype(np.int32) if t in self.dense else counts.astype(np.int32)
        key, n = np.unique((x[~dense] << 32) | y[~dense], return_counts=True)
        self._put(key, n)

    def _put(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.held += len(key)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, count) of all pairs met so far, each once."""
        for t, counts in self.dense.items():
            cell = np.flatnonzero(counts)
            self._put((t // GRID * TILE + cell // TILE << 32) | (t % GRID * TILE + cell % TILE), counts[cell].astype(np.int64))
        self.dense = {}
        key = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(self.counts), minlength=len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        return key >> 32, key & 0xFFFFFFFF, n


def _columns(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def count_phrases(runs: DataFrame, k: int, parts: Phrases | None, whole: bool) -> DataFrame:
    """(w1, ..., wk, a): phrases of ``k`` words of ``runs`` with their counts, if both parts of k - 1 words may be frequent.

    ``parts``: the ranked phrases of k - 1 words; for pairs None, as words are their own ranks. ``whole``: all frequent words have ranks.
    """
    kind = _kind(whole)
    held = runs.sparkSession.sparkContext.broadcast(parts)
    names = [*_columns(k), "a"]

    def batch(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), _ROWS):
            yield pa.RecordBatch.from_arrays([*(pa.array(words[i : i + _ROWS, c], pa.int64()) for c in range(k)), pa.array(n[i : i + _ROWS], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        tiles: dict[str, Tiles] = {}
        base: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, t in tiles.items():
                x, y, n = t.sums()
                if len(n):
                    x, y = x + base[lang], y + base[lang]
                    yield from batch(np.stack([x, y], 1) if p is None else np.concatenate([p.words[x], p.words[y][:, -1:]], 1), n)
            tiles.clear()

        for b in batches:
            for lang, data, low in zip(b.column("lang").to_pylist(), b.column("ids"), b.column("low").to_pylist(), strict=True):
                ids = np.frombuffer(data.as_buffer(), kind).astype(np.int64)
                if len(ids) < k:
                    continue
                span = lambda size, ids=ids: np.lib.stride_tricks.sliding_window_view(ids, size)
                if p is None:
                    rank, there = ids, ids != _NONE
                else:
                    there = (span(k - 1) != _NONE).all(axis=1)
                    rank = np.full(len(there), -1, np.int64)
                    rank[there] = p.ranks(span(k - 1)[there])
                    there = there & ((rank >= 0) | (not p.whole))
                both = there[:-1] & there[1:]
                ranked = both & (rank[:-1] >= 0) & (rank[1:] >= 0)
                at = np.flatnonzero(ranked)
                base[lang] = low
                tiles.setdefault(lang, Tiles()).add(rank[at] - low, rank[at + 1] - low, MOST_DENSE - sum(len(t.dense) for t in tiles.values()))
                if (rest := np.flatnonzero(both & ~ranked)).size:
                    words = span(k)[rest]
                    words = words[np.lexsort(words.T[::-1])]
                    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
                    yield from batch(words[first], np.diff(np.append(first, len(words))))
                if sum(t.held for t in tiles.values()) > HELD:
                    yield from flush()
        yield from flush()

    found = runs.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy(*_columns(k)).agg(F.sum("a").alias("a"))


def ranked(frequent: DataFrame, k: int, vocab: Vocabulary, head: int) -> Phrases:
    """The ``head`` most frequent of ``frequent`` (w1, ..., wk, a) whose words all have ranks, by language and frequency."""
    few, whole = most_frequent(frequent.withColumnRenamed("a", "n"), head)
    known = few.where(" and ".join(f"{c} >= 0" for c in _columns(k))).toArrow()
    words = np.stack([known.column(c).to_numpy() for c in _columns(k)], 1).reshape(-1, k)
    lang, n = vocab.lang_of(words[:, 0]), known.column("n").to_numpy()
    order = np.lexsort((*words.T[::-1], -n, lang))
    return Phrases(words[order], np.searchsorted(lang[order], np.arange(len(vocab.langs))), whole and vocab.whole)


def _with_low(runs: DataFrame, langs: list[str], base: np.ndarray) -> DataFrame:
    """``runs`` with ``low``: the first rank of its language."""
    of = dict(zip(langs, base.tolist(), strict=True))
    if not of:
        return runs.withColumn("low", F.lit(0).cast("long"))
    return runs.withColumn("low", F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast(t) for k, v in of.items() for x, t in ((k, "string"), (v, "long")))), F.col("lang")), F.lit(0).cast("long")))


def _named(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``words`` (lang, word, n) with ``id``."""
    held = words.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs = np.full(b.num_rows, _NONE, np.int64), b.column("lang").dictionary_encode()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(langs.indices.to_numpy() == k)
                ids[at] = held.value.ids(name, b.column("word").take(pa.array(at)).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], names=[*b.schema.names, "id"])

    return words.mapInArrow(run, "lang string, word string, n long, id long")


def _vocabulary_without_clashes(words: DataFrame, frequent: DataFrame, head: int) -> Vocabulary:
    """A vocabulary in which no two words of ``words`` have one id; another salt for the hashes if they have."""
    for salt in range(1, _SALTS + 1):
        vocab = vocabulary(frequent, head, salt)
        if vocab.whole or _named(words, vocab).groupBy("id").count().where("count > 1").isEmpty():
            return vocab
    raise RuntimeError(f"words' hashes clash with {_SALTS} salts")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, head: int = HEAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of ``docs`` (lang, text; others are ignored).

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at ``[\\x20\\x09]`` into words; a null
    text is empty, a null language ``und``. n counts a language's words, a a phrase's occurrences within pieces, overlaps included. A phrase of
    2 to LONGEST words with a >= ``least`` scores floor(SCALE * a / (l + r)) at the cut into two parts with l and r occurrences that
    scores least (the first of equals). It goes if a longer one that holds it has COVER % of its occurrences or more. Order: score and a
    descending, then the phrase's bytes. Repeated rows count as often as they are there; no rows give none. Results don't depend on ``head``.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs))
    frequent = words.where(F.col("n") >= least)
    vocab = _vocabulary_without_clashes(words, frequent, head)
    runs = scratch.keep(id_runs(docs, vocab))
    size = (words.agg(F.sum("n")).first()[0] or 0) * _kind(vocab.whole)().itemsize
    fewer = runs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_IDS)))
    named = scratch.keep(_named(frequent, vocab))
    fill = lambda df, k: df.select(*_columns(k), *(F.lit(_NONE).cast("long").alias(c) for c in _columns(LONGEST)[k:]), "a")
    levels = [fill(named.select(F.col("id").alias("w1"), F.col("n").alias("a")), 1)]
    parts, low = None, vocab.base
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, BATCH)
    try:
        for k in range(2, LONGEST + 1):
            found = scratch.keep(count_phrases(_with_low(runs if k == 2 else fewer, vocab.langs, low), k, parts, vocab.whole).where(F.col("a") >= least))
            levels.append(fill(found, k))
            if k < LONGEST:
                parts = ranked(found, k, vocab, head)
                low = parts.base
    finally:
        conf.set(name, before)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return _report(every, named, words, top)


def _part(words: list, size: int) -> list:
    return words + [F.lit(_NONE).cast("long")] * (size - len(words))


def _report(every: DataFrame, named: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """Scores, covers, order and texts of the counted phrases ``every`` (w1, ..., w4, a)."""
    cols = _columns(LONGEST)
    w, size = [F.col(c) for c in cols], sum((F.col(c) != _NONE).cast("int") for c in cols)
    phrases = every.where(F.col("w2") != _NONE).withColumn("size", size)
    struct = lambda p: F.struct(*(x.alias(c) for x, c in zip(_part(p, LONGEST), cols, strict=True)))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # cuts: the first k words and the rest
    cuts = F.array_compact(F.array(*(F.when(F.col("size") == s, F.struct(F.lit(k).alias("cut"), struct(w[:k]).alias("first"), struct(w[k:s]).alias("rest"))) for s in range(2, LONGEST + 1) for k in range(1, s))))
    cut = phrases.select(*cols, "a", F.explode(cuts).alias("c")).select(*cols, "a", "c.cut", "c.first", "c.rest")
    side = lambda key, n: every.select(F.struct(*cols).alias(key), F.col("a").alias(n))
    cut = cut.join(side("first", "l"), "first").join(side("rest", "r"), "rest")
    score = F.expr(f"cast(cast(a as decimal(38,0)) * {SCALE} div (cast(l as decimal(38,0)) + cast(r as decimal(38,0))) as bigint)")
    scored = cut.withColumn("score", score).groupBy(*cols, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # the most frequent longer phrase that holds a phrase
    inside = F.array_compact(F.array(*(F.when(F.col("size") == s, struct(w[i : i + k])) for s in range(3, LONGEST + 1) for k in range(2, s) for i in range(s - k + 1))))
    cover = phrases.select(F.col("a").alias("longer"), F.explode(inside).alias("p")).groupBy("p").agg(F.max("longer").alias("longer")).select("p.*", "longer")
    left = scored.join(cover, cols, "left").where(F.col("longer").isNull() | (100 * wide("longer") < COVER * wide("a")))
    lang = named.select(F.col("id").alias("w1"), "lang")
    left = left.join(lang, "w1").select("lang", *cols, "a", "m.score", "m.l", "m.r")
    # few are left to be spelt: ties of the last place stay until texts decide
    order = [F.desc("score"), F.desc("a")]
    left = left.withColumn("_k", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_k") <= top).drop("_k")
    for c in cols:
        left = left.join(named.select(F.col("id").alias(c), F.col("word").alias(f"_{c}")), c, "left")
    left = left.withColumn("phrase", F.concat_ws(" ", *(f"_{c}" for c in cols)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    best = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same in DuckDB SQL."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, list_slice(w, i, i + {k - 1}) AS p FROM pieces, unnest(range(1, len(w) - {k - 2})) AS t(i)" for k in range(1, LONGEST + 1))
    return f"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM docs)),
every AS MATERIALIZED (SELECT lang, size, p, count(*) AS a FROM ({grams}) GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM every WHERE size = 1 GROUP BY 1),
f AS MATERIALIZED (SELECT * FROM every WHERE a >= {LEAST}),
cuts AS (SELECT f.lang, f.size, f.p, f.a, k, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * f.a) // (l.a + r.a) AS score FROM f, unnest(range(1, f.size)) AS t(k) JOIN f l ON l.lang = f.lang AND l.p = list_slice(f.p, 1, k) JOIN f r ON r.lang = f.lang AND r.p = list_slice(f.p, k + 1, f.size)),
scored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
cover AS (SELECT f.lang, list_slice(f.p, i, i + k - 1) AS p, max(f.a) AS longer FROM f, unnest(range(2, f.size)) AS t(k), unnest(range(1, f.size - k + 2)) AS u(i) WHERE f.size > 2 GROUP BY 1, 2),
rest AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN cover c ON c.lang = s.lang AND c.p = s.p WHERE longer IS NULL OR 100::HUGEINT * longer < {COVER}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM rest) JOIN total USING (lang) WHERE rank <= {TOP}"""
