"""Document fingerprints by randomised edit embedding.

All texts walk along their characters with shared random bits: at step j a text shows its current character and moves on if
the bit of (j, character) says so. Texts at a small edit distance fall into step again soon after an edit, so edit distance
becomes Hamming distance between what they show. The fingerprint samples that sequence at shared positions: SAMPLES bits for
each doubling of the step number. Its likeness is the share of equal shown characters, estimated octave by octave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.bytesets import mix
from seamline.session import cut, shuffle_partitions

#: Bits sampled of each octave, the steps [2**o - 1, 2**(o + 1) - 1).
SAMPLES = 64
_PERIOD = 4096  # rows of the shared random table; each pass over it permutes the character classes anew
_random = mix(np.arange(_PERIOD * 256, dtype=np.uint64) + np.uint64(0x5EED << 32))
_MOVE = (_random & np.uint64(1)).astype(np.uint8).reshape(_PERIOD, 256)
_SHOW = ((_random >> np.uint64(1)) & np.uint64(1)).astype(np.uint8).reshape(_PERIOD, 256)
#: Members of a band bucket that are compared with as many others in one row.
BLOCK = 64
#: Texts are walked together up to so many characters at a time.
_TOGETHER = 8 << 20


def _positions(octave: int) -> np.ndarray:
    low, size = (1 << octave) - 1, 1 << octave
    if size <= SAMPLES:
        return np.arange(low, low + size)
    jitter = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(octave << 20)).astype(np.float64) / 2.0**64
    return low + ((np.arange(SAMPLES) + jitter) * (size / SAMPLES)).astype(np.int64)


_OCTAVES = [_positions(o) for o in range(40)]


def n_octaves(n_chars: int) -> int:
    """A walk takes two steps a character on average: the octaves that 2 * n_chars steps reach."""
    return (2 * n_chars).bit_length()


def _class_of(step: int) -> np.uint8:
    return np.uint8((step // _PERIOD * 0x9D) & 0xFF)


def _moves(step: int) -> np.ndarray:
    """The rows of the pass that starts at ``step``, by character class; class 0 stays where it is."""
    out = _MOVE[:, np.arange(256) ^ _class_of(step)]
    out[:, 0] = 0
    return out


def walk_bits(texts: list[str]) -> list[np.ndarray]:
    """The sampled bits of each text, octave after octave. All texts step together, so the work per step is a few array operations."""
    n = len(texts)
    length = np.fromiter(map(len, texts), np.int64, n)
    # class 0 closes each text and is never left; characters have the classes 1 to 255
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    last = np.cumsum(length + 1) - 1
    classes = (code % 255 + 1).astype(np.uint8)
    classes[last] = 0
    need = np.array([n_octaves(int(x)) for x in length])
    blocks: list[np.ndarray] = []
    live = np.flatnonzero(length)
    at, end = (last - length)[live], last[live]
    step, move = 0, _moves(0)
    for octave in range(int(need.max(initial=0))):
        block = np.empty((n, len(_OCTAVES[octave])), np.uint8)
        for k, stop in enumerate([*_OCTAVES[octave].tolist(), (2 << octave) - 1]):
            while len(live) and step < stop:
                upto = min(stop, step + 32)
                for s in range(step, upto):
                    if s % _PERIOD == 0:
                        move = _moves(s)
                    at += move[s % _PERIOD][classes[at]]
                step = upto
                stay = at < end
                if not stay.all():
                    live, at, end = live[stay], at[stay], end[stay]
            step = stop
            if k < block.shape[1]:
                block[:, k] = _SHOW[stop % _PERIOD, 0 ^ _class_of(stop)]
                block[live, k] = _SHOW[stop % _PERIOD][classes[at] ^ _class_of(stop)]
        blocks.append(block)
    return [np.concatenate([b[i] for b in blocks[: need[i]]]) if need[i] else np.zeros(0, np.uint8) for i in range(n)]


def embed(texts: list[str]) -> list[np.ndarray]:
    """walk_bits in groups of bounded size."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= _TOGETHER):
            total += len(texts[j])
            j += 1
        out += walk_bits(texts[i:j])
        i = j
    return out


def spell(n_chars: int, bits: np.ndarray) -> str:
    """``<length>:<sampled bits in hex>``"""
    return f"{n_chars}:{np.packbits(bits).tobytes().hex()}"


def fingerprints_of(texts: list[str]) -> list[str]:
    return [spell(len(t), b) for t, b in zip(texts, embed(texts), strict=True)]


_LENGTHS = [len(x) for x in _OCTAVES]
_START = np.concatenate([[0], np.cumsum(_LENGTHS)])
#: What a finished text shows at each sampled step, and the steps that each sampled bit of a whole octave stands for.
_END_BITS = np.concatenate([[_SHOW[p % _PERIOD, _class_of(p)] for p in x.tolist()] for x in _OCTAVES[:32]]).astype(np.uint8)
_WEIGHT = np.concatenate([np.full(len(x), (1 << o) / len(x)) for o, x in enumerate(_OCTAVES[:32])])


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    n, _, digits = fingerprint.partition(":")
    return int(n), np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8))[: _START[n_octaves(int(n))]]


def bits_likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal shown characters, 0 to 1: twice the excess of agreeing bits over one half, octaves weighted by their steps. Two empty texts: 1."""
    if a[0] < b[0]:
        a, b = b, a
    n, x = a
    if n == 0:
        return 1.0
    y = b[1] if len(b[1]) == len(x) else np.concatenate([b[1], _END_BITS[len(b[1]) : len(x)]])
    same = x == y
    if same.all() and n == b[0]:
        return 1.0
    top = n_octaves(n) - 1
    k = _START[top]
    total = float(_WEIGHT[:k] @ same[:k])
    used = same[k:][_OCTAVES[top] < 2 * n]
    if len(used):
        total += used.mean() * (2 * n - (1 << top) + 1)
    return min(1.0, max(0.0, total / n - 1))


def likeness(a: str, b: str) -> float:
    return bits_likeness(read(a), read(b))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row of ``docs`` (doc_id, text; null: empty). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints_of(texts), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def near_pairs(prints: DataFrame, least: float = 0.75, bands: int = 24, width: int = 20) -> DataFrame:
    """(a, b, likeness) of distinct fingerprints at ``least`` or more, by bit-sampled banding.

    ``prints`` has doc_id and fingerprint. Rows of equal fingerprint are first reduced to the least doc_id (pairs are between
    representatives). A band is ``width`` bits sampled from the two octaves that hold most steps at the text's length class, so that a pair meets
    if all of one band's bits agree; lengths within a factor of two share a class or the next. Candidates are then verified on
    whole fingerprints. Every two members of a band bucket are compared: buckets are cut into blocks of BLOCK members and each pair of blocks is
    a row, so that a large bucket spreads over many tasks; its cost grows with the square of its distinct fingerprints. Two texts that
    never share a band are missed; see the README for how often.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = np.random.default_rng(7).integers(0, SAMPLES, (bands, width))
        for b in batches:
            ids, ks = [], []
            for i, f in zip(b.column("doc_id").to_pylist(), b.column("fingerprint").to_pylist(), strict=True):
                n, whole = read(f)
                if not n:
                    continue
                o = max(n_octaves(n) - 2, 0)
                for octave in {o, max(o - 1, 0)}:
                    bits = whole[_START[octave] : _START[octave + 1]]
                    for k in range(bands):
                        ids.append(i)
                        ks.append(f"{octave}:{k}:{np.packbits(bits[pick[k] % len(bits)]).tobytes().hex()}")
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ids, pa.int64())], names=["band", "doc_id"])

    one = cut(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    band = one.mapInArrow(keys, "band string, doc_id long")
    w = Window.partitionBy("band")
    block = band.withColumn("n", F.count("*").over(w)).where("n > 1").withColumn("block", F.floor((F.row_number().over(w.orderBy("doc_id")) - 1) / BLOCK).cast("int"))
    members = cut(block.groupBy("band", "block").agg(F.collect_list("doc_id").alias("ids")))
    other = members.select("band", F.col("block").alias("block_2"), F.col("ids").alias("ids_2"))
    pairs = members.join(other, "band").where("block <= block_2").select(F.explode("ids").alias("a"), "ids_2").select("a", F.explode("ids_2").alias("b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(one.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("fa")), "a").join(one.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("fb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            score = np.array([likeness(p, q) for p, q in zip(x.column("fa").to_pylist(), x.column("fb").to_pylist(), strict=True)])
            keep = pa.array(score >= least)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(score, pa.float64())], names=["a", "b", "likeness"]).filter(keep)

    return both.select("a", "b", "fa", "fb").mapInArrow(verify, "a long, b long, likeness double")


OP1_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last floor(n / 3) characters replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OP1_SCHEMA.split(", ")]
    held: list[tuple] = []  # the last row waits for the one after it
    for b in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(z).decode("utf-8", "surrogatepass") if z else "" for z in b.column("packed").to_pylist()]
        rows = held + list(zip(b.column("bucket").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), texts, embed(texts), strict=True))
        held = rows[-1:]
        own = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
        changed = [edited(x[3], y[3]) for x, y in own]
        marks = embed(changed)
        cols = [
            pa.array([x[2] for x, _ in own], pa.int64()),
            pa.array([len(x[3]) for x, _ in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([spell(len(x[3]), x[4]) for x, _ in own], pa.string()),
            pa.array([spell(len(t), m) for t, m in zip(changed, marks, strict=True)], pa.string()),
            pa.array([bits_likeness((len(x[3]), x[4]), (len(t), m)) for (x, _), t, m in zip(own, changed, marks, strict=True)], pa.float64()),
            pa.array([bits_likeness((len(x[3]), x[4]), (len(y[3]), y[4])) for x, y in own], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with the fingerprints of its text, of its edited text, and their likeness; see OP1_SCHEMA.

    The next document is that of the next smaller doc_id; after the last comes the first. Equal ids stand in a fixed order of
    their contents; null ids come last, by a hash of their texts; a null text is empty; a table of one row follows itself; an empty one gives no rows; other columns are ignored.
    Texts travel compressed, once. Ranges of ids (bounds from approximate quantiles, eight a shuffle partition) are dealt out once and sorted; the first rows
    of each range also go, as guests, to the range before it, so no ordering ever passes through one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = 8 * shuffle_partitions(spark)
    bounds = sorted(set(rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))))
    cuts = np.array(bounds, np.int64)
    null_cuts = np.array([i * ((1 << 64) // n) - (1 << 63) for i in range(1, n)], np.int64)
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))

    def ranges(ids: pa.Array, key: pa.Array) -> np.ndarray:
        """Numbered from the largest keys down: those of the ids, then those of null ids, whose keys are hashes."""
        known, key = np.array(ids.is_valid().to_pylist(), bool), key.to_numpy(zero_copy_only=False)
        own, other = len(cuts) - np.searchsorted(cuts, key, side="left"), len(null_cuts) - np.searchsorted(null_cuts, key, side="left")
        return np.where(known, own, len(cuts) + 1 + other).astype(np.int64)

    def top_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranges(b.column(0), b.column(1)), pa.int64()), b.column(1)], names=["bucket", "key"])

    keys = rows.where("doc_id is not null").select("doc_id", F.col("doc_id").alias("key")).union(rows.where("doc_id is null").select("doc_id", hashed.alias("key")))
    tops = keys.mapInArrow(top_keys, "bucket long, key long").groupBy("bucket").agg(F.max("key").alias("top")).collect()
    if not tops:
        return spark.createDataFrame([], OP1_SCHEMA)
    first = {r["bucket"]: r["top"] for r in tops}
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # whose last row is followed by b's first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, key = b.column("doc_id"), b.column("text"), b.column("key")
            bucket = ranges(ids, key)
            lead = np.array([i for i, (d, k) in enumerate(zip(key.to_pylist(), bucket.tolist(), strict=True)) if d == first[k]], np.int64)
            at = np.concatenate([np.arange(len(bucket)), lead])
            to = np.concatenate([bucket, np.array([before[k] for k in bucket[lead].tolist()], np.int64)])
            guest = np.arange(len(at)) >= len(bucket)
            pack = zstandard.ZstdCompressor(level=3).compress
            packed = pa.array([pack(t.encode("utf-8", "surrogatepass")) if t else b"" for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), key.take(pa.array(at)), packed.take(pa.array(at)), pa.array(to), pa.array(guest)], names=["doc_id", "key", "packed", "bucket", "guest"])

    dealt = rows.withColumn("key", F.coalesce("doc_id", hashed)).mapInArrow(deal, "doc_id long, key long, packed binary, bucket long, guest boolean")
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", F.col("key").desc(), "packed").drop("key")
    return dealt.mapInArrow(_compare, OP1_SCHEMA)
