"""Near-duplicates by HyperMinHash.

A document's set is its distinct five-word shingles (64-bit hashes). Its sketch has REGISTERS buckets; each keeps the least hash
that fell into it, compressed to the count of leading zeros and the next MANTISSA bits. BANDS groups of ROWS registers are the
join keys; candidates pass a collision-corrected estimate of Jaccard similarity and are then confirmed on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.bytesets import chunks, lower, mix, prefix_hashes, range_hash, utf8, words
from seamline.operators.graph import components
from seamline.session import Scratch, shuffle_partitions

SHINGLE = 5
#: A pair of similarity 0.75 shares no band with probability (1 - 0.75**ROWS)**BANDS = 4e-6, one of 0.3 shares any with 0.05.
REGISTERS, ROWS, BANDS, MANTISSA = 384, 6, 64, 10
#: Candidates whose estimate is this many standard errors under the threshold are left out (probability 1e-9).
MARGIN = 6.0
#: Links ask for 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Buckets of up to GROUP documents are compared pair by pair; larger ones are linked to their first and previous member.
GROUP = 3
_K = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64))
_EMPTY = 0xFFFF


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer than SHINGLE words the whole sequence is one shingle, without words the set is empty."""
    data = lower(data)
    starts, ends, first = words(data, offsets)
    h = mix(range_hash(prefix_hashes(data), starts, ends))
    n = len(offsets) - 1
    full = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        full = h[: len(h) - SHINGLE + 1] * _K[0]
        for d in range(1, SHINGLE):
            full = full + h[d : len(h) - SHINGLE + 1 + d] * _K[d]
        full = mix(full)
    out = []
    for r in range(n):
        a, b = first[r], first[r + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _K[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _orders() -> np.ndarray:
    """Row i: the place of each bucket in the order in which an empty bucket i looks for one to borrow from."""
    key = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(0xB0 << 40)).reshape(REGISTERS, REGISTERS)
    return np.argsort(np.argsort(key, axis=1), axis=1).astype(np.int16)


_ORDERS = _orders()


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: leading zeros (6 bits) above MANTISSA bits of the bucket's least hash.

    A bucket that nothing fell into borrows the register of the first one that isn't empty in its own fixed random order, so
    that registers of small sets agree with the probability of their similarity too; 0xFFFF only for the empty set.
    """
    out = np.full(REGISTERS, _EMPTY, np.uint16)
    if not len(s):
        return out
    bucket = (((s >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least = np.minimum.reduceat(mix(s) | np.uint64(1), at)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - np.minimum(exponent, 64), 62)
    full = bucket[at]
    out[full] = (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    if len(full) < REGISTERS:
        none = np.ones(REGISTERS, bool)
        none[full] = False
        none = np.flatnonzero(none)
        out[none] = out[full[np.argmin(_ORDERS[none[:, None], full[None, :]], axis=1)]]
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; none for the empty set."""
    g = reg.reshape(BANDS, ROWS).astype(np.uint64)
    k = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(56)
    for c in range(ROWS):
        k = mix(k + g[:, c])
    return k if reg[0] != _EMPTY else k[:0]


def _collisions(n: np.ndarray) -> np.ndarray:
    """P(zeros) of the least of n / REGISTERS uniform hashes, by row."""
    lam = np.maximum(n / REGISTERS, 1e-9)[:, None]
    z = np.arange(40)[None, :]
    return np.exp(-lam * 2.0 ** -(z + 1)) - np.exp(-lam * 2.0**-z)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate with expected chance collisions taken out, its standard error at PERCENT) for rows of registers of sets of na and nb."""
    share = (ra == rb).mean(axis=1)
    chance = (_collisions(na) * _collisions(nb)).sum(axis=1) / (1 << MANTISSA)
    filled = REGISTERS * -np.expm1(-np.minimum(na, nb) / REGISTERS)  # buckets with a hash of their own
    j = PERCENT / 100
    return (share - chance) / (1 - chance), np.sqrt(j * (1 - j) * (1 / np.maximum(filled, 1) + 1 / REGISTERS))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = utf8(batch.column("text"))
    for i, j in chunks(offsets):
        yield i, shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of every row of ``docs``; digest (of the set) and bands are empty for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, bands = [], [], []
            for _, sets in _texts(b):
                for s in sets:
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(band_keys(registers(s)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _within(key: np.ndarray, doc: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, ...]:
    """Candidates (key, a, b, large) of members sorted by key and doc: all pairs of a small bucket, links to the first and the previous member in one over GROUP."""
    first, size = _runs(key)
    begin, count = np.repeat(first, size), np.repeat(size, size)
    flag = np.repeat(np.logical_or.reduceat(large, first) | (size > GROUP), size)
    at = np.arange(len(key))
    later = [at[(at - begin >= d) & ((count <= GROUP) | (d == 1))] for d in range(1, GROUP)]
    earlier = [i - d for d, i in enumerate(later, 1)]
    star = at[(count > GROUP) & (at > begin + 1)]
    x, y = np.concatenate([*earlier, begin[star]]), np.concatenate([*later, star])
    differ = doc[x] != doc[y]
    x, y = x[differ], y[differ]
    return key[y], doc[x], doc[y], flag[y]


_CANDIDATES = "key long, a long, b long, large boolean"


def _batch(key: np.ndarray, a: np.ndarray, b: np.ndarray | None, large: np.ndarray) -> pa.RecordBatch:
    to = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), to, pa.array(large, pa.bool_())], names=["key", "a", "b", "large"])


def candidates(reps: DataFrame) -> DataFrame:
    """Candidate pairs (key, a, b, large) of ``reps`` (doc, bands).

    Members of a bucket that meet in one batch of a task are linked there if they are more than GROUP, and only the first goes
    on, so a bucket that holds a large part of all rows reaches the shuffle as a few rows a task. large marks every link of
    a bucket of which not all pairs are listed.
    """

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            bands = t.column("bands")
            doc = np.repeat(t.column("doc").to_numpy(), np.diff(bands.offsets.to_numpy()))
            key = bands.flatten().to_numpy()
            if not len(key):
                continue
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first, size = _runs(key)
            many = np.repeat(size > GROUP, size)
            if many.any():
                yield _batch(*_within(key[many], doc[many], many[many]))
            stay = ~many
            stay[first] = True
            yield _batch(key[stay], doc[stay], None, many[stay])

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for t in batches:
            open_ = ~t.column("b").is_valid().to_numpy(zero_copy_only=False)
            if not open_.all():
                yield t.filter(pa.array(~open_))
            new = (t.column(c).to_numpy(zero_copy_only=False)[open_] for c in ("key", "a", "large"))
            key, doc, large = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(key):
                continue
            begin = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if len(key) - begin > 1 << 16:  # a very large one: link what is there, its first member goes on
                yield _batch(*_within(key, doc, large))
                held = (key[begin : begin + 1], doc[begin : begin + 1], np.ones(1, bool))
                continue
            held = (key[begin:], doc[begin:], large[begin:])
            if begin:
                yield _batch(*_within(key[:begin], doc[:begin], large[:begin]))
        if len(held[0]):
            yield _batch(*_within(*held))

    n = shuffle_partitions(reps.sparkSession)
    dealt = reps.select("doc", "bands").mapInArrow(before, _CANDIDATES)
    spread = F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("a", "b"))
    return dealt.repartition(n, spread).sortWithinPartitions("key", "a").mapInArrow(after, _CANDIDATES)


def profiles(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, n, regs, items) of the rows of ``docs`` (doc_id, text) that ``ids`` (doc) names, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs, items = [], []
            for _, sets in _texts(b):
                regs += [registers(s).tobytes() for s in sets]
                items += [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([len(x) // 8 for x in items], pa.int64()), pa.array(regs, pa.binary()), pa.array(items, pa.binary())], names=["doc", "n", "regs", "items"])

    rows = docs.select(F.col("doc_id").alias("doc"), "text").join(ids.hint("merge"), "doc", "left_semi")
    return rows.mapInArrow(run, "doc long, n long, regs binary, items binary")


def verified(pairs: DataFrame, prof: DataFrame, scratch: Scratch) -> DataFrame:
    """The ``pairs`` (a, b) that are links: estimate first, then 100 * intersection >= PERCENT * union on the full sets. Ids and pairs grow with the corpus and are never broadcast."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            j, error = estimate(ra, rb, b.column("na").to_numpy(), b.column("nb").to_numpy())
            keep = pa.array(j >= PERCENT / 100 - MARGIN * error)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    side = lambda one, cols: prof.select(F.col("doc").alias(one), *(F.col(c).alias(d) for c, d in cols))
    few = pairs.hint("merge").join(side("a", [("regs", "ra"), ("n", "na")]), "a").join(side("b", [("regs", "rb"), ("n", "nb")]), "b")
    few = scratch.keep(few.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(likely, "a long, b long"))
    sets = few.hint("merge").join(side("a", [("items", "sa")]), "a").join(side("b", [("items", "sb")]), "b")
    return sets.select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


#: Shingles of a cell's side in ``bridges`` (8 bytes each), and the copies of each group's row that a hot group's members are spread over.
CELL_ITEMS, SALT = 1 << 21, 32


def bridges(members: DataFrame, prof: DataFrame) -> DataFrame:
    """(a, b): links between different components of a candidate group that join all of them that any link joins.

    ``members``: (g, doc, c), the members of groups with their components so far; ``prof``: (doc, n, items). Within a group
    the members outside its largest component are probes: each is compared with all members through their shingles' posting lists. A
    group is a grid of cells (blocks of probes by slices of members) of bounded size; a cell gives a link only if it
    joins two components, so at most as many as it has members. Bytes grow with probes times members over CELL_ITEMS.
    """
    sized = members.join(prof.select("doc", "n"), "doc")
    part = sized.groupBy("g", "c").agg(F.count("*").alias("k"), F.sum("n").alias("items"))
    whole = part.groupBy("g").agg(F.max(F.struct("k", "c", "items")).alias("top"), F.sum("k").alias("all"), F.sum("items").alias("items"))
    cells = lambda x: F.ceil(x / CELL_ITEMS).cast("int")
    grid = whole.where(F.col("all") > F.col("top.k")).select("g", F.col("top.c").alias("big"), cells(F.col("items") - F.col("top.items")).alias("blocks"), cells(F.col("items")).alias("slices"))
    grid = grid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = members.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALT))).join(grid, ["g", "salt"])
    own = own.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("j", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("slices")).cast("int"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    own = own.withColumn("probe", F.col("c") != F.col("big"))
    own = own.withColumn("t", F.explode(F.when(F.col("probe"), F.array_union(as_member, as_probe)).otherwise(as_member)))
    own = own.select("g", "t.i", "t.j", "doc", "c", (F.col("probe") & (F.col("i") == F.col("t.i"))).alias("probe"), (F.col("j") == F.col("t.j")).alias("member"))
    dealt = own.join(prof.select("doc", "items"), "doc").repartition(shuffle_partitions(members.sparkSession), "g", "i", "j")

    def compare(table: pa.Table) -> pa.Table:
        doc, c = table.column("doc").to_numpy(), table.column("c").to_numpy().copy()
        probe, member = (table.column(x).to_numpy() for x in ("probe", "member"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, item = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(sets)), size)
        listed = np.flatnonzero(member[owner])
        order = listed[np.argsort(item[listed], kind="stable")]
        posting, at = owner[order], np.searchsorted(item[order], np.arange(int(item.max(initial=-1)) + 2))
        a, b = [], []
        for x in np.flatnonzero(probe).tolist():
            mine = item[begin[x] : begin[x + 1]]
            length = at[mine + 1] - at[mine]
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            both = np.bincount(posting[step + np.repeat(at[mine], length)], minlength=len(sets))
            for y in np.flatnonzero((100 * both >= PERCENT * (size[x] + size - both)) & (c != c[x])).tolist():
                if c[y] != c[x]:
                    a.append(doc[x]), b.append(doc[y])
                    c[c == c[y]] = c[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; others are ignored).

    Rows of one doc_id are one document whose links are those of all its texts; a null doc_id is linked with nothing
    (component_id null, kept). A null or wordless text has an empty set and is linked with nothing. Equal sets are reduced to the least doc_id first (an aggregate
    with map-side sums) and get its label at the end; pairs are sought between these representatives only. Buckets of up to GROUP representatives give all
    their pairs. A larger bucket gives each member one pair, with the least first member of its buckets; what such buckets hold
    is a group, and members outside their group's largest component are then compared with the whole group, so no link between components is lost.
    No component, link or sketch is gathered in one place.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    s = scratch.keep(sketches(rows))
    known = s.where("doc_id is not null")
    reps = scratch.keep(known.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    found = candidates(reps.select(F.col("rep").alias("doc"), "bands")).where("b is not null and a <> b")
    found = scratch.keep(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("large").alias("large"), F.max("large").alias("any_large")))
    anchor = found.where("large").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    pairs = found.where("not large").select("a", "b").union(anchor)
    named = found.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    prof = scratch.keep(profiles(rows.where("doc_id is not null"), named))
    label = components(scratch.keep(verified(pairs, prof, scratch)))
    wide = found.where("any_large").select("a", "b")
    if not wide.isEmpty():
        group = components(wide).select(F.col("node").alias("doc"), F.col("component").alias("g"))
        group = group.join(label.select(F.col("node").alias("doc"), F.col("component").alias("c")), "doc", "left").withColumn("c", F.coalesce("c", "doc"))
        label = components(label.toDF("a", "b").union(scratch.keep(bridges(scratch.keep(group), prof))))
    texts = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.bool_or(F.col("digest").isNull()).alias("empty"))
    several = scratch.keep(texts.where("lo <> hi or (lo is not null and empty)").select(F.col("doc_id").alias("_several"), "lo"))
    s = s.select("doc_id", "n_shingles", "digest")
    if not several.isEmpty():  # all texts of one doc_id hang together
        s = s.join(several, F.col("doc_id") == F.col("_several"), "left").withColumn("digest", F.coalesce("digest", "lo"))
        ties = s.where("digest <> lo").select("lo", "digest").distinct().join(reps.select("digest", F.col("rep").alias("a")), "digest")
        ties = ties.join(reps.select(F.col("digest").alias("lo"), F.col("rep").alias("b")), "lo").select("a", "b")
        label = components(label.toDF("a", "b").union(ties))
        s = s.select("doc_id", "n_shingles", "digest")
    scratch.drop(found, prof)
    named = reps.select("digest", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    single = F.col("digest").isNull() | F.col("doc_id").isNull()
    out = s.where(~single).join(named, "digest").select("doc_id", "n_shingles", "component_id")
    out = out.union(s.where(single).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
