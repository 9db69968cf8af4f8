"""Quality rules: counts of each text, then a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.bytesets import chunks, mix, prefix_hashes, range_hash, utf8, words
from seamline.operators.catalogue import small
from seamline.operators.graph import numbered
from seamline.session import Scratch

#: Hash buckets of words and word pairs together: the multinomials' size, whatever the corpus.
BUCKETS = 1 << 16
#: Trusted ids that are broadcast at most (some 20 MB); more meet the texts in a shuffled join.
MAX_BROADCAST = 500_000
#: Share of the raw distribution in the trusted one, whatever the count of trusted rows.
RAW_WEIGHT = 0.5
#: Share of the trusted rows that the limit may reject, the lowest scores first; under 1 / REJECT rows it is the lowest score.
REJECT = 0.005
BASE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_K = mix(np.arange(11, 19, dtype=np.uint64))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first) of each key, in the order given."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    twice = again.copy()
    twice[:-1] |= again[1:]
    out = np.zeros((2, len(k)), bool)
    out[0, order], out[1, order] = twice, again
    return out[0], out[1]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple:
    prefix = prefix_hashes(data)
    starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return prefix, starts, ends, first, row, mix(range_hash(prefix, starts, ends))


def base_counts(data: np.ndarray, offsets: np.ndarray, parts: tuple) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    prefix, starts, ends, first, row, h = parts
    n = len(offsets) - 1
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    in_words = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lead[ends] - lead[starts], out=in_words[1:])
    # lines: a newline or a row's end closes one
    stop = data == 10
    cuts = np.union1d(np.flatnonzero(stop), offsets[1:])
    line_start = np.concatenate([[0], cuts[:-1]])
    line_start += (line_start < len(data)) & np.isin(line_start, np.flatnonzero(stop))
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    has_word = np.searchsorted(starts, cuts) > np.searchsorted(starts, line_start)
    line_start, cuts, line_row = line_start[has_word], cuts[has_word], line_row[has_word]
    lines = mix(mix(range_hash(prefix, line_start, cuts)) + mix(line_row.astype(np.uint64)))
    dup = np.bincount(line_row[_repeated(lines)[1]], minlength=n)
    # words in three-word windows that the text holds twice
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = row[2:] == row[:-2]
        at = np.flatnonzero(inside)
        w = mix(mix(h[at] * _K[0] + h[at + 1] * _K[1] + h[at + 2] * _K[2]) + mix(row[at].astype(np.uint64)))
        hit = at[_repeated(w)[0]]
        for d in range(3):
            covered[hit + d] = True
    return [np.diff(first), in_words[first[1:]] - in_words[first[:-1]], _per_row(_SYMBOL[data], offsets), dup, np.bincount(row[covered], minlength=n)]


def _grams(parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbouring words."""
    row, h = parts[4], parts[5]
    near = row[1:] == row[:-1]
    two = mix(h[:-1] * _K[3] + h[1:] * _K[4])[near]
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([row, row[1:][near]]), np.concatenate([h & mask, two & mask]).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    data, offsets = utf8(batch.column("text"))
    for i, j in chunks(offsets):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, half_0, half_1): n-gram counts of the rows (text, half) of either half.

    Each task sums its own rows first, so that BUCKETS rows a task are shuffled at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            half = b.column("half").to_numpy()
            for data, offsets, i, j in _rows(b):
                row, bucket = _grams(_word_hashes(data, offsets))
                for k in (0, 1):
                    if (half[i:j] == k).any():
                        total[k] += np.bincount(bucket[half[i:j][row] == k], minlength=BUCKETS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["bucket", "half_0", "half_1"])

    each = rows.select("text", "half").mapInArrow(count, "bucket long, half_0 long, half_1 long")
    return each.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("half_0", "half_1")])


def trusted_halves(labels: DataFrame) -> DataFrame:
    """(trusted, half): ids of all labelled good, non-toxic rows; in the order of their hash, they go to the halves 0 and 1 in turn."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted")).distinct()
    return numbered(good.withColumn("_h", F.xxhash64("trusted")), "_h", "trusted").select("trusted", (F.col("node") % 2).cast("int").alias("half"))


def _table(counts: DataFrame) -> np.ndarray:
    total = np.zeros((2, BUCKETS))
    for r in counts.collect():
        total[:, r["bucket"]] = r["half_0"], r["half_1"]
    return total


def log_ratio(docs: DataFrame, trusted: DataFrame) -> np.ndarray | None:
    """log p(trusted) / p(raw) of each bucket, for rows of half 0, of half 1 and of neither; None unless both halves of ``trusted`` (text, half) have words.

    The trusted side is a mixture with the raw distribution, so its weight doesn't depend on how many rows are trusted. Rows
    of one half are judged by the other, so that no text vouches for itself; all others by the mean of both.
    """
    own = _table(gram_counts(trusted))
    if not own.any(axis=1).all():
        return None
    raw = _table(gram_counts(docs.withColumn("half", F.lit(0))))[0]
    raw = (raw + 1) / (raw + 1).sum()
    by = [np.log((1 - RAW_WEIGHT) * t / t.sum() / raw + RAW_WEIGHT) for t in own]
    return np.array([by[1], by[0], (by[0] + by[1]) / 2])


def _judged(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """The five counts and base_failed of each row, then its score by each row of ``weight``."""
    parts = _word_hashes(data, offsets)
    row, bucket = _grams(parts)
    n = len(offsets) - 1
    counts = base_counts(data, offsets, parts)
    grams = np.maximum(np.bincount(row, minlength=n), 1)
    scores = [np.bincount(row, w[bucket], minlength=n) / grams for w in weight]
    return [*counts, (counts[0] < 50) | (100 * counts[4] > 50 * counts[0]), *scores]


def cutoff(trusted: DataFrame, ratio: np.ndarray, reject: float = REJECT) -> float | None:
    """The score that a share ``reject`` of the ``trusted`` rows (text, half) doesn't pass when judged by the other half; None if all fail the base rule."""
    at = trusted.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = b.column("half").to_numpy()
            for data, offsets, i, j in _rows(b):
                *_, failed, by_0, by_1 = _judged(data, offsets, at.value[:2])
                yield pa.RecordBatch.from_arrays([pa.array(np.where(half[i:j] == 0, by_0, by_1)[~failed])], names=["score"])

    return trusted.select("text", "half").mapInArrow(score, "score double").agg(F.percentile_approx("score", reject, 1_000_000)).first()[0]


def quality(docs: DataFrame, labels: DataFrame, reject: float = REJECT, carry: bool = False) -> DataFrame:
    """Counts, ``base_failed``, ``score`` (mean log ratio per n-gram, 0 without words) and ``kept`` of every row of ``docs``.

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic. With ``carry`` the columns of ``docs`` come first
    (a clash of names is an error then), else doc_id alone. A null or empty text has no words and fails the base rule;
    null ids are kept as null; repeated rows get equal verdicts. Scores fall and spread as the trusted set shrinks, so the
    limit is the score under which a share ``reject`` of the trusted rows themselves lie (see cutoff); with fewer than two
    trusted rows only the base rule decides and scores are 0. The statistics cover all of ``docs`` and all trusted rows, whose
    texts are kept once in a table. Three scans; with more than MAX_BROADCAST trusted ids one shuffle of the texts, to find
    theirs, and one of the results (with ``carry``, of all columns).
    """
    halves = small(trusted_halves(labels).toDF("_trusted", "_half"), MAX_BROADCAST)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scratch = Scratch(docs.sparkSession)
    trusted = scratch.keep(texts.join(halves, F.col("doc_id") == F.col("_trusted")).select("text", F.col("_half").alias("half")))
    ratio = log_ratio(texts, trusted)
    limit = None if ratio is None else cutoff(trusted, ratio, reject)
    scratch.drop(trusted)
    least = -np.inf if limit is None else limit
    at = docs.sparkSession.sparkContext.broadcast(np.zeros((3, BUCKETS)) if ratio is None else ratio)
    keep = docs if carry else texts
    names = [x for x in keep.columns if carry or x == "doc_id"]
    added = BASE_SCHEMA.split(", ")[1:] + ["base_failed boolean", "score double", "kept boolean"]
    if clash := {x.split()[0] for x in added} & set(names):
        raise ValueError(f"columns already there: {sorted(clash)}")
    made = [*added[:6], "_by_0 double", "_by_1 double", "_by_2 double"]
    schema = keep.select(names).schema
    for x in made:
        schema = schema.add(*x.split())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in made]
            for data, offsets, _, _ in _rows(b):
                for c, v in zip(cols, _judged(data, offsets, at.value), strict=True):
                    c.append(v)
            v = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            out = [b.column(x) for x in names] + [pa.array(x.astype(np.int64)) for x in v[:5]] + [pa.array(v[5].astype(bool)), *(pa.array(x.astype(float)) for x in v[6:])]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *(x.split()[0] for x in made)])

    rows = keep.mapInArrow(judge, schema).join(halves, F.col("doc_id").cast("long") == F.col("_trusted"), "left")
    score = F.when(F.col("_half") == 0, F.col("_by_0")).when(F.col("_half") == 1, F.col("_by_1")).otherwise(F.col("_by_2"))
    return rows.select(*names, *(x.split()[0] for x in added[:6]), score.alias("score"), (~F.col("base_failed") & (score >= F.lit(float(least)))).alias("kept"))
