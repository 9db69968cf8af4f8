"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1 made from its code point. A trigram binds three letters: the first permuted twice,
the second once, multiplied. A text bundles (adds) the vectors of its trigrams, a language those of its training texts, and
a text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.bytesets import mix

#: Dimensions of the vectors.
DIMENSIONS = 512
#: More learned languages than this are an error: bounds what reaches the driver to MAX_LANGUAGES * DIMENSIONS numbers.
MAX_LANGUAGES = 4096
UNKNOWN = "und"
_CHUNK = 1 << 20
_SPACE = 32


class _Letters:
    """Code point to lower-case letter or mark, or to the space that stands for a run of anything else; and whether it is a letter. Built once a process."""

    table: np.ndarray | None = None
    letter: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            t, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
            for c in range(0x110000):
                x = chr(c)
                if (kind := unicodedata.category(x)[0]) in "LM":
                    t[c] = ord(x.lower()[0])
                    letter[c] = kind == "L"
            cls.table, cls.letter = t, letter
        return cls.table


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """(len, DIMENSIONS) of +1 and -1, from the code points alone."""
    words = mix(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :])
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.float32)


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    """Bound vectors of packed trigrams; a permutation is a rotation by one."""
    a, b, c = (trigrams >> 42) & 0x1FFFFF, (trigrams >> 21) & 0x1FFFFF, trigrams & 0x1FFFFF
    letters, inverse = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    v, n = letter_vectors(letters), len(trigrams)
    return np.roll(v, 2, axis=1)[inverse[:n]] * np.roll(v, 1, axis=1)[inverse[n : 2 * n]] * v[inverse[2 * n :]]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, packed trigram) of every text; each text stands between spaces, runs of other characters count as one space."""
    raw = np.frombuffer((" \0 ".join(["", *texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _Letters.get()[raw]
    row = np.cumsum(raw == 0) - 1  # a NUL inside a text is rare: see below
    if (raw == 0).sum() != len(texts) + 1:
        texts = [t.replace("\0", " ") for t in texts]
        return trigrams(texts)
    lettered = np.bincount(row[_Letters.letter[raw]], minlength=len(texts) + 1) > 0  # marks alone make no text of a language
    space = code == _SPACE
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    code, row = code[keep].astype(np.int64), row[keep]
    ok = (row[2:] == row[:-2]) & (code[1:-1] != _SPACE) & lettered[row[1:-1]] if len(code) > 2 else np.zeros(0, bool)
    # a trigram has a letter in its middle, so that pairs across a space aren't bound to each other
    packed = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[ok]
    return row[1:-1][ok], packed


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= _CHUNK):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, their bundled vectors of length one) of ``docs`` (text, lang), rows of null lang left out.

    Each task adds up its own rows, so one vector a task and language is shuffled; whole numbers are summed, so the result
    doesn't depend on the order of rows.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = [t or "" for t in b.column("text").to_pylist()], b.column("lang").to_pylist()
            for i, j in _groups(texts):
                names, which = np.unique(langs[i:j], return_inverse=True)
                row, grams = trigrams(texts[i:j])
                kinds, at = np.unique(grams, return_inverse=True)
                if not len(kinds):
                    continue
                count = np.bincount(which[row] * len(kinds) + at, minlength=len(names) * len(kinds)).reshape(len(names), len(kinds))
                sums = count.astype(np.float64) @ trigram_vectors(kinds).astype(np.float64)
                for name, v in zip(names.tolist(), sums, strict=True):
                    total[name] = total.get(name, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = docs.where("lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(bundle, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum("x").alias("x"))
    each = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    rows = sorted(each.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not rows:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    v = np.array([r["v"] for r in rows], np.float64)
    return [r["lang"] for r in rows], (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], profile: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with ``lang_pred`` and ``score``: cosine with the nearest prototype, 0 to 1.

    A null text, one without a letter, or no learned language gives ``und`` and 0. Ties go to the first language by name.
    """
    held = docs.sparkSession.sparkContext.broadcast((languages, profile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = held.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, j in _groups(texts):
                row, grams = trigrams(texts[i:j])
                if not len(grams) or not names:
                    continue
                kinds, at = np.unique(grams, return_inverse=True)
                vectors = trigram_vectors(kinds)
                order = np.argsort(row * len(kinds) + at, kind="stable")
                key = (row * len(kinds) + at)[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count = np.diff(np.append(first, len(key))).astype(np.float32)
                r, k = key[first] // len(kinds), key[first] % len(kinds)
                edge = np.searchsorted(r, np.arange(j - i + 1))
                for d in range(j - i):
                    lo, hi = edge[d], edge[d + 1]
                    if lo < hi:
                        v = count[lo:hi] @ vectors[k[lo:hi]]
                        cos = p @ v / max(float(np.linalg.norm(v)), 1e-9)
                        w = int(np.argmax(cos))
                        best[i + d], score[i + d] = names[w], min(1.0, max(0.0, float(cos[w])))
            out = [b.column(c) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    schema = docs.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: crc32 of doc_id as text leaves 2 on division by 4; a null doc_id is not held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang), learned from the rows not held out.

    lang, source and doc_id are no inputs of a prediction; other columns are ignored; repeated rows get equal predictions.
    """
    rows = held_out(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    names, profile = prototypes(rows.where(~F.col("held_out")).select("text", "lang"))
    return predict(rows.select("doc_id", "held_out", "text"), names, profile)
