"""Spelling variants, byte-level BPE and collocations against brute force, the tiktoken library and SQL."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seamline.llm import byte_bpe, collocations, language, variants
from seamline.llm.queries import RANKS
from tests.llm.test_edges import by_sql
from tests.llm.test_llm import DOC, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame_of(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use inside."""
    made = spark.createDataFrame([(i, t, la, "src0", len(t or "")) for i, t, la in rows], DOC)
    return made.withColumns({c: F.lit("x") for c in ("word", "n", "node", "ids", "low", "w1", "a", "rank")}).repartition(parts)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    close, form = {w: [x for x in count if near(w, x)] for w in count}, {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        if best and count[best] >= 10 * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n, len(close[w]), count.get(form.get(w))) for w, n in count.items())


@pytest.mark.parametrize("letters,low,high,kinds", [("ab", 7, 10, 300), ("abcÀÿ÷", 7, 9, 500), ("a", 7, 40, 100), ("ABxyz", 5, 60, 300)])
def test_variants(spark, letters, low, high, kinds):
    rng = random.Random(len(letters))
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(kinds)]
    weight = [1 / (k + 1) for k in range(kinds)]
    rows = [(i, " ".join(rng.choices(known, weight, k=60)) if i % 17 else None, "en") for i in range(200)]
    rows += [(None, "Abcdefgh,abcdefgh;ABCDEFGH ", None), (7, "", "en")] * 3 + rows[5:15]
    assert Counter(map(tuple, variants.variants(frame_of(spark, rows)).collect())) == brute_variants(rows)


def test_variants_of_long_words_and_of_none(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef") for _ in range(20000))
    rows = [(i, f"{long} {long[:9000]}x{long[9001:]} {long}y short", "en") for i in range(4)]
    assert Counter(map(tuple, variants.variants(frame_of(spark, rows)).collect())) == brute_variants(rows)
    for none in ([], [(1, None, None), (2, "a b c", "en")]):
        assert variants.variants(spark.createDataFrame([(*r, None, None) for r in none], DOC)).collect() == []


def test_variants_root_follows_several_forms(spark):
    text = " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200)
    rows = [(i, text, "en") for i in range(5)]
    got = {r["word"]: r["root"] for r in variants.variants(frame_of(spark, rows)).collect()}
    assert got["abcdefg"] == "abcdefghi" == got["abcdefgh"]
    assert Counter(map(tuple, variants.variants(frame_of(spark, rows)).collect())) == brute_variants(rows)


@pytest.fixture(scope="module")
def ranks(spark):
    return byte_bpe.read_ranks(spark, RANKS)


@pytest.fixture(scope="module")
def library():
    of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})


PARTS = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "'", "'l", "l", "'re", "1", "23", "é", "日本", "😀", "!", "...", "\t", " ", "\x1c", "\r\n", "aaaa", "<|endoftext|>"]


@pytest.mark.parametrize("leaves", [(16, 4096), (1, 4), (2, 5), (3, 9)])
def test_tree_equals_library(ranks, library, monkeypatch, leaves):
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaves[0])
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", leaves[1])
    ranks.known.clear()
    rng = random.Random(leaves[0])
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcde", k=rng.randint(100, 2000))) for _ in range(40)] + [x * rng.randint(50, 900) for x in ("ab", "a", "ha", "tion", " ", "\n ", "!?", "'l") for _ in range(3)]
    for t in texts:
        ids = byte_bpe.encode_text(ranks, t)
        assert ids == library.encode_ordinary(t)
        assert byte_bpe.decode_ids(ranks, ids) == t.encode()


def test_tokens_that_merging_misses_are_taken_whole():
    own = byte_bpe.Ranks([bytes([i]) for i in range(256)] + [b"bc", b"ab", b"abc", b"xyzw"])
    assert own.whole == {b"xyzw": 259}
    theirs = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    for t in ("xyzw abcabc", "xyzw", " xyzw", "xyzwxyzw", "ab" * 9000 + "\nxyzw"):
        assert byte_bpe.encode_text(own, t) == theirs.encode_ordinary(t)


def test_byte_bpe(spark, ranks, library):
    rng = random.Random(6)
    rows = [(i, words_of(rng, rng.randint(0, 300)), "en") for i in range(30)] + [(50, None, None), (51, "", "en"), (None, "x y", "en"), (52, "a" * 100_000, "en"), (53, "日本語 é́ 😀", "fr")]
    rows += rows[3:6] + [(54, words_of(rng, 30_000), "en")]
    docs = frame_of(spark, rows)

    def digests(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert Counter(map(tuple, byte_bpe.round_trip(docs, ranks).collect())) == Counter(digests(i, t) for i, t, _ in rows)
    ids = byte_bpe.encode(docs.drop("ids"), ranks)
    assert ids.columns[-1] == "ids" and "text" not in ids.columns
    back = byte_bpe.decode(ids, ranks).select("doc_id", "text").collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t, _ in rows)
    assert byte_bpe.round_trip(spark.createDataFrame([], DOC), ranks).collect() == []


def tied_rows():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "de", None, "und"])
        text = " ".join(rng.choices(["New", "york", "city", "hall.", "of,the", "A\tb", "ça", "x:y", "Straße\n", "one", "two", "three"], k=rng.randint(0, 60)))
        rows.append((i if i % 9 else None, text if i % 13 else None, lang))
    phrase = "in the middle of the night "
    return rows + [(1000 + i, phrase * (1 + i % 3), "en") for i in range(60)] + rows[:20] + [(2000, "word " * 20_000, "fr")]


@pytest.mark.parametrize("head", [collocations.HEAD, 12, 0])
def test_collocations(spark, head, monkeypatch):
    monkeypatch.setattr(collocations, "DENSE", 50)
    rows = tied_rows()
    want = by_sql([(i, t, la, "src0", 0) for i, t, la in rows], collocations.oracle())
    assert len(want) > 50
    got = collocations.collocations(frame_of(spark, rows), head=head)
    assert Counter((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()) == want


def test_collocations_of_none(spark):
    for none in ([], [(1, None, None), (2, "", "en"), (3, "a few words only", "en")]):
        assert collocations.collocations(spark.createDataFrame([(i, t, la, None, None) for i, t, la in none], DOC)).collect() == []


def test_a_top_that_ties_cut(spark):
    rows = [(i, "d c. b a. f e. h g", "en") for i in range(40)]
    got = collocations.collocations(frame_of(spark, rows), top=2).collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "b a", 1_000_000), (2, "d c", 1_000_000)]


def test_tiles_sum_like_a_counter():
    rng = random.Random(1)
    tiles, want = collocations.Tiles(), Counter()
    import numpy as np

    for _ in range(5):
        x, y = (np.array([int(rng.paretovariate(0.4)) % 6000 for _ in range(60_000)]) for _ in "xy")
        tiles.add(x, y)
        want.update(zip(x.tolist(), y.tolist()))
    assert tiles.dense and dict(zip(zip(*(v.tolist() for v in tiles.sums()[:2])), tiles.sums()[2].tolist())) == want


def test_letters_of_every_plane_count_and_marks_alone_do_not(spark):
    rng = random.Random(3)
    rows = [(i, words_of(rng, 60), "en") for i in range(20)] + [(100 + i, " ".join("".join(chr(0x30000 + rng.randrange(4)) for _ in range(5)) for _ in range(40)), "zh") for i in range(20)]
    rows += [(200, "\U00030000\U00030001\U00030002 \U00030003", None), (201, "\u0301\u0302 \u0300", None), (202, "12 .", None), (203, None, None), (204, "e\u0301t\u00e9", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame_of(spark, rows)).collect()}
    assert got[200] == "zh" and got[201] == got[202] == got[203] == "und" and got[204] in ("en", "zh")
