"""Null and repeated ids, hot groups and grids of small cells, against brute force or the operator's SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from seamline.llm import minhash, mixing, suffix_dedup
from tests.llm.test_llm import DOC, brute_components, words_of


def by_sql(rows, sql):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    return Counter(con.execute(sql).fetchall())


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "null and equal"])
def test_mixing_of_tied_rows(spark, kind):
    rng = random.Random(4)
    texts = [words_of(rng, 100) for _ in range(10)]
    rows = [(None if "null" in kind else 7 if kind != "x" else i, texts[0] if "equal" in kind else t, "en", "src0", 0) for i, t in enumerate(texts)]
    got = mixing.mix(spark.createDataFrame(rows, DOC).repartition(3), mixing.corpus_domain(), mixing.corpus_weights(), budget=0.5).collect()
    assert sum(r["n_taken"] for r in got) == 500


def test_mixing_equals_its_sql_on_ties(spark, docs_with_ties):
    got = mixing.op2_rows(spark.createDataFrame(docs_with_ties, DOC).repartition(3)).collect()
    assert Counter(map(tuple, got)) == by_sql(docs_with_ties, mixing.oracle())


@pytest.fixture(scope="module")
def docs_with_ties():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        doc_id = None if i % 3 == 0 else i % 40
        text = None if i % 31 == 0 else words_of(rng, rng.randint(0, 120)) if i % 4 else "the same words again"
        rows.append((doc_id, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src20", None]), len(text or "")))
    return rows


def test_near_duplicates_in_a_grid_of_cells(spark, monkeypatch):
    """Two families whose first member is no kin of most others: probes and members meet in many cells."""
    monkeypatch.setattr(minhash, "CELL_ITEMS", 300)
    rng = random.Random(12)
    base = words_of(rng, 90).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(13)
    a, b, c = (words_of(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (5, None), (3, a), (4, b), (6, c), (None, a), (None, a), (7, c), (8, "")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 3, False): 3, (3, 3, True): 1, (4, 3, False): 1, (6, 6, True): 1, (7, 6, False): 1, (8, 8, True): 1, (None, None, True): 2})


def brute_repeats(rows):
    """(id, n_bytes, n_removed, n_spans, sha) of each row; texts of one id are told apart and ordered as the operator does it."""
    seen, out = {}, Counter()
    for i, _, t in sorted({(-(1 << 63) if i is None else i, u, t or "") for i, u, t in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen[w] = 1
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limits", [(suffix_dedup.HOT, 1 << 16, False), (suffix_dedup.HOT, 1 << 16, True), (2, 5, False), (2, 5, True)])
def test_repeated_bytes_of_null_and_repeated_ids(spark, limits):
    """2,000 null ids and an id of 200 texts: no span of one text is cut from another."""
    from pyspark.sql import functions as F

    rng = random.Random(21)
    passages = [words_of(rng, 30) for _ in range(5)]
    rows = []
    for i in range(2400):
        t = f"{words_of(rng, 6)} {rng.choice(passages) if i % 3 == 0 else ''} {words_of(rng, rng.randint(1, 40))}"
        rows.append((None if i < 2000 else 7 if i < 2200 else i, "ab" * rng.randint(50, 400) if i % 40 == 0 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    told = [(r[0], r[1], r[2]) for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect()]
    got = suffix_dedup.repeated_bytes(df, *limits).distinct().collect()
    assert Counter((-(1 << 63) if r[0] is None else r[0], *r[1:]) for r in got) == Counter(set(brute_repeats(told)))


def test_contexts_of_one_hash_are_compared_by_bytes(monkeypatch):
    """With every context hash made equal, texts that only share an anchor must not be taken for repeats."""
    import numpy as np
    import pyarrow as pa

    plain = suffix_dedup.window_anchors
    monkeypatch.setattr(suffix_dedup, "window_anchors", lambda *a: (*plain(*a)[:5], np.full(len(plain(*a)[0]), 5, np.uint64)))
    rng = random.Random(2)
    shared = words_of(rng, 9)[:60]
    texts = sorted(f"{words_of(rng, 20)} {shared} {words_of(rng, 20)}" for _ in range(9)) + ["q " * 100]
    texts += [texts[0], texts[3]]
    b = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "u": [0] * len(texts), "text": texts})
    found = pa.Table.from_batches(list(suffix_dedup._sift(iter([pa.Table.from_batches(suffix_dedup._find_anchors(iter([b.slice(k, 1) for k in range(len(b))]))).sort_by([(c, "ascending") for c in ("anchor", "context", "doc", "u", "place")]).combine_chunks().to_batches()[0]]), 100, 1000, True)))
    marks = {}
    for r in found.to_pylist():
        marks.setdefault(r["doc"], []).append({k: r[k] for k in ("anchor", "context", "place", "kind")})
    docs = sorted(marks)
    cut = pa.RecordBatch.from_pydict({"doc": docs, "u": [0] * len(docs), "text": [texts[d] for d in docs], "found": [marks[d] for d in docs]})
    t = pa.Table.from_batches(suffix_dedup._cut_contexts(iter([cut])))
    t = t.append_column("again", pa.array([k == suffix_dedup.AGAIN for k in t.column("kind").to_pylist()]))
    t = t.sort_by([(c, "ascending") for c in ("anchor", "again", "doc", "u", "place")]).drop_columns("again").combine_chunks()
    got = {}
    for r in pa.Table.from_batches(suffix_dedup._sort_contexts(iter(t.to_batches()))).to_pylist():
        got.setdefault(r["doc"], set()).update(range(r["first"], r["last"] + 1))
    seen, want = set(), {}
    for d, text in enumerate(texts):
        for k in range(len(text) - 99):
            if (w := text[k : k + 100]) in seen:
                want.setdefault(d, set()).add(k)
            seen.add(w)
    assert want and got == want


LONG = "A long paragraph, with commas, and more words in it than any menu has."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content has-sidebar"><article><p>Some text, here.</p></article></div>', "Some text, here."),
        ('<div id="page" class="no-comments"><article><p>Some text, here.</p><p>More, there.</p></article><div class="comments"><p>I like it, really.</p></div></div>', "Some text, here. More, there."),
        ('<p>a <a title="x>b</a> c', "a b c"),
        (f'<div class="a1"><a href="/">Home</a> <a href="/x">News</a> <a href="/y">About</a></div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div>', f"Title {LONG} {LONG}"),
        (f"<article><h1>Head</h1><p>{LONG}</p><ul><li>First of a list</li><li>Second of it</li></ul><p>{LONG}</p></article>", f"Head {LONG} First of a list Second of it {LONG}"),
    ],
)
def test_tag_path_ratios_decide(page, want):
    from seamline.llm import html_text

    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<font>" * 100_000 + "x", "<font>" * 100_000 + "<p>x" * 50_000, "<font><div>" * 50_000 + "</font>" * 50_000 + "x", '<div class="">' * 100_000 + "x" + "</div>" * 100_000])
def test_deeply_nested_pages(page):
    import tracemalloc

    from seamline.llm import html_text

    tracemalloc.start()
    assert html_text.main_text(page).startswith("x")
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_fingerprints_of_null_ids(spark):
    """Null ids are followed by one another in one order, then by the largest id; every text has one follower."""
    from seamline.llm import edit_fingerprint

    rng = random.Random(31)
    rows = [(None if i % 2 else i, words_of(rng, 5 + i % 9)) for i in range(300)] + [(None, "same text here")] * 4
    got = edit_fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    cuts = {hashlib.sha256(edit_fingerprint.edited(t, n).encode()).hexdigest() for _, t in rows for _, n in rows}
    assert all(r["edited_sha256"] in cuts for r in got)
    ids = [t for i, t in sorted((r for r in rows if r[0] is not None), reverse=True)]
    want = [hashlib.sha256(edit_fingerprint.edited(t, n).encode()).hexdigest() for t, n in zip(ids, ids[1:])]
    assert [r["edited_sha256"] for r in sorted((r for r in got if r["doc_id"] is not None), key=lambda r: -r["doc_id"])][:-1] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN GB82 WEST 1234 5698 7654 32 2024", [("iban", 5, 32)]),
        ("iban: DE89370400440532013000.", [("iban", 6, 28)]),
        ("IBAN GB82 WEST 1234 5698 7654 33", []),
        ("GB82 WEST 1234 5698 7654 32 Please pay", [("iban", 0, 27)]),
        ("IBAN ZZ82 WEST 1234 5698 7654 32", []),
    ],
)
def test_account_numbers_have_their_countrys_length(text, want):
    from seamline.llm import pii

    assert [s for s in pii.find(text)[1] if s[0] == "iban"] == want


def test_archives_of_other_writers(spark, tmp_path):
    """Plain files, one member a record without length fields, all records in one member, headers in any case."""
    import gzip

    from seamline.llm import warc

    def record(kind, uri, block, **more):
        extra = "".join(f"{k}: {v}\r\n" for k, v in more.items())
        return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:{uri}-{kind}>\r\nWARC-Target-URI: http://{uri}/\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    def http(n):
        return b"HTTP/1.1 200 OK\r\ncontent-length: 7\r\n\r\n" + bytes([65 + n % 26]) * (n * 70_000)

    for k, name in enumerate(("plain.warc", "members.warc.gz", "whole.warc.gz")):
        parts = [record("warcinfo", f"i{k}", b"software: x")]
        for n in range(3):
            parts += [record("request", f"h{k}{n}", b"GET / HTTP/1.1\r\n\r\n"), record("response", f"h{k}{n}", http(n), **{"WARC-Payload-Digest": "sha1:ABC"})]
        parts.append(record("revisit", f"v{k}", b"HTTP/1.1 200 OK\r\nContent-Length: 55\r\n\r\n", **{"WARC-Refers-To": "<urn:h>"}))
        data = b"".join(parts) if name != "members.warc.gz" else b"".join(map(gzip.compress, parts))
        (tmp_path / name).write_bytes(gzip.compress(data) if name == "whole.warc.gz" else data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter(r["record_type"] for r in rows) == {"warcinfo": 3, "request": 9, "response": 9, "revisit": 3}
    assert all(r["payload_length"] == 55 and r["payload"] is None and r["refers_to"] == "<urn:h>" for r in rows if r["record_type"] == "revisit")
    for r in rows:
        if r["record_type"] == "response":
            n = int(r["target_uri"][9])
            assert bytes(r["payload"]) == http(n)[38:] and r["payload_length"] == n * 70_000 and r["payload_digest"] == "ABC"
    only = warc.read_warc(spark, str(tmp_path), payload=False).where("record_type = 'response'").collect()
    assert len(only) == 9 and all(r["payload"] is None for r in only)
