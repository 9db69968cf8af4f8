"""The llm operators against brute-force versions, round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from seamline.llm import edit_fingerprint, html_text, language, mixing, minhash, pieces, pii, quality, suffix_dedup, warc
from seamline.llm.queries import MODEL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnop", k=3 + i % 6)) for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty, ties, repeated rows, one long text, a clashing extra column."""
    rng = random.Random(5)
    base = [words_of(rng, rng.randint(30, 160)) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "src0") for i in range(5)]
    for i in range(10):
        w = base[i].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), "en", "src0"))
    passage = words_of(rng, 40)
    rows += [(300 + i, f"{words_of(rng, 30)} {passage} {words_of(rng, 30)}", "de", "src1") for i in range(6)]
    rows += [(400, None, None, None), (401, "", "en", "src0"), (402, "   ", "en", "src0"), (403, "One two", "en", "src0"), (404, "one TWO", "en", "src0"), (405, words_of(rng, 6000), "en", "src2")]
    rows += [(406, base[3], "en", "src0")] * 2 + [(407, "é ü 日本 ﬁ 😀 \n\t x", "fr", "src0")]
    return [(i, t, a, b, len(t or "")) for i, t, a, b in rows]


@pytest.fixture(scope="module")
def frame(spark, docs):
    from pyspark.sql import functions as F

    return spark.createDataFrame(docs, DOC).withColumn("anchor", F.lit("x")).withColumn("bucket", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_fingerprints(spark, frame, docs, empty):
    got = edit_fingerprint.compare_with_next(frame).collect()
    order = sorted(docs, key=lambda r: -r[0])
    text = [r[1] or "" for r in order]
    want = Counter((r[0], len(t), hashlib.sha256(edit_fingerprint.edited(t, n).encode()).hexdigest()) for r, t, n in zip(order, text, text[1:] + text[:1]))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[0] == prints[100] and prints[0] != prints[1]
    assert edit_fingerprint.likeness(prints[0], prints[200]) > 0.8 > 0.3 > edit_fingerprint.likeness(prints[0], prints[1])
    assert edit_fingerprint.compare_with_next(empty).count() == 0
    one = spark.createDataFrame(docs[:1], DOC)
    assert edit_fingerprint.compare_with_next(one).first()["near_next"] == 1
    pairs = {(r["a"], r["b"]) for r in edit_fingerprint.near_pairs(edit_fingerprint.fingerprint(frame)).collect()}
    assert sum((i, 200 + i) in pairs for i in range(10)) >= 8


def test_mixing_conserves_budgets(spark, frame, docs, empty):
    got = mixing.mix(frame.drop("anchor", "bucket"), mixing.corpus_domain(), mixing.corpus_weights(), budget=0.5).collect()
    n = lambda t: len(WORD.findall(t or ""))
    assert sum(r["n_taken"] for r in got) <= 0.5 * sum(n(r[1]) for r in docs)
    assert sum(r["n_taken"] for r in got) >= 0.5 * sum(n(r[1]) for r in docs) - 20
    seen = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert max(v for k, v in seen.items() if k[0] != 406) == 1
    assert mixing.mix(empty, mixing.corpus_domain(), mixing.corpus_weights()).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav>a</nav><article><h1>Head &amp; more</h1><p>First  <b>bold</b>\nline.<br>Next<p>Second, with commas, and so on.</article><footer>c</footer>", "Head & more First bold line. Next Second, with commas, and so on."),
        ("<div class='cookie-notice'>We use cookies, a lot.</div><main><p>Body text, longer than others.</p><aside>x</aside><section class='comments'><p>Nice!</p></section></main>", "Body text, longer than others."),
        ("<script>var a='<p>no</p>'</script><div id=content><p>Only this, really.<p>And this, too.</div><form>f</form>", "Only this, really. And this, too."),
        ("<article><p>cut off &am", "cut off &am"),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page) == want


def test_html_table(spark):
    p = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>Hello, world.</p>", "x"), (2, None, "<p>Hello, world.</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract(p).collect()) == ["", "Hello, world.", "Hello, world."]
    assert html_text.extract(p.limit(0)).count() == 0


def test_language(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "the and of", None), (None, "the", "en")], "doc_id long, text string, lang string")
    by_id = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in by_id.values())
    assert language.identify(empty).count() == 0


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_components(docs):
    sets = {}
    for r in docs:
        w = WORD.findall(low(r[1]))
        sets[r[0]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = sets[a], sets[b]
            if p and q and 100 * len(p & q) >= 75 * len(p | q):
                u, v = sorted((find(a), find(b)))
                top[v] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(frame, docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_components(docs)
    assert minhash.near_duplicates(empty).count() == 0


def test_hovering_group(spark):
    """A group whose members are near the threshold: links beyond the bucket's first member must not be lost."""
    rng = random.Random(3)
    base = words_of(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_components(rows)


def test_registers_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    j, _ = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert abs(j[0] - true) < 0.1


def test_pieces(spark, frame, docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    p = pieces.read_model(spark, MODEL)
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL.removeprefix("file://"))
    texts = [r[1] or "" for r in docs] + ["a  b", " a", "x" * 300 + "hello" * 50, "日本語 😀😀 !!!!" + "=" * 99, " " * 77 + "a"]
    ids, at = pieces.encode_texts(p, texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.encode(t) for t in texts]
    assert pieces.decode_ids(p, ids, at) == [t.encode() for t in texts]
    rows = pieces.round_trip(frame, p).collect()
    assert all(r["same"] for r in rows) and len(rows) == len(docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(frame.select("doc_id", "text"), p), p).collect()}
    assert back == {r[0]: r[1] or "" for r in docs}
    assert pieces.round_trip(empty, p).count() == 0


def test_relational_lattice_is_the_viterbi_path(spark):
    table = [(" a", 0, -1.0), ("b", 1, -1.5), ("c", 2, -1.5), ("bc", 3, -2.0), (" ab", 4, -2.2), ("a", 5, -3.0), (" ", 6, -4.0), ("abc", 7, -9.0)]
    df = spark.createDataFrame(table, "piece string, id int, score double")
    score = {t: (i, s) for t, i, s in table}

    def best(w):
        if not w:
            return 0.0, []
        ways = []
        for k in range(1, len(w) + 1):
            if w[:k] in score or k == 1:
                i, s = score.get(w[:k], (99, -20.0))
                rest = best(w[k:])
                ways.append((s + rest[0], [i, *rest[1]]))
        return max(ways)

    words = [" abc", " abcbc", " ", "zab", " a c", "bcbcb"]
    got = {r["word"]: (r["score"], list(r["ids"])) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string"), df, 4, 99, -20.0).collect()}
    assert set(got) == set(words)
    for w in words:
        assert got[w][0] == pytest.approx(best(w)[0])


def test_relational_merges_are_the_librarys_ids(spark, docs):
    """Words with and without a leading space, of bytes without pieces, and too long for a mask."""
    sentencepiece = pytest.importorskip("sentencepiece")
    p = pieces.read_model(spark, MODEL)
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL.removeprefix("file://"))
    words = {w for r in docs for w in (r[1] or "").split(" ") if w} | {"x" * 300 + "hello" * 50, "日本語", "😀é😀", "=" * 61, "=" * 62, "a" * 63}
    rows = [(f" {w}",) for w in words] + [(None,), ("",), (" the",), (" the",)]
    got = {r["word"]: list(r["ids"]) for r in pieces.merge_words(spark.createDataFrame(rows, "word string"), p).collect()}
    assert got == {f" {w}": own.encode(w) for w in words | {"the"}}
    assert pieces.merge_words(spark.createDataFrame([], "word string"), p).count() == 0


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality(spark, frame, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    extra = [(900, "a b c\n\na b c\n a b c\r\na b c x a b c", "en", "s", 0)]
    rows = quality.quality(frame.select("doc_id", "text").union(spark.createDataFrame(extra, DOC).select("doc_id", "text")), labels).collect()
    text = {r[0]: r[1] for r in docs + extra}
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(text[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.quality(empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("n", [6, 40, 240])
def test_quality_with_trusted_sets_of_any_size(spark, n):
    rng = random.Random(2)
    junk_words = ["".join(random.Random(9000 + i).choices("qrstuvwxyz", k=5)) for i in range(400)]
    good = [(i, words_of(rng, 120)) for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choices(junk_words, k=120))) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(i, 0, 0) for i, _ in junk[:5]], "doc_id long, quality int, toxic int")
    rows = quality.quality(spark.createDataFrame(good + junk, "doc_id long, text string").repartition(3), labels).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert not any(r["base_failed"] for r in rows) and not kept & {i for i, _ in junk}
    # an unseen good text lies under all n trusted ones with probability 1 / (n + 1)
    assert len({i for i in range(n, 300)} - kept) <= (300 - n) * 3 / n and len({i for i in range(n)} - kept) <= 1


def brute_repeats(docs):
    seen, out = {}, {}
    for i, t in sorted({(r[0], r[1] or "") for r in docs}):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.setdefault(w, i)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("limits", [(suffix_dedup.HOT, 1 << 16), (1, 3)])
def test_repeated_bytes(frame, docs, empty, limits):
    more = [(500, "ab" * 300, "en", "s", 0), (501, "x" * 99, "en", "s", 0), (502, "x" * 99 + "y", "en", "s", 0), (503, "z" + "x" * 99 + "y" + "ab" * 60, "en", "s", 0)]
    df = frame.select("doc_id", "text").union(frame.sparkSession.createDataFrame(more, DOC).select("doc_id", "text"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(df, *limits).collect()}
    assert got == brute_repeats(docs + more)
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    start = np.arange(700)
    segment = np.repeat([0, 1], [300, 400])
    order = suffix_dedup.suffix_sort(data, suffix_dedup.prefix_hashes(data), start, segment)
    s = [data[i : i + 100].tobytes() for i in range(700)]
    assert [s[i] for i in order] == sorted(s[:300]) + sorted(s[300:])


def test_warc(spark):
    big, small = "<p>" + "x" * 1200, "<p>tiny"
    rows = [(1, "u1", big, 0), (2, "u%2\r\nx", big, 0), (3, None, small, 0), (4, "u4", small, 0), (5, "u5", None, 0), (6, "u6", big + "é", 0), (7, "u7", big, 0), (7, "u7", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        old = h == big and i != 7
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if old else "response", 7 if old else None)] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_pushdown(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>" + "y" * 2000 + str(i % 2)) for i in range(6)], "page_id long, url string, html string")
    warc.write_warc(warc.capture_plan(pages), f"file://{tmp_path}/a")
    df = warc.read_warc(spark, f"file://{tmp_path}/a", payload=False).where("record_type = 'revisit' and target_uri in ('u0', 'u1')")
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["target_uri"] for r in df.collect()) == ["u0", "u1"] and all(r["payload"] is None for r in df.collect())
    assert sorted(r["target_uri"] for r in warc.read_warc(spark, f"file://{tmp_path}/a").where("payload is not null").collect()) == ["u4", "u5"]


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_pii(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.ORDER[x[0]]))


def test_pii(spark, empty):
    rng = random.Random(11)
    texts = ["a@b.c_d@e.fg", "x@y", "@a.b", "1.2.3.4.5.6.7.8", "300.1.1.1 0001.2.3.4", "4111 1111-1111 1111", "+1 (386) 555-5010.", "++1 22 333 4444", "é a.b+c@d-e.f. 1.2.3.4", None, ""]
    texts += ["".join(rng.choices("a1.@+- 4(", k=60)) for _ in range(400)]
    texts += ["a" * 50_000 + "@", "1" * 50_000, "." * 20_000]
    for t in texts:
        assert pii.find(t)[0] == brute_pii(t or "") or len(t) > 1000
    found = pii.find("IBAN GB82 WEST 1234 5698 7654 32, api token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff and GB82 WEST 1234 5698 7654 33")[1]
    assert [k for k, _, _ in found] == ["iban", "secret"]
    assert pii.redact("mail a@b.cd or +1 (386) 555-5010.") == "mail [EMAIL] or [PHONE]."
    df = spark.createDataFrame([(1, "a@b.cd", 3), (None, None, 4)], "doc_id long, text string, spans int")
    rows = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert rows[1]["spans"] == "email:0:6" and rows[1]["n_spans"] == 1 and rows[None]["n_spans"] == 0 and rows[1]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest() and rows[None]["n_email"] == 0
    assert pii.personal_data(empty).count() == 0


def test_pipeline(spark, tmp_path, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t if t is None else f"{t} mail me at someone@example.org", a, b, n) for i, t, a, b, n in docs]
    spark.createDataFrame(rows, DOC).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, f"file://{tmp_path}").cache()
        assert d.columns == corpus_pipeline.COLUMNS
    epochs = Counter(r["doc_id"] for r in d.collect())
    ids = set(epochs)
    assert max(epochs.values()) <= 2 and not ids & {100, 101, 102, 103, 104, 400, 401, 402, 406} and all("@" not in r["text"] and len(r["text"]) == r["n_chars"] for r in d.collect())
    assert all(r["same"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())


def test_pipeline_gives_the_ids(spark, frame, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.to_pieces(spark, frame, "").collect()
    want = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(frame.select("doc_id", "text"), pieces.read_model(spark, MODEL)).collect()}
    assert len(rows) == len(docs) and all(list(r["ids"]) == want[r["doc_id"]] and len(r["ids"]) == r["n_pieces"] for r in rows)
    digest = lambda ids: hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    assert all(digest(r["ids"]) == r["ids_sha256"] for r in rows)


def test_near_pairs_of_large_buckets(spark):
    """One band of one bit: large buckets whose members must all be compared; brute force over those that share a bucket."""
    rng = random.Random(8)
    bases = [words_of(rng, 60) for _ in range(3)]
    texts = []
    for i in range(150):
        w = bases[i % 3].split()
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts.append(" ".join(w))
    prints = edit_fingerprint.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    p = {}
    for r in prints.collect():
        p.setdefault(r["fingerprint"], r["doc_id"])
    p = {i: f for f, i in p.items()}
    want = {(a, b) for a in p for b in p if a < b and edit_fingerprint.likeness(p[a], p[b]) >= 0.75}
    got = {(r["a"], r["b"]) for r in edit_fingerprint.near_pairs(prints, bands=40, width=4).collect()}
    assert len(want) > 1000 and got <= want and len(want - got) <= 1e-3 * len(want)
