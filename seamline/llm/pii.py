"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, and the further kinds with their context words.
# EMAIL is [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ cut at the @, and IP starts at the first digit of a run only:
# the same matches, but linear in texts that are one long run.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
# The lengths of account numbers by country (ISO 13616).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[A-Za-z0-9_\-]{24,128})(?![A-Za-z0-9])")
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax", "insurance"),
    "secret": ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "bearer", "authorization"),
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: A kind's score without context, and what a context word within WINDOW characters before it adds; kept from THRESHOLD on.
PRIOR = {"iban": 0.8, "ssn": 0.3, "secret": 0.1}
CONTEXT_GAIN, WINDOW, THRESHOLD = 0.5, 40, 0.5

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616 check: move four characters to the end, letters to numbers from 10, remainder 1."""
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds: leftmost non-overlapping matches of each; failing ones are dropped and not tried again."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, free := m.end()))
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _score(kind: str, text: str, start: int) -> float:
    near = text[max(0, start - WINDOW) : start].lower()
    near = re.findall(r"[a-z_]+", near)
    return PRIOR[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind])


def _iban(text: str, start: int) -> int | None:
    """End of the account number at ``start``: as many letters and digits as its country has, single spaces between them, checked by mod-97."""
    left, at, found = IBAN_LENGTH.get(text[start : start + 2], 0), start, []
    while left and at < len(text):
        if text[at] in ALNUM:
            found.append(text[at])
            left -= 1
        elif text[at] != " " or text[at - 1] == " ":
            return None
        at += 1
    whole = bool(found) and not left and not (at < len(text) and text[at].isalnum())
    return at if whole and mod97("".join(found)) else None


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further kinds that score THRESHOLD or more and overlap no base span; of two that overlap the one listed first stays."""
    taken, out = sorted((s, e) for _, s, e in base), []
    reach = list(itertools.accumulate((e for _, e in taken), max))  # base kinds may overlap one another
    mine: list[tuple[int, int]] = []  # these never do

    def free(s: int, e: int) -> bool:
        k, m = bisect.bisect_left(taken, (e,)), bisect.bisect_left(mine, (e,))
        return not (k and reach[k - 1] > s) and not (m and mine[m - 1][1] > s)

    for kind, rule in (("iban", IBAN), ("ssn", SSN), ("secret", SECRET)):
        for m in rule.finditer(text):
            found, start, end = m[0], m.start(), m.end()
            if kind == "iban" and (end := _iban(text, start)) is None:
                continue
            if kind == "secret" and not (re.search("[0-9]", found) and re.search("[A-Za-z]", found)):
                continue
            if _score(kind, text, start) >= THRESHOLD and free(start, end):
                out.append((kind, start, end))
                bisect.insort(mine, (start, end))
    return out


def find(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    key = lambda x: (x[1], ORDER[x[0]], x[2])
    base.sort(key=key)
    return base, sorted(base + added_spans(text, base), key=key)


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None) -> str | None:
    """Each span replaced by its kind in brackets; of overlapping spans the first by start, then the longest, is replaced and what it leaves of others goes with it."""
    if not text:
        return text
    spans, out, at = find(text)[1], [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for text in b.column("text").to_pylist():
            base, spans = find(text)
            kinds = [k for k, _, _ in base]
            row = (*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base), len(spans))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored) with counts, the digest of the base spans and all spans.

    A null text counts as empty; a null doc_id stays null; repeated rows give repeated results; an empty table gives none.
    Texts of any length are scanned whole. No shuffle: each row is scanned where it is read.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_report, SCHEMA)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [KIND]; all columns stay, null texts stay null."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([redact(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(clean, docs.schema)
