"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Each record is a gzip member of its own whose extra field holds the member's length, so that a reader inflates the record's
headers alone, tests the pushed-down predicates on them, and steps over an unwanted payload without inflating it.
Files are reached through pyarrow's file systems, so a path may lie in any store they know; a partition is a run of whole files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from seamline.session import shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Column to header line; payload and payload_length are made from the block.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
#: Gzip member header with an extra field ("sl": compressed length, length), and a fixed date.
_GZIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
_DATE = "2000-01-01T00:00:00Z"
#: Records of equal payload under this many bytes are all written in full.
REVISIT_FROM = 1000
_FILE_BYTES = 64 << 20


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = len(_GZIP) + 2 + 12 + len(body) + 8
    return _GZIP + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header value: what would end its line is percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def encode_record(row: dict) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP headers (with the payload's length) and leaves the payload out."""
    payload = bytes(row["payload"] or b"") if row["record_type"] != "revisit" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Date: {_DATE}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    lines += [f"{h}: {'sha1:' if c == 'payload_digest' else ''}{_clean(row[c])}" for c, h in HEADERS.items() if row[c] is not None]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n")


def _wanted(headers: dict, tests: list[tuple[str, frozenset | None]]) -> bool:
    return all((headers[c] is not None) if values is None else headers[c] in values for c, values in tests)


def _parsed(head: bytes) -> tuple[dict, int]:
    """(headers by column, block length) of a record's header lines; names are matched in any case, folded lines are joined."""
    lines: dict[str, str] = {}
    for x in re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()[1:]:
        name, _, value = x.partition(":")
        lines.setdefault(name.strip().lower(), value.strip())
    row = {c: (_plain(lines[h.lower()]) if h.lower() in lines else None) for c, h in HEADERS.items()}
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
    return row, int(lines.get("content-length") or 0)


class _Bytes:
    """What a plain file holds from ``at`` on, or its gzip members inflated one after another; only what is asked for stays in memory."""

    def __init__(self, f, at: int, packed: bool):
        f.seek(at)
        self.f, self.packed, self.held, self.z, self.raw = f, packed, b"", None, b""

    def _more(self) -> bool:
        if not self.packed:
            piece = self.f.read(1 << 16)
        else:
            self.raw = self.raw or self.f.read(1 << 16)
            self.z = self.z or zlib.decompressobj(31)
            piece = self.z.decompress(self.raw, 1 << 18) if self.raw else b""
            used, self.raw = self.raw, self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.z = None if self.z.eof else self.z
            if used and not piece:
                return True
        self.held += piece
        return bool(piece)

    def until(self, mark: re.Pattern) -> bytes | None:
        """The bytes before ``mark``, which is passed; None at the end."""
        start = 0
        while not (m := mark.search(self.held, start)):
            start = max(0, len(self.held) - 4)
            if not self._more():
                return None
        out, self.held = self.held[: m.start()], self.held[m.end() :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes; without ``keep`` they are passed over, in a plain file without reading them."""
        out = bytearray()
        while n:
            if not self.held:
                if not keep and not self.packed:
                    self.f.seek(self.f.tell() + n)
                    break
                if not self._more():
                    raise ValueError("archive ends inside a record")
                continue
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if keep:
                out += piece
        return bytes(out)


_BLANK = re.compile(rb"\r?\n\r?\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)")


def _any_records(f, at: int, packed: bool, tests: list, payload: bool) -> Iterator[tuple[dict, bytes | None, int | None]]:
    """As ``decode_records``, of an archive by any writer, record after record: the block of an unwanted one is passed over."""
    stream = _Bytes(f, at, packed)
    while (head := stream.until(_BLANK)) is not None:
        if not head.strip():
            continue
        row, size = _parsed(head.lstrip())
        if not _wanted(row, tests):
            stream.take(size, keep=False)
            continue
        block = stream.take(size, keep=payload or row["record_type"] == "revisit" or size < 1 << 16)
        http = _BLANK.search(block) if block.startswith(b"HTTP/") else None
        body = block[http.end() :] if http else block
        n = len(body) if block or not size else None
        if row["record_type"] == "revisit":
            told = _LENGTH.search(block)
            n = int(told[1]) if told else None
        yield row, body if payload and row["record_type"] != "revisit" else None, n


def decode_records(f, tests: list[tuple[str, frozenset | None]], payload: bool, packed: bool = True) -> Iterator[tuple[dict, bytes | None, int | None]]:
    """(headers by column, payload or None, payload length) of each record that passes ``tests``; ``f`` is a seekable file.

    Members with a length field are stepped over unread; from the first one without it on, and in plain files, records follow one
    another. There the payload's length is that of the block after its HTTP headers, null if the block was passed over.
    """
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        start = f.read(24)
        if not packed or start[:4] != _GZIP[:4] or start[12:14] != b"sl":
            yield from _any_records(f, at, packed, tests, payload)
            return
        length = struct.unpack("<I", start[16:20])[0]
        z, raw, left = zlib.decompressobj(-15), b"", length - 24
        while raw.count(b"\r\n\r\n") < 2 and left > 0:  # WARC headers and HTTP headers only
            piece = f.read(min(1024, left))
            left -= len(piece)
            raw += z.decompress(piece)
        head, _, rest = raw.partition(b"\r\n\r\n")
        row, _ = _parsed(head)
        if _wanted(row, tests):
            http = rest.partition(b"\r\n\r\n")[0]
            n = int(_LENGTH.search(http)[1])
            body = None
            if payload and row["record_type"] != "revisit":
                if left:
                    rest += z.decompress(f.read(left))
                body = rest[len(http) + 4 : len(http) + 4 + n]
            yield row, body, n
        at += length


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, per_task: int):
        self.path, self.payload, self.per_task, self.tests = path, payload, per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and not-null tests of header columns are done here; others go back to Spark."""
        for x in filters:
            column = x.attribute[0] if hasattr(x, "attribute") and len(x.attribute) == 1 else None
            if column in HEADERS and isinstance(x, EqualTo):
                self.tests.append((column, frozenset([x.value])))
            elif column in HEADERS and isinstance(x, In):
                self.tests.append((column, frozenset(x.value)))
            elif column in HEADERS and isinstance(x, IsNotNull):
                self.tests.append((column, None))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        """Whole files, gathered up to ``per_task`` bytes."""
        system, path = fs.FileSystem.from_uri(self.path)
        files = sorted((x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith((".warc.gz", ".warc"))), key=lambda x: x.path)
        out, now, total = [], [], 0
        for x in files:
            if now and total + x.size > self.per_task:
                out.append(_Files(tuple(now)))
                now, total = [], 0
            now.append(x.path)
            total += x.size
        return [*out, _Files(tuple(now))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for row, body, n in decode_records(f, self.tests, self.payload, path.endswith(".gz")):
                    rows.append((*(row[c] for c in HEADERS), n, body))
                    held += len(body or b"")
                    if len(rows) == 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@dataclass
class _Written(WriterCommitMessage):
    paths: tuple[str, ...]


class _Writer(DataSourceWriter):
    """Each task attempt writes files under names of its own in _temporary; the commit moves those of the attempts that count."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        system, path = fs.FileSystem.from_uri(self.path)
        temporary = f"{path}/_temporary/{self.job}"
        system.create_dir(temporary, recursive=True)
        paths, out, size = [], None, 0
        for row in iterator:
            if out is None or size > _FILE_BYTES:
                if out:
                    out.close()
                paths.append(f"{temporary}/{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(paths[-1], compression=None), 0
            size += out.write(encode_record(row.asDict())) or 0
        if out:
            out.close()
        return _Written(tuple(paths))

    def commit(self, messages) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for x in m.paths if m else ():
                system.move(x, f"{path}/{x.rpartition('/')[2]}")
        self._clear(system, path)

    def abort(self, messages) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, system, path: str) -> None:
        if system.get_file_info(f"{path}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary/{self.job}")


class WarcDataSource(DataSource):
    """Archives by any writer, .warc.gz or .warc. Options: path (a URI); payload ("false": headers only, payload stays null); taskbytes (compressed bytes of files per task)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("taskbytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def capture_plan(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as records: of equal payloads of REVISIT_FROM bytes or more the largest page_id is the response.

    Null html is an empty payload. A null page_id counts as the smallest; rows that share the largest page_id are all responses.
    The digests are aggregated before the shuffle (hot payloads collapse in each task), then joined on the digest, where
    adaptive execution can split a skewed one.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    light = pages.select(F.col("page_id").cast("long"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("p"))
    first = light.where(F.octet_length("p") >= REVISIT_FROM).select("page_id", F.sha1("p").alias("payload_digest")).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    large = F.col("payload_length") >= REVISIT_FROM  # smaller payloads, which may all be equal, don't join
    alone = rows.where(~large).withColumn("original", F.lit(None).cast("long"))
    joined = rows.where(large).join(first.where("n > 1").drop("n"), "payload_digest", "left").unionByName(alone)
    revisit = F.coalesce(F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("original"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI in the store that Spark takes it to be in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(_qualified(records.sparkSession, path))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``; filters on header columns are pushed down to the reader."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(_qualified(spark, path))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to): responses from their payload as read, revisits from
    their headers. Empty table: no rows. Extra columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(capture_plan(pages), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.nullif(page(c), F.lit("")).cast("long")
    full = read_warc(spark, path).where("record_type = 'response'").select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(again)
