"""Stitch files: PEC records as expressions over ordered stitch tables, a reader and a writer for whole files."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.operators.stitch import COLOR, JUMP, STITCH, TRIM, bounds, in_order, shift_origin, with_block, with_runs

#: Fixed values of the file format.
JUMP_FLAG, TRIM_FLAG, REACH = 0x10, 0x20, 2047
LABEL_SIZE, TABLE_SIZE, HEAD_SIZE, STITCH_HEAD, THUMB_W, THUMB_H = 16, 463, 512, 20, 48, 38

#: Designs whose parts are Python objects at once; those objects are ten times as large as their batch.
PACK_DESIGNS = 16


def pec_hex(v: Column, flag: Column, force_long: Column) -> Column:
    """One coordinate: a byte for -64 to 63, else (or if forced) two, big-endian, with the flag above 12 bits."""
    long = F.lpad(F.hex(v.bitwiseAND(F.lit(0x0FFF)).bitwiseOR(F.lit(0x8000)).bitwiseOR(F.shiftleft(flag, 8))), 4, "0")
    return F.when(~force_long & v.between(-64, 63), F.lpad(F.hex(v.bitwiseAND(F.lit(0x7F))), 2, "0")).otherwise(long)


def le16_hex(v: Column) -> Column:
    """A saturated 16-bit number, little-endian."""
    h = F.lpad(F.hex(F.greatest(F.lit(-32768), F.least(F.lit(32767), v)).bitwiseAND(F.lit(0xFFFF))), 4, "0")
    return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))


def split_moves(s: DataFrame) -> DataFrame:
    """(design_id, seq, step, dx, dy, k, flag, long): each record's move, in steps of at most REACH an axis.

    Plain stitches within reach have no flag; longer ones and jumps are jumps; a trim cuts in its first step only. Positions start at the origin.
    """
    lag = lambda c: F.col(c) - F.lag(c, 1, 0).over(in_order())
    return in_steps(s.select("design_id", "seq", "k", lag("x").alias("dx"), lag("y").alias("dy")))


def in_steps(rows: DataFrame) -> DataFrame:
    """Moves (design_id, seq, k, dx, dy, ...) in steps, see ``split_moves``."""
    more = [c for c in rows.columns if c not in ("design_id", "seq", "k", "dx", "dy")]
    far = F.greatest(F.abs("dx"), F.abs("dy"))
    rows = rows.withColumn("long", (F.col("k") != STITCH) | (far > REACH)).withColumn("n", F.greatest(F.lit(1), F.ceil(far / REACH).cast("int")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n"))))
    upto = lambda c, i: F.signum(c) * F.least(F.abs(F.col(c)), F.lit(REACH) * i)
    part = lambda c: (upto(c, F.col("step")) - upto(c, F.col("step") - 1)).cast("int").alias(c)
    flag = F.when(~F.col("long"), 0).when((F.col("k") == TRIM) & (F.col("step") == 1), TRIM_FLAG).otherwise(JUMP_FLAG)
    return rows.select("design_id", "seq", "step", part("dx"), part("dy"), "k", flag.alias("flag"), "long", *more)


def color_markers(s: DataFrame) -> DataFrame:
    """(design_id, seq, marker) of the COLOR records: 2, 1, 2, ..."""
    return s.where(F.col("k") == COLOR).select("design_id", "seq", (2 - (F.row_number().over(in_order()) - 1) % 2).cast("int").alias("marker"))


def pec_deltas(s: DataFrame) -> DataFrame:
    """``split_moves`` with ``hex``, the record's bytes, its colour marker included, and their number."""
    n = F.sum(F.when((F.col("k") == COLOR) & (F.col("step") == 1), 1).otherwise(0)).over(Window.partitionBy("design_id").orderBy("seq", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return with_bytes(split_moves(s), n)


def with_bytes(steps: DataFrame, n: Column) -> DataFrame:
    """``steps`` with ``hex`` and ``n_bytes``, see ``pec_deltas``; ``n``: COLOR records up to and including each."""
    marker = F.when((F.col("k") == COLOR) & (F.col("step") == 1), F.concat(F.lit("FEB0"), F.lpad((2 - (n - 1) % 2).cast("string"), 2, "0"))).otherwise("")
    rows = steps.withColumn("hex", F.concat(marker, *[pec_hex(F.col(c), F.col("flag"), F.col("long")) for c in ("dx", "dy")]))
    return rows.withColumn("n_bytes", (F.length("hex") / 2).cast("int"))


def pes_blocks(s: DataFrame) -> DataFrame:
    """(design_id, run, chunk, kind, block, points): kind 1, the jump to a run's start; kind 0, its stitches, 1,000 points at most, each later chunk starting with the last point before it.

    Points are relative to the left and bottom edge of the design.
    """
    b = bounds(s).select("design_id", "min_x", "max_y", "height")
    rows = with_runs(with_block(s)).withColumn("before", F.lag(F.struct("x", "y")).over(in_order())).join(b, "design_id")
    p = lambda c: F.struct((c["x"] - F.col("min_x")).alias("x"), (c["y"] - F.col("max_y")).alias("y"))
    corner = F.struct(F.lit(0).alias("x"), (-F.col("height")).alias("y"))
    here = F.struct("x", "y")
    rows = rows.select("design_id", "seq", "k", "run", "block", p(here).alias("at"), F.when(F.col("before").isNotNull(), p(F.col("before"))).otherwise(corner).alias("frm"))
    # consecutive moves before a run count as one jump: from where the first of them left
    sewn = F.max((F.col("k") == STITCH).cast("int")).over(Window.partitionBy("design_id", "run"))
    rows = rows.withColumn("sewn", sewn == 1)
    start = rows.groupBy("design_id", "run", "sewn").agg(F.min(F.struct("seq", "at", "frm", "k")).alias("f"), F.max("block").alias("block"))
    w = Window.partitionBy("design_id").orderBy("run")
    start = start.withColumn("_new", F.coalesce(F.lag("sewn").over(w), F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(w))
    origin = F.first("f.frm").over(Window.partitionBy("design_id", "island").orderBy("run"))
    start = start.withColumn("origin", origin).where("sewn")
    jumps = start.select("design_id", "run", F.lit(-1).alias("chunk"), F.lit(1).alias("kind"), "block", F.array("origin", "f.at").alias("points"))
    body = rows.where("sewn").withColumn("i", F.row_number().over(Window.partitionBy("design_id", "run").orderBy("seq")) - 1)
    # a first record that is a STITCH starts its own run and is its first point twice
    lead = body.where((F.col("i") == 0) & (F.col("k") == STITCH))
    body = body.where("i > 0").withColumn("i", F.col("i") - 1).unionByName(lead.withColumn("i", F.lit(-1)))
    first = body.join(start.select("design_id", "run", F.col("f.at").alias("head"), (F.col("f.k") == STITCH).cast("int").alias("shift")), ["design_id", "run"])
    first = first.withColumn("i", F.col("i") + F.col("shift")).withColumn("chunk", F.floor(F.col("i") / 999).cast("int"))
    chunks = first.groupBy("design_id", "run", "chunk").agg(F.max("block").alias("block"), F.sort_array(F.collect_list(F.struct("i", "at"))).alias("p"), F.first("head").alias("head"))
    tail = F.lag(F.element_at("p", -1)["at"]).over(Window.partitionBy("design_id", "run").orderBy("chunk"))
    chunks = chunks.withColumn("head", F.coalesce(tail, "head"))
    return jumps.unionByName(chunks.select("design_id", "run", "chunk", F.lit(0).alias("kind"), "block", F.concat(F.array("head"), F.transform("p", lambda q: q["at"])).alias("points")))


def thumbnails(s: DataFrame) -> DataFrame:
    """(design_id, block, py, byte_no, value): the bytes that hold stitches in the 48 x 38 pictures, one of the whole design (block -1) and one for each block."""
    b = bounds(s)
    wide, high = F.greatest("width", F.lit(1)), F.greatest("height", F.lit(1))
    scale = F.least(F.lit(38) / wide, F.lit(28) / high)
    rows = with_block(s).where(F.col("k") == STITCH).join(b, "design_id").withColumn("scale", scale)
    px = (5 + (38 - wide * F.col("scale")) / 2 + (F.col("x") - F.col("min_x")) * F.col("scale")).cast("int")
    py = (5 + (28 - high * F.col("scale")) / 2 + (F.col("y") - F.col("min_y")) * F.col("scale")).cast("int")
    dots = rows.select("design_id", F.explode(F.array(F.lit(-1), F.col("block"))).alias("block"), px.alias("px"), py.alias("py")).where("px between 0 and 47 and py between 0 and 37").distinct()
    return dots.groupBy("design_id", "block", "py", (F.col("px") / 8).cast("int").alias("byte_no")).agg(F.bit_or(F.expr("shiftleft(1, px % 8)")).cast("int").alias("value"))


def pes_header_fields(s: DataFrame) -> DataFrame:
    """Bounds of the design centred on (1000, 1000), and the 12-bit offsets of its corner."""
    b = bounds(s)
    left, top = 1000 - (F.col("width") / 2).cast("int"), 1000 - (F.col("height") / 2).cast("int")
    return b.select("design_id", left.alias("left"), top.alias("top"), (left + F.col("width")).alias("right"), (top + F.col("height")).alias("bottom"), "width", "height", (-F.col("min_x")).bitwiseAND(F.lit(0xFFF)).alias("off_x"), (-F.col("min_y")).bitwiseAND(F.lit(0xFFF)).alias("off_y"))


def _frame() -> bytearray:
    img = bytearray(THUMB_W // 8 * THUMB_H)
    dots = [(x, y) for x in range(4, 44) for y in (1, 36)] + [(x, y) for y in range(4, 34) for x in (1, 46)]
    dots += [(3, 2), (44, 2), (3, 35), (44, 35), (2, 3), (45, 3), (2, 34), (45, 34)]
    for x, y in dots:
        img[y * 6 + x // 8] |= 1 << x % 8
    return img


def write_pes(s: DataFrame, colours: DataFrame, labels: DataFrame) -> DataFrame:
    """(design_id, pes): whole files. ``colours`` (design_id, block, machine_index), ``labels`` (design_id, label of up to 16 plain characters).

    Records, blocks and pictures are made and ordered by the operators above; a design's parts, at most one file, then meet in
    one row, where a helper packs the fixed header around them.
    """
    moved = shift_origin(s)
    records = pec_deltas(moved).groupBy("design_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "step", "hex"))), lambda p: p["hex"]), "").alias("body"))
    b = pes_blocks(moved)
    point = lambda p: F.concat(le16_hex(p["x"]), le16_hex(p["y"]))
    parts = b.groupBy("design_id").agg(F.sort_array(F.collect_list(F.struct("run", "chunk", "kind", "block", F.size("points").alias("n"), F.array_join(F.transform("points", point), "").alias("hex")))).alias("blocks"))
    dots = thumbnails(moved).groupBy("design_id").agg(F.collect_list(F.struct("block", "py", "byte_no", "value")).alias("dots"))
    table = colours.groupBy("design_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "machine_index"))), lambda p: p["machine_index"]).alias("colours"))
    one = pes_header_fields(moved).join(records, "design_id").join(parts, "design_id", "left").join(dots, "design_id", "left").join(table, "design_id", "left").join(labels, "design_id", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PACK_DESIGNS):
                rows = b.slice(lo, PACK_DESIGNS).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["design_id"] for r in rows], pa.int64()), pa.array([_pack(r) for r in rows], pa.binary())], names=["design_id", "pes"])

    return one.mapInArrow(pack, "design_id long, pes binary")


def _list(x) -> list:
    return [] if x is None else list(x)


def _pack(r: dict) -> bytes:
    colours = [int(c) for c in _list(r["colours"])] or [20]
    of = lambda block: colours[min(int(block), len(colours) - 1)]
    head = struct.pack("<HHHHH", 0, 1, 1, 0xFFFF, 0) + struct.pack("<H", 7) + b"CEmbOne"
    head += struct.pack("<4h", r["left"], r["top"], r["right"], r["bottom"]) * 2 + struct.pack("<6f", 1, 0, 0, 1, r["left"], r["bottom"])
    head += struct.pack("<Hhhhh", 1, 0, 0, r["width"], r["height"]) + bytes(8)
    blocks, log = [], []
    for i, x in enumerate(_list(r["blocks"])):
        c = of(x["block"])
        blocks.append(struct.pack("<HHH", x["kind"], c, x["n"]) + bytes.fromhex(x["hex"]))
        if not log or log[-1][1] != c:
            log.append((i, c))
    head += struct.pack("<HHH", len(blocks), 0xFFFF, 0) + struct.pack("<H", 7) + b"CSewSeg" + struct.pack("<H", 0x8003).join(blocks)
    head += struct.pack("<H", len(log)) + b"".join(struct.pack("<HH", *x) for x in log) + bytes(4)
    label = (r["label"] or "").encode("ascii", "ignore")[:LABEL_SIZE].ljust(LABEL_SIZE)
    pec = b"LA:" + label + b"\r" + b" " * 12 + bytes([0xFF, 0, 6, 0x26]) + b" " * 12 + bytes([len(colours) - 1, *colours]).ljust(TABLE_SIZE + 1, b" ")
    body = bytes.fromhex(r["body"]) + b"\xff"
    size = STITCH_HEAD + len(body)
    pec += bytes(2) + size.to_bytes(3, "little") + bytes([0x31, 0xFF, 0xF0]) + struct.pack("<hhHH", r["width"], r["height"], 0x1E0, 0x1B0) + struct.pack(">HH", 0x9000 | r["off_x"], 0x9000 | r["off_y"]) + body
    pictures = [_frame() for _ in range(len(colours) + 1)]
    for d in _list(r["dots"]):
        if d["block"] + 1 < len(pictures):
            pictures[d["block"] + 1][d["py"] * 6 + d["byte_no"]] |= d["value"]
    pec += b"".join(pictures) + bytes([len(colours) - 1, *colours]).ljust(128, b" ")
    return b"#PES0001" + struct.pack("<I", 12 + len(head)) + head + pec


DESIGN_COLUMNS = ["path", "label", "colours", "n_colours", "error", "stitches"]
_NOTHING = {"label": None, "colours": None, "n_colours": None, "error": None, "x": None, "y": None, "k": None}


def read_head(read: Callable[[int, int], bytes], size: int) -> dict:
    """Label, colour indexes and their number of a file of ``size`` bytes, or its error; ``read`` (from, number) gives some of its bytes."""
    start = read(0, 12)
    if len(start) < 12 or start[:4] != b"#PES":
        return _NOTHING | {"error": "not a PES file"}
    pec = int.from_bytes(start[8:12], "little")
    if pec + HEAD_SIZE + STITCH_HEAD >= size:
        return _NOTHING | {"error": "truncated"}
    head = read(pec, HEAD_SIZE)
    colours = list(head[49 : 50 + head[48]])
    return _NOTHING | {"label": head[3:19].decode("latin-1").strip(), "colours": colours, "n_colours": len(colours)}


def read_file(data: bytes) -> dict:
    """``read_head`` and the stitches (x, y, k) of one file, or its error."""
    out = read_head(lambda at, n: data[at : at + n], len(data))
    if out["error"]:
        return out
    p, x, y, pending = int.from_bytes(data[8:12], "little") + HEAD_SIZE + STITCH_HEAD, 0, 0, False
    xs, ys, ks = array("i"), array("i"), array("i")
    while p < len(data) and data[p] != 0xFF:
        if data[p] == 0xFE and data[p + 1 : p + 2] == b"\xb0":
            p, pending = p + 3, True
            continue
        step, flags = [], 0
        for _ in range(2):
            if p >= len(data):
                return _NOTHING | {"error": "truncated"}
            if data[p] & 0x80:
                v = (data[p] & 0x0F) << 8 | (data[p + 1] if p + 1 < len(data) else 0)
                flags |= data[p] & 0x70
                step.append(v - 0x1000 if v & 0x800 else v)
                p += 2
            else:
                step.append(data[p] - 128 if data[p] > 63 else data[p])
                p += 1
        x, y = x + step[0], y + step[1]
        xs.append(x)
        ys.append(y)
        ks.append(COLOR if pending else TRIM if flags & TRIM_FLAG else JUMP if flags & JUMP_FLAG else STITCH)
        pending = False
    return out | {"x": xs, "y": ys, "k": ks}


def as_batch(rows: list[dict], columns: list[str]) -> pa.RecordBatch:
    """Files as ``columns`` of one batch; the stitches of all lie in flat arrays."""
    out = {c: pa.array([r[c] for r in rows], t) for c, t in (("path", pa.string()), ("label", pa.string()), ("colours", pa.list_(pa.int32())), ("n_colours", pa.int32()), ("error", pa.string())) if c in columns}
    if "stitches" in columns:
        flat = [np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r[c], np.int32) for r in rows if r[c])]) for c in ("x", "y", "k")]
        ends = np.cumsum([0, *(len(r["x"] or ()) for r in rows)]).astype(np.int32)
        bad = pa.array([r["x"] is None for r in rows])
        out["stitches"] = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v) for v in flat], ["x", "y", "k"]), mask=bad)
    return pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)


def decode_pes(files: DataFrame) -> DataFrame:
    """(path, content) to (path, label, colours, stitches, error); a bad file has an error and nulls."""
    columns = ["path", "label", "colours", "stitches", "error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield as_batch([read_file(content.as_py() or b"") | {"path": path} for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True)], columns)

    return files.select("path", "content").mapInArrow(rows, "path string, label string, colours array<int>, stitches array<struct<x:int,y:int,k:int>>, error string")


def read_pes(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """(designs, stitches) of all files under ``path``: designs (path, design_id, label, colours, error), stitches (design_id, seq, x, y, k).

    PERMISSIVE keeps bad files as designs with an error and no stitches, FAILFAST raises on the first.
    """
    raw = decode_pes(spark.read.format("binaryFile").load(path)).withColumn("design_id", F.xxhash64("path"))
    if mode.upper() == "FAILFAST":
        raw = raw.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error"))))
    rows = raw.select("design_id", F.posexplode("stitches").alias("seq", "p")).select("design_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y", "p.k")
    return raw.select("path", "design_id", "label", "colours", "error"), rows

