"""A stream of stitch files: new files of a folder as designs and thread statistics, as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.encoding import decode_pes
from seamline.operators.stitch import COLOR, STITCH, TRIM

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_designs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming (path, label, error, stitches, trims, changes): one row per file that appears under ``path``; bad files carry their error.

    Stateless, so nothing is kept between batches; counts are taken inside a file's own array of records.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.pes").load(path)
    n = lambda k: F.size(F.filter("stitches", lambda p: p["k"] == k))
    rows = decode_pes(files)
    return rows.select("path", "label", "error", *[F.when(F.col("error").isNull(), n(k)).alias(c) for k, c in ((STITCH, "stitches"), (TRIM, "trims"), (COLOR, "changes"))])
