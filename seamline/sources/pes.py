"""Stitch files as a Python data source: ``spark.read.format("pes")`` and ``df.write.format("pes")``.

A reader takes a file's headers first, tests the pushed-down predicates on them, and reads the stitches only of files that pass, and only
if the column is asked for. Files are reached through pyarrow's file systems; a partition is a run of whole files.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from seamline.operators.encoding import DESIGN_COLUMNS, HEAD_SIZE, as_batch, read_file, read_head
from seamline.session import qualified

HEADER_COLUMNS = ["path", "label", "colours", "n_colours", "error"]
_SCHEMA = {"path": "string", "label": "string", "colours": "array<int>", "n_colours": "int", "error": "string", "stitches": "array<struct<x:int,y:int,k:int>>"}
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def schema_of(columns: list[str]) -> str:
    return ", ".join(f"{c} {_SCHEMA[c]}" for c in columns)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], per_task: int):
        self.path, self.columns, self.per_task, self.tests = path, columns, per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons, membership and not-null tests of the label and the number of colours are done here; others go back to Spark."""
        for x in filters:
            column = x.attribute[0] if hasattr(x, "attribute") and len(x.attribute) == 1 else None
            if column not in ("label", "n_colours"):
                yield x
            elif type(x) in _COMPARED and (column == "n_colours" or isinstance(x, EqualTo)):
                self.tests.append((column, _COMPARED[type(x)], x.value))
            elif isinstance(x, In):
                self.tests.append((column, lambda v, among: v in among, frozenset(x.value)))
            elif isinstance(x, IsNotNull):
                self.tests.append((column, lambda v, _: v is not None, None))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        """Whole files, gathered up to ``per_task`` bytes, of which a file counts for at least a header."""
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x for x in found if x.is_file and x.path.endswith(".pes") and "/_temporary/" not in x.path), key=lambda x: x.path)
        out, now, total = [], [], 0
        for x in files:
            if now and total + max(x.size, HEAD_SIZE) > self.per_task:
                out.append(_Files(tuple(now)))
                now, total = [], 0
            now.append(x.path)
            total += max(x.size, HEAD_SIZE)
        return [*out, _Files(tuple(now))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                row = read_head(lambda at, n: f.read_at(n, at), f.size())  # noqa: B023
                if not all(row[c] is not None and test(row[c], v) for c, test, v in self.tests):
                    continue
                if "stitches" in self.columns and row["error"] is None:
                    row = read_file(f.read_at(f.size(), 0))
            rows.append(row | {"path": path})
            held += len(row["x"] or ())
            if len(rows) == 1000 or held > 1 << 18:
                yield as_batch(rows, self.columns)
                rows, held = [], 0
        if rows:
            yield as_batch(rows, self.columns)


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    """Each task attempt writes ``<design_id>.pes`` into a folder of its own in _temporary; the commit moves the folders of the attempts that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        system, path = fs.FileSystem.from_uri(self.path)
        folder = None
        for row in iterator:
            if folder is None:
                folder = f"{path}/_temporary/{self.job}/part-{uuid.uuid4().hex}"
                system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{row['design_id']}.pes") as out:
                out.write(bytes(row["pes"]))
        return _Written(folder)

    def commit(self, messages) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        old = []
        if self.overwrite and system.get_file_info(path).type == fs.FileType.Directory:
            old = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-")]
        for m in messages:
            if m and m.folder:
                system.move(m.folder, f"{path}/{m.folder.rpartition('/')[2]}")
        for x in old:
            system.delete_dir(x)
        self._clear(system, path)

    def abort(self, messages) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, system, path: str) -> None:
        if system.get_file_info(f"{path}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary/{self.job}")


class PesDataSource(DataSource):
    """Options: path (a URI); taskbytes (bytes of files per task). Reading takes any of the columns of ``_SCHEMA``; writing takes design_id and pes."""

    @classmethod
    def name(cls) -> str:
        return "pes"

    def schema(self) -> str:
        return schema_of(DESIGN_COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema.fieldNames(), int(self.options.get("taskbytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PesDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_designs(files: DataFrame, path: str, mode: str = "append") -> None:
    """``files`` (design_id, pes; other columns are ignored), one file each: a task that is tried again leaves one file a design.

    Rows without a file are left out; a design of several rows has one file in each task that holds some of them. ``overwrite`` takes
    away what earlier writes left once the new files are there.
    """
    register(files.sparkSession)
    files.select("design_id", "pes").where("pes is not null").write.format("pes").mode(mode).save(qualified(files.sparkSession, path))


def read_designs(spark: SparkSession, path: str, columns: list[str] = DESIGN_COLUMNS) -> DataFrame:
    """``columns`` (of path, label, colours, n_colours, error, stitches) of all stitch files under ``path``.

    Without ``stitches`` only headers are read, and only what is wrong with them is an error; a bad file has an error and nulls. Filters on label and
    n_colours are pushed down to the reader.
    """
    register(spark)
    return spark.read.format("pes").schema(schema_of(columns)).load(qualified(spark, path))
