"""Session helpers shared by all operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where it is unset, a folder beside the warehouse serves in local mode; on a cluster that is an error, as every executor
    would write to a disk of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI in the store that Spark takes it to be in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterations and reused stages read it instead of recomputing, and lost executors don't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which goes when the application ends: for large tables of which several steps read some columns.

    Joins sort and merge it: its size on disk, from which Spark would choose, is a fiftieth of what a broadcast of it takes.
    """
    path = f"{own_folder(df.sparkSession, 'kept')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


class Scratch:
    """Parquet tables of one job in the shared folder, read back with only the columns asked for.

    ``drop`` deletes a table once nothing reads it any more; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folder = f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._made = 0
        self._marked = False

    def _on_disk(self, path: str) -> tuple:
        p = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{self._made}"
        self._made += 1
        df.write.parquet(path)
        if not self._marked:
            fs, p = self._on_disk(self._folder)
            self._marked = fs.deleteOnExit(p)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, p = self._on_disk(self._paths[id(t)])
            fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
