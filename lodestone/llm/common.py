"""What the operators of this package share: tables, folds, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod `folds` is `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session (tests) that names none gets a temporary folder; a cluster without the
    setting is an error, since a machine's own folder would lose rows there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and path, for workers that read or write files there themselves."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _path(self, path: str, act) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        act(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return the table that reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))


#: Parts into which hashes are dealt for sampling: far more than any table has rows.
_PARTS = 1 << 52


def hash_share(key: Column, salt: str, share: float | Column) -> Column:
    """True for about `share` of the values of a key, by its hash, so that every run takes the same."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(_PARTS)) < (share if isinstance(share, Column) else F.lit(share)) * F.lit(float(_PARTS))


def sample_by_hash(df: DataFrame, key: str, bound: int, salt: str) -> DataFrame:
    """About `bound` rows of a table with distinct keys, however large it is."""
    return df.where(hash_share(F.col(key), salt, min(1.0, bound / max(1, df.count()))))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least one: rows that repeat an id don't make a bounded sample grow."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*").select(*rows.columns)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one row a document; rows without an id or label go, repeated ones are averaged."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))
