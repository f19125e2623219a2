"""Scratch tables in the folder all machines share, and small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share. On one machine a temporary one is set where none is."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        # few rows per Arrow batch, as one text may be long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._scratch = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(conf).delete(path, True)


def text_bytes(text) -> F.Column:
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5) == 0


def count_words(text) -> F.Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.size(F.regexp_extract_all(text_bytes(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def hash_bits(rows: int, per_bucket: int, most: int = 14) -> int:
    """Bits of a hash prefix so that a bucket holds about ``per_bucket`` of ``rows`` rows."""
    return min(most, max(0, (max(rows, 1) // per_bucket).bit_length()))


def bucket_of(key_hex: F.Column, bits: int) -> F.Column:
    """The first ``bits`` (28 at most) of a hex string."""
    return F.shiftright(F.conv(F.substring(key_hex, 1, 7), 16, 10).cast("long"), 28 - bits)
