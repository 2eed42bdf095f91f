"""What the corpus operators share: the word pattern, hashes, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_last_resort: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset a temporary one serves a local session; on a cluster it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _last_resort[app] = _last_resort.get(app) or tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/tidemark"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, files: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    files: how many files it is written to at most.  On a local folder Hadoop starts three
    processes a file to set modes, and each shares the executor's memory until it has begun.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from cut() that nothing reads any more, and let Spark's cleaner drop the shuffles of finished jobs."""
    for t in tables:
        remove_path(t.sparkSession, t.written_path)
    tables[0].sparkSession._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df, whatever its case, is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, null text has 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
