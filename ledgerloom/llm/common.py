"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, for bytes.translate.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: For each thread the folders that it has written, in order, and that are still there.
_THREAD = threading.local()
#: Word pattern of the contracts, in Java and Python syntax alike.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and everything runs on
    one machine a temporary folder is made and set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. Column names
    must be unique.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written().append(path)
    keep_until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Let a file or folder that is there go when the driver's JVM ends, whether or not the session has been stopped by then."""
    where, files = _located(spark, path)
    files.deleteOnExit(where)


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _written() -> list[str]:
    if not hasattr(_THREAD, "paths"):
        _THREAD.paths = []
    return _THREAD.paths


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows``, so that what is made of one stays small beside long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose places an operator's own results take, whatever their case."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def with_text(name: str) -> Column:
    """Column ``name`` of the struct ``row``, with what a new ``text`` beside it means for it."""
    if name == "text":
        return F.col("text")
    if name == "n_chars":
        return F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars")
    return F.col(f"row.`{name}`").alias(name)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def written() -> int:
    """How many folders this thread has written so far and not deleted; a mark for ``clean``."""
    return len(_written())


def clean(spark: SparkSession, mark: int) -> None:
    """Delete the folders that this thread has written since a mark, but for the last one, on which nothing before it has a hold any more."""
    paths = _written()
    for path in paths[mark:-1]:
        remove_tree(spark, path)
    del paths[mark:-1]


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever it is."""
    where, files = _located(spark, path)
    files.delete(where, True)


def single_threaded() -> None:
    """Keep native libraries to the one core that a Spark task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
