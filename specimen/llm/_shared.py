"""Plumbing shared by the corpus operators: tables, scratch space, sizes.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``, which every executor and the driver
see.  Lineage is cut by writing a table there and reading it back, so that a lost executor costs a re-read of finished
files and never a re-run of the scan that made them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python: bounds the memory of a Python worker however long the texts are.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches for this session (idempotent)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder; in local mode without one, a temporary folder is set as such."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="specimen-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Scratch folders made inside the ``temporary`` blocks that are open, innermost last; the first list has all others.
_MADE: list[list[str]] = [[]]


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to shared scratch space and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    _MADE[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession):
    """Scratch tables that are kept inside the block are deleted at its end, but for one whose frame the block ``lasts``:
    ``with temporary(spark) as lasts: return lasts(keep(...))``.  Nothing lazy that reads the others may leave the block."""
    own: list[str] = []
    _MADE.append(own)

    def lasts(df: DataFrame) -> DataFrame:
        _MADE[-2].append(own.pop())
        return df

    try:
        yield lasts
    finally:
        _MADE.remove(own)
        _delete(spark, own)


def clean_up(spark: SparkSession) -> None:
    """Delete every scratch table this process has made and not deleted yet: for the end of a job, when all results are written."""
    for own in _MADE:
        _delete(spark, own)
        own.clear()


def _delete(spark: SparkSession, folders) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``keep`` made, once nothing reads them any more."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextmanager
def ranges(spark: SparkSession, file: str):
    """``read(offset, length)`` over one open file, on any file system that Spark knows."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)

    def read(offset: int, length: int) -> bytes:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))

    try:
        yield read
    finally:
        stream.close()


#: Words of a sieve at most: what is broadcast is a row of two longs for each (about 8 MB in memory).
SIEVE_WORDS = 1 << 18


def sieve(hashes: DataFrame, column: str = "h") -> Callable[[DataFrame, str], DataFrame]:
    """``marked(df, h)``: a frame with ``__sp_pass``, which is false only where the long in ``h`` is not among the hashes.

    A Bloom filter, broadcast as a table of at most ``SIEVE_WORDS`` words.  Where the hashes are very many it lets more pass, up
    to everything: what passes is to be looked up exactly."""
    n = hashes.count()
    words = 64
    while words < SIEVE_WORDS and words * 4 < n:  # sixteen bits and more a hash
        words *= 2
    bit = lambda h, k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, {k}) & 63 as int))")
    mask = lambda h: bit(h, 40).bitwiseOR(bit(h, 46)).bitwiseOR(bit(h, 52))
    word = lambda h: F.pmod(F.col(h), F.lit(words)).alias("__sp_word")
    made = hashes.select(word(column), mask(column).alias("m")).groupBy("__sp_word").agg(F.bit_or("m").alias("__sp_mask"))

    kept = keep(made, "sieve")

    def marked(df: DataFrame, h: str) -> DataFrame:
        both = df.withColumn("__sp_word", word(h)).join(F.broadcast(kept), "__sp_word", "left")
        return both.withColumn("__sp_pass", F.coalesce(F.col("__sp_mask").bitwiseAND(mask(h)) == mask(h), F.lit(False))).drop("__sp_word", "__sp_mask")

    return marked


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
