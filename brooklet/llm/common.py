"""What the operators share: scratch tables in the cluster's shared folder, table
readers, and Arrow batch sizing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so the default of 10,000 is too many.
BATCH_ROWS = 500
#: Rows of one join value that go to one task, and hot values (under 40 bytes each) up to which
#: their list is broadcast; a longer list is joined by a shuffle.
HOT, BROADCAST_HOT = 1024, 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, unless the session chose a size itself."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; on an unset local
    session (tests) a folder of its own, which then becomes the checkpoint folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brooklet-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables that one run of an operator writes to cut its lineage. They are plain Parquet in
    the shared folder: a lost executor costs the tasks it ran, never the table."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/brooklet/{what}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._brooklet_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._brooklet_path)
            p.getFileSystem(conf).delete(p, True)


def if_small(side: DataFrame, rows: int, most: int) -> DataFrame:
    """``side`` with a broadcast hint where it has been counted and is within ``most`` rows;
    beyond that Spark's own join choice (a shuffle) stands."""
    return F.broadcast(side) if rows <= most else side


def hot_values(rows: DataFrame, *on: str) -> DataFrame:
    """How many rows hold each value of ``on`` (column ``c``), where that is more than HOT."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT)


def join_dealt(scratch: Scratch, rows: DataFrame, side: DataFrame, on: list[str], by: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side`` (one row for each value of ``on``). Rows of a ``hot`` value (with
    its count ``c``) are dealt over several tasks by a hash of ``by``, and the side's row of that
    value is copied to each of them. Rows with a null in ``on`` match nothing and are dealt too."""
    hot = scratch.cut(hot.select(*on, F.ceil(F.col("c") / HOT).cast("int").alias("_parts")), "hot")
    if not (n := hot.count()):
        return rows.join(side, on, how)
    few = if_small(hot, n, BROADCAST_HOT)
    blank = reduce(or_, [F.col(c).isNull() for c in on])
    parts = F.when(blank, F.lit(1024)).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = rows.join(few, on, "left").withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), *by), parts).cast("int")).drop("_parts")
    copied = side.join(few, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"], how).drop("_part")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; the folder is a parameter (``BROOKLET_TOKENIZERS``)."""
    return os.path.join(os.environ.get("BROOKLET_TOKENIZERS", "/opt/tokenizers"), name)


def releasing(batches: Iterator, *forget: Callable[[], None]) -> Iterator:
    """The same batches; at their end a task forgets what it remembered and gives its memory back.
    Python workers live on, and the next stage of a pipeline needs the room."""
    try:
        yield from batches
    finally:
        for f in forget:
            f()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)
