"""Session, table and scratch-space helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "spanloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for; an existing session is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table of texts for operators that read every text in Python. If its files give fewer partitions than there are
    cores (a single small file), the rows are spread by their key; larger tables are left where they lie."""
    df = read_table(spark, sf_dir, name)
    n = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: `spark.checkpoint.dir` of the session, or the checkpoint folder set on its context.

    Only on a single machine (master `local` or `local[n]`) may both be unset: a temporary folder is made once and removed
    at exit. On a cluster that would be another disk for every executor, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_on_context.get() if set_on_context.isDefined() else spark.conf.get("spanloom.scratch.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spanloom.scratch.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder to cut lineage. They survive the loss of executors,
    and superseded ones are removed with `drop` (all but the one that a lazy result reads)."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, files: int | None = None) -> tuple[DataFrame, str]:
        path = f"{self.root}/{self._n}"
        self._n += 1
        (df.coalesce(files) if files else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def write_counting(self, df: DataFrame, condition: Column) -> tuple[DataFrame, str, int]:
        """As `write`, with the number of rows that meet a condition, counted while they are written."""
        seen = Observation()
        table, path = self.write(df.observe(seen, F.count_if(condition).alias("n")))
        return table, path, int(seen.get["n"] or 0)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
