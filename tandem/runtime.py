"""Session helpers shared by every operator: table access, shared work folder, staging."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a single parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder is used."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tandem-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage is cut, the rows are
    computed once, and a lost executor costs nothing that was already written."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """The size of the files a staged table is read from."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    names = df.inputFiles()
    if not names:
        return 0
    folder = jvm.org.apache.hadoop.fs.Path(names[0]).getParent()
    return folder.getFileSystem(conf).getContentSummary(folder).getLength()


def release(*frames: DataFrame) -> None:
    """Deletes what ``stage`` wrote for tables that nothing will read any more, as those of the rounds before."""
    for df in frames:
        for name in dict.fromkeys(f.rsplit("/", 1)[0] for f in df.inputFiles()):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            if folder.toString().split(":", 1)[-1].lstrip("/").startswith(shared_folder(df.sparkSession).split(":", 1)[-1].lstrip("/")):
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of what has been staged as soon as nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Evens rows out over all cores before a stage that is heavy per row, where the input has fewer parts than
    cores; a larger input already has enough and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(shuffle_partitions(df.sparkSession), cores), *keys)


def heavy_groups(df: DataFrame, *keys: str):
    """``df.groupBy(*keys)`` for a function that is heavy per group: partitions of few bytes are not merged, so small
    tables with much work still use all cores."""
    n = max(shuffle_partitions(df.sparkSession), 3 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys).groupBy(*keys)
