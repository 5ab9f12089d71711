"""Session settings, and tables written to the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder. Where it is unset a local master gets a temporary one; a cluster raises, as its machines share none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="cargosift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def compiled(spark: SparkSession) -> None:
    """Has Spark run long expressions as several methods: those of over 8000 bytes of code stay interpreted in the JVM for good.

    Letters change case by the JVM, which takes plain ASCII byte by byte; ICU goes through every text as UTF-16.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: inputs of a few files or row groups are dealt out, larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder; cuts the lineage, and joins know its size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables made by stored() that nothing reads any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if not files:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
