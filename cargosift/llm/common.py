"""Session settings, scratch tables and connected components shared by the text operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cargosift.scratch import scratch_dir, stored

__all__ = ["arrow_rows", "components", "drop_stored", "fresh", "partitions", "prepare", "scratch_dir", "stored"]

ARROW_ROWS = 400
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches for the session, so that a Python worker holds a few hundred texts at a time; results are read with it too."""
    spark.conf.set(_ROWS, str(ARROW_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Other Arrow batches for what is written inside; the session's own come back."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables made by stored() that nothing reads any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if not files:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star, an aggregation and a join each, both written to the shared folder, until
    neither changes an edge; the writes themselves count what changed. Nodes without an edge to another node do not appear; an empty input gives an empty result.
    Rounds grow with the logarithm of a component's size; if max_rounds do not do, it raises.
    """
    norm = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(norm(edges), "cc")
    busy = not now.isEmpty()  # of plans that Spark finds empty it observes nothing
    for _ in range(max_rounds):
        if not busy:
            break
        moved, merged = Observation(), Observation()
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").observe(moved, F.count(F.when(F.col("m") < F.col("u"), 1)).alias("n"))
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "cc")  # a row for each edge at most
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").observe(merged, F.count(F.when(F.col("m") < F.col("v"), 1)).alias("n"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = stored(small, "cc")
        drop_stored(large)
        drop_stored(now)
        now = after
        busy = moved.get["n"] + merged.get["n"] > 0
    if busy:
        raise RuntimeError(f"components are not done after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
