"""The feedback log as a base table and small deltas of reviews, merged when it is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64  # folders of the base, by shipment, of which a batch of reviews reads those it touches
DELTA = "bucket int, feedback_id string, reviewer_id string, final_decision string, reviewer_notes string, reviewed_at timestamp, batch long"


def _bucket(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class FeedbackLog:
    """A folder: base/through=N holds the log with the reviews of all batches to N, reviews/batch=N those of a batch.

    A batch writes its reviews alone, each set on a row; a batch that is there already changes nothing. compact() writes a new
    base, from which later readers start. Rows have feedback_id (distinct), shipment_id, created_at and the review columns.
    """

    spark: SparkSession
    path: str

    def _done(self, folder: str, key: str) -> list[int]:
        """Numbers of the finished parts of a folder."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{key}=*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def create(self, log: DataFrame) -> None:
        log.withColumn("bucket", _bucket("shipment_id")).repartition("bucket", F.pmod(F.xxhash64("feedback_id"), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.path}/base/through=-1")

    def _base(self) -> tuple[int, DataFrame]:
        through = self._done("base", "through")[-1]
        return through, self.spark.read.parquet(f"{self.path}/base/through={through}")

    def _reviews(self, after: int, before: int | None = None) -> DataFrame:
        parts = [n for n in self._done("reviews", "batch") if n > after and (before is None or n < before)]
        reader = self.spark.read.schema(DELTA)
        return reader.parquet(*[f"{self.path}/reviews/batch={n}" for n in parts]) if parts else self.spark.createDataFrame([], DELTA)

    def apply(self, reviews: DataFrame, batch: int) -> None:
        """Sets reviews (shipment_id, reviewer_id, final_decision, notes) on the newest row of their shipment that none before has reviewed.

        Of several of one shipment in a batch the last by reviewer_id holds; without such a row a review changes nothing.
        """
        if batch in self._done("reviews", "batch"):
            return
        through, base = self._base()
        if batch <= through:
            return
        one = reviews.groupBy("shipment_id").agg(F.max_by(F.struct("reviewer_id", "final_decision", "notes"), "reviewer_id").alias("r")).withColumn("b", _bucket("shipment_id"))
        touched = [x.b for x in one.select("b").distinct().collect()]  # BUCKETS at most
        taken = self._reviews(through, batch).where(F.col("bucket").isin(touched)).select("feedback_id")
        open_rows = base.where(F.col("bucket").isin(touched) & F.col("reviewer_id").isNull()).select("bucket", "feedback_id", "shipment_id", "created_at")
        mine = open_rows.join(one.select("shipment_id", "r"), "shipment_id").join(taken, "feedback_id", "left_anti")
        newest = mine.withColumn("n", F.row_number().over(Window.partitionBy("shipment_id").orderBy(F.desc("created_at"), F.desc("feedback_id")))).where("n = 1")
        out = newest.select("bucket", "feedback_id", "r.reviewer_id", "r.final_decision", F.col("r.notes").alias("reviewer_notes"), F.current_timestamp().alias("reviewed_at"), F.lit(batch).cast("long").alias("batch"))
        out.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/reviews/batch={batch}")

    def read(self) -> DataFrame:
        """The log with all reviews so far."""
        through, base = self._base()
        set_ = ("reviewer_id", "final_decision", "reviewer_notes", "reviewed_at")
        new = self._reviews(through).select(F.col("feedback_id").alias("_id"), F.struct(*set_).alias("_new"))
        out = base.join(new, base["feedback_id"] == new["_id"], "left")
        return out.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in set_}).drop("_id", "_new", "bucket")

    def compact(self) -> None:
        """A new base with the reviews of all finished batches; older parts stay for readers that began before."""
        done = self._done("reviews", "batch")
        if done and done[-1] > self._base()[0]:
            self.read().withColumn("bucket", _bucket("shipment_id")).repartition("bucket", F.pmod(F.xxhash64("feedback_id"), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/through={done[-1]}")
