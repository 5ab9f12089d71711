"""Screening and its analytics over streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargosift.functions import expressions as E
from cargosift.operators import drift
from cargosift.operators import matching as M
from cargosift.operators.feedback import FeedbackLog


def parquet_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def action_counts(events: DataFrame, at: str = "ts", action: str = "action", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and action, with a watermark for late rows."""
    w = F.window(at, window)
    return events.withWatermark(at, late).groupBy(w.alias("w"), action).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), action, "n")


def to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete"):
    """Writes what each micro-batch gives to a folder of its own; a batch that runs again replaces it."""
    each = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_counts(events: DataFrame, edges: list[float], value: str, at: str = "ts", window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows (window_start, bin, n) of sliding windows, as state that a watermark bounds: counts by bin of the baseline, no values."""
    inner = F.array(*[F.lit(float(e)) for e in edges])
    binned = events.where(F.col(value).isNotNull()).select(at, drift.bin_of(F.col(value), inner).alias("bin")).withWatermark(at, late)
    return binned.groupBy(F.window(at, window, slide).alias("w"), "bin").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "bin", "n")


def rolling_psi(counts: DataFrame, base: list[int]) -> DataFrame:
    """Rows (window_start, n, psi) of the newest counts of every window and bin (window_start, bin, n, batch), as batches in update mode leave them, against a baseline's bins."""
    newest = counts.groupBy("window_start", "bin").agg(F.max_by("n", "batch").alias("n"))
    held = newest.groupBy("window_start").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("n"))
    total = float(sum(base))
    share = lambda x: F.least(F.greatest(x, F.lit(drift.EPS)), F.lit(1.0))
    terms = [drift.psi_term(share(F.lit(b / max(total, 1.0))), share(F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0)) / F.col("n"))) for i, b in enumerate(base)]
    return held.select("window_start", "n", (sum(terms[1:], terms[0]) if total else F.lit(0.0)).alias("psi"))


def rolling_drift(events: DataFrame, baseline: DataFrame, value: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger_once: bool = True, bins: int = 10):
    """PSI of every micro-batch against a static baseline, handed to the sink as one row (psi, batch). The baseline is counted once."""
    inner = drift.edges(baseline, value, bins)
    at = [float(e) for e in inner.first().edges or []]
    own = drift.binned(baseline, value, at, bins).withColumnRenamed("n", "n_base").collect()  # a row a bin

    def each(batch: DataFrame, number: int) -> None:
        base = batch.sparkSession.createDataFrame(own, "bin int, n_base long")
        both = base.join(drift.binned(batch, value, at, bins).withColumnRenamed("n", "n_current"), "bin")
        sink(drift.psi(both).withColumn("batch", F.lit(number)), number)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def apply_reviews(reviews: DataFrame, log: FeedbackLog, checkpoint: str):
    """Sets arriving reviews on a feedback log, each batch as a delta of its own; a batch that ran before changes nothing."""
    return reviews.writeStream.foreachBatch(lambda batch, number: log.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class KnownNames:
    """A folder of names that were compared with a denied-party list: list=V/batch=N holds those that batch N was the first to bring, each with its match or none.

    V is a digest of the list and the threshold, so another version of the list begins without names. A batch compares its new names alone,
    and one that runs again gives the same rows. compact() makes one part of all; what holds the names grows with the distinct ones.
    """

    spark: SparkSession
    path: str
    threshold: float = 0.80

    def _list(self, denied: DataFrame) -> str:
        """The digest of a list, whatever the order of its rows."""
        row = F.xxhash64("ord", "key", "matched_party", "list_name").cast("decimal(38,0)")
        told = denied.agg(F.count("*").alias("n"), F.sum(row).alias("s"), F.bit_xor(row.cast("long")).alias("x")).first()
        return f"{told.n}_{told.s}_{told.x}_{self.threshold}".replace("-", "m").replace(".", "_")

    def _parts(self, version: str) -> list[tuple[int, int, str]]:
        """(last batch, first batch, path) of the finished parts that hold all names, without those that a larger part covers."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/list={version}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getParent() for s in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(root, "*/_SUCCESS")) or []]
        spans = sorted(((*map(int, p.getName().split("=")[1].split("-")[::-1]), p.toString()) for p in found), key=lambda x: (x[1], -x[0]))
        out: list[tuple[int, int, str]] = []
        for last, first, path in spans:
            if not out or last > out[-1][0]:
                out.append((last, first, path))
        return out

    def _known(self, version: str, before: int | None = None) -> DataFrame:
        paths = [p for last, _, p in self._parts(version) if before is None or last < before]
        schema = "key string, ord long, score double, exact_match boolean, matched_party string, list_name string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def learn(self, rows: DataFrame, denied: DataFrame, batch: int) -> tuple[str, int]:
        """Compares the names of rows that no batch before has brought; gives the list's version and how many they were."""
        version = self._list(denied)
        if any(first <= batch <= last for last, first, _ in self._parts(version)):
            return version, 0
        names = rows.select(F.explode(F.array(*[E.normal_name(F.col(r)) for r in M.ROLES])).alias("key")).where("key <> ''").distinct()
        new = names.join(self._known(version, batch).select("key"), "key", "left_anti")
        out = f"{self.path}/list={version}/batch={batch}-{batch}"
        M.name_matches(new, denied, self.threshold).write.mode("overwrite").parquet(out)
        return version, self.spark.read.parquet(out).count()

    def matches(self, rows: DataFrame, version: str) -> DataFrame:
        """Adds matches to rows whose names are all known, as matching.party_matches does."""
        known = self._known(version).where("ord is not null")  # of most names there is nothing to tell
        out = rows
        for r in M.ROLES:
            mine = known.select(F.col("key").alias(f"_k_{r}"), F.struct("ord", "score", "exact_match", "matched_party", "list_name").alias(f"_party_{r}"))
            out = out.join(mine, E.normal_name(F.col(r)) == F.col(f"_k_{r}"), "left").drop(f"_k_{r}")
        return M.with_matches(out)

    def expire(self, denied: DataFrame) -> None:
        """Removes the names that were compared with other versions of the list."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(root, "list=*")) or []:
            if s.getPath().getName() != f"list={self._list(denied)}":
                fs.delete(s.getPath(), True)

    def compact(self, denied: DataFrame) -> None:
        """One part of all finished ones; the older stay for readers that began before."""
        version = self._list(denied)
        parts = self._parts(version)
        if len(parts) > 1:
            self._known(version).write.mode("overwrite").parquet(f"{self.path}/list={version}/batch={parts[0][1]}-{parts[-1][0]}")


def screen(stream: DataFrame, known: KnownNames, denied: DataFrame, screened: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame], path: str, checkpoint: str):
    """Screens micro-batches into a folder for each; one that runs again replaces it.

    screened gets a batch and the function that adds its matches from the names compared so far (an Engine's matcher), and gives the rows to write.
    """

    def each(batch: DataFrame, number: int) -> None:
        version, _ = known.learn(batch, denied, number)
        screened(batch, lambda rows: known.matches(rows, version)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
