"""Distribution drift between a baseline and a current set of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargosift.operators.quantiles import quantiles
from cargosift.scratch import stored

EPS = 1e-6


def _share(n: Column, total: Column) -> Column:
    return F.least(F.greatest(n / F.greatest(total, F.lit(1.0)), F.lit(EPS)), F.lit(1.0))


def psi_term(expected: Column, actual: Column) -> Column:
    return (actual - expected) * F.ln(actual / expected)


def edges(base: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """One row: the bins - 1 inner quantile edges (linear interpolation), rounded to nine places; null without values.

    Exact, found by counting ranges (see quantiles) when this is called.
    """
    found = quantiles(base, value, [i / bins for i in range(1, bins)])
    at = F.lit(None).cast("array<double>") if found is None else F.array(*[F.lit(float(x)) for x in found])
    return base.sparkSession.range(1).select(F.transform(at, lambda e: F.round(e, 9)).alias("edges"))


def bin_of(value: Column, inner: Column) -> Column:
    """Number of inner edges at or below the value."""
    return F.size(F.filter(inner, lambda e: e <= F.round(value, 9)))


def binned(rows: DataFrame, value: str, inner: list[float], bins: int = 10) -> DataFrame:
    """Rows (bin, n) of every bin between given edges, nulls left out."""
    at = F.array(*[F.lit(e) for e in inner]).cast("array<double>")
    counted = rows.where(F.col(value).isNotNull()).groupBy(bin_of(F.col(value), at).alias("bin")).agg(F.count("*").alias("k"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("k", F.lit(0)).alias("n"))


def histogram(base: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Rows (bin, n_base, n_current) for every bin of the baseline's quantiles."""
    rows = base.select(value, F.lit(1).alias("b")).unionByName(current.select(value, F.lit(0).alias("b"))).where(F.col(value).isNotNull())
    counted = rows.join(F.broadcast(edges(base, value, bins))).groupBy(bin_of(F.col(value), F.col("edges")).alias("bin")).agg(F.sum("b").alias("n_base"), F.sum(1 - F.col("b")).alias("n_current"))
    every = base.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_current", F.lit(0)).alias("n_current"))


def psi(counts: DataFrame, labels: bool = False) -> DataFrame:
    """One row (psi) from rows (n_base, n_current): population stability index, 0 if either side is empty; of labels an empty side has the least share of each."""
    totals = counts.agg(F.sum("n_base").cast("double").alias("tb"), F.sum("n_current").cast("double").alias("tc"))
    e, a = _share(F.col("n_base"), F.col("tb")), _share(F.col("n_current"), F.col("tc"))
    return counts.join(F.broadcast(totals)).agg(F.coalesce(F.when(F.lit(labels) | ((F.max("tb") > 0) & (F.max("tc") > 0)), F.sum(psi_term(e, a))), F.lit(0.0)).alias("psi"))


def categorical(base: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """Rows (label, n_base, n_current) over the labels of both sides."""
    count = lambda df, n: df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias(n))
    both = count(base, "n_base").join(count(current, "n_current"), label, "full_outer")
    return both.select(label, F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_current", F.lit(0)).alias("n_current"))


def hit_rates(decisions: DataFrame, hits: str = "all_hits") -> DataFrame:
    """Rows (group_id, rate): hits of each group over all decisions."""
    total = decisions.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return decisions.select(F.explode(F.transform(hits, lambda h: h["group_id"])).alias("group_id")).groupBy("group_id").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("group_id", (F.col("n") / F.col("total")).alias("rate"))


def rate_deltas(base: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (group_id, delta, large) from two tables of rates; a missing rate is 0, large means above 0.05 either way."""
    both = base.withColumnRenamed("rate", "b").join(current.withColumnRenamed("rate", "c"), "group_id", "full_outer")
    delta = F.coalesce("c", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return both.select("group_id", delta.alias("delta"), (F.abs(delta) > 0.05).alias("large"))


def centroid_distance(base: DataFrame, current: DataFrame, vec: str) -> DataFrame:
    """One row (centroid_shift): distance between the mean vectors, 0 if a side is empty."""
    mean = lambda df, n: df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias(n))
    return mean(base, "b").join(mean(current, "c"), "pos").agg(F.coalesce(F.sqrt(F.sum(F.pow(F.col("c") - F.col("b"), F.lit(2)))), F.lit(0.0)).alias("centroid_shift"))


def report(base: DataFrame, current: DataFrame, value: str, label: str, deltas: DataFrame | None = None, shift: DataFrame | None = None) -> DataFrame:
    """One row (psi_confidence, label_psi, centroid_shift, hit_rate_deltas, significant, summary)."""
    spark = base.sparkSession
    out = psi(histogram(base, current, value)).withColumnRenamed("psi", "psi_confidence")
    out = out.join(F.broadcast(psi(categorical(base, current, label), labels=True).withColumnRenamed("psi", "label_psi")))
    out = out.join(F.broadcast(shift if shift is not None else spark.range(1).select(F.lit(0.0).alias("centroid_shift"))))
    rates = deltas.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_id", "delta")))).alias("hit_rate_deltas")) if deltas is not None else spark.range(1).select(F.create_map().cast("map<string,double>").alias("hit_rate_deltas"))
    out = out.join(F.broadcast(rates))
    large = F.map_filter("hit_rate_deltas", lambda k, v: F.abs(v) > 0.05)
    parts = F.array_compact(F.array(
        F.format_string("confidence_psi=%.3f", "psi_confidence"), F.format_string("label_psi=%.3f", "label_psi"),
        F.when(F.col("centroid_shift") != 0, F.format_string("centroid_shift=%.3f", "centroid_shift")),
        F.when(F.size(large) > 0, F.concat(F.lit("hit_rate_changes={"), F.array_join(F.transform(F.map_entries(large), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", "), F.lit("}"))),
    ))
    return out.select("*", significant(F.col("psi_confidence"), F.col("label_psi"), F.col("centroid_shift")).alias("significant"), F.array_join(parts, "; ").alias("summary"))


def significant(psi_confidence: Column, label_psi: Column, shift: Column) -> Column:
    return (psi_confidence >= 0.25) | (label_psi >= 0.25) | (shift >= 0.3)


def baseline(decisions: DataFrame, confidence: str = "classification.confidence", label: str = "classification.label", hits: str = "taxonomy_hits", vec: str | None = None, bins: int = 10) -> DataFrame:
    """One row (sample_size, edges, counts, labels, hit_rates, centroid): what later decisions are held against.

    The confidences' inner quantile edges and the count in each bin stand for the confidences, so that the row stays small;
    rows without classification count for hit rates alone. Without vectors centroid is null. Decisions are read once: a narrow table of
    what counts is written to the shared folder, and every pass reads that.
    """
    own = [F.col(confidence).alias("value"), F.col(label).alias("label"), F.transform(hits, lambda h: F.struct(h["group_id"].alias("group_id"))).alias("hits")]
    decisions = stored(decisions.select(*own, *([] if vec is None else [F.col(vec).alias("vec")])), "baseline")
    rows = decisions.select("value", "label")
    inner = edges(rows, "value", bins)
    counted = rows.where("value is not null").join(F.broadcast(inner)).groupBy(bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))  # one row of edges
    every = decisions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left")
    counts = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("counts"))
    labels = rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    rates = hit_rates(decisions, "hits").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_id", "rate")))).alias("hit_rates"))
    out = decisions.agg(F.count("*").alias("sample_size"))
    for one in (inner, counts, labels, rates):
        out = out.join(F.broadcast(one))  # one row each
    if vec is None:
        return out.withColumn("centroid", F.lit(None).cast("array<double>"))
    mean = decisions.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return out.join(F.broadcast(mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))))


def against(base: DataFrame, current: DataFrame) -> DataFrame:
    """report() of two baselines, the second of current decisions counted with the first's edges (see rebinned())."""
    def index(left: Column, right: Column, keys: Column, of_labels: bool = False) -> Column:
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
        at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long"))
        tb, tc = total(F.map_values(left)), total(F.map_values(right))
        terms = F.transform(keys, lambda k: psi_term(_share(at(left, k), tb), _share(at(right, k), tc)))
        return F.when(F.lit(of_labels) | ((tb > 0) & (tc > 0)), F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))).otherwise(0.0)

    b, c = base.select(F.struct("*").alias("b")), current.select(F.struct("*").alias("c"))
    both = b.join(F.broadcast(c))  # one row each
    numbered = lambda side: F.map_from_arrays(F.sequence(F.lit(1), F.size(f"{side}.counts")), F.col(f"{side}.counts"))
    labels = F.array_union(F.map_keys("b.labels"), F.map_keys("c.labels"))
    groups = F.array_union(F.map_keys("b.hit_rates"), F.map_keys("c.hit_rates"))
    rate = lambda side, g: F.coalesce(F.try_element_at(F.col(f"{side}.hit_rates"), g), F.lit(0.0))
    shift = F.coalesce(F.sqrt(F.aggregate(F.zip_with("b.centroid", "c.centroid", lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))
    out = both.select(
        index(numbered("b"), numbered("c"), F.sequence(F.lit(1), F.size("b.counts"))).alias("psi_confidence"), index(F.col("b.labels"), F.col("c.labels"), labels, True).alias("label_psi"),
        shift.alias("centroid_shift"), F.map_from_arrays(groups, F.transform(groups, lambda g: rate("c", g) - rate("b", g))).alias("hit_rate_deltas"),
    )
    return out.withColumn("significant", significant(F.col("psi_confidence"), F.col("label_psi"), F.col("centroid_shift")))


def rebinned(base: DataFrame, decisions: DataFrame, confidence: str = "classification.confidence", **kw) -> DataFrame:
    """baseline() of decisions with the counts of another baseline's bins, for against()."""
    own = baseline(decisions, confidence, **kw)
    cells = decisions.select(F.col(confidence).alias("value")).where("value is not null").join(F.broadcast(base.select("edges"))).groupBy(bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))
    at = cells.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("cells"))
    joined = own.join(F.broadcast(at)).withColumn("counts", F.transform(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0).cast("long"))))
    return joined.drop("cells", "edges").join(F.broadcast(base.select("edges"))).select(*own.columns)
