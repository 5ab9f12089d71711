"""Choice of rows to label, feedback tables, export, training and evaluation."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargosift.functions import expressions as E
from cargosift.operators.matching import best_match
from cargosift.scratch import drop_stored, stored

LABEL_IDS = {"approve": 0, "block": 1, "manual_review": 2}


def informativeness(rows: DataFrame, probabilities: str, margin_weight: float = 0.5, entropy_weight: float = 0.5) -> DataFrame:
    """Adds margin, entropy and informativeness, each of the first two over its maximum (as it is if that is 0)."""
    own = rows.withColumn("margin", E.margin(F.col(probabilities))).withColumn("entropy", E.entropy(F.col(probabilities)))
    top = own.agg(F.max("margin").alias("_mm"), F.max("entropy").alias("_me"))
    part = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(F.col(c))
    out = own.join(F.broadcast(top))
    return out.withColumn("informativeness", margin_weight * part("margin", "_mm") + entropy_weight * part("entropy", "_me")).drop("_mm", "_me")


POOL = 512  # rows whose vectors the driver holds while it picks


def _distances(v: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(v - point).cumsum(axis=1)[:, -1])  # added up in order, wherever it is computed


def diverse(rows: DataFrame, vec: str, weight: str, budget: int, id_col: str = "vec_id", pool: int = POOL) -> DataFrame:
    """Greedy core set: the row of greatest weight, then again and again the row of greatest weight times distance to those chosen.

    Rows (id, pick). Ties go to the smaller id; rows without vector or weight take no part. Distances only shrink as rows are chosen, so
    scores of a pass bound all later ones: from the pool of best rows the driver picks exactly, as long as the best of them beats what the
    best row outside had in the last pass. Then one pass brings all distances up to date; one pass serves many picks.
    """
    spark = rows.sparkSession
    picks: list[int] = []
    own = stored(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col(weight).cast("double").alias("w"), F.lit(float("inf")).alias("d")).where("id is not null and v is not null and w is not null"), "core-set")
    while len(picks) < budget:
        begun = bool(picks)
        score = F.col("w") * F.col("d") if begun else F.col("w")
        top = own.select(score.alias("s"), "id").orderBy(F.desc("s"), "id").limit(pool + 1).collect()
        if not top:
            break
        rest = (-top[pool].s, top[pool].id) if len(top) > pool else None
        near = own.where(F.col("id").isin([t.id for t in top[:pool]])).collect()
        ids, w, d = np.array([r.id for r in near]), np.array([r.w for r in near]), np.array([r.d for r in near])
        v = np.array([r.v for r in near], np.float64)
        new: list[np.ndarray] = []
        while len(picks) < budget and len(ids):
            scores = w * d if begun else w
            at = min(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
            if rest is not None and new and (-scores[at], ids[at]) >= rest:
                break
            picks.append(int(ids[at]))
            new.append(v[at])
            d = np.minimum(d, _distances(v, v[at]))
            left = ids != ids[at]
            ids, w, d, v = ids[left], w[left], d[left], v[left]
            if not begun:
                break  # from now on distances count
        points = np.array(new)

        def least(vs: pd.Series, ds: pd.Series) -> pd.Series:
            out = ds.to_numpy(copy=True)
            rows = np.stack(vs.to_numpy()) if len(vs) else np.zeros((0, 1))
            for p in points:
                out = np.minimum(out, _distances(rows, p))
            return pd.Series(out)

        if len(picks) < budget:
            after = own.where(~F.col("id").isin(picks[-len(new) :])).select("id", "v", "w", F.pandas_udf(least, "double")("v", "d").alias("d"))
            before, own = own, stored(after, "core-set")
            drop_stored(before)
    drop_stored(own)
    return spark.createDataFrame([(p, i + 1) for i, p in enumerate(picks)], "id long, pick int")


def select_for_review(rows: DataFrame, vec: str, probabilities: str, budget: int, id_col: str = "vec_id") -> DataFrame:
    """Informative and diverse rows to label; rows need both a vector and probabilities."""
    bad = rows.where(F.col(vec).isNull() | F.col(probabilities).isNull()).limit(1).count()
    if bad:
        raise ValueError("every row needs a vector and probabilities")
    return diverse(informativeness(rows, probabilities), vec, "informativeness", budget, id_col)


FEEDBACK = """feedback_id string, shipment_id string, description string, keyword_decision string, ai_decision string, ai_confidence decimal(4,3),
taxonomy_hit boolean, taxonomy_group string, final_decision string, disagreement_type string, risk_score int, risk_raw decimal(5,4), entity_hit boolean,
entity_list_name string, entity_match_score decimal(5,4), rationale string, model_version string, classifier_type string, thresholds_snapshot string,
input_snapshot string, reviewer_id string, reviewer_notes string, created_at timestamp, reviewed_at timestamp"""


def disagreement(keyword: Column, ai: Column) -> Column:
    k = F.lower(keyword)
    return F.when((k == "block") & (ai == "allowed"), "KW_BLOCK_AI_ALLOW").when((k == "allow") & (ai == "restricted"), "KW_ALLOW_AI_BLOCK")


def record(decisions: DataFrame, keyword: str | None = None, snapshot: Column | None = None) -> DataFrame:
    """Feedback rows of decisions: first taxonomy group, best entity match, type of disagreement, audit fields."""
    c, r, best = F.col("classification"), F.col("risk_assessment"), best_match(F.col("entity_matches"))
    none = F.lit(None)
    return decisions.select(
        F.expr("uuid()").alias("feedback_id"), "shipment_id", "description", (F.col(keyword) if keyword else none).cast("string").alias("keyword_decision"), c["label"].alias("ai_decision"),
        c["confidence"].cast("decimal(4,3)").alias("ai_confidence"), (F.size("taxonomy_hits") > 0).alias("taxonomy_hit"), F.get("taxonomy_hits", F.lit(0))["group_id"].alias("taxonomy_group"),
        F.col("action").alias("final_decision"), (disagreement(F.col(keyword), c["label"]) if keyword else none.cast("string")).alias("disagreement_type"), r["score"].alias("risk_score"),
        r["raw_score"].cast("decimal(5,4)").alias("risk_raw"), (F.size("entity_matches") > 0).alias("entity_hit"), best["list_name"].alias("entity_list_name"), best["score"].cast("decimal(5,4)").alias("entity_match_score"),
        F.when(F.col("rationale") != "", F.col("rationale")).alias("rationale"), "model_version", "classifier_type", "thresholds_snapshot", (snapshot if snapshot is not None else F.lit("{}")).alias("input_snapshot"),
        none.cast("string").alias("reviewer_id"), none.cast("string").alias("reviewer_notes"), F.current_timestamp().alias("created_at"), none.cast("timestamp").alias("reviewed_at"),
    )


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    """The feedback and drift-baseline tables, partitioned by what is filtered most."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}screening_feedback ({FEEDBACK}) USING parquet PARTITIONED BY (final_decision)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}drift_baselines (baseline_id string, name string, sample_size int, confidences string, labels string, hit_rates string, embeddings string, created_at timestamp) USING parquet")


def input_snapshot(columns: list[str]) -> Column:
    """JSON of a shipment's columns without its metadata, nulls kept."""
    return F.to_json(F.struct(*[c for c in columns if c != "metadata"]), {"ignoreNullFields": "false"})


def apply_feedback(log: DataFrame, reviews: DataFrame, id_col: str = "shipment_id", at: str = "created_at") -> DataFrame:
    """log with each review (shipment_id, reviewer_id, final_decision, notes) set on the newest row of its shipment not yet reviewed.

    A review of a shipment without such a row changes nothing; of several reviews of one shipment the last by
    reviewer_id holds.
    """
    one = reviews.groupBy("shipment_id").agg(F.max_by(F.struct("reviewer_id", "final_decision", "notes"), "reviewer_id").alias("_r")).withColumnRenamed("shipment_id", "_s")
    w = Window.partitionBy("_s").orderBy(F.desc("_at"), F.desc("_f"))
    open_rows = log.where("reviewer_id is null").select(F.col(id_col).alias("_s"), F.col(at).alias("_at"), F.col("feedback_id").alias("_f"))  # of the reviewed shipments alone, before they are ranked
    mine = open_rows.join(one, "_s").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_f", "_r")
    joined = log.join(mine, log["feedback_id"] == mine["_f"], "left")
    keep = lambda new, old: F.when(F.col("_r").isNotNull(), F.col(new)).otherwise(F.col(old))
    return joined.withColumns({"final_decision": keep("_r.final_decision", "final_decision"), "reviewer_notes": keep("_r.notes", "reviewer_notes"), "reviewed_at": F.when(F.col("_r").isNotNull(), F.current_timestamp()).otherwise(F.col("reviewed_at")), "reviewer_id": keep("_r.reviewer_id", "reviewer_id")}).select(*log.columns)


def disagreement_page(log: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return log.where("disagreement_type is not null").orderBy(F.desc("created_at"), "feedback_id").offset(offset).limit(limit)


def labelled(log: DataFrame, least_confidence: float | None = None) -> DataFrame:
    """Reviewed rows, newest first; with a least confidence, compared as stored (three places)."""
    out = log.where("reviewer_id is not null and reviewed_at is not null")
    if least_confidence is not None:
        out = out.where(F.col("ai_confidence") >= F.lit(least_confidence).cast("decimal(4,3)"))
    return out.orderBy(F.desc("reviewed_at"), "feedback_id")


def latest_baselines(rows: DataFrame) -> DataFrame:
    """The last saved row of each baseline name: what an upsert would leave."""
    w = Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("baseline_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def save_baseline(spark: SparkSession, path: str, name: str, sample_size: int, summary: str) -> None:
    """Appends a drift baseline; latest_baselines() reads the current ones."""
    row = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("baseline_id"), F.lit(name).alias("name"), F.lit(sample_size).alias("sample_size"), F.lit(summary).alias("summary"), F.current_timestamp().alias("created_at"))
    row.write.mode("append").parquet(path)


def save_summary(spark: SparkSession, path: str, name: str, summary: DataFrame) -> None:
    """Appends the one row of drift.baseline() under a name, as JSON."""
    row = summary.select(F.col("sample_size").cast("int").alias("n"), F.to_json(F.struct("*")).alias("j")).first()
    save_baseline(spark, path, name, row.n, row.j)


def load_summary(rows: DataFrame, name: str) -> DataFrame:
    """The newest baseline saved under a name, as drift.baseline() made it; no row if there is none."""
    kind = "sample_size long, edges array<double>, counts array<long>, labels map<string,long>, hit_rates map<string,double>, centroid array<double>"
    return latest_baselines(rows.where(F.col("name") == name)).select(F.from_json("summary", kind).alias("s")).select("s.*")


def append_feedback(rows: DataFrame, table: str = "screening_feedback") -> None:
    """Appends feedback rows to the table of create_tables(), columns by name."""
    spark = rows.sparkSession
    rows.select(*spark.table(table).columns).write.insertInto(table)


def training_rows(log: DataFrame, text: str = "description", decision: str = "final_decision", id_col: str = "shipment_id") -> DataFrame:
    """Rows (text, label, label_name, shipment_id) of mapped decisions."""
    ids = F.create_map(*[F.lit(x) for kv in LABEL_IDS.items() for x in kv])
    return log.where(F.col(decision).isin(*LABEL_IDS)).select(F.col(text).alias("text"), F.try_element_at(ids, F.col(decision)).alias("label"), F.col(decision).alias("label_name"), F.col(id_col).alias("shipment_id"))


def split_rows(rows: DataFrame, key: str = "shipment_id", test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split (test, then val, then train) in a seeded order, with the sizes int(n * share).

    The order is that of a hash; its rank comes from counts of hash ranges and a rank inside each range, so no
    task sorts all rows.
    """
    n = rows.count()
    hashed = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_b", F.shiftright("_h", 48))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("c"))
    before = sizes.withColumn("_g", F.shiftright("_b", 8))
    groups = before.groupBy("_g").agg(F.sum("c").alias("gc")).withColumn("_gs", F.coalesce(F.sum("gc").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    start = before.join(F.broadcast(groups.drop("gc")), "_g").withColumn("_s", F.col("_gs") + F.coalesce(F.sum("c").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_s")
    placed = hashed.join(F.broadcast(start), "_b").withColumn("_r", F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))  # at most 65536 ranges
    n_test, n_val = int(n * test), int(n * val)
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return placed.withColumn("split", split).drop("_h", "_b", "_s", "_r")


def export(rows: DataFrame, path: str, **kw) -> DataFrame:
    """Writes one JSON-lines folder for each split and gives the counts."""
    out = split_rows(rows, **kw)
    out.write.mode("overwrite").partitionBy("split").json(path)
    return out.groupBy("split").agg(F.count("*").alias("n"))


def train_text_classifier(rows: DataFrame, features: int = 1 << 14, iterations: int = 20):
    """Fits words, hashed counts, inverse document frequency and a three-class logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=iterations, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows.where("text is not null and label is not null").withColumn("label", F.col("label").cast("double")))


def save_text_classifier(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_text_classifier(spark: SparkSession, path: str):
    """A model that save_text_classifier() wrote; raises FileNotFoundError where there is none."""
    from pyspark.ml import PipelineModel

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"no trained model at {path}; train one, or classify by logits or a scorer")
    return PipelineModel.load(path)


def class_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction", classes: int = 3) -> DataFrame:
    """Rows (class, precision, recall, f1, support); a share of nothing is 0."""
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    pairs = rows.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    part = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("double")
    c = F.col("class")
    got = every.join(F.broadcast(pairs)).groupBy("class").agg(part((F.col("y") == c) & (F.col("p") == c)).alias("tp"), part(F.col("p") == c).alias("pp"), part(F.col("y") == c).alias("support"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = got.withColumn("precision", share(F.col("tp"), F.col("pp"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    s = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0)).select("class", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


def gate(metrics: DataFrame, allow_precision: float = 0.95, restricted_recall: float = 0.98) -> DataFrame:
    """One row (passed, failures): class 0 needs the precision, class 1 the recall."""
    one = metrics.agg(F.max(F.when(F.col("class") == 0, F.col("precision"))).alias("p"), F.max(F.when(F.col("class") == 1, F.col("recall"))).alias("r"))
    failures = F.array_compact(F.array(F.when(F.col("p") < allow_precision, F.lit("allow_precision")), F.when(F.col("r") < restricted_recall, F.lit("restricted_recall"))))
    return one.select((F.size(failures) == 0).alias("passed"), failures.alias("failures"))
