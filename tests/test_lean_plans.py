"""Queries do not work for columns that they do not return, and read their shipments once."""

import pytest
from pyspark.sql import functions as F

from cargosift.functions import expressions as E
from cargosift.operators import drift
from cargosift.operators import matching as M
from cargosift.plans import queries


def _plan(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["op_J15_hypotheses", "op_W11_batch_scores"])
def test_hypotheses_match_no_names(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "matched(" not in plan and "LeftOuter" not in plan


@pytest.mark.parametrize("name", ["op_S11_decision_counts", "op_D9_cross_border", "op_PR1_profile"])
def test_facts_come_without_joins(spark, sf_dir, name):
    assert "LeftOuter" not in _plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["op_PR1_profile", "op_PR4_narrative", "op_D4_valuation", "op_D9_cross_border"])
def test_unread_evidence_is_not_made(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "Declared value not provided" not in plan and "Route includes" not in plan


def test_baseline_reads_decisions_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x / 7

    rows = spark.range(300).select(F.struct(F.lit("allowed").alias("label"), told.asNondeterministic()("id").alias("confidence")).alias("classification"), F.array(F.struct((F.col("id") % 3).cast("string").alias("group_id"))).alias("taxonomy_hits"))
    got = drift.baseline(rows).first()
    assert got.sample_size == 300 and sum(got.counts) == 300 and len(got.hit_rates) == 3
    assert seen.value == 300


def test_three_scores_as_any_number(spark):
    """The compiled form of three scores gives what the general one gives for three of four, the last without weight."""
    odd = [[1.0, 2.0, 3.0], [3.0, 3.0, 1.0], [-800.0, 0.0, 800.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 2.0], [1e-300, 5.0, 5.0]]
    rows = spark.createDataFrame([(x, x + [float("-inf")]) for x in odd], "a array<double>, b array<double>")
    for r in rows.select(M.classify(F.col("a")).alias("x"), M.classify(F.col("b")).alias("y")).collect():
        assert r.x.label == r.y.label and (r.x.confidence == r.y.confidence or r.x.confidence != r.x.confidence)
    short = spark.sql("SELECT CAST(NULL AS array<double>) AS a UNION ALL SELECT array(1.0D, 2.0D) UNION ALL SELECT array(1.0D, NULL, 2.0D)").select(M.classify(F.col("a")).alias("x")).collect()
    assert short[1].x.label == "restricted" and short[0].x.confidence is None and short[2].x.confidence is None


def test_fixed_is_what_the_formatter_gives(spark):
    odd = [0.0, -0.0, -1.5, float("nan"), float("inf"), 1e9, 0.0005, 0.9995, 0.9999, 0.0004, None, 1e-9, 999999999.9999, 2.675, 0.125]
    rows = spark.createDataFrame([(x,) for x in odd + [i / 10_000 for i in range(20_000)] + [i * 977.123457 for i in range(2000)]], "x double")
    for digits in (2, 3):
        assert rows.where(~E.fixed(F.col("x"), digits).eqNullSafe(F.format_string(f"%.{digits}f", "x"))).count() == 0
