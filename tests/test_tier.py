"""A country's tier changes the case of its code once."""

from pyspark.sql import functions as F

from cargosift.config import Screening
from cargosift.operators.assessors import tier


def test_tier_makes_upper_case_once(spark):
    settings = Screening()
    assert str(tier(F.col("c"), settings)).count("upper") == 1
    rows = spark.createDataFrame([(c,) for c in ("XX", "xx", "aA", " XX", "", "US", None)], "c string").select(tier(F.col("c"), settings).alias("t"))
    assert [r.t for r in rows.collect()] == [4, 4, 1, 0, 0, 0, 0]
    assert spark.range(1).select(tier(F.lit("XX"), Screening(tiers={})).alias("t")).first().t == 0
