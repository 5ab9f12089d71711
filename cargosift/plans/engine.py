"""Whole screening of a DataFrame of shipments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargosift import schemas
from cargosift.config import DUAL_USE_CONCEPTS, HS_DESCRIPTIONS, TAXONOMY, Screening
from cargosift.functions import expressions as E
from cargosift.operators import decisions as D
from cargosift.operators import matching as M
from cargosift.operators.assessors import with_places
from cargosift.scratch import compiled
from cargosift.sources import readers


@dataclass(frozen=True)
class Engine:
    """Settings and reference tables; every method maps a DataFrame to a DataFrame. with_taxonomy gives a new engine."""

    spark: SparkSession
    settings: Screening = field(default_factory=Screening)
    groups: tuple = tuple(TAXONOMY)
    parties: DataFrame | None = None
    countries: DataFrame | None = None
    embedder: M.Embedder | None = None
    scorer: M.Scorer | M.BatchScorer | None = None  # of hypotheses, used where rows bring no logits
    scorer_triples: bool = False
    matcher: Callable[[DataFrame], DataFrame] | None = None  # adds matches from names that were compared before, as streams.KnownNames does

    def __post_init__(self) -> None:
        compiled(self.spark)

    def with_taxonomy(self, groups: list[dict]) -> Engine:
        return replace(self, groups=tuple(readers.validate_taxonomy(groups)))

    def describe(self) -> dict:
        return {"status": "ok", "model_version": self.settings.model_version, "classifier": self.settings.classifier, "taxonomy_groups": len(self.groups), "embedder": self.embedder is not None}

    def _denied(self) -> DataFrame:
        return self.parties if self.parties is not None else readers.denied_parties(self.spark)

    def _with_countries(self, rows: DataFrame) -> DataFrame:
        table = self.countries if self.countries is not None else readers.country_risk(self.spark)
        return with_places(rows, table)

    def _vectors(self, texts: list[str]) -> np.ndarray:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", self.embedder(F.col("t")).alias("v")).collect()
        return np.array([r.v for r in sorted(rows, key=lambda r: r.i)])

    def enrich(self, rows: DataFrame) -> DataFrame:
        """Adds hits (keyword, then semantic), classification (if logits or a scorer are there), matches, ai, places and risk."""
        groups = list(self.groups)
        out = rows.withColumn("hits", M.keyword_hits(F.col("description"), groups))
        if self.embedder is not None:
            phrases = self._vectors([p for g in groups for p in g["semantic_phrases"]])
            titles, concepts = self._vectors(list(HS_DESCRIPTIONS.values())), self._vectors(list(DUAL_USE_CONCEPTS))
            vec = rows["vec"] if "vec" in rows.columns else self.embedder(F.col("description"))
            out = out.withColumn("_v", vec).withColumn("_s", M.semantic_signals(F.col("_v"), groups, phrases, titles, concepts, E.hs_chapter(F.col("hs_code")), self.settings))
            known = F.transform("hits", lambda h: h["group_id"])
            more = F.filter(F.col("_s.hits"), lambda h: ~F.array_contains(known, h["group_id"]))
            out = out.withColumn("ai", F.col("_s.ai")).withColumn("hits", F.concat("hits", more)).drop("_v", "_s")
        else:
            out = out.withColumn("ai", F.lit(None).cast(schemas.AI))
        out = self.resolve_parties(self.classify(out))
        return self._with_countries(out).withColumn("risk", D.legacy_risk(self.settings))

    def classify(self, rows: DataFrame) -> DataFrame:
        """Adds classification: of the rows' logits, else of the scorer's, null without either."""
        if "logits" in rows.columns:
            return rows.withColumn("classification", M.classify(F.col("logits")))
        if self.scorer is None:
            return rows.withColumn("classification", F.lit(None).cast("struct<label:string,confidence:double>"))
        scored = rows.withColumn("_logits", M.hypothesis_scores(F.col("description"), self.scorer, self.scorer_triples))
        return scored.withColumn("classification", M.classify(F.col("_logits"))).drop("_logits")

    def score_risk(self, rows: DataFrame) -> DataFrame:
        """Legacy tier of shipments: adds risk."""
        return rows.withColumn("risk", D.legacy_risk(self.settings))

    def build_profile(self, rows: DataFrame) -> DataFrame:
        return D.profile(self.enrich(rows), self.settings)

    def resolve_parties(self, rows: DataFrame) -> DataFrame:
        return self.matcher(rows) if self.matcher is not None else M.party_matches(rows, self._denied(), self.settings.fuzzy_match)

    def screen(self, rows: DataFrame, with_profile: bool = True) -> DataFrame:
        """Decisions: one row for each shipment; taxonomy_hits is empty unless a hit decided."""
        wide = self.enrich(rows)
        if with_profile:
            wide = D.profile(wide, self.settings, told="_told")
        branch, action, reason = D.routed(self.settings)
        wide = wide.withColumn("branch", branch).withColumn("action", action).withColumn("reason", reason)
        wide = wide.withColumn("decided_hits", F.when(F.col("branch") == 1, F.col("hits")).otherwise(F.array().cast(f"array<{schemas.HIT}>")))
        wide = D.audit(wide.withColumn("rationale", D.rationale(self.settings, with_profile, D.legacy_values(self.settings), F.col("_told") if with_profile else None)), self.settings)
        extra = ["risk_profile"] if with_profile else []
        return wide.select(F.col("id").alias("shipment_id"), "description", "action", F.col("decided_hits").alias("taxonomy_hits"), F.col("hits").alias("all_hits"), "classification", F.col("matches").alias("entity_matches"), F.col("risk").alias("risk_assessment"), *extra, "reason", "rationale", "branch", "model_version", "classifier_type", "thresholds_snapshot")

    @staticmethod
    def summarize(decisions: DataFrame) -> DataFrame:
        return decisions.groupBy("action").agg(F.count("*").alias("n"))
