"""Legacy risk tier, risk profile, routing, rationale and audit columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargosift.config import Screening
from cargosift.functions import expressions as E
from cargosift.operators.assessors import ASSESSORS, assess, evidence, tier
from cargosift.operators.matching import best_match

_cat, _lit = F.concat, F.lit


def _legacy_parts(settings: Screening) -> list[tuple]:
    """Name, condition, value, weight and evidence of the six structured signals, in order."""
    v, w = F.col("declared_value"), settings.legacy_weights
    nulls = sum((F.col(c).isNull().cast("int") for c in ("destination_country", "consignee", "declared_value")), F.col("origin_country").isNull().cast("int"))
    prefix = E.first_prefix(F.col("hs_code"), settings.sensitive_prefixes)
    place = lambda c: (c, F.col(c).isNotNull() & (tier(F.col(c), settings) > 0), F.least(tier(F.col(c), settings) / 4.0, _lit(1.0)), w.get(c, 0.25), _cat(_lit("Country "), F.upper(F.col(c)), _lit(" is tier "), tier(F.col(c), settings).cast("string")))
    return [
        place("origin_country"),
        place("destination_country"),
        ("high_value", v >= settings.high_value, F.least(v / (settings.high_value * 10), _lit(1.0)), w.get("high_value", 0.15), _cat(_lit("Declared value "), E.fixed(v, 2), _lit(f" exceeds threshold {settings.high_value:.2f}"))),
        ("round_value", E.is_round(v, settings.round_tolerance, 10_000.0), 0.5, w.get("round_value", 0.1), _cat(_lit("Declared value "), E.fixed(v, 2), _lit(" is suspiciously round"))),
        ("sensitive_hs", prefix.isNotNull(), 1.0, w.get("sensitive_hs", 0.15), _cat(_lit("HS code "), F.col("hs_code"), _lit(" matches sensitive prefix '"), prefix, _lit("'"))),
        ("missing_fields", nulls > 0, nulls / 4.0, w.get("missing_fields", 0.1), _cat(nulls.cast("string"), _lit(" of 4 critical fields are missing"))),
    ]


def legacy_signals(settings: Screening) -> Column:
    """The six structured signals with their weights, in order."""
    return E.signals(*[E.signal(*part) for part in _legacy_parts(settings)])


def legacy_values(settings: Screening) -> Column:
    """The names and values of those signals as a text, without their evidence."""
    return F.array_join(F.array(*[F.when(F.coalesce(when, _lit(False)), _cat(_lit(f"{name}="), E.fixed(value if isinstance(value, Column) else _lit(value), 2))) for name, when, value, _, _ in _legacy_parts(settings)]), ", ")


def legacy_raw(settings: Screening) -> Column:
    """The raw score alone, as flat arithmetic that stays in generated code."""
    v, w = F.col("declared_value"), settings.legacy_weights
    nulls = sum((F.col(c).isNull().cast("int") for c in ("destination_country", "consignee", "declared_value")), F.col("origin_country").isNull().cast("int"))
    part = lambda when, value: F.when(F.coalesce(when, _lit(False)), value).otherwise(0.0)
    total = part(F.col("origin_country").isNotNull(), F.least(tier(F.col("origin_country"), settings) / 4.0, _lit(1.0)) * w.get("origin_country", 0.25))
    total = total + part(F.col("destination_country").isNotNull(), F.least(tier(F.col("destination_country"), settings) / 4.0, _lit(1.0)) * w.get("destination_country", 0.25))
    total = total + part(v >= settings.high_value, F.least(v / (settings.high_value * 10), _lit(1.0)) * w.get("high_value", 0.15))
    total = total + part(E.is_round(v, settings.round_tolerance, 10_000.0), _lit(0.5 * w.get("round_value", 0.1)))
    total = total + part(E.first_prefix(F.col("hs_code"), settings.sensitive_prefixes).isNotNull(), _lit(float(w.get("sensitive_hs", 0.15))))
    return F.least(total + nulls / 4.0 * w.get("missing_fields", 0.1), _lit(1.0))


def legacy_risk(settings: Screening) -> Column:
    """Struct (score, raw_score, signals): tier 1 to 5 of the capped weighted sum, which needs none of the signals' texts."""
    raw = legacy_raw(settings)
    return F.struct(E.tier_of(raw).alias("score"), raw.alias("raw_score"), legacy_signals(settings).alias("signals"))


FLAGS = "array<struct<name:string,severity:string,dimension:string,description:string>>"


def flags(hits: Column, matches: Column) -> Column:
    make = lambda name, level, dim, text: F.struct(_lit(name).alias("name"), _lit(level).alias("severity"), _lit(dim).alias("dimension"), text.alias("description"))

    def of_hit(h: Column) -> Column:
        word = make("taxonomy_keyword_hit", "critical", "goods", _cat(_lit("Hard keyword '"), h["matched_keyword"], _lit("' matched taxonomy group '"), h["group_name"], _lit("'")))
        near = make("taxonomy_semantic_hit", "high", "goods", _cat(_lit("Strong semantic match to taxonomy phrase '"), h["matched_phrase"], _lit("' (score "), E.fixed(h["similarity_score"], 3), _lit(")")))
        return F.when(E.present(h["matched_keyword"]), word).when(E.present(h["matched_phrase"]) & (h["similarity_score"] >= 0.85), near)

    def of_match(m: Column) -> Column:
        exact = make("denied_party_exact_match", "critical", "party", _cat(_lit("Exact denied-party match on "), m["role"], _lit(" ('"), m["matched_party"], _lit("', list '"), m["list_name"], _lit("')")))
        high = make("denied_party_high_fuzzy_match", "high", "party", _cat(_lit("High-confidence fuzzy match on "), m["role"], _lit(" ('"), m["matched_party"], _lit("', score "), E.fixed(m["score"], 3), _lit(")")))
        return F.when(m["exact_match"], exact).when(m["score"] >= 0.92, high)

    return F.array_compact(F.concat(F.transform(hits, of_hit), F.transform(matches, of_match)))


def overall(rows: DataFrame, settings: Screening, assessors: dict | None = None) -> DataFrame:
    """assess() with the columns of a profile beside it: overall_severity, overall_score, dimensions, flags, narrative, advisory_action and advisory_confidence.

    Severity, advice and narrative come from levels and summaries, so that signals and their evidence are made only where they are read.
    """
    chosen = assessors or ASSESSORS
    out = assess(rows, settings, chosen)
    weights = {n: float(settings.dimension_weights.get(n, 1.0)) for n in chosen}
    total = sum((F.col(f"_v_{n}") * w for n, w in weights.items()), _lit(0.0))
    whole = sum(weights.values())
    score = F.round(F.least(total / whole if whole else _lit(0.0), _lit(1.0)), 4)
    found = F.when((F.size("hits") == 0) & (F.size("matches") == 0), F.array().cast(FLAGS)).otherwise(flags(F.col("hits"), F.col("matches")))
    out = out.withColumn("flags", found).withColumn("overall_score", score)
    top = F.greatest(_lit(0), F.when(F.size("flags") > 0, F.coalesce(F.array_max(F.transform("flags", lambda f: E.rank(f["severity"]))), _lit(0))), *[E.rank(F.col(f"_l_{n}")) for n in chosen])
    out = out.withColumn("overall_severity", E.severity_of(top))
    sev = F.col("overall_severity")
    doubt = E.rank(F.col("_l_model_uncertainty")) >= 3 if "model_uncertainty" in chosen else _lit(False)
    action = F.when(sev == "critical", "block").when(sev.isin("high", "medium"), "manual_review").when(doubt, "manual_review").otherwise("approve")
    sure = F.when(sev == "critical", 0.90).when(sev == "high", 0.75).when(sev == "medium", 0.60).when(doubt, 0.55).when(sev == "none", 0.90).otherwise(0.80)
    return out.withColumns({"dimensions": F.array(*[F.col(f"_d_{n}") for n in chosen]), "narrative": narrative(list(chosen), F.col("flags"), sev), "advisory_action": action, "advisory_confidence": sure})


PROFILE = ("overall_severity", "overall_score", "dimensions", "flags", "narrative", "advisory_action", "advisory_confidence")


def profile(rows: DataFrame, settings: Screening, assessors: dict | None = None, told: str | None = None) -> DataFrame:
    """Adds risk_profile: the dimensions, flags, overall score and severity, advice and narrative.

    With told a column of that name has what rationale() tells of the profile, made without the dimensions' structs: evidence is made of raised ones alone.
    """
    chosen = assessors or ASSESSORS
    taken = [c for c in PROFILE if c in rows.columns]
    out = overall(rows.withColumnsRenamed({c: f"_own_{c}" for c in taken}), settings, chosen)
    if told is not None:
        level, title, some = (lambda n: F.col(f"_l_{n}")), (lambda n: F.col(f"_h_{n}")), (lambda n: F.col(f"_a_{n}"))
        listed = lambda n: F.when(some(n), _cat(_lit(" Evidence: "), F.array_join(evidence(chosen[n], settings, F.col(f"_d_{n}")), "; "), _lit("."))).otherwise("")
        raised = F.array_join(F.array(*[F.when(E.rank(level(n)) >= 2, _cat(_lit("["), title(n), _lit(" / "), level(n), _lit("] "), F.col(f"_s_{n}"), listed(n))) for n in chosen]), " ")
        quiet = F.array_join(F.array(*[F.when((E.rank(level(n)) < 2) & some(n), title(n)) for n in chosen]), ", ")
        clean = F.array_join(F.array(*[F.when((E.rank(level(n)) == 0) & ~some(n), title(n)) for n in chosen]), ", ")
        out = out.withColumn("_raised", raised)  # read twice, made once
        out = out.withColumn(told, _sentence(_of_profile(F.col, F.col("_raised"), quiet, clean))).drop("_raised")
    out = out.withColumn("risk_profile", F.struct(F.col("id").alias("shipment_id"), *PROFILE)).drop(*PROFILE, *[f"_{x}_{n}" for n in chosen for x in "dhvlast"])
    return out.withColumnsRenamed({f"_own_{c}": c for c in taken})


def dimension(profile_column: Column, name: str) -> Column:
    """The assessment of one dimension of a profile, null if it has none."""
    return F.get(F.filter(profile_column["dimensions"], lambda d: d["dimension"] == name), _lit(0))


def _names(dims: Column, test) -> Column:
    return F.array_join(F.transform(F.filter(dims, test), lambda d: d["dimension"]), ", ")


def _elevated(d: Column) -> Column:
    return E.rank(d["severity"]) >= 2


def _quiet(d: Column) -> Column:
    return (E.rank(d["severity"]) < 2) & (F.size(d["signals"]) > 0)


def _sentence(parts: list[Column]) -> Column:
    return F.array_join(F.array(*parts), " ")  # nulls are left out


def narrative(names: list[str], found: Column, sev: Column) -> Column:
    """The text of a profile, of the levels, summaries and signals that assess() gives for each name."""
    level, listed = (lambda n: E.rank(F.col(f"_l_{n}"))), (lambda parts, by: F.array_join(F.array(*parts), by))
    title = lambda n: F.col(f"_h_{n}")
    quiet = listed([F.when((level(n) < 2) & F.col(f"_a_{n}"), title(n)) for n in names], ", ")
    raised = listed([F.when(level(n) >= 2, _cat(_lit("["), title(n), _lit("] "), F.col(f"_s_{n}"))) for n in names], " ")
    told = F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda f: _cat(f["name"], _lit(": "), f["description"])), "; "))
    return _sentence([
        _cat(_lit("Overall risk: "), F.upper(sev), _lit(".")),
        F.when(F.size(found) > 0, _cat(F.size(found).cast("string"), _lit(" hard flag(s) — "), told, _lit("."))),
        F.when(raised != "", raised),
        F.when(quiet != "", _cat(_lit("Low-severity signals in: "), quiet, _lit("."))),
        _lit("Action is advisory only — compliance officer makes the final call."),
    ])


def _of_profile(p, raised: Column, quiet: Column, clean: Column) -> list[Column]:
    """The sentences of a rationale on a profile, whose fields p gives."""
    return [
        _cat(_lit("OVERALL RISK: "), F.upper(p("overall_severity")), _lit(" (score "), E.fixed(p("overall_score"), 3), _lit(").")),
        F.when(F.size(p("flags")) > 0, _cat(F.size(p("flags")).cast("string"), _lit(" hard flag(s): "), F.array_join(F.transform(p("flags"), lambda f: _cat(_lit("["), F.upper(f["severity"]), _lit("] "), f["description"])), "; "), _lit("."))),
        F.when(raised != "", _cat(_lit("Elevated dimensions: "), raised)),
        F.when(quiet != "", _cat(_lit("Low-severity dimensions with signals: "), quiet, _lit("."))),
        F.when(clean != "", _cat(_lit("No concerns in: "), clean, _lit("."))),
        _cat(_lit("System's advisory suggestion: "), F.upper(p("advisory_action")), _lit(" (confidence "), E.fixed(p("advisory_confidence"), 2), _lit("). Compliance officer makes the final call.")),
    ]


def auto_block(m: Column, settings: Screening) -> Column:
    return m["exact_match"] | (m["score"] >= settings.entity_block)


def routed(settings: Screening) -> tuple[Column, Column, Column]:
    """Branch number, action and reason: the first of eight rules that holds."""
    hits, matches, c, risk = F.col("hits"), F.coalesce(F.col("matches"), F.array()), F.col("classification"), F.col("risk")
    conf, label = c["confidence"], c["label"]
    sure = conf >= settings.approve_confidence
    branch = (
        F.when(F.size(hits) > 0, 1)
        .when(F.exists(matches, lambda m: auto_block(m, settings)), 2)
        .when(risk["score"] == 5, 3)
        .when(F.size(matches) > 0, 4)
        .when((label == "restricted") & (conf >= settings.block_confidence), 5)
        .when((label == "allowed") & sure & (risk.isNull() | (risk["score"] <= 3)), 6)
        .when((label == "allowed") & sure & (risk["score"] == 4), 7)
        .otherwise(8)
    )
    action = F.when(branch.isin(1, 2, 5), "block").when(branch == 6, "approve").otherwise("manual_review")
    of_hit = lambda h: F.when(E.present(h["matched_keyword"]), _cat(_lit("keyword '"), h["matched_keyword"], _lit("'"))).otherwise(_cat(_lit("phrase '"), h["matched_phrase"], _lit("' (score="), E.fixed(h["similarity_score"], 3), _lit(")")))
    best, n3 = best_match(matches), E.fixed(conf, 3)
    blocked = F.array_join(F.transform(F.filter(matches, lambda m: auto_block(m, settings)), lambda m: _cat(m["role"], _lit(" '"), m["input_party"], _lit("' -> '"), m["matched_party"], _lit("' (score "), E.fixed(m["score"], 3), _lit(")"))), ", ")
    reason = (
        F.when(branch == 1, _cat(_lit("Taxonomy hit: "), F.array_join(F.transform(hits, lambda h: h["group_name"]), ", "), _lit(" — "), F.array_join(F.transform(hits, of_hit), "; ")))
        .when(branch == 2, _cat(_lit("Denied party match: "), blocked))
        .when(branch == 3, _cat(_lit("Critical risk tier ("), E.fixed(risk["raw_score"], 3), _lit("); escalated to manual review")))
        .when(branch == 4, _cat(_lit("Possible denied-party match: "), best["role"], _lit(" '"), best["input_party"], _lit("' ~ '"), best["matched_party"], _lit("' at score "), E.fixed(best["score"], 3)))
        .when(branch == 5, _cat(_lit("AI classified as restricted with confidence "), n3))
        .when(branch == 6, _cat(_lit("AI classified as allowed with confidence "), n3))
        .when(branch == 7, _cat(_lit("AI allows (conf "), n3, _lit(") but risk tier HIGH — escalated to manual review")))
        .otherwise(F.when(c.isNull() | label.isNull(), "Uncertain: no AI classification").otherwise(_cat(_lit("Uncertain: AI classified as "), label, _lit(" with confidence "), F.coalesce(n3, _lit("n/a")), _lit(" (below threshold)"))))
    )
    return branch, action, reason


def rationale(settings: Screening, with_profile: bool = True, values: Column | None = None, told: Column | None = None) -> Column:
    """Text that explains a decision row (id, description, action, reason, and what they rest on).

    values is the text of the legacy signals' values where rows have the columns that legacy_values() reads; else risk has the signals. told is
    the column that profile() makes by that name; without it risk_profile is read.
    """
    head = _cat(_lit("Shipment "), F.col("id"), _lit(' ("'), F.coalesce(E.preview(F.col("description")), _lit("")), _lit('") was screened through the hybrid pipeline.'))
    if with_profile and told is not None:
        body = [told]
    elif with_profile:
        p = F.col("risk_profile")
        listed = lambda d: F.when(F.size(d["signals"]) > 0, _cat(_lit(" Evidence: "), F.array_join(F.transform(d["signals"], lambda s: s["evidence"]), "; "), _lit("."))).otherwise("")
        raised = F.array_join(F.transform(F.filter(p["dimensions"], _elevated), lambda d: _cat(_lit("["), d["dimension"], _lit(" / "), d["severity"], _lit("] "), d["summary"], listed(d))), " ")
        quiet, clean = _names(p["dimensions"], _quiet), _names(p["dimensions"], lambda d: (E.rank(d["severity"]) == 0) & (F.size(d["signals"]) == 0))
        body = _of_profile(lambda name: p[name], raised, quiet, clean)
    else:
        hits, c, matches, risk = F.col("decided_hits"), F.col("classification"), F.col("matches"), F.col("risk")
        of_hit = lambda h: F.when(E.present(h["matched_keyword"]), _cat(_lit("matched hard keyword '"), h["matched_keyword"], _lit("' in group '"), h["group_name"], _lit("' (risk: "), h["risk_level"], _lit(")"))).otherwise(_cat(_lit("matched semantic phrase '"), h["matched_phrase"], _lit("' in group '"), h["group_name"], _lit("' at similarity "), E.fixed(h["similarity_score"], 3), _lit(" (risk: "), h["risk_level"], _lit(")")))
        of_match = lambda m: _cat(m["role"], _lit(" '"), m["input_party"], _lit("' matched denied party '"), m["matched_party"], _lit("' ("), F.when(m["exact_match"], "exact match").otherwise(_cat(_lit("fuzzy match at "), E.fixed(m["score"], 3))), _lit(", list: "), m["list_name"], _lit(")"))
        if values is None:
            values = F.array_join(F.transform(risk["signals"], lambda s: _cat(s["name"], _lit("="), E.fixed(s["value"], 2))), ", ")
        body = [
            F.when(F.size(hits) > 0, _cat(_lit("Layer 1 (Taxonomy) produced "), F.size(hits).cast("string"), _lit(" hit(s): "), F.array_join(F.transform(hits, of_hit), "; "), _lit(". Taxonomy hits are non-negotiable and always result in BLOCK."))),
            F.when(c.isNotNull(), _cat(_lit("Layer 2 (AI Classifier) classified the shipment as "), F.upper(c["label"]), _lit(" with confidence "), E.fixed(c["confidence"], 3), _lit("."))),
            F.when(F.size(matches) > 0, _cat(_lit("Entity resolution found "), F.size(matches).cast("string"), _lit(" match(es): "), F.array_join(F.transform(matches, of_match), "; "), _lit("."))),
            F.when(risk.isNotNull(), _cat(_lit("Multi-feature risk assessment: tier "), risk["score"].cast("string"), _lit(" (raw score "), E.fixed(risk["raw_score"], 3), _lit("); contributing signals: "), F.when(values == "", "none").otherwise(values), _lit("."))),
        ]
    tail = _cat(_lit("Advisory action (officer-owned decision): "), F.upper(F.col("action")), _lit(". Reason: "), F.col("reason"))
    return _sentence([head, *body, tail])


def audit(rows: DataFrame, settings: Screening) -> DataFrame:
    """Adds model_version, classifier_type and thresholds_snapshot (JSON)."""
    snapshot = {
        "taxonomy": settings.similarity,
        "routing": {"auto_approve_min_confidence": settings.approve_confidence, "auto_block_min_confidence": settings.block_confidence},
        "entity_resolution": {"enabled": True, "auto_block_threshold": settings.entity_block, "review_threshold": settings.fuzzy_match},
    }
    return rows.withColumns({"model_version": _lit(f"{settings.model_version};classifier={settings.classifier}"), "classifier_type": _lit(settings.classifier), "thresholds_snapshot": _lit(json.dumps(snapshot))})


def disagreements(decisions: DataFrame) -> DataFrame:
    """Events of taxonomy hits on items that the classifier allows (rows with all_hits and classification)."""
    return decisions.where((F.size("all_hits") > 0) & (F.col("classification.label") == "allowed")).select("shipment_id", _lit("block").alias("taxonomy_action"), F.col("classification.label").alias("ai_action"), F.col("classification.confidence").alias("ai_confidence"), E.preview(F.col("description"), 200).alias("description"))
