"""The nine risk dimensions, each a struct column (dimension, severity, score, signals, summary).

A dimension is a list of conditional signals in a fixed order, their weighted mean, and a summary. The wide row
holds the shipment's columns, hits, classification, matches, ai, and places (country facts, see with_places).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargosift.config import DUAL_USE_CHAPTERS, DUAL_USE_KEYWORDS, HS_CHAPTERS, Screening
from cargosift.functions import expressions as E
from cargosift.scratch import compiled

_col, _lit, _cat = F.col, F.lit, F.concat


@dataclass(frozen=True)
class Slot:
    """A signal that counts where its condition holds."""

    name: Column | str
    when: Column
    value: Column | float
    weight: Column | float
    evidence: Column | str

    def signal(self) -> Column:
        return E.signal(self.name, self.when, self.value, self.weight, self.evidence)

    def holds(self) -> Column:
        return F.coalesce(self.when, _lit(False))


First = tuple[Slot, ...]  # alternatives: the first that holds is the signal


def first(*slots: Slot) -> First:
    return slots


def _group(part: Slot | First) -> First:
    return (part,) if isinstance(part, Slot) else part


def _chosen(group: First, value: Callable[[Slot], Column]) -> Column:
    """The value of the first slot that holds, null without one."""
    return F.coalesce(*[F.when(s.holds(), value(s)) for s in group])


def _weight(s: Slot) -> Column:
    return s.weight.cast("double") if isinstance(s.weight, Column) else _lit(float(s.weight))


def _product(s: Slot) -> Column:
    return (s.value.cast("double") if isinstance(s.value, Column) else _lit(float(s.value))) * _weight(s)


@dataclass(frozen=True)
class Each:
    """Signals of every element of an array that is mostly empty; some tells whether there is one."""

    items: Column
    of: Callable[[Column], list[First]]
    some: Column


@dataclass(frozen=True)
class Assessment:
    """The parts of a dimension: its signals in order, the summary of (whether there is a signal, the level), and what makes it critical."""

    dimension: str
    parts: list[Slot | First | Each]
    summary: Callable[[Column, Column], Column]
    force: Column | None = None


Assessor = Callable[[Screening], Assessment | Column]


def _added(each: Each, value: Callable[[Slot], Column]) -> Callable[[Column, Column], Column]:
    held = lambda group: reduce(lambda x, y: x | y, [s.holds() for s in group])
    return lambda acc, x: sum((F.when(held(g), _chosen(g, value)).otherwise(0.0) for g in each.of(x)), acc)


def _named(s: Slot) -> Column:
    return F.when(s.holds(), F.array(s.name if isinstance(s.name, Column) else _lit(s.name)))


def _told(s: Slot) -> Column:
    return F.when(s.holds(), F.array(s.evidence if isinstance(s.evidence, Column) else _lit(s.evidence)))


def evidence(assessor: Assessor, settings: Screening, made: Column) -> Column:
    """The texts of a dimension's signals, of made (its struct) where the assessor gives no parts."""
    a = assessor(settings)
    return _found(a.parts, _told) if isinstance(a, Assessment) else F.transform(made["signals"], lambda s: s["evidence"])


def _found(parts: list[Slot | First | Each], one: Callable[[Slot], Column] = Slot.signal) -> Column:
    """The array of the signals that hold, in order, or of what else is made of each (a list of one, null where it does not hold)."""
    of_group = lambda g: F.coalesce(*[one(s) for s in g])
    of_each = lambda each: lambda x: E.signals(*[of_group(g) for g in each.of(x)])
    out: list[Column] = []
    fixed: list[Column] = []
    for p in [*parts, None]:
        if not isinstance(p, Each) and p is not None:
            fixed.append(of_group(_group(p)))
            continue
        if fixed:
            out.append(E.signals(*fixed))
            fixed = []
        if p is not None:
            made = F.flatten(F.transform(p.items, of_each(p)))
            out.append(F.when(F.coalesce(F.size(p.items) == 0, _lit(False)), F.array()).otherwise(made))
    return F.concat(*out) if len(out) > 1 else out[0]


def assess(rows: DataFrame, settings: Screening, chosen: Mapping[str, Assessor]) -> DataFrame:
    """Adds _d_, _h_, _v_, _l_, _a_, _s_ and _t_ and name for each assessor, which gives an Assessment or a whole struct column: the dimension, its title, its score, its level, whether it has a signal, its summary and its signals' names.

    Every fixed signal is two numbers, its weight (null where it does not hold) and value times weight, and scores and levels are made of
    these alone in generated code. Names and evidence are in the arrays of the dimensions, which Spark leaves out where nobody asks for them.
    """
    compiled(rows.sparkSession)
    made = {n: f(settings) for n, f in chosen.items()}
    parts = {n: a for n, a in made.items() if isinstance(a, Assessment)}
    fixed = [(f"{n}_{i}", _group(g)) for n, a in parts.items() for i, g in enumerate(a.parts) if not isinstance(g, Each)]
    out = rows.withColumns({f"_w_{k}": _chosen(g, _weight) for k, g in fixed} | {f"_p_{k}": _chosen(g, _product) for k, g in fixed})

    def total(n: str, a: Assessment, kind: str, value: Callable[[Slot], Column]) -> Column:
        out = _lit(0.0)
        for i, g in enumerate(a.parts):
            if isinstance(g, Each):
                none = F.coalesce(F.size(g.items) == 0, _lit(False))
                out = F.when(none, out).otherwise(F.aggregate(g.items, out, _added(g, value)))
            else:
                out = out + F.when(_col(f"_w_{n}_{i}").isNotNull(), _col(f"_{kind}_{n}_{i}")).otherwise(0.0)
        return out

    any_of = lambda n, a: reduce(lambda x, y: x | y, [F.coalesce(g.some, _lit(False)) if isinstance(g, Each) else _col(f"_w_{n}_{i}").isNotNull() for i, g in enumerate(a.parts)])
    out = out.withColumns({f"_a_{n}": any_of(n, a) for n, a in parts.items()} | {f"_n_{n}": total(n, a, "p", _product) for n, a in parts.items()} | {f"_m_{n}": total(n, a, "w", _weight) for n, a in parts.items()})
    out = out.withColumns({f"_v_{n}": F.when(_col(f"_m_{n}") > 0, F.least(_col(f"_n_{n}") / _col(f"_m_{n}"), _lit(1.0))).otherwise(0.0) for n in parts})
    level = lambda n, a: E.severity(_col(f"_v_{n}")) if a.force is None else F.when(F.coalesce(a.force, _lit(False)), "critical").otherwise(E.severity(_col(f"_v_{n}")))
    out = out.withColumns({f"_l_{n}": level(n, a) for n, a in parts.items()})
    whole = lambda n, a: F.struct(_lit(a.dimension).alias("dimension"), _col(f"_l_{n}").alias("severity"), _col(f"_v_{n}").alias("score"), _found(a.parts).alias("signals"), _col(f"_s_{n}").alias("summary"))
    out = out.withColumns({f"_s_{n}": a.summary(_col(f"_a_{n}"), _col(f"_l_{n}")) for n, a in parts.items()})
    out = out.withColumns({f"_d_{n}": whole(n, a) if n in parts else a for n, a in made.items()})
    given = [n for n in made if n not in parts]
    out = out.withColumns({f"_{x}_{n}": _col(f"_d_{n}.{field}") for n in given for x, field in (("h", "dimension"), ("v", "score"), ("l", "severity"), ("s", "summary"))} | {f"_a_{n}": F.size(f"_d_{n}.signals") > 0 for n in given})
    out = out.withColumns({f"_h_{n}": _lit(a.dimension) for n, a in parts.items()} | {f"_t_{n}": _found(a.parts, _named) for n, a in parts.items()} | {f"_t_{n}": _col(f"_d_{n}.signals.name") for n in given})
    return out.drop(*[f"_{x}_{k}" for k, _ in fixed for x in "wp"], *[f"_{x}_{n}" for n in parts for x in "nm"])


COUNTRIES = 10_000  # rows that a country table may have
FACTS = ("country_code", "country_name", "overall_risk", "overall_score", "sanctions_status", "fatf_status", "transshipment_hub", "near_sanctioned", "is_sanctioned", "is_fatf_listed", "is_high_risk", "source")
ROLES = {"origin": "origin_country", "destination": "destination_country", "final": "final_destination", "maker": "country_of_manufacture"}


def _code(c: Column) -> Column:
    return F.upper(E.strip(c))


def _stops() -> Column:
    return F.filter(F.coalesce(_col("transit_countries"), F.array().cast("array<string>")), E.present)


SLOTS = 1024  # parts of the lookup of stops, so that one code is looked for among a few


def with_places(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Adds places: the facts of the countries of origin, destination, final destination and maker, and of the stops.

    Facts are null where a code is unknown. The table is read once; one of more than COUNTRIES rows is no table of countries and raises.
    Facts come from a constant in the plan, so that no join is left where nobody reads them.
    """
    table = countries.select(*FACTS, F.pmod(F.hash("country_code"), _lit(SLOTS)).alias("_slot"))
    listed = table.limit(COUNTRIES + 1).collect()
    if len(listed) > COUNTRIES:
        raise ValueError(f"more than {COUNTRIES} countries")
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for r in listed:
        slots[r["_slot"]][r["country_code"]] = {x: r[x] for x in FACTS}
    kind = "array<map<string," + table.select(F.struct(*FACTS).alias("f")).schema["f"].dataType.simpleString() + ">>"
    known = F.from_json(_lit(json.dumps(slots)), kind)
    fact = lambda code: F.try_element_at(F.get(known, F.pmod(F.hash(code), _lit(SLOTS))), code)
    out = rows.withColumns({f"_p_{r}": _code(_col(c)) for r, c in ROLES.items()})
    out = out.withColumns({f"_p_{r}": fact(_col(f"_p_{r}")) for r in ROLES})
    return out.withColumn("places", F.struct(*[_col(f"_p_{r}").alias(r) for r in ROLES], F.transform(_stops(), lambda c: fact(_code(c))).alias("stops"))).drop(*[f"_p_{r}" for r in ROLES])


def _sentences(none: str | None, critical: str, high: str, medium: str, other: str, clear: str | None = None):
    def text(some: Column, level: Column) -> Column:
        out = F.when(level == "critical", critical).when(level == "high", high).when(level == "medium", medium)
        out = out.when(level == "low", other).otherwise(clear if clear is not None else other)
        return out if none is None else F.when(~some, none).otherwise(out)

    return text


def _labelled(none: Column | str, label: str):
    return lambda some, level: F.when(~some, none).otherwise(_cat(_lit(label + " "), level, _lit(".")))


def tier(code: Column, settings: Screening) -> Column:
    """Configured tier of a country code, 0 if none; letters of any case, spaces count."""
    if not settings.tiers:
        return _lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*[_lit(x) for pair in settings.tiers.items() for x in pair]), F.upper(code)), _lit(0))  # upper case is made once


def goods(settings: Screening) -> Column:
    c = _col("classification")

    def of_hit(h: Column) -> list[First]:
        sim = F.coalesce(h["similarity_score"], _lit(0.0))
        word = Slot("taxonomy_keyword", E.present(h["matched_keyword"]), 1.0, 2.0, _cat(_lit("Hard keyword '"), h["matched_keyword"], _lit("' matched taxonomy group '"), h["group_name"], _lit("'")))
        phrase = Slot("taxonomy_semantic", E.present(h["matched_phrase"]), F.least(sim + 0.1, _lit(1.0)), 1.5, _cat(_lit("Semantic phrase '"), h["matched_phrase"], _lit("' matched taxonomy group '"), h["group_name"], _lit("' at similarity "), E.fixed(sim, 3)))
        return [first(word, phrase)]

    conf = c["confidence"]
    verdicts = [
        Slot("classifier_restricted", c["label"] == "restricted", conf, 1.0, _cat(_lit("AI classifier labeled the item as 'restricted' (confidence "), E.fixed(conf, 3), _lit(")"))),
        Slot("classifier_needs_review", c["label"] == "needs_review", conf * 0.6, 1.0, _cat(_lit("AI classifier flagged the item as 'needs review' (confidence "), E.fixed(conf, 3), _lit(")"))),
    ]
    hits = Each(_col("hits"), of_hit, F.exists("hits", lambda h: E.present(h["matched_keyword"]) | E.present(h["matched_phrase"])))
    text = _sentences("No goods-related risk detected.", "Goods classification indicates a prohibited or highly restricted item.", "Goods classification strongly suggests a restricted item.", "Goods classification raises moderate concerns.", "Minor goods-classification signals present.")
    return Assessment("goods", [hits, *verdicts], text, F.exists("hits", lambda h: E.present(h["matched_keyword"])))


def party(settings: Screening) -> Column:
    def of_match(m: Column) -> list[First]:
        who = _cat(E.capital(m["role"]), _lit(" '"), m["input_party"])
        score = E.fixed(m["score"], 3)
        exact = Slot("denied_party_exact", m["exact_match"], 1.0, 2.0, _cat(who, _lit("' is an EXACT match to denied party '"), m["matched_party"], _lit("' on list '"), m["list_name"], _lit("'")))
        high = Slot("denied_party_high_fuzzy", m["score"] >= 0.92, m["score"], 1.5, _cat(who, _lit("' closely resembles denied party '"), m["matched_party"], _lit("' (score "), score, _lit(")")))
        low = Slot("denied_party_fuzzy", _lit(True), m["score"] * 0.8, 1.0, _cat(who, _lit("' fuzzily matches denied party '"), m["matched_party"], _lit("' (score "), score, _lit(")")))
        return [first(exact, high, low)]

    none = Slot("no_party_information", _col("consignee").isNull() & _col("shipper").isNull(), 0.3, 0.5, "No consignee or shipper information provided")
    text = _sentences("No party / denied-list concerns detected.", "Exact denied-party match on a shipment party.", "Close fuzzy match to a denied party.", "Possible denied-party match requiring investigation.", "Low-confidence or secondary party concerns.", "No party concerns.")
    return Assessment("party", [Each(_col("matches"), of_match, F.size("matches") > 0), none], text, F.exists("matches", lambda m: m["exact_match"]))


def geography(settings: Screening) -> Column:
    def of_role(role: str) -> list[Slot]:
        code = _col(f"{role}_country")
        c, t = _col("places")[role], tier(code, settings)
        up = F.upper(code)
        name = F.coalesce(c["country_name"], c["country_code"])
        who = _cat(_lit(f"{role.capitalize()} country "), name, _lit(" ("), c["country_code"], _lit(")"))
        value = F.greatest(E.level_value(c["overall_risk"]), c["overall_score"])
        return [
            Slot(f"{role}_country_risk", value > 0, value, 1.0, _cat(who, _lit(" has "), c["overall_risk"], _lit(" overall risk (score "), E.fixed(c["overall_score"], 2), _lit(", source "), c["source"], _lit(")"))),
            Slot(f"{role}_country_sanctioned", c["is_sanctioned"], 1.0, 2.0, _cat(who, _lit(" carries "), c["sanctions_status"], _lit(" sanctions"))),
            Slot(_cat(_lit(f"{role}_fatf_"), c["fatf_status"]), c["is_fatf_listed"], F.when(c["fatf_status"] == "black", 0.8).otherwise(0.6), 1.0, _cat(who, _lit(" is on the FATF "), c["fatf_status"], _lit(" list"))),
            Slot(_cat(_lit(f"{role}_country_tier_"), t.cast("string")), code.isNotNull() & c["country_code"].isNull() & (t > 0), F.least(t / 4.0, _lit(1.0)), 1.0, _cat(_lit(f"{role.capitalize()} country "), up, _lit(" is configured as tier "), t.cast("string"), _lit(" (of 4)"))),
        ]

    found = [*of_role("origin"), *of_role("destination"), *[Slot(f"missing_{r}", _col(f"{r}_country").isNull(), 0.3, 0.3, f"{r.capitalize()} country not provided") for r in ("origin", "destination")]]
    o, d = _col("origin_country"), _col("destination_country")
    way = F.array_join(F.array(F.when(E.present(o), _cat(_lit("from "), F.upper(o))), F.when(E.present(d), _cat(_lit("to "), F.upper(d)))), " ")
    way = F.when(way == "", "route unspecified").otherwise(way)
    return Assessment("geography", found, lambda some, level: F.when(~some, "No geography information available or no elevated country risk.").otherwise(_cat(_lit("Geography risk "), level, _lit(" ("), way, _lit(")."))))


def valuation(settings: Screening) -> Column:
    v = _col("declared_value")
    money = lambda c: F.format_string("%,.2f", c)
    over = lambda limit: _cat(_lit("Declared value "), money(v), _lit(f" exceeds {limit:,.2f}"))
    found = [
        Slot("missing_declared_value", v.isNull(), 0.3, 1.0, "Declared value not provided"),
        Slot("nonpositive_value", v <= 0, 0.7, 1.0, _cat(_lit("Declared value is "), v.cast("string"), _lit(" (non-positive)"))),
        Slot("very_high_value", v >= settings.very_high_value, 1.0, 1.5, over(settings.very_high_value)),
        Slot("high_value", (v >= settings.high_value) & (v < settings.very_high_value), 0.7, 1.0, over(settings.high_value)),
        Slot("suspiciously_round_value", E.is_round(v, 0.01, settings.round_base), 0.5, 0.8, _cat(_lit("Declared value "), money(v), _lit(" is suspiciously round (TBML indicator)"))),
        Slot("missing_currency", v.isNotNull() & _col("declared_currency").isNull(), 0.25, 0.3, "Declared currency not provided"),
    ]
    return Assessment("valuation", found, _labelled("No valuation concerns.", "Valuation risk"))


def _title(chapter: Column, missing: str) -> Column:
    titles = F.create_map(*[_lit(x) for pair in HS_CHAPTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, chapter), _lit(missing))


def hs_code(settings: Screening) -> Column:
    hs, ai = _col("hs_code"), _col("ai")
    clean, chapter = E.hs_clean(hs), E.hs_chapter(hs)
    prefix = E.first_prefix(clean, [p.replace(".", "") for p in settings.sensitive_prefixes])
    top, own = ai["hs_predictions"], ai["declared_similarity"]
    judged = F.coalesce(F.size(top) > 0, _lit(False)) & chapter.isNotNull()
    absent = judged & ~F.exists(top, lambda p: p["chapter"] == chapter)
    gap = F.greatest(F.get(top, _lit(0))["similarity"] - F.coalesce(own, _lit(0.0)), _lit(0.0))
    declared = _cat(_lit("Declared HS chapter "), chapter, _lit(" ("), _title(chapter, "unknown"), _lit(")"))
    n = F.size(top).cast("string")
    listed = F.array_join(F.transform(top, lambda p: _cat(p["chapter"], _lit(" ("), p["title"], _lit(": "), E.fixed(p["similarity"], 2), _lit(")"))), ", ")
    found = [
        Slot("missing_hs_code", hs.isNull(), 0.3, 1.0, "No HS code provided"),
        Slot("malformed_hs_code", hs.isNotNull() & ~E.hs_well_formed(hs), 0.5, 1.0, _cat(_lit("HS code '"), hs, _lit("' does not appear well-formed"))),
        Slot(_cat(_lit("sensitive_hs_prefix_"), prefix), prefix.isNotNull(), 1.0, 1.5, _cat(_lit("HS code "), hs, _lit(" matches sensitive chapter '"), prefix, _lit("'"))),
        Slot("hs_declared_not_in_top_k", absent, F.least(0.5 + gap * 1.5, _lit(1.0)), 2.0, _cat(declared, _lit(" is not in AI top-"), n, _lit(" predictions. AI top-"), n, _lit(": ["), listed, _lit("]. Declared chapter similarity: "), F.coalesce(E.fixed(own, 2), _lit("n/a")))),
        Slot("hs_low_declared_similarity", judged & ~absent & (own < 0.30), F.least(0.3 + (0.30 - own) * 2, _lit(1.0)), 1.0, _cat(declared, _lit(" has low semantic similarity to description ("), E.fixed(own, 2), _lit(")"))),
    ]
    return Assessment("hs_code", found, _labelled(_cat(_lit("HS code "), hs, _lit(" presents no elevated concerns.")), "HS code risk"))


ESSENTIAL = ("origin_country", "destination_country", "consignee", "shipper", "declared_value", "hs_code")


def data_quality(settings: Screening) -> Column:
    missing = E.signals(*[F.when(_col(c).isNull(), F.array(_lit(c))) for c in ESSENTIAL])
    k = F.size(missing)
    length = F.length(E.strip(F.coalesce(_col("description"), _lit(""))))
    o, d, w, v, own = _col("origin_country"), _col("destination_country"), _col("weight_kg"), _col("declared_value"), _col("ai")["declared_similarity"]
    chapter = E.hs_chapter(_col("hs_code"))
    found = [
        Slot("missing_fields", k > 0, k / float(len(ESSENTIAL)), 1.0, _cat(k.cast("string"), _lit(f" of {len(ESSENTIAL)} critical fields missing: "), F.array_join(missing, ", "))),
        Slot("very_short_description", length < 10, 0.6, 1.0, _cat(_lit("Description is only "), length.cast("string"), _lit(" characters"))),
        Slot("zero_weight_positive_value", (w <= 0) & (F.coalesce(v, _lit(0.0)) > 0), 0.5, 1.0, _cat(_lit("Weight is "), w.cast("string"), _lit(" but declared value is "), v.cast("string"))),
        Slot("origin_equals_destination", E.present(o) & E.present(d) & (F.upper(o) == F.upper(d)), 0.3, 0.5, _cat(_lit("Origin and destination are both "), F.upper(o), _lit(" (possible mislabeling)"))),
        Slot("description_hs_incoherent", E.present(_col("hs_code")) & (own < 0.35), F.least(0.3 + (0.35 - own) * 2, _lit(1.0)), 1.0, _cat(_lit("Description is semantically incoherent with declared HS chapter "), F.coalesce(chapter, _lit("None")), _lit(" ("), _title(chapter, "unknown"), _lit(") — coherence score "), E.fixed(own, 2))),
    ]
    return Assessment("data_quality", found, _labelled("Shipment record is complete and coherent.", "Data-quality risk"))


def model_uncertainty(settings: Screening) -> Column:
    c = _col("classification")
    doubt = F.greatest(_lit(0.0), 1.0 - c["confidence"])
    found = [
        Slot("no_classifier_output", c.isNull(), 0.8, 1.0, "AI classifier produced no result"),
        Slot("classifier_uncertainty", c.isNotNull(), F.least(doubt * 1.5, _lit(1.0)), 1.0, _cat(_lit("Classifier confidence is "), E.fixed(c["confidence"], 3), _lit(" (uncertainty "), E.fixed(doubt, 3), _lit(")"))),
        Slot("classifier_needs_review", c["label"] == "needs_review", 0.7, 1.0, "Classifier explicitly flagged for review"),
    ]
    text = _sentences(None, "AI model is highly uncertain about this shipment.", "AI model confidence is low — human judgment recommended.", "AI model confidence is moderate.", "AI model is reasonably confident.", "AI model is highly confident.")
    return Assessment("model_uncertainty", found, text)


def dual_use(settings: Screening) -> Column:
    words = E.keyword_set(F.coalesce(_col("description"), _lit("")), DUAL_USE_KEYWORDS)
    chapter = F.substring(E.hs_clean(_col("hs_code")), 1, 2)
    near = _col("ai")["dual_use"]
    three = F.slice(near, 1, 3)
    found = [
        Slot("dual_use_keyword", F.size(words) > 0, F.least(0.4 + 0.2 * F.size(words), _lit(1.0)), 1.5, _cat(_lit("Description contains dual-use keyword(s): "), F.array_join(words, ", "))),
        Slot("dual_use_hs_chapter", chapter.isin(*DUAL_USE_CHAPTERS), 0.4, 0.8, _cat(_lit("HS chapter "), chapter, _lit(" commonly includes dual-use machinery/electronics"))),
        Slot("ai_dual_use_match", F.size(near) > 0, F.greatest(F.least(0.5 + (F.get(near, _lit(0))["similarity"] - 0.55) * 3.0, _lit(1.0)), _lit(0.5)), 1.8, _cat(_lit("Description is semantically similar to dual-use concept(s): "), F.array_join(F.transform(three, lambda m: _cat(_lit("'"), m["concept"], _lit("' ("), E.fixed(m["similarity"], 2), _lit(")"))), "; "))),
    ]
    return Assessment("dual_use", found, _labelled("No dual-use indicators detected.", "Dual-use risk"))


def route() -> Column:
    """Legs (code, role) in order: origin, transit stops, destination, then a final destination and a maker's country that differ."""
    o, d, f, m = (_col(c) for c in ("origin_country", "destination_country", "final_destination", "country_of_manufacture"))
    leg = lambda c, role: F.array(F.struct(c.alias("code"), _lit(role).alias("role")))
    other = lambda c, base: E.present(c) & (~E.present(base) | (F.upper(c) != F.upper(base)))
    return F.concat(E.signals(F.when(E.present(o), leg(o, "origin"))), F.transform(_stops(), lambda c: F.struct(c.alias("code"), _lit("transit").alias("role"))), E.signals(F.when(E.present(d), leg(d, "destination")), F.when(other(f, d), leg(f, "final_destination")), F.when(other(m, o), leg(m, "manufacture"))))


def cross_border(settings: Screening) -> Column:
    o, d, f, m = (_col(c) for c in ("origin_country", "destination_country", "final_destination", "country_of_manufacture"))

    def of_leg(c: Column, code: Column, role: str, there: Column | None = None) -> list[First]:
        name = _cat(F.coalesce(c["country_name"], code), _lit(" ("), code, _lit(f") as {role}"))
        on = (lambda x: x) if there is None else (lambda x: there & x)
        sanctioned = Slot(f"sanctioned_{role}", on(c["is_sanctioned"]), 1.0, 2.5, _cat(_lit("Route includes sanctioned country "), name, _lit(" ["), c["sanctions_status"], _lit("]")))
        listed = Slot(f"fatf_listed_{role}", on(c["is_fatf_listed"]), F.when(c["fatf_status"] == "black", 0.75).otherwise(0.55), 1.5, _cat(_lit("Route includes FATF "), c["fatf_status"], _lit("-listed country "), name))
        high = Slot(f"high_risk_transit_{role}", on(c["is_high_risk"]), E.level_value(c["overall_risk"]), 1.5, _cat(_lit("Route includes high-risk country "), name))
        hub = Slot(f"transshipment_hub_{role}", on(c["transshipment_hub"]), 0.45, 0.8, _cat(_lit("Route uses known transshipment hub "), name))
        return [first(sanctioned, listed, high), *([first(hub)] if role in ("transit", "destination") else [])]

    places = _col("places")
    near = places["destination"]["near_sanctioned"]
    differs = lambda a, b: E.present(a) & E.present(b) & (F.upper(a) != F.upper(b))
    end = places["final"]
    stops = F.coalesce(F.size(F.coalesce(_col("transit_countries"), F.array().cast("array<string>"))), _lit(0))
    elsewhere = lambda c, base: E.present(c) & (~E.present(base) | (F.upper(c) != F.upper(base)))
    on_way = F.zip_with(_stops(), places["stops"], lambda c, x: F.struct(c.alias("code"), x.alias("fact")))
    risky = lambda x: F.coalesce(x["is_sanctioned"], _lit(False))
    some = F.exists(places["stops"], lambda x: risky(x) | F.coalesce(x["is_fatf_listed"], _lit(False)) | F.coalesce(x["is_high_risk"], _lit(False)) | F.coalesce(x["transshipment_hub"], _lit(False)))
    single = lambda c, role, there, of=None: of_leg(places[of or role], c, role, there)
    legs = [*single(o, "origin", E.present(o)), Each(on_way, lambda x: of_leg(x["fact"], x["code"], "transit"), some), *single(d, "destination", E.present(d)), *single(f, "final_destination", elsewhere(f, d), "final"), *single(m, "manufacture", elsewhere(m, o), "maker")]
    rest = [
        Slot("diversion_risk_sanctioned_neighbor", F.size(near) > 0, 0.75, 1.8, _cat(_lit("Destination "), d, _lit(" borders sanctioned country/ies: "), F.array_join(near, ", "), _lit(" (diversion risk)"))),
        Slot("manufacture_origin_mismatch", differs(m, o), 0.55, 1.0, _cat(_lit("Country of manufacture ("), F.upper(m), _lit(") differs from country of origin ("), F.upper(o), _lit(") — possible re-export pattern"))),
        Slot("final_destination_mismatch", differs(f, d), 0.6, 1.0, _cat(_lit("Final destination ("), F.upper(f), _lit(") differs from immediate destination ("), F.upper(d), _lit(") — multi-leg shipment"))),
        Slot("final_destination_sanctioned", differs(f, d) & end["is_sanctioned"], 1.0, 2.5, _cat(_lit("Declared final destination "), F.upper(f), _lit(" is sanctioned ("), end["sanctions_status"], _lit(")"))),
        Slot("many_transit_stops", stops >= settings.many_transit, F.least(0.3 + 0.15 * stops, _lit(1.0)), 0.6, _cat(_lit("Shipment has "), stops.cast("string"), _lit(" transit stops — route opacity is elevated"))),
    ]
    hops = F.concat(
        E.signals(F.when(E.present(o), F.array(F.upper(o)))),
        F.transform(_stops(), F.upper),
        E.signals(F.when(E.present(d), F.array(F.upper(d))), F.when(E.present(f) & (~E.present(d) | (F.upper(f) != F.upper(d))), F.array(_cat(_lit("→"), F.upper(f), _lit(" (final)"))))),
    )
    way = F.when(F.size(hops) == 0, "route unspecified").otherwise(F.array_join(hops, " → "))
    text = lambda some, level: F.when(~some, "No cross-border routing concerns detected.").otherwise(_cat(_lit("Cross-border risk "), level, _lit(": "), way, _lit(".")))
    here = [E.present(o) & risky(places["origin"]), E.present(d) & risky(places["destination"]), elsewhere(f, d) & risky(places["final"]), elsewhere(m, o) & risky(places["maker"]), F.exists(places["stops"], risky)]
    return Assessment("cross_border", [*legs, *rest], text, reduce(lambda x, y: x | y, here, differs(f, d) & risky(end)))


ASSESSORS: dict[str, Assessor] = {f.__name__: f for f in (goods, party, geography, valuation, hs_code, data_quality, model_uncertainty, dual_use, cross_border)}
