"""SQL that computes the same rows as the queries, for comparison on small tables."""

from __future__ import annotations

import re

from cargosift.config import COUNTRIES, COUNTRY_LEVELS, DUAL_USE_CHAPTERS, DUAL_USE_KEYWORDS, HYPOTHESES, PARTIES, PROFILE_WEIGHTS, TIERS
from cargosift.plans import bridge
from cargosift.plans.bridge import DUCK_SQL

_q = lambda s: "'" + str(s).replace("'", "''") + "'"

COUNTRY_CTE = "country(code, cname, level, score, sanctions, fatf, hub, neighbors) AS (VALUES " + ", ".join(
    f"({_q(c['country_code'])}, {_q(c['country_name'])}, {_q(c['overall_risk'])}, CAST({c['overall_score']} AS DOUBLE), {_q(c['sanctions_status'])}, {_q(c['fatf_status'])}, {str(c['transshipment_hub']).lower()}, CAST([{', '.join(map(_q, c['sanctioned_neighbors']))}] AS VARCHAR[]))" for c in COUNTRIES
) + ")"
FACTS_CTE = """near AS (SELECT c.code, count(*) AS n FROM (SELECT code, unnest(neighbors) AS nb FROM country) c JOIN country k ON k.code = c.nb AND k.sanctions <> 'none' GROUP BY c.code),
facts AS (
  SELECT c.code, cname, level, score, sanctions, fatf, hub, sanctions <> 'none' AS sanctioned, fatf IN ('grey', 'black') AS listed, level IN ('high', 'critical') AS high,
    CASE level """ + " ".join(f"WHEN {_q(k)} THEN CAST({v} AS DOUBLE)" for k, v in COUNTRY_LEVELS.items()) + """ END AS lv, coalesce(near.n, 0) AS near
  FROM country c LEFT JOIN near ON near.code = c.code)"""
SHIP = f"ship AS ({DUCK_SQL})"


def tier(code: str) -> str:
    return f"(CASE upper({code}) " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in TIERS.items()) + " ELSE 0 END)"


def severity(x: str) -> str:
    return f"(CASE WHEN {x} >= 0.80 THEN 'critical' WHEN {x} >= 0.60 THEN 'high' WHEN {x} >= 0.40 THEN 'medium' WHEN {x} >= 0.15 THEN 'low' ELSE 'none' END)"


def sig(name: str, when: str, value: str, weight: float) -> str:
    name = name if name.startswith("'") or "||" in name else _q(name)
    return f"CASE WHEN coalesce({when}, false) THEN {{'n': {name}, 'v': CAST({value} AS DOUBLE), 'w': CAST({weight} AS DOUBLE)}} END"


def listed(*each: str) -> str:
    return "list_filter([" + ", ".join(each) + "], lambda s: s IS NOT NULL)"


def clean(c: str) -> str:
    return f"replace(trim({c}), '.', '')"


PARTS = "regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')"


def name_of(c: str) -> str:
    return f"trim({PARTS.format(c=c)})"


def _lcs(s: str, t: str) -> str:
    """Longest common subsequence of two lists of characters: one row of the table for each character of s."""
    before = "CASE WHEN i > 1 THEN acc[i - 1] ELSE 0 END"
    cell = f"greatest(acc[j], list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN {t}[i] = x[1] THEN {before} + 1 ELSE 0 END)))"
    return f"coalesce(list_max(list_reduce(list_transform({s}, lambda c: [c]), lambda acc, x: list_transform(range(1, len({t}) + 1), lambda j: {cell}), list_transform({t}, lambda c: CAST(0 AS BIGINT)))), 0)"


_LISTED = ", ".join(f"({1000 * i + n}, {_q(p['name'])}, {_q(alias)})" for i, p in enumerate(PARTIES) for n, alias in enumerate([p["name"], *p["aliases"]]))
_words = lambda c: f"list_sort(list_distinct(string_split({c}, ' ')))"
MATCHED_CTE = f"""listed AS (SELECT ord, party, {name_of('alias')} AS lkey FROM (VALUES {_LISTED}) AS v(ord, party, alias)),
names AS (SELECT DISTINCT key FROM (SELECT {name_of('consignee')} AS key FROM ship UNION ALL SELECT {name_of('shipper')} FROM ship) WHERE key <> ''),
worded AS (SELECT *, {_words('key')} AS a, {_words('lkey')} AS b FROM names, listed),
split AS (SELECT *, list_filter(a, lambda x: list_contains(b, x)) AS c, list_filter(a, lambda x: NOT list_contains(b, x)) AS l, list_filter(b, lambda x: NOT list_contains(a, x)) AS r FROM worded),
spaced AS (SELECT *, array_to_string(list_concat(c, l), ' ') AS s, array_to_string(list_concat(c, r), ' ') AS t, length(array_to_string(c, ' ')) AS m FROM split),
comparable AS MATERIALIZED (SELECT key, ord, string_split(s, '') AS cs, string_split(t, '') AS ct FROM spaced WHERE 2 * least(length(s), length(t)) >= 0.8 * (length(s) + length(t))),
ratios AS (SELECT key, ord, 2.0 * CAST({_lcs('cs', 'ct')} AS DOUBLE) / (len(cs) + len(ct)) AS ratio FROM comparable),
scored_names AS (SELECT spaced.key, spaced.ord, party, spaced.key = lkey AS exact, CASE WHEN len(c) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 1.0
  ELSE greatest(coalesce(ratio, 0), CASE WHEN m > 0 THEN greatest(2.0 * m / (m + length(s)), 2.0 * m / (m + length(t))) ELSE 0 END) END AS score FROM spaced LEFT JOIN ratios ON ratios.key = spaced.key AND ratios.ord = spaced.ord),
matched AS MATERIALIZED (SELECT key, party, exact, CASE WHEN exact THEN 1.0 ELSE score END AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY key ORDER BY exact DESC, score DESC, CASE WHEN exact THEN -ord ELSE ord END) AS n FROM scored_names WHERE exact OR score >= 0.8) WHERE n = 1)"""


def match(m: str, role: str) -> str:
    return f"CASE WHEN {m}.key IS NOT NULL THEN {{'role': {_q(role)}, 'score': CAST({m}.score AS DOUBLE), 'exact': {m}.exact}} END"


_ESC = [k.replace("-", "\\-") for k in DUAL_USE_KEYWORDS]
WORDS = "list_sort(list_distinct(list_transform(regexp_extract_all(description, '(?i)\\b(" + "|".join(_ESC) + ")\\b', 1), lambda x: lower(x))))"
_exp = "exp(l{i} - greatest(l0, l1, l2))"
_P = [f"({_exp.format(i=i)} / ({' + '.join(_exp.format(i=j) for j in range(3))}))" for i in range(3)]
PROBS = ", ".join(f"{p} AS p{i}" for i, p in enumerate(_P))

WIDE = f"""wide0 AS (SELECT *, {PROBS} FROM ship),
wide AS (
  SELECT s.*, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'allowed' WHEN p1 >= p2 THEN 'restricted' ELSE 'needs_review' END AS label,
    {{'c': o.code, 'lv': o.lv, 'score': o.score, 'sanctioned': o.sanctioned, 'listed': o.listed, 'fatf': o.fatf}} AS oc,
    {{'c': d.code, 'lv': d.lv, 'score': d.score, 'sanctioned': d.sanctioned, 'listed': d.listed, 'fatf': d.fatf, 'near': d.near}} AS dc, coalesce(e.sanctioned, false) AS end_sanctioned,
    {listed(match('mc', 'consignee'), match('ms', 'shipper'))} AS matches, {WORDS} AS words,
    {listed("CASE WHEN contains(lower(description), 'ak47') THEN 'ak47' END", "CASE WHEN contains(lower(description), 'ivory') THEN 'ivory' END")} AS hits,
    CASE WHEN regexp_matches(replace({clean('hs_code')}, ' ', ''), '^[0-9]{{2}}') THEN left(replace({clean('hs_code')}, ' ', ''), 2) END AS chapter
  FROM wide0 s LEFT JOIN facts o ON o.code = upper(trim(s.origin_country)) LEFT JOIN facts d ON d.code = upper(trim(s.destination_country)) LEFT JOIN facts e ON e.code = upper(trim(s.final_destination))
    LEFT JOIN matched mc ON mc.key = {name_of('consignee')} LEFT JOIN matched ms ON ms.key = {name_of('shipper')})"""

ROUND = "(declared_value > 0 AND (declared_value % 10000 < 0.01 * declared_value OR declared_value % 10000 > 0.99 * 10000))"


def _geo(role: str, c: str) -> list[str]:
    code = f"{role}_country"
    return [
        sig(f"{role}_country_risk", f"{c}.c IS NOT NULL AND greatest({c}.lv, {c}.score) > 0", f"greatest({c}.lv, {c}.score)", 1),
        sig(f"{role}_country_sanctioned", f"{c}.sanctioned", "1", 2),
        sig(f"'{role}_fatf_' || {c}.fatf", f"{c}.listed", f"CASE WHEN {c}.fatf = 'black' THEN 0.8 ELSE 0.6 END", 1),
        sig(f"'{role}_country_tier_' || CAST({tier(code)} AS VARCHAR)", f"{code} IS NOT NULL AND {c}.c IS NULL AND {tier(code)} > 0", f"least({tier(code)} / 4.0, 1.0)", 1),
    ]


def _diff(a: str, b: str) -> str:
    return f"(coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' AND upper({a}) <> upper({b}))"


_MISSING = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in ("origin_country", "destination_country", "consignee", "shipper", "declared_value", "hs_code"))
_PREFIX = f"(CASE WHEN starts_with({clean('hs_code')}, '93') THEN '93' WHEN starts_with({clean('hs_code')}, '36') THEN '36' WHEN starts_with({clean('hs_code')}, '28') THEN '28' END)"
SIGNALS = {
    "goods": "list_concat(list_transform(hits, lambda h: {'n': 'taxonomy_keyword', 'v': CAST(1 AS DOUBLE), 'w': CAST(2 AS DOUBLE)}), " + listed(sig("classifier_restricted", "label = 'restricted'", "conf", 1), sig("classifier_needs_review", "label = 'needs_review'", "conf * 0.6", 1)) + ")",
    "party": "list_concat(list_transform(matches, lambda m: CASE WHEN m.exact THEN {'n': 'denied_party_exact', 'v': CAST(1 AS DOUBLE), 'w': CAST(2 AS DOUBLE)} WHEN m.score >= 0.92 THEN {'n': 'denied_party_high_fuzzy', 'v': m.score, 'w': CAST(1.5 AS DOUBLE)} ELSE {'n': 'denied_party_fuzzy', 'v': m.score * 0.8, 'w': CAST(1 AS DOUBLE)} END), " + listed(sig("no_party_information", "consignee IS NULL AND shipper IS NULL", "0.3", 0.5)) + ")",
    "geography": listed(*_geo("origin", "oc"), *_geo("destination", "dc"), sig("missing_origin", "origin_country IS NULL", "0.3", 0.3), sig("missing_destination", "destination_country IS NULL", "0.3", 0.3)),
    "valuation": listed(sig("missing_declared_value", "declared_value IS NULL", "0.3", 1), sig("nonpositive_value", "declared_value <= 0", "0.7", 1), sig("very_high_value", "declared_value >= 1000000", "1", 1.5), sig("high_value", "declared_value >= 100000 AND declared_value < 1000000", "0.7", 1), sig("suspiciously_round_value", ROUND, "0.5", 0.8), sig("missing_currency", "declared_value IS NOT NULL AND declared_currency IS NULL", "0.25", 0.3)),
    "hs_code": listed(sig("missing_hs_code", "hs_code IS NULL", "0.3", 1), sig("malformed_hs_code", f"hs_code IS NOT NULL AND NOT regexp_full_match({clean('hs_code')}, '[0-9]{{4,}}')", "0.5", 1), sig(f"'sensitive_hs_prefix_' || {_PREFIX}", f"{_PREFIX} IS NOT NULL", "1", 1.5)),
    "data_quality": listed(sig("missing_fields", f"{_MISSING} > 0", f"({_MISSING}) / 6.0", 1), sig("very_short_description", "length(trim(description)) < 10", "0.6", 1), sig("zero_weight_positive_value", "weight_kg <= 0 AND coalesce(declared_value, 0) > 0", "0.5", 1), sig("origin_equals_destination", "upper(origin_country) = upper(destination_country)", "0.3", 0.5)),
    "model_uncertainty": listed(sig("classifier_uncertainty", "true", "least(greatest(0.0, 1.0 - conf) * 1.5, 1.0)", 1), sig("classifier_needs_review", "label = 'needs_review'", "0.7", 1)),
    "dual_use": listed(sig("dual_use_keyword", "len(words) > 0", "least(0.4 + 0.2 * len(words), 1.0)", 1.5), sig("dual_use_hs_chapter", f"left({clean('hs_code')}, 2) IN ({', '.join(map(_q, DUAL_USE_CHAPTERS))})", "0.4", 0.8)),
    "cross_border": "list_concat(coalesce(legs, []), " + listed(sig("diversion_risk_sanctioned_neighbor", "dc.near > 0", "0.75", 1.8), sig("manufacture_origin_mismatch", _diff("country_of_manufacture", "origin_country"), "0.55", 1), sig("final_destination_mismatch", _diff("final_destination", "destination_country"), "0.6", 1), sig("final_destination_sanctioned", _diff("final_destination", "destination_country") + " AND end_sanctioned", "1", 2.5), sig("many_transit_stops", "len(transit_countries) >= 2", "least(0.3 + 0.15 * len(transit_countries), 1.0)", 0.6)) + ")",
}
FORCED = {"goods": "taxonomy_keyword", "party": "denied_party_exact"}
LEGS = f"""route AS (
  SELECT id, unnest(list_filter(list_concat([{{'c': origin_country, 'r': 'origin'}}], list_transform(transit_countries, lambda t: {{'c': t, 'r': 'transit'}}),
      [{{'c': destination_country, 'r': 'destination'}}, {{'c': CASE WHEN coalesce(upper(final_destination) <> upper(destination_country), true) THEN final_destination END, 'r': 'final_destination'}},
       {{'c': CASE WHEN coalesce(upper(country_of_manufacture) <> upper(origin_country), true) THEN country_of_manufacture END, 'r': 'manufacture'}}]), lambda l: coalesce(l.c, '') <> '')) AS leg,
    unnest(range(0, len(list_filter(list_concat([origin_country], transit_countries, [destination_country, CASE WHEN coalesce(upper(final_destination) <> upper(destination_country), true) THEN final_destination END, CASE WHEN coalesce(upper(country_of_manufacture) <> upper(origin_country), true) THEN country_of_manufacture END]), lambda c: coalesce(c, '') <> '')))) AS pos
  FROM ship),
leg_signals AS (
  SELECT id, pos, CASE WHEN f.sanctioned THEN {{'n': 'sanctioned_' || leg.r, 'v': CAST(1 AS DOUBLE), 'w': CAST(2.5 AS DOUBLE)}}
      WHEN f.listed THEN {{'n': 'fatf_listed_' || leg.r, 'v': CAST(CASE WHEN f.fatf = 'black' THEN 0.75 ELSE 0.55 END AS DOUBLE), 'w': CAST(1.5 AS DOUBLE)}}
      WHEN f.high THEN {{'n': 'high_risk_transit_' || leg.r, 'v': f.lv, 'w': CAST(1.5 AS DOUBLE)}} END AS a,
    CASE WHEN f.hub AND leg.r IN ('transit', 'destination') THEN {{'n': 'transshipment_hub_' || leg.r, 'v': CAST(0.45 AS DOUBLE), 'w': CAST(0.8 AS DOUBLE)}} END AS b
  FROM route JOIN facts f ON f.code = upper(trim(leg.c))),
legs AS (SELECT id, list_filter(flatten(list([a, b] ORDER BY pos)), lambda s: s IS NOT NULL) AS legs FROM leg_signals GROUP BY id)"""


def score_of(s: str) -> str:
    total = f"list_sum(list_transform({s}, lambda x: x.w))"
    return f"(CASE WHEN len({s}) = 0 THEN 0.0 ELSE least(list_sum(list_transform({s}, lambda x: x.v * x.w)) / {total}, 1.0) END)"


def _ctes(*more: str) -> str:
    return "WITH " + ",\n".join([SHIP, COUNTRY_CTE, FACTS_CTE, MATCHED_CTE, WIDE, LEGS, *more])


def _dimension_ctes(names) -> list[str]:
    sigs = ", ".join(f"{SIGNALS[n]} AS s_{n}" for n in names)
    out = [f"signalled AS (SELECT w.*, {sigs} FROM (SELECT wide.*, legs.legs FROM wide LEFT JOIN legs ON legs.id = wide.id) w)"]
    scores = ", ".join(f"{score_of(f's_{n}')} AS x_{n}" for n in names)
    out.append(f"scored AS (SELECT *, {scores} FROM signalled)")
    levels = []
    for n in names:
        level = severity(f"x_{n}")
        if n in FORCED:
            level = f"CASE WHEN list_contains(list_transform(s_{n}, lambda x: x.n), {_q(FORCED[n])}) THEN 'critical' ELSE {level} END"
        if n == "cross_border":
            level = f"CASE WHEN len(list_filter(s_{n}, lambda x: starts_with(x.n, 'sanctioned_') OR x.n = 'final_destination_sanctioned')) > 0 THEN 'critical' ELSE {level} END"
        levels.append(f"{level} AS sev_{n}")
    out.append(f"graded AS (SELECT *, {', '.join(levels)} FROM scored)")
    return out


def dimension(n: str) -> str:
    return f"{_ctes(*_dimension_ctes([n]))}\nSELECT id, sev_{n} AS severity, round(x_{n}, 6) AS score, array_to_string(list_transform(s_{n}, lambda x: x.n), ',') AS signals FROM graded"


_RANK = lambda x: f"(CASE {x} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"
_ALL = list(SIGNALS)
_TOTAL = " + ".join(f"x_{n} * {PROFILE_WEIGHTS[n]}" for n in _ALL)
_TOP = "greatest(" + ", ".join(_RANK(f"sev_{n}") for n in _ALL) + ", CASE WHEN len(list_filter(matches, lambda m: m.exact)) > 0 THEN 4 WHEN len(list_filter(matches, lambda m: m.score >= 0.92)) > 0 THEN 3 ELSE 0 END)"
PROFILE = f"""{_ctes(*_dimension_ctes(_ALL))},
topped AS (SELECT id, {_TOP} AS top, least(({_TOTAL}) / {sum(PROFILE_WEIGHTS.values())}, 1.0) AS score, len(hits) + len(list_filter(matches, lambda m: m.exact OR m.score >= 0.92)) AS n_flags FROM graded)
SELECT id, ['none', 'low', 'medium', 'high', 'critical'][top + 1] AS overall_severity, round(score, 4) AS overall_score, n_flags,
  CASE WHEN top = 4 THEN 'block' WHEN top >= 2 THEN 'manual_review' ELSE 'approve' END AS advisory_action,
  CAST(CASE top WHEN 4 THEN 0.90 WHEN 3 THEN 0.75 WHEN 2 THEN 0.60 WHEN 1 THEN 0.80 ELSE 0.90 END AS DOUBLE) AS advisory_confidence FROM topped"""

_LEG = [
    sig("origin_country", f"{tier('origin_country')} > 0", f"least({tier('origin_country')} / 4.0, 1.0)", 0.25),
    sig("destination_country", f"{tier('destination_country')} > 0", f"least({tier('destination_country')} / 4.0, 1.0)", 0.25),
    sig("high_value", "declared_value >= 100000", "least(declared_value / 1000000, 1.0)", 0.15),
    sig("round_value", ROUND, "0.5", 0.10),
    sig("sensitive_hs", "starts_with(hs_code, '93') OR starts_with(hs_code, '36') OR starts_with(hs_code, '28')", "1", 0.15),
    sig("missing_fields", "origin_country IS NULL OR destination_country IS NULL OR consignee IS NULL OR declared_value IS NULL", " + ".join(f"CAST({c} IS NULL AS INTEGER) / 4.0" for c in ("origin_country", "destination_country", "consignee", "declared_value")), 0.10),
]
_RAW = "least(coalesce(list_sum(list_transform(s, lambda x: x.v * x.w)), 0.0), 1.0)"
_TIER = lambda r: f"(CASE WHEN {r} >= 0.80 THEN 5 WHEN {r} >= 0.60 THEN 4 WHEN {r} >= 0.40 THEN 3 WHEN {r} >= 0.20 THEN 2 ELSE 1 END)"
LEGACY_CTE = f"legacy AS (SELECT id, destination_country, round({_RAW}, 9) AS raw, s FROM (SELECT *, {listed(*_LEG)} AS s FROM ship))"
BRANCH = f"""{_ctes(LEGACY_CTE)},
branched AS (SELECT w.id, w.label, CASE WHEN len(hits) > 0 THEN 1 WHEN len(list_filter(matches, lambda m: m.exact OR m.score >= 0.92)) > 0 THEN 2 WHEN {_TIER('l.raw')} = 5 THEN 3 WHEN len(matches) > 0 THEN 4
  WHEN label = 'restricted' AND conf >= 0.90 THEN 5 WHEN label = 'allowed' AND conf >= 0.90 AND {_TIER('l.raw')} <= 3 THEN 6 WHEN label = 'allowed' AND conf >= 0.90 AND {_TIER('l.raw')} = 4 THEN 7 ELSE 8 END AS branch,
  len(hits) AS n_hits, conf, description, destination_country FROM (SELECT wide.* EXCLUDE (destination_country), wide.destination_country FROM wide) w JOIN (SELECT id, raw FROM legacy) l ON l.id = w.id),
acted AS (SELECT *, CASE WHEN branch IN (1, 2, 5) THEN 'block' WHEN branch = 6 THEN 'approve' ELSE 'manual_review' END AS action FROM branched)"""

_PSI = "CAST(sum((a - e) * ln(a / e)) AS DOUBLE)"
_BASE = "ts < TIMESTAMP '2024-01-15'"
HIST = f"""WITH e AS (SELECT list_transform(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9)) AS edges FROM events WHERE {_BASE}),
b AS (SELECT len(list_filter(edges, lambda x: x <= round(value, 9))) AS bin, {_BASE} AS base FROM events, e WHERE value IS NOT NULL),
h AS (SELECT CAST(r.bin AS INTEGER) AS bin, CAST(coalesce(sum(CAST(base AS INTEGER)), 0) AS BIGINT) AS n_base, CAST(coalesce(sum(CAST(NOT base AS INTEGER)), 0) AS BIGINT) AS n_current FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin)"""
_SH = "SELECT greatest(n_base / (SELECT sum(n_base) FROM h), 1e-6) AS e, greatest(n_current / (SELECT sum(n_current) FROM h), 1e-6) AS a FROM h"
CAT = f"h AS (SELECT event_type, count(*) FILTER (WHERE {_BASE}) AS n_base, count(*) FILTER (WHERE NOT ({_BASE})) AS n_current FROM events GROUP BY event_type)"
_dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_cos = lambda a, b: f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"
PAIRS = f"pairs AS (SELECT f.vec_id AS row_id, p.vec_id AS phrase_idx, p.label AS grp, {_cos('f.embedding', 'p.embedding')} AS sim FROM embeddings f, embeddings p WHERE f.vec_id >= 40 AND p.vec_id < 40)"
_dist = lambda a, b: f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)))"

_hyp = lambda h: "[" + ", ".join(map(_q, dict.fromkeys(w for w in re.split("[^a-z0-9]+", h.lower()) if w))) + "]"
_told = lambda h: f"len(list_filter({_hyp(h)}, lambda w: list_contains(said, w))) / CAST(len({_hyp(h)}) AS DOUBLE)"
_METRICS = "WITH r AS (SELECT quality AS y, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS p FROM labels)"
_GATED = "(SELECT coalesce(CAST(count(*) FILTER (WHERE y = 0 AND p = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE p = 0), 0), 0) AS pr, coalesce(CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0), 0) AS re FROM r)"

SQL: dict[str, str] = {
    "op_J15_hypotheses": f"WITH {SHIP}, w AS (SELECT id, string_split_regex(lower(description), '[^a-z0-9]+') AS said FROM ship), s AS (SELECT id, {', '.join(f'exp({_told(h)}) AS e{i}' for i, h in enumerate(HYPOTHESES))} FROM w) SELECT id, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 'allowed' WHEN e1 >= e2 THEN 'restricted' ELSE 'needs_review' END AS label, round(greatest(e0, e1, e2) / (e0 + e1 + e2), 6) AS confidence FROM s",
    "op_DR1_baseline": f"""{_ctes()}, q AS (SELECT list_transform(quantile_cont(conf, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9)) AS edges FROM wide),
binned AS (SELECT len(list_filter(edges, lambda x: x <= round(conf, 9))) + 1 AS bin FROM wide, q)
SELECT 'size' AS part, 'all' AS name, CAST(count(*) AS DOUBLE) AS value FROM ship
UNION ALL SELECT 'edge', CAST(i AS VARCHAR), round(edges[i], 6) FROM q, range(1, 10) AS t(i)
UNION ALL SELECT 'bin', CAST(i AS VARCHAR), CAST(count(bin) AS DOUBLE) FROM range(1, 11) AS t(i) LEFT JOIN binned ON bin = i GROUP BY i
UNION ALL SELECT 'label', label, CAST(count(*) AS DOUBLE) FROM wide GROUP BY label
UNION ALL SELECT 'rate', CASE g WHEN 'ak47' THEN 'military_and_dual_use' ELSE 'restricted_biology_and_wildlife' END, round(count(*) / CAST((SELECT count(*) FROM ship) AS DOUBLE), 6) FROM (SELECT unnest(hits) AS g FROM wide) GROUP BY g""",
    "op_A14_gate": f"{_METRICS} SELECT pr >= 0.95 AND re >= 0.98 AS passed, array_to_string(list_filter([CASE WHEN pr < 0.95 THEN 'allow_precision' END, CASE WHEN re < 0.98 THEN 'restricted_recall' END], lambda x: x IS NOT NULL), ',') AS failures FROM {_GATED}",
    "op_X1_stream_screen": BRANCH + " SELECT id, branch, action FROM acted",
    "op_S1_shipments": f"WITH {SHIP} SELECT id, description, origin_country, destination_country, consignee, shipper, declared_value, declared_currency, hs_code, weight_kg, array_to_string(transit_countries, ',') AS transit, country_of_manufacture, final_destination FROM ship",
    "op_S11_decision_counts": BRANCH + " SELECT action, count(*) AS n, CAST(sum(CASE WHEN branch = 1 THEN n_hits ELSE 0 END) AS BIGINT) AS hits FROM acted GROUP BY action",
    "op_A5_tier_by_destination": f"WITH {SHIP}, {LEGACY_CTE} SELECT destination_country, {_TIER('raw')} AS tier, count(*) AS n, round(avg(raw), 6) AS avg_raw FROM legacy GROUP BY ALL",
    "op_A2_legacy_raw": f"WITH {SHIP}, {LEGACY_CTE} SELECT id, round(raw, 6) AS raw FROM legacy",
    "op_R1_legacy_risk": f"WITH {SHIP}, {LEGACY_CTE} SELECT id, {_TIER('raw')} AS tier, round(raw, 6) AS raw, array_to_string(list_transform(s, lambda x: x.n), ',') AS signals FROM legacy",
    "op_A19_missing_fields": f"WITH {SHIP} SELECT {_MISSING} AS missing, count(*) AS n FROM ship GROUP BY ALL",
    "op_F9_round_value": f"WITH {SHIP} SELECT coalesce({ROUND}, false) AS is_round, count(*) AS n, round(sum(coalesce(declared_value, 0)), 2) AS total FROM ship GROUP BY ALL",
    "op_F3_hs_fields": _ctes() + f" SELECT hs_code, chapter, coalesce(regexp_full_match({clean('hs_code')}, '[0-9]{{4,}}'), false) AS well_formed, {_PREFIX} AS prefix, CAST(count(*) AS BIGINT) AS n FROM wide GROUP BY ALL",
    "op_F14_dual_use_words": _ctes() + " SELECT id, array_to_string(words, ',') AS words FROM wide WHERE len(words) > 0",
    "op_F1_names": f"WITH {SHIP} SELECT consignee, {name_of('consignee')} AS name, count(*) AS n FROM ship GROUP BY ALL",
    "op_F26_country_facts": f"WITH {COUNTRY_CTE}, {FACTS_CTE} SELECT s_suppkey, code AS country_code, sanctioned AS is_sanctioned, listed AS is_fatf_listed, high AS is_high_risk, CAST(near AS INTEGER) AS n_near FROM supplier JOIN facts ON code = ([{', '.join(repr(c) for c in bridge.CODES)}])[CAST(s_nationkey % {len(bridge.CODES)} AS INTEGER) + 1]",
    "op_T1_keyword_hits": _ctes() + " SELECT id, array_to_string(hits, ',') AS keywords FROM wide WHERE len(hits) > 0",
    "op_A6_hit_rates": _ctes() + " SELECT CASE g WHEN 'ak47' THEN 'military_and_dual_use' ELSE 'restricted_biology_and_wildlife' END AS group_id, round(count(*) / CAST((SELECT count(*) FROM ship) AS DOUBLE), 9) AS rate FROM (SELECT unnest(hits) AS g FROM wide) GROUP BY g",
    "op_C1_classify": _ctes() + " SELECT id, label, round(conf, 6) AS confidence FROM wide",
    "op_J6_party_matches": _ctes() + " SELECT id, array_to_string(list_transform(matches, lambda m: m.role), ',') AS roles, round(list_max(list_transform(matches, lambda m: m.score)), 6) AS best FROM wide WHERE len(matches) > 0",
    "op_J2_country_lookup": f"WITH {SHIP}, {COUNTRY_CTE} SELECT level, count(*) AS n FROM ship LEFT JOIN country ON code = upper(trim(origin_country)) GROUP BY ALL",
    "op_J3_route_legs": f"{_ctes()} SELECT leg.r AS role, f.code AS code, count(*) AS n FROM route JOIN facts f ON f.code = upper(trim(leg.c)) GROUP BY ALL",
    **{f"op_D{i}_{n}": dimension(n) for i, n in enumerate(SIGNALS, 1)},
    "op_PR1_profile": PROFILE,
    "op_RT1_router": BRANCH + " SELECT id, branch, action FROM acted",
    "op_S11_decision_csv": BRANCH + " SELECT id AS shipment_id, action, CAST(CASE WHEN branch = 1 THEN n_hits ELSE 0 END AS INTEGER) AS taxonomy_hits_count, label AS classification_label, round(conf, 4) AS confidence, true AS reasoned FROM acted",
    "op_S10_decision_json": BRANCH + " SELECT id AS shipment_id, action, CAST(CASE WHEN branch = 1 THEN n_hits ELSE 0 END AS INTEGER) AS taxonomy_hits_count, label AS classification_label, round(conf, 4) AS confidence FROM acted",
    "op_S12_split_files": "WITH n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.1) AS BIGINT) AS tenth FROM documents JOIN labels USING (doc_id)) SELECT split, CASE split WHEN 'train' THEN n - 2 * tenth ELSE tenth END AS n FROM n, (VALUES ('train'), ('val'), ('test')) AS s(split)",
    "op_S17_log": BRANCH + " SELECT 'WARNING' AS level, 'screening_disagreement' AS event, id AS shipment_id, label AS ai_action, round(conf, 6) AS ai_confidence FROM acted WHERE n_hits > 0 AND label = 'allowed'",
    "op_LG1_disagreements": BRANCH + " SELECT id AS shipment_id, label AS ai_action, round(conf, 6) AS ai_confidence FROM acted WHERE n_hits > 0 AND label = 'allowed'",
    "op_FB1_record": BRANCH + " SELECT id AS shipment_id, label AS ai_decision, CAST(CAST(conf AS DECIMAL(4, 3)) AS DOUBLE) AS ai_confidence, branch = 1 AS taxonomy_hit, action AS final_decision FROM acted",
    "op_AL1_margin": f"WITH {SHIP}, p AS (SELECT id, list_reverse_sort([{', '.join(_P)}]) AS s, [{', '.join(_P)}] AS p FROM ship), m AS (SELECT id, 1 - (s[1] - s[2]) AS margin, -list_sum(list_transform(p, lambda x: least(greatest(x, 1e-12), 1.0) * ln(least(greatest(x, 1e-12), 1.0)))) AS entropy FROM p) SELECT id, round(margin, 6) AS margin, round(entropy, 6) AS entropy, round(0.5 * margin / (SELECT max(margin) FROM m) + 0.5 * entropy / (SELECT max(entropy) FROM m), 6) AS informativeness FROM m",
    "op_A7_quantile_edges": f"SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS nth, unnest(list_transform(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 6))) AS edge FROM events WHERE {_BASE}",
    "op_A8_histogram": HIST + " SELECT bin, n_base, n_current FROM h",
    "op_A9_psi": HIST + f" SELECT round({_PSI}, 9) AS psi FROM ({_SH})",
    "op_A10_label_psi": f"WITH {CAT} SELECT round({_PSI}, 9) AS psi FROM ({_SH})",
    "op_J13_label_counts": f"WITH {CAT} SELECT event_type, n_base, n_current FROM h",
    "op_A11_centroid": f"WITH x AS (SELECT label < 5 AS b, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings), m AS (SELECT pos, avg(CAST(v AS DOUBLE)) FILTER (WHERE b) AS p, avg(CAST(v AS DOUBLE)) FILTER (WHERE NOT b) AS q FROM x GROUP BY pos) SELECT round(sqrt(sum((q - p) ** 2)), 6) AS centroid_shift FROM m",
    "op_DR2_drift_report": HIST + f", c AS (SELECT {_PSI} AS psi FROM ({_SH})), {CAT.replace('h AS', 'h2 AS')}, l AS (SELECT {_PSI} AS psi FROM ({_SH.replace('FROM h', 'FROM h2')})) SELECT round(c.psi, 9) AS psi_confidence, round(l.psi, 9) AS label_psi, c.psi >= 0.25 OR l.psi >= 0.25 AS significant FROM c, l",
    "op_T2_semantic_hits": f"WITH {PAIRS}, b AS (SELECT row_id, grp, max(sim) AS sim, arg_max(phrase_idx, (sim, -phrase_idx)) AS phrase_idx FROM pairs GROUP BY ALL) SELECT row_id, CAST(grp AS VARCHAR) AS group_id, phrase_idx, round(sim, 6) AS similarity FROM b WHERE sim >= 0.3",
    "op_AI1_top_chapters": f"WITH {PAIRS}, r AS (SELECT row_id, phrase_idx, sim, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, phrase_idx DESC) AS rank FROM pairs) SELECT row_id, CAST(rank AS INTEGER) AS rank, phrase_idx AS chapter, round(sim, 6) AS similarity FROM r WHERE rank <= 3",
    "op_AI2_declared": f"SELECT f.vec_id AS row_id, p.vec_id AS chapter, round({_cos('f.embedding', 'p.embedding')}, 6) AS similarity FROM embeddings f JOIN embeddings p ON p.vec_id = f.vec_id % 45 AND p.vec_id < 40 WHERE f.vec_id >= 40",
    "op_AI3_dual_use": f"WITH {PAIRS} SELECT row_id, array_to_string(list(CAST(phrase_idx AS VARCHAR) ORDER BY sim DESC, phrase_idx), ',') AS concepts FROM pairs WHERE sim >= 0.25 GROUP BY row_id",
    "op_AL4_diverse": f"WITH e AS (SELECT vec_id AS id, embedding AS v, abs(CAST(embedding[1] AS DOUBLE)) AS w FROM embeddings), p1 AS (SELECT * FROM e ORDER BY w DESC, id LIMIT 1), d1 AS (SELECT e.*, {_dist('e.v', 'p1.v')} AS d FROM e, p1 WHERE e.id <> p1.id), p2 AS (SELECT * FROM d1 ORDER BY w * d DESC, id LIMIT 1), d2 AS (SELECT d1.id, d1.v, d1.w, least(d1.d, {_dist('d1.v', 'p2.v')}) AS d FROM d1, p2 WHERE d1.id <> p2.id), p3 AS (SELECT * FROM d2 ORDER BY w * d DESC, id LIMIT 1) SELECT id, 1 AS pick FROM p1 UNION ALL SELECT id, 2 FROM p2 UNION ALL SELECT id, 3 FROM p3",
    "op_FB2_reviewed": "WITH l AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 12, '0') DESC) AS n FROM events) SELECT event_id, user_id % 3 = 0 AND n = 1 AS reviewed FROM l",
    "op_FB3_disagreements": "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10",
    "op_FB4_labelled": "SELECT event_id, CAST(CAST(value / 1000 AS DECIMAL(4, 3)) AS DOUBLE) AS confidence FROM events WHERE user_id % 3 = 0 AND CAST(value / 1000 AS DECIMAL(4, 3)) >= 0.1",
    "op_FB5_baselines": "WITH r AS (SELECT event_type AS name, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT name, event_id FROM r WHERE n = 1",
    "op_TR1_split_sizes": "WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'test' AS split, CAST(floor(n * 0.1) AS BIGINT) AS n FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.1) AS BIGINT) FROM n UNION ALL SELECT 'train', n - 2 * CAST(floor(n * 0.1) AS BIGINT) FROM n",
    "op_A13_class_metrics": "WITH r AS (SELECT quality AS y, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS p FROM labels), c AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS class), t AS (SELECT class, CAST(count(*) FILTER (WHERE y = class AND p = class) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p = class) AS DOUBLE) AS pp, count(*) FILTER (WHERE y = class) AS support FROM c, r GROUP BY class), m AS (SELECT class, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re, support FROM t) SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support FROM m",
    "op_X3_rolling_drift": f"""WITH b AS (SELECT value FROM events WHERE {_BASE} AND value IS NOT NULL),
e AS (SELECT list_transform(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9)) AS edges FROM b),
nb AS (SELECT len(list_filter(edges, lambda x: x <= round(value, 9))) AS bin, count(*) AS n FROM b, e GROUP BY ALL),
w AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS window_start, len(list_filter(edges, lambda x: x <= round(value, 9))) AS bin FROM events, e, range(0, 7) r(k) WHERE NOT ({_BASE}) AND value IS NOT NULL),
nw AS (SELECT window_start, bin, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT window_start, sum(n) AS n FROM nw GROUP BY ALL),
s AS (SELECT t.window_start, t.n, greatest(coalesce(nb.n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM nb), 1e-6) AS e, greatest(coalesce(nw.n, 0) / CAST(t.n AS DOUBLE), 1e-6) AS a
  FROM t CROSS JOIN range(0, 10) g(bin) LEFT JOIN nb ON nb.bin = g.bin LEFT JOIN nw ON nw.window_start = t.window_start AND nw.bin = g.bin)
SELECT window_start, CAST(n AS BIGINT) AS n, round(sum((a - e) * ln(a / e)), 6) AS psi FROM s GROUP BY window_start, n""",
    "op_X4_review_stream": "WITH l AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 12, '0') DESC) AS n FROM events) SELECT event_id, CASE WHEN user_id % 3 = 0 AND n = 1 THEN 'r3' WHEN user_id % 6 = 0 AND n = 2 THEN 'r6' END AS reviewer_id, CASE WHEN (user_id % 3 = 0 AND n = 1) OR (user_id % 6 = 0 AND n = 2) THEN 'block' ELSE event_type END AS final_decision FROM l",
    "op_X2_window_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "op_F21_parsers": f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 18 = 17 THEN CAST(p_size AS VARCHAR) ELSE ([{", ".join(repr(c) for c in bridge.CELLS)}])[CAST(p_partkey % 18 AS INTEGER) + 1] END AS cell FROM part)
SELECT p_partkey, cell, CASE WHEN lower(trim(cell)) IN ('severe', 'very high', 'critical') THEN 'critical' WHEN lower(trim(cell)) = 'high' THEN 'high' WHEN lower(trim(cell)) IN ('moderate', 'medium') THEN 'medium' WHEN lower(trim(cell)) IN ('minimal', 'very low', 'low') THEN 'low' ELSE 'unknown' END AS level,
 lower(trim(cell)) IN ('1', 'true', 'yes', 'y', 't') AS flag, least(greatest(CASE WHEN coalesce(TRY_CAST(cell AS DOUBLE), 0) > 1 THEN TRY_CAST(cell AS DOUBLE) / 100 ELSE coalesce(TRY_CAST(cell AS DOUBLE), 0) END, 0.0), 1.0) AS share,
 CASE WHEN lower(trim(cell)) IN ('comprehensive', 'sanctioned', 'full', 'total') THEN 'comprehensive' WHEN lower(trim(cell)) IN ('sectoral', 'partial', 'sector') THEN 'sectoral' ELSE 'none' END AS sanctions,
 CASE WHEN lower(trim(cell)) IN ('black', 'blacklist', 'increased monitoring') THEN 'black' WHEN lower(trim(cell)) IN ('grey', 'greylist', 'enhanced monitoring') THEN 'grey' WHEN lower(trim(cell)) IN ('compliant', 'clear', 'ok', '') THEN 'compliant' ELSE 'unknown' END AS fatf FROM v""",
}
SQL["op_W11_batch_scores"] = SQL["op_J15_hypotheses"]
SQL |= {k: SQL["op_S1_shipments"] for k in ("op_S1_json_source", "op_S2_csv_source")}
