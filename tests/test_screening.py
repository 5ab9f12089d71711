"""Cases of single operators on rows made by hand."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargosift import schemas
from cargosift.config import TAXONOMY, Screening
from cargosift.functions import expressions as E
from cargosift.functions import keywords as K
from cargosift.operators import decisions as D
from cargosift.operators import drift, learning
from cargosift.operators import matching as M
from cargosift.operators import quantiles as Q
from cargosift.operators.feedback import FeedbackLog
from cargosift.plans.engine import Engine
from cargosift.sources import readers
from cargosift.streaming import streams

BLANK = dict.fromkeys(schemas.SHIPMENT.names)


def ship(spark, **kw):
    row = BLANK | {"id": "a", "description": "cotton shirts for retail", "transit_countries": [], "metadata": {}} | kw
    return spark.createDataFrame([tuple(row[n] for n in schemas.SHIPMENT.names)], schemas.SHIPMENT)


CLEAN = dict(origin_country="US", destination_country="CA", consignee="Good Co", shipper="Fine Co", declared_value=5123.0, declared_currency="USD", hs_code="6109.10", weight_kg=500.0)


def dims(spark, logits=None, **kw):
    rows = ship(spark, **kw)
    if logits is not None:
        rows = rows.withColumn("logits", F.array(*[F.lit(float(x)) for x in logits]))
    p = Engine(spark).build_profile(rows).select("risk_profile").first()[0]
    return p, {d.dimension: d for d in p.dimensions}


def test_clean_shipment_is_quiet(spark):
    p, d = dims(spark, (9, 0, 0), **CLEAN)
    assert p.overall_severity in ("none", "low") and p.advisory_action == "approve" and len(d) == 9
    assert d["valuation"].summary == "No valuation concerns."


def test_bare_row_is_critical(spark):
    p, d = dims(spark)
    assert d["data_quality"].score == 1.0 and p.advisory_action == "block" and p.advisory_confidence == 0.9
    assert [s.name for s in d["model_uncertainty"].signals] == ["no_classifier_output"]


def test_route_signals(spark):
    _, d = dims(spark, (9, 0, 0), **CLEAN | {"transit_countries": ["HK", "", "IR"], "final_destination": "SY", "country_of_manufacture": "cn"})
    names = [s.name for s in d["cross_border"].signals]
    assert names == ["transshipment_hub_transit", "sanctioned_transit", "sanctioned_final_destination", "sanctioned_manufacture", "manufacture_origin_mismatch", "final_destination_mismatch", "final_destination_sanctioned", "many_transit_stops"]
    assert d["cross_border"].severity == "critical" and "US → HK → IR → CA → →SY (final)" in d["cross_border"].summary


def test_diversion_does_not_force(spark):
    _, d = dims(spark, (9, 0, 0), **CLEAN | {"destination_country": "TR"})
    assert "diversion_risk_sanctioned_neighbor" in [s.name for s in d["cross_border"].signals] and d["cross_border"].severity != "critical"


def test_dual_use_needs_whole_words(spark):
    _, d = dims(spark, (9, 0, 0), **CLEAN | {"description": "drones and a Drone with LIDAR"})
    assert "drone, lidar" in d["dual_use"].signals[0].evidence


@pytest.mark.parametrize("hs,chapter,ok", [(None, None, None), ("abc", None, False), ("84", "84", False), ("6109.10", "61", True), (" 9301.10", "93", True), ("1", None, False)])
def test_hs(spark, hs, chapter, ok):
    r = ship(spark, hs_code=hs).select(E.hs_chapter(F.col("hs_code")), E.hs_well_formed(F.col("hs_code"))).first()
    assert r[0] == chapter and (r[1] or False) == (ok or False)


def test_legacy_missing_all(spark):
    r = ship(spark).select(D.legacy_risk(Screening()).alias("r"), D.legacy_raw(Screening()).alias("f")).first()
    assert r.r.raw_score == pytest.approx(0.1) and r.r.score == 1 and r.f == pytest.approx(0.1)


def route_row(spark, hits=0, matches=(), tier=None, label="allowed", conf=0.95):
    hit = [("g", "Group", "high", None, "kw", None)] * hits
    risk = None if tier is None else (tier, 0.5)
    schema = f"hits array<{schemas.HIT}>, matches array<{schemas.MATCH}>, classification struct<label:string,confidence:double>, risk struct<score:int,raw_score:double>"
    return spark.createDataFrame([(hit, [("P", "in", "consignee", s, "l", e) for s, e in matches], (label, conf), risk)], schema)


@pytest.mark.parametrize(
    "kw,branch,action",
    [
        (dict(hits=1, matches=[(1.0, True)]), 1, "block"), (dict(matches=[(1.0, True)]), 2, "block"), (dict(matches=[(0.92, False)]), 2, "block"), (dict(tier=5), 3, "manual_review"),
        (dict(matches=[(0.85, False)]), 4, "manual_review"), (dict(label="restricted", conf=0.90), 5, "block"), (dict(conf=0.90), 6, "approve"), (dict(conf=0.90, tier=3), 6, "approve"),
        (dict(tier=4), 7, "manual_review"), (dict(conf=0.89), 8, "manual_review"), (dict(label="needs_review", conf=0.99), 8, "manual_review"),
    ],
)
def test_router(spark, kw, branch, action):
    b, a, reason = D.routed(Screening())
    r = route_row(spark, **kw).select(b.alias("b"), a.alias("a"), reason.alias("r")).first()
    assert (r.b, r.a) == (branch, action) and r.r


def test_parties(spark):
    def best(name):
        m = Engine(spark).resolve_parties(ship(spark, consignee=name)).first().matches
        return (m[0].matched_party, m[0].exact_match, m[0].score) if m else None

    assert best("BLOCKED INDUSTRIES, LTD.") == ("Blocked Industries Ltd", True, 1.0)
    assert best("Blocked Industries Limited")[:2] == ("Blocked Industries Ltd", True)
    typo = best("Blockd Industries Ltd")
    assert typo[1] is False and typo[2] >= 0.8
    assert best("Totally Unrelated Company") is None and best("") is None
    assert best("Ltd")[1:] == (False, 1.0)


def test_token_set():
    assert M.token_set_similarity("a b", "b a c") == 1.0 and M.token_set_similarity("", "a") == 0.0
    assert M.token_set_similarity("blockd industries ltd", "blocked industries ltd") == pytest.approx(42 / 43)


def plain_similarity(a, b):
    """Token-set similarity with the whole table of common subsequences."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (left and right):
        return 1.0

    def ratio(s, t):
        rows = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for i, c in enumerate(s):
            for j, e in enumerate(t):
                rows[i + 1][j + 1] = rows[i][j] + 1 if c == e else max(rows[i][j + 1], rows[i + 1][j])
        return 2 * rows[-1][-1] / (len(s) + len(t))

    s, t, common = " ".join(both + left), " ".join(both + right), " ".join(both)
    return max([ratio(s, t)] + ([ratio(common, s), ratio(common, t)] if both else []))


@pytest.mark.parametrize("threshold,listed", [(0.8, 20_000), (0.6, 20_000), (0.9, 25)])
def test_names_against_every_pair(spark, monkeypatch, threshold, listed):
    """The index loses no match that comparing all names with the whole list finds, in one piece or in several."""
    monkeypatch.setattr(M, "LISTED", listed)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 7)))

    def near(name):
        t = list(name)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a", " "])
        w = "".join(t).split()
        rng.shuffle(w)
        return " ".join(w)

    base = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)]
    keys = [k for k in dict.fromkeys(base[:40] + [near(rng.choice(base)) for _ in range(25)]) if k]
    names = sorted({k for k in base + [near(rng.choice(keys)) for _ in range(250)] + [" ".join(word() for _ in range(3)) for _ in range(50)] if k})
    denied = spark.createDataFrame([(i, f"P{i}", k, "l") for i, k in enumerate([*keys, keys[0]])], "ord int, matched_party string, key string, list_name string")
    got = {r.key: (r.matched_party, r.exact_match, r.score) for r in M.match_names(spark.createDataFrame([(n,) for n in names], "key string"), denied, threshold).collect()}
    want = {}
    for n in names:
        if n in keys:
            want[n] = (f"P{len(keys) if n == keys[0] else keys.index(n)}", True, 1.0)
        else:
            score, i = max((plain_similarity(n, k), -i) for i, k in enumerate(keys))
            if score >= threshold:
                want[n] = (f"P{-i}", False, score)
    assert got == want and sum(not e for _, e, _ in want.values()) > 50


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.92])
def test_index_gives_every_match_and_few_others(threshold):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["a", "x1"]
    name = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))
    listed = [name() for _ in range(600)]
    names = [name() for _ in range(60)] + ["".join(rng.choice([c, c, c, c, "", "q"]) for c in rng.choice(listed)) for _ in range(60)] + ["", "a", "aa aa aa"]
    index = M.NameIndex(listed, threshold)
    compared = matches = 0
    for n in names:
        got = set(index.near(n).tolist())
        want = {i for i, k in enumerate(listed) if M.token_set_similarity(n, k) >= threshold}
        assert want <= got
        compared, matches = compared + len(got), matches + len(want)
        score, first = max(((M.token_set_similarity(n, listed[i]), -i) for i in want), default=(0, 0))
        assert index.best(n) == ((-first, score) if want else None)
    assert threshold < 0.7 or compared < 10 * matches


def test_decision_without_classifier_or_description(spark):
    got = Engine(spark).screen(ship(spark, **CLEAN | {"description": None})).first()
    assert got.reason == "Uncertain: no AI classification" and 'Shipment a ("") was screened' in got.rationale and got.rationale.endswith("Reason: Uncertain: no AI classification")


def test_classify_and_entailment(spark):
    r = spark.createDataFrame([([1.0, 5.0, 2.0], [[0.1, 0.2, 3.0], [0.4, 0.7]])], "x array<double>, s array<array<double>>").select(M.classify(F.col("x")).alias("c"), M.entailment(F.col("s")).alias("e")).first()
    assert r.c.label == "restricted" and r.c.confidence == pytest.approx(math.exp(5) / (math.e + math.exp(5) + math.exp(2))) and r.e == [3.0, 0.7]


def test_semantic_signals_skip_keyword_groups(spark):
    e = Engine(spark, embedder=M.hashing_embedder())
    hit = e.enrich(ship(spark, description="ivory", hs_code="8471.30")).first()
    assert [h.matched_keyword for h in hit.hits] == ["ivory"]
    hit = e.enrich(ship(spark, description="guided missile")).first()
    assert hit.hits[0].matched_phrase == "guided missile" and hit.hits[0].similarity_score == pytest.approx(1.0, abs=1e-6)
    assert len(hit.ai.hs_predictions) == 3


def test_rationale_previews(spark):
    rows = Engine(spark).screen(ship(spark, description="x" * 130).withColumn("logits", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), with_profile=False).first()
    assert "x" * 120 + "..." in rows.rationale and "Layer 2 (AI Classifier)" in rows.rationale and json.loads(rows.thresholds_snapshot)["taxonomy"]["high"] == 0.78


def test_sources(spark, tmp_path):
    p = tmp_path / "s.json"
    for content in ([{"id": "1", "description": "d"}], {"shipments": [{"id": "1", "description": "d"}]}):
        p.write_text(json.dumps(content))
        assert [r.id for r in readers.shipments(spark, str(p)).collect()] == ["1"]
    c = tmp_path / "s.csv"
    c.write_text("shipment_id,description,hs_code\n7,cups,6912\n")
    assert readers.shipments(spark, str(c)).first().hs_code is None and readers.shipments(spark, str(c), True).first().hs_code == "6912"
    with pytest.raises(ValueError):
        readers.shipments(spark, "x.xml")
    r = tmp_path / "c.csv"
    r.write_text("iso2,name,tier,score100,sanct\nir,Iran,severe,98,full\nde,Germany,low,2,\n,none,low,1,\nae,Emirates,moderate,55,\n")
    cols = readers.CsvColumns("iso2", "name", "tier", "score100", "sanct")
    got = {x.country_code: x for x in readers.country_risk(spark, str(r), cols).collect()}
    assert set(got) == {"IR", "DE", "AE"} and got["IR"].is_sanctioned and got["IR"].overall_score == 0.98 and got["DE"].fatf_status == "unknown"
    assert readers.country_risk(spark, str(tmp_path / "none.json")).count() == 0 and readers.denied_parties(spark, str(tmp_path / "none.json")).count() == 0
    t = tmp_path / "t.json"
    for bad in ({}, {"groups": [{"semantic_phrases": ["a"]}]}, {"groups": [{"group_id": "a", "semantic_phrases": []}]}, {"groups": [{"group_id": "a", "semantic_phrases": ["x"]}] * 2}):
        t.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            readers.taxonomy(spark, str(t))
    with pytest.raises(FileNotFoundError):
        readers.taxonomy(spark, str(tmp_path / "no.json"))
    readers.write_taxonomy([{"group_id": "a", "semantic_phrases": ["x"]}], str(t))
    assert readers.taxonomy(spark, str(t)).count() == 1


def test_settings(tmp_path, monkeypatch):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"country_tiers": {"QQ": 2}, "high_value_threshold": 5, "unknown": 1, "dimension_weights": {"goods": 9, "odd": 1}}))
    s = Screening.from_json(str(p))
    assert s.tiers == {"QQ": 2} and s.high_value == 5 and s.dimension_weights == {"goods": 9.0} and Screening.from_json("missing") == Screening()
    monkeypatch.setenv("CARGOSIFT_HIGH_VALUE", "7")
    assert Screening().from_env().high_value == 7.0


def psi(spark, a, b):
    f = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    return drift.psi(drift.histogram(f(a), f(b), "v")).first().psi


def test_psi(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0.85, 0.95, 400)
    assert psi(spark, a, a) == pytest.approx(0) and psi(spark, a, rng.uniform(0.5, 0.75, 400)) > 0.25 and psi(spark, [], a) == 0.0
    assert psi(spark, [0.9] * 30, [0.9] * 30) == pytest.approx(0)


def test_diverse_matches_plain_loop(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(30, 4)).astype(np.float32), rng.random(30)
    rows = spark.createDataFrame([(i, [float(a) for a in v], float(u)) for i, (v, u) in enumerate(zip(x, w))], "vec_id long, v array<float>, w double")
    got = [r.id for r in learning.diverse(rows, "v", "w", 10).orderBy("pick").collect()]
    chosen, d = [int(np.argmax(w))], np.linalg.norm(x.astype(float) - x[np.argmax(w)], axis=1)
    while len(chosen) < 10:
        s = np.where(np.isin(np.arange(30), chosen), -1, d * w)
        chosen.append(int(np.argmax(s)))
        d = np.minimum(d, np.linalg.norm(x.astype(float) - x[chosen[-1]], axis=1))
    assert got == chosen and learning.diverse(rows, "v", "w", 0).count() == 0 and learning.diverse(rows, "v", "w", 99).count() == 30


def test_feedback(spark):
    log = learning.record(Engine(spark).screen(ship(spark, **CLEAN).withColumn("logits", F.array(F.lit(0.0), F.lit(9.0), F.lit(0.0))), with_profile=False).withColumn("kw", F.lit("allow")), "kw")
    log = spark.createDataFrame(log.collect(), log.schema)
    assert log.first().disagreement_type == "KW_ALLOW_AI_BLOCK" and log.first().final_decision == "block"
    review = spark.createDataFrame([("a", "r", "approve", None), ("zz", "r", "block", None)], "shipment_id string, reviewer_id string, final_decision string, notes string")
    once = learning.apply_feedback(log, review)
    assert once.first().reviewer_id == "r" and once.first().final_decision == "approve"
    assert learning.labelled(once).count() == 1 and learning.training_rows(once).first().label == 0


def test_gate(spark):
    good = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "label int, prediction int")
    assert learning.gate(learning.class_metrics(good)).first().passed
    bad = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    assert learning.gate(learning.class_metrics(bad)).first().failures == ["allow_precision", "restricted_recall"]


def test_stream_screens_as_batch_does(spark, sf_dir):
    from cargosift.plans import queries

    got = sorted(tuple(r) for r in queries.x1_screen(spark, sf_dir).collect())
    want = sorted(tuple(r) for r in queries.QUERIES["op_RT1_router"](spark, sf_dir).collect())
    assert got == want and any(r[1] in (2, 4) for r in got)


def decided(spark, n=12):
    logits = F.array(*[F.when(F.length("id") % 3 == i, 5.0).otherwise(0.5 * i) for i in range(3)])
    rows = ship(spark, **CLEAN)
    for i in range(1, n):
        rows = rows.unionByName(ship(spark, **CLEAN | {"id": "a" * (i + 1), "description": "carved ivory" if i % 4 == 0 else f"cotton shirts number {i}", "consignee": "Blockd Industries Ltd" if i % 5 == 0 else "Good Co"}))
    return Engine(spark).screen(rows.withColumn("logits", logits))


def test_decision_sinks_and_export(spark, tmp_path):
    """JSON and CSV of decisions come back as written; labelled rows go to one JSON-lines folder a split."""
    d = decided(spark)
    want = {r.shipment_id: r for r in d.collect()}
    readers.write_decisions(d, str(tmp_path / "json"))
    got = {r.shipment_id: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert set(got) == set(want) and all(got[k].rationale == want[k].rationale and got[k].risk_profile.narrative == want[k].risk_profile.narrative for k in want)
    readers.write_decisions(d, str(tmp_path / "csv"), "csv")
    got = {r.shipment_id: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert list(got["a"].asDict()) == ["shipment_id", "action", "reason", "taxonomy_hits_count", "classification_label", "classification_confidence"]
    assert all(got[k].action == want[k].action and int(got[k].taxonomy_hits_count) == len(want[k].taxonomy_hits) and got[k].classification_confidence == f"{want[k].classification.confidence:.4f}" for k in want)
    with pytest.raises(ValueError):
        readers.write_decisions(d, str(tmp_path / "xml"), "xml")
    rows = learning.training_rows(learning.record(d))
    counts = {r.split: r.n for r in learning.export(rows, str(tmp_path / "out"), test=0.25, val=0.25).collect()}
    back = spark.read.json(str(tmp_path / "out"))
    assert counts == {"test": 3, "val": 3, "train": 6} and back.count() == 12 and set(back.columns) == {"text", "label", "label_name", "shipment_id", "split"}


def test_feedback_tables(spark):
    """Tables are made once, rows are appended by name, and a review reaches them."""
    learning.create_tables(spark, "fb_test_")
    learning.create_tables(spark, "fb_test_")
    log = learning.record(decided(spark, 4), snapshot=learning.input_snapshot(["shipment_id", "description"]))
    learning.append_feedback(log, "fb_test_screening_feedback")
    learning.append_feedback(log, "fb_test_screening_feedback")
    table = spark.table("fb_test_screening_feedback")
    assert table.count() == 8 and table.where("created_at is null or reviewer_id is not null").count() == 0
    assert json.loads(table.where("shipment_id = 'aa'").first().input_snapshot) == {"shipment_id": "aa", "description": "cotton shirts number 1"}
    spark.sql("DROP TABLE fb_test_screening_feedback")
    spark.sql("DROP TABLE fb_test_drift_baselines")


def test_drift_baseline(spark, tmp_path):
    """A baseline saved and read again finds no drift in its own decisions, and the report's figures for others."""
    rng = np.random.default_rng(3)
    make = lambda conf, labels, hits: spark.createDataFrame([(("x", float(c)) if c is not None else None, [(h,)] if h else [], [float(c or 0), 1.0]) for c, h in zip(conf, hits)], "classification struct<label:string,confidence:double>, taxonomy_hits array<struct<group_id:string>>, v array<double>").withColumn("classification", F.when(F.col("classification").isNotNull(), F.struct(F.when(F.col("classification.confidence") < labels, "restricted").otherwise("allowed").alias("label"), F.col("classification.confidence").alias("confidence"))))
    old = make([*rng.uniform(0.85, 0.95, 300), None], 0.87, ["g"] * 30 + [None] * 271)
    new = make(rng.uniform(0.5, 0.9, 300), 0.6, ["h"] * 60 + [None] * 240)
    base = drift.baseline(old, vec="v")
    b = base.first()
    assert b.sample_size == 301 and sum(b.counts) == 300 and sum(b.labels.values()) == 300 and b.hit_rates == {"g": pytest.approx(30 / 301)} and len(b.edges) == 9
    learning.save_summary(spark, str(tmp_path / "b"), "old", base)
    learning.save_summary(spark, str(tmp_path / "b"), "old", base)
    saved = spark.read.parquet(str(tmp_path / "b"))
    kept = learning.load_summary(saved, "old")
    assert kept.first() == b and learning.load_summary(saved, "none").count() == 0
    same = drift.against(kept, drift.rebinned(kept, old, vec="v")).first()
    assert same.psi_confidence == pytest.approx(0) and same.label_psi == pytest.approx(0) and same.centroid_shift == pytest.approx(0) and not same.significant
    got = drift.against(kept, drift.rebinned(kept, new, vec="v")).first()
    flat = lambda d: d.select(F.col("classification.confidence").alias("c"), F.col("classification.label").alias("l"))
    want = drift.report(flat(old), flat(new), "c", "l").first()
    assert got.psi_confidence == pytest.approx(want.psi_confidence) and got.label_psi == pytest.approx(want.label_psi) and got.significant
    assert got.centroid_shift == pytest.approx(drift.centroid_distance(old, new, "v").first().centroid_shift)
    assert got.hit_rate_deltas == {"g": pytest.approx(-30 / 301), "h": pytest.approx(0.2)}
    deltas = {r.group_id: r.large for r in drift.rate_deltas(drift.hit_rates(old, "taxonomy_hits"), drift.hit_rates(new, "taxonomy_hits")).collect()}
    assert deltas == {"g": True, "h": True}


def test_hypotheses_and_saved_models(spark, tmp_path):
    """A scorer of text and hypothesis stands in for logits; triples give their entailment; a missing model raises."""
    rows = ship(spark, description="this item is restricted or controlled").unionByName(ship(spark, id="b", description=None))
    got = Engine(spark, scorer=M.word_overlap).enrich(rows).orderBy("id").collect()
    assert got[0].classification.label == "restricted" and got[1].classification.confidence == pytest.approx(1 / 3) and "_logits" not in got[0].asDict()
    triple = lambda p, h: F.array(F.lit(9.0), F.lit(0.0), F.when(h.contains("allowed"), 2.0).otherwise(0.0))
    assert Engine(spark, scorer=triple, scorer_triples=True).enrich(rows).first().classification.label == "allowed"
    with pytest.raises(FileNotFoundError):
        learning.load_text_classifier(spark, str(tmp_path / "none"))
    texts = spark.createDataFrame([("good cotton", 0), ("bad missile", 1), ("odd thing", 2)] * 5, "text string, label int")
    model = learning.train_text_classifier(texts, features=64, iterations=5)
    learning.save_text_classifier(model, str(tmp_path / "m"))
    again = learning.load_text_classifier(spark, str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(texts).collect()] == [r.prediction for r in model.transform(texts).collect()]
    ai = Engine(spark, embedder=M.hashing_embedder()).enrich(ship(spark, description="Wheat, rice, barley, oats, maize, sorghum and other cereal grains")).first().ai
    assert ai.coherence == ai.hs_predictions[0].similarity and ai.hs_predictions[0].chapter == "10"


def test_review_choice(spark):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(5)], [0.5 + 0.1 * (i == 2), 0.5 - 0.1 * (i == 2)]) for i in range(5)], "vec_id long, v array<double>, p array<double>")
    assert len({r.id for r in learning.select_for_review(rows, "v", "p", 3).collect()}) == 3
    with pytest.raises(ValueError):
        learning.select_for_review(rows.withColumn("v", F.when(F.col("vec_id") != 1, F.col("v"))), "v", "p", 2)


def test_rolling_drift_and_reviews(spark, tmp_path):
    """Every micro-batch is held against the baseline; reviews of all batches are in the last log."""
    base = spark.range(100).selectExpr("id / 100 v")
    for i in range(2):
        spark.range(50).selectExpr(f"id / 100 + {i} v").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    seen = []
    stream = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    streams.rolling_drift(stream, base, "v", lambda df, n: seen.append((n, df.first().psi)), str(tmp_path / "c1")).awaitTermination()
    assert sorted(n for n, _ in seen) == [0, 1] and max(p for _, p in seen) > 1
    log = FeedbackLog(spark, str(tmp_path / "log"))
    log.create(learning.record(decided(spark, 4)))
    for i, k in enumerate(("a", "aa")):
        spark.createDataFrame([(k, f"r{i}", "approve", None)], "shipment_id string, reviewer_id string, final_decision string, notes string").coalesce(1).write.parquet(str(tmp_path / f"rev/{i}"))
    reviews = spark.readStream.schema("shipment_id string, reviewer_id string, final_decision string, notes string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rev/*"))
    streams.apply_reviews(reviews, log, str(tmp_path / "c2")).awaitTermination()
    done = {r.shipment_id: r.reviewer_id for r in log.read().collect()}
    assert done == {"a": done["a"], "aa": done["aa"], "aaa": None, "aaaa": None} and {done["a"], done["aa"]} == {"r0", "r1"}


LOG = "feedback_id string, shipment_id string, reviewer_id string, final_decision string, reviewer_notes string, created_at timestamp, reviewed_at timestamp, extra int"


def test_feedback_deltas(spark, tmp_path):
    """Each review lands on the newest open row; a replayed batch and a compaction change nothing; batches write their reviews alone."""
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(f"f{n}", f"s{n % 3}", "old" if n == 5 else None, "allow", None, day(n + 1), day(9) if n == 5 else None, n) for n in range(9)]
    log = FeedbackLog(spark, str(tmp_path / "log"))
    log.create(spark.createDataFrame(rows, LOG))
    review = lambda *xs: spark.createDataFrame([(s, r, "block", "n") for s, r in xs], "shipment_id string, reviewer_id string, final_decision string, notes string")
    state = lambda: {r.feedback_id: (r.reviewer_id, r.final_decision, r.reviewed_at, r.extra) for r in log.read().collect()}
    log.apply(review(("s0", "r1"), ("s0", "r2"), ("s9", "r1")), 0)
    first = state()
    assert {k: v[0] for k, v in first.items() if v[0]} == {"f6": "r2", "f5": "old"} and len(first) == 9 and first["f6"][1] == "block" and first["f1"] == (None, "allow", None, 1)
    log.apply(review(("s1", "rx")), 0)
    assert state() == first
    log.apply(review(("s0", "r3"), ("s2", "r3")), 1)
    second = state()
    assert {k: v[0] for k, v in second.items() if v[0]} == {"f6": "r2", "f5": "old", "f3": "r3", "f8": "r3"}
    assert spark.read.parquet(str(tmp_path / "log/reviews/batch=1")).count() == 2
    log.compact()
    assert state() == second
    log.apply(review(("s1", "rx")), 1)
    assert state() == second
    log.apply(review(("s2", "r4"), ("s1", "r4")), 2)
    assert {k for k, v in state().items() if v[0] == "r4"} == {"f2", "f7"}
    log.apply(review(("none", "r")), 3)
    assert len(state()) == 9


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_quantiles_against_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "LIMIT", limit)
    rng = np.random.default_rng(limit)
    for values in (rng.normal(size=500), rng.integers(0, 4, 300).astype(float), np.full(50, 0.9), np.concatenate([np.zeros(200), rng.pareto(1, 100) * 1e9, [-np.inf, np.inf, 5e-324]]), np.array([2.5]), rng.uniform(size=11)):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        at = [i / 10 for i in range(1, 10)]
        assert Q.quantiles(rows, "v", at) == pytest.approx(np.quantile(values, at).tolist(), rel=1e-12)
    assert Q.quantiles(rows.limit(0), "v", [0.5]) is None
    assert drift.edges(rows.limit(0), "v").first().edges is None


def test_label_psi_of_an_empty_side(spark):
    """An empty side of labels has the least share of each, so that the index is large; numbers give zero."""
    counts = lambda *xs: spark.createDataFrame(xs, "label string, n_base long, n_current long")
    want = sum((a - 1e-6) * math.log(a / 1e-6) for a in (0.25, 0.75))
    assert drift.psi(counts(("x", 0, 1), ("y", 0, 3)), labels=True).first().psi == pytest.approx(want)
    assert drift.psi(counts(("x", 1, 0), ("y", 3, 0)), labels=True).first().psi == pytest.approx(want)
    assert drift.psi(counts(("x", 0, 1))).first().psi == 0.0 and drift.psi(counts(("x", 0, 1)).limit(0), labels=True).first().psi == 0.0


def test_rolling_windows_are_replayed(spark, tmp_path):
    """Counts of sliding windows over several batches give the index of each window's values."""
    rng = np.random.default_rng(3)
    day = lambda n: datetime.datetime(2024, 2, 1) + datetime.timedelta(days=int(n), hours=5)
    base = rng.uniform(size=300)
    rows = [(day(n // 20), float(v)) for n, v in enumerate(rng.uniform(0, 1.4, 100))]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    frame = spark.createDataFrame([(float(v),) for v in base], "v double")
    inner = [float(e) for e in drift.edges(frame, "v").first().edges]
    counts = [r.n for r in drift.binned(frame, "v", inner).orderBy("bin").collect()]
    stream = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    streams.to_folder(streams.rolling_counts(stream, inner, "v", window="3 days", late="30 days"), str(tmp_path / "out"), str(tmp_path / "c"), "update").awaitTermination()
    got = {r.window_start: (r.n, r.psi) for r in streams.rolling_psi(spark.read.schema("window_start timestamp, bin int, n long, batch long").parquet(str(tmp_path / "out")), counts).collect()}
    assert len(got) == 7
    for start, (n, psi) in got.items():
        own = [v for t, v in rows if start <= t < start + datetime.timedelta(days=3)]
        share = lambda xs: np.clip(np.bincount([sum(e <= round(x, 9) for e in inner) for x in xs], minlength=10) / len(xs), 1e-6, 1)
        e, a = share(base), share(own)
        assert n == len(own) and psi == pytest.approx(float(((a - e) * np.log(a / e)).sum()))


def test_json_shapes(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    item = '{"id": "1", "description": "d", "transit_countries": null}'
    for name, text in (("a.JSON", f"[{item}]"), ("b.json", '\n {"shipments": [' + item + "]}"), ("c.CSV", "id,description\n1,d\n")):
        assert [(r.id, r.description) for r in readers.shipments(spark, write(name, text)).collect()] == [("1", "d")]
    with pytest.raises(ValueError):
        readers.shipments(spark, write("d.json", item))
    with pytest.raises(Exception, match="no description"):
        readers.shipments(spark, write("e.json", '[{"id": "1"}]')).collect()
    assert readers.shipments(spark, write("f.json", '{"shipments": []}')).count() == 0


def test_many_keywords_like_few(spark, monkeypatch):
    """The automaton gives what testing keywords one by one gives, and takes 50,000 of them."""
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice("abAB1_-é ") for _ in range(rng.randint(1, 4)))
    texts = [None, "", *("".join(piece() for _ in range(rng.randint(1, 12))) for _ in range(150))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    groups = [{"group_id": f"g{i}", "name": f"n{i}", "risk_level": "high", "hard_keywords": [piece() for _ in range(3)] + [""]} for i in range(8)]
    words = [w for w in dict.fromkeys(piece().strip("-é ") for _ in range(20)) if w]
    ask = lambda: [tuple(r) for r in rows.select("id", M.keyword_hits(F.col("t"), groups).alias("h"), E.keyword_set(F.col("t"), words).alias("w")).orderBy("id").collect()]
    one_by_one = ask()
    monkeypatch.setattr(K, "CHAINED", 0)
    assert ask() == one_by_one and sum(len(h) for _, h, _ in one_by_one) > 100 and sum(len(w or ()) for _, _, w in one_by_one) > 50
    monkeypatch.undo()
    long = [{"group_id": "g", "name": "n", "risk_level": "low", "hard_keywords": [f"keyword {n} of" for n in range(50_000)]}]
    got = spark.createDataFrame([("a keyword 49999 of many and Keyword 7 Of few",)], "t string").select(M.keyword_hits(F.col("t"), long).alias("h")).first().h
    assert [h.matched_keyword for h in got] == ["keyword 7 of"]


def test_core_set_like_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(160, 3)), 1)
    v[100:110] = v[0]
    w = np.round(rng.uniform(0, 2, 160), 1)
    w[150:] = 0
    rows = spark.createDataFrame([(i, v[i].tolist(), float(w[i])) for i in range(160)] + [(200, None, 9.0), (201, [1.0, 1.0, 1.0], None)], "vec_id long, v array<double>, w double")
    picks, d = [], np.full(160, np.inf)
    while len(picks) < 40:
        score = w * d if picks else w.copy()
        best = min((i for i in range(160) if i not in picks), key=lambda i: (-score[i], i))
        picks.append(best)
        d = np.minimum(d, np.sqrt(np.square(v - v[best]).cumsum(axis=1)[:, -1]))
    for pool in (7, 500):
        assert [r.id for r in learning.diverse(rows, "v", "w", 40, pool=pool).orderBy("pick").collect()] == picks
    assert learning.diverse(rows.limit(0), "v", "w", 3).count() == 0 and learning.diverse(rows, "v", "w", 500).count() == 160


def test_batch_scorer(spark):
    """Batches and triples give what the scorer of single pairs gives."""
    texts = [None, "", "prohibited weapons and restricted goods", "Ordinary goods, allowed; they need review!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one = M.hypothesis_scores(F.col("t"), M.word_overlap)
    many = M.hypothesis_scores(F.col("t"), M.BatchScorer(M.overlap_model, 2))

    def tripled():
        model = M.overlap_model()
        return lambda ts, hs: np.stack([np.zeros((len(ts), len(hs))), np.ones((len(ts), len(hs))), model(ts, hs)], axis=2)

    three = M.hypothesis_scores(F.col("t"), M.BatchScorer(tripled), triples=True)
    for r in rows.select(one.alias("a"), many.alias("b"), three.alias("c")).collect():
        assert r.a == pytest.approx(r.b) and r.a == pytest.approx(r.c) and len(r.a) == 3


def test_phrases_of_groups(spark):
    groups = readers.taxonomy(spark)
    rows = readers.phrases(groups).orderBy("phrase_idx").collect()
    assert [r.phrase for r in rows] == [p for g in TAXONOMY for p in g["semantic_phrases"]] and [r.phrase_idx for r in rows] == list(range(len(rows)))
    assert all(TAXONOMY[r.group_idx]["group_id"] == r.group_id for r in rows)


def test_signals_are_compiled(spark):
    """Lists of signals and hits hold no function that takes a lambda, which Spark would not compile, nor anything inside it."""
    from cargosift.functions import expressions as E

    rows = spark.createDataFrame([(1, "a drone", None), (2, None, "x"), (3, "none", "")], "id int, description string, code string")
    made = rows.select("id", E.signals(E.signal("a", F.col("id") > 1, F.col("id"), 2.0, F.col("code")), E.signal("b", F.col("code") == "x", 1.0, 1.0, "e"), F.lit(None).cast("array<struct<name:string,value:double,weight:double,evidence:string>>")).alias("s"), M.keyword_hits(F.col("description"), [{"group_id": "g", "name": "n", "risk_level": "low", "hard_keywords": ["drone"], "semantic_phrases": []}]).alias("h"))
    assert [([tuple(s) for s in r.s], [h.matched_keyword for h in r.h]) for r in made.orderBy("id").collect()] == [([], ["drone"]), ([("a", 2.0, 2.0, "x"), ("b", 1.0, 1.0, "e")], []), ([("a", 3.0, 2.0, "")], [])]
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
