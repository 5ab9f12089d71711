"""The filter audit against plain application of every order, and on odd rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cargosift.llm import audit


def plain(rows, filters, marks):
    """rows: (part, failing letters, marks). The audit's rows by applying each order to lists."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), *(sum(m in r[2] for r in gone) for m in marks), f)
    return out


def shapley(found, f, part):
    return sum(v[1] for (p, _, _), v in found.items() if p == part and v[-1] == f)


@pytest.mark.parametrize("filters", ["A", "BA", "ABCD"])
def test_audit_against_every_order(spark, filters):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", ""]), {f for f in filters if rng.random() < 0.4}, {m for m in "gt" if rng.random() < 0.5}) for _ in range(200)] + [("clean", set(), {"g"})]
    frame = spark.createDataFrame([(p, *(f in fails or (None if p == "y" else False) for f in filters), *(m in marks for m in "gt")) for p, fails, marks in rows], "part string, " + ", ".join(f"{f} boolean" for f in [*filters, "g", "t"]))
    got = audit.orders(audit.edges(frame.withColumn("state", F.lit(8)).withColumn("alive", F.lit("mine")), list(filters), ["g", "t"]), list(filters), ["g", "t"]).collect()
    want = plain(rows, filters, "gt")
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["g_lost"], r["t_lost"], r["filter_order"][r["step"] - 1]) for r in got} == want and len(got) == len(want)
    assert all(r["shapley"] == shapley(want, r["filter_order"][r["step"] - 1], r["part"]) for r in got)


def test_text_failures(spark):
    texts = [None, "", " \n", "Word " * 300, " ".join(f"w{n}" for n in range(100)), "LOUD and clear", "a & b", "É È", "x" * 200000, "\x85a\x1fb c"]
    found = audit.text_failures(F.col("text"))
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(found["words"].alias("w"), found["C"].alias("c"), found["D"].alias("d")).collect()
    for text, r in zip(texts, got, strict=True):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        assert (r["w"]["n"], r["w"]["d"]) == (len(words), len(set(words)))
        assert r["c"] == (100 * sum("A" <= c <= "Z" for c in text or "") > 10 * len(text or "")) and r["d"] == any(c in "#$%&*|" for c in text or "")


def test_failures_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "same", "en"), (2, "same", None), (2, "same", None), (None, "same", "en"), (3, None, "en"), (4, "", "en"), (5, "Same", "en")], "doc_id long, text string, lang string").withColumn("A", F.lit("mine")).withColumn("digest", F.lit(1)).withColumn("good", F.lit(2))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = audit.failures(docs, labels)
    assert sorted((r["part"], r["E"], bool(r["good"]), bool(r["toxic"])) for r in rows.collect()) == sorted([("en", False, True, True), ("", True, False, False), ("", True, False, False), ("en", False, False, False), ("en", False, False, False), ("en", True, False, True), ("en", False, False, False)])
    none = audit.failures(docs.limit(0), labels.limit(0))
    assert audit.orders(audit.edges(none, list("ABCDE"), ["good", "toxic"]), list("ABCDE"), ["good", "toxic"]).count() == 0
