"""Conversation repair against every sequence of edits, over pieces and on odd rows."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from cargosift.llm import conversations, queries

TURN = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def classed(turns):
    """Turns in order with their first faults."""
    seen, out = set(), []
    for _, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_way(turns):
    """(cost, audit, repaired text) of the best of all edits, two inserts at most in each gap."""
    gaps = [(), *itertools.product("ua"), *itertools.product("ua", repeat=2)]
    options = []
    for role, text, fault in turns:
        more = 3 * (fault == "truncated")
        own = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        options.append(own)
    best = None
    for edits in itertools.product(*options):
        for filled in itertools.product(gaps, repeat=len(turns) + 1):
            out, audit, cost = [], "", 0
            for n, gap in enumerate(filled):
                for x in gap:
                    out.append(("user" if x == "u" else "assistant", ""))
                audit, cost = audit + "I" * len(gap), cost + 3 * len(gap)
                if n < len(turns):
                    cost, audit = cost + edits[n][0], audit + edits[n][1]
                    if edits[n][2]:
                        out.append(edits[n][2])
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.match("".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def results(spark, rows):
    turns = spark.createDataFrame(rows, TURN)
    plans = conversations.audits(turns)
    found = {r["conv"]: r for r in plans.collect()}
    told = {r["conv"]: r["repaired_sha256"] for r in conversations.digests(turns, plans).collect()}
    return turns, plans, found, told


def test_repair_against_all_edits(spark):
    rng = random.Random(5)
    convs = {n: [(rng.randint(0, 3), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", " \n", "", "Why? "])) for _ in range(rng.randint(1, 3))] for n in range(40)}
    _, _, found, told = results(spark, [(n, *r) for n, rows in convs.items() for r in rows])
    assert set(found) == set(told) == set(convs)
    for n, rows in convs.items():
        turns = classed(rows)
        cost, audit, text = every_way(turns)
        assert (found[n]["cost"], found[n]["audit"], told[n]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
        for kind in ("blank", "duplicate", "truncated"):
            assert found[n][kind] == sum(f == kind for *_, f in turns)
        numbers = {t for t, *_ in rows}
        assert found[n]["gap"] == max(numbers) - min(numbers) + 1 - len(numbers)
        assert found[n]["illegal"] == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))


def plain(turns):
    """The same by one pass over all turns, the four states' cheapest edits kept."""
    nxt, best = conversations.NEXT, {0: (0, "")}

    def filled(now):
        out = dict(now)
        for _ in range(2):
            for s, (c, a) in list(out.items()):
                t, new = nxt[s, "a" if s == 2 else "u"], (c + 3, a + "I")
                if t not in out or new < out[t]:
                    out[t] = new
        return out

    best = filled(best)
    for role, _, fault in turns:
        after = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((nxt[s, "a" if s == 2 else "u"], c + 3 + more, a + "R"))
                if (s, role[:1]) in nxt:
                    ways.append((nxt[s, role[:1]], c + more, a + "K"))
            for t, *x in ways:
                after[t] = min(after.get(t, tuple(x)), tuple(x))
        best = filled(after)
    return min(best[s] for s in (0, 3) if s in best)


def test_repair_over_pieces_and_batches(spark):
    rng = random.Random(6)
    long = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"Turn {t}.", f"turn {t}", "again!", ""])) for t in range(conversations.BATCH + 3 * conversations.PIECE + 7)]
    short = [(n, t, "user" if t % 2 == 0 else "assistant", "Fine.") for n in range(2, 60) for t in range(2)]
    turns, plans, found, told = results(spark, long + short)
    assert (found[1]["cost"], found[1]["audit"]) == plain(classed([r[1:] for r in long]))
    assert {(found[n]["cost"], found[n]["audit"]) for n in range(2, 60)} == {(0, "KK")}
    lines = conversations.repaired(turns, plans).where("conv = 1").orderBy("place").collect()
    assert [r["place"] for r in lines] == list(range(1, len(lines) + 1)) and GRAMMAR.match("".join(r["role"][0] for r in lines))
    assert told[1] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest()


def test_repair_odd_rows(spark):
    rows = [(None, 0, "user", "Hm."), (None, None, "assistant", None), (1, None, None, "x" * 300000 + "!"), (2, 3, "user", "Is it?"), (2, 3, "user", "Is it?"), (3, 7, "system", "Be brief.")]
    turns = spark.createDataFrame(rows, TURN).withColumn("kind", F.lit("mine")).withColumn("place", F.lit(4)).withColumn("fault", F.lit(1))
    plans = conversations.audits(turns)
    found = {r["conv"]: (r["cost"], r["audit"], r["blank"], r["duplicate"], r["gap"]) for r in plans.collect()}
    assert found == {None: (7, "DKI", 1, 0, 0), 1: (4, "D", 0, 0, 0), 2: (7, "KDI", 0, 1, 0), 3: (4, "D", 0, 0, 0)}
    assert conversations.digests(turns, plans).count() == 4
    assert conversations.audits(turns.limit(0)).count() == 0 and conversations.repaired(turns.limit(0), plans.limit(0)).count() == 0


def test_damage_names_its_turns(spark):
    rows = [(c, t, "assistant", "Well. Yes!") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    bad = queries.damaged(spark.createDataFrame(rows, TURN)).collect()
    texts = {t: sum(r["text"] == t for r in bad) for t in ("", "Well Yes")}
    assert len(bad) < 420 and min(texts.values()) > 0 and any(r["role"] == "user" for r in bad)
