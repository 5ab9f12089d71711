"""What filters do to one another in every order, over the trie of all permutations.

The trie is walked depth first from all rows; a child holds the survivors of one more filter, persisted while
its own children are counted. Two paths that have applied the same filters hold the same survivors, so each
unordered set of filters is one state, counted when it is first met and remembered. One aggregation over a
state's survivors counts what each of the filters left would remove: all edges that leave it.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargosift.scratch import new_path

from .common import drop_stored, stored

SPACE = r"\x20\x09-\x0D"
MOST = 7  # filters; the orders of more are too many to list


def edges(rows: DataFrame, filters: list[str], marks: list[str], part: str = "part") -> DataFrame:
    """Rows (part, state, filter, alive, removed, lost): every edge of the trie that some row of the part reaches.

    filters: boolean columns of rows, true for rows that fail; marks: boolean columns, whose rows among the removed
    lost counts in order. Null is false in both. state has bit n set if filter n was applied before; alive counts the rows
    that were left. An empty table has no edges.
    """
    if not 1 <= len(filters) <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = rows.select(F.col(part).alias("part"), *[truth(c).alias(f"f{n}") for n, c in enumerate(filters)], *[truth(c).alias(f"m{n}") for n, c in enumerate(marks)])
    base = stored(base, "audit-rows")
    path = new_path(rows.sparkSession, "audit-edges")
    one = lambda c: F.count(F.when(c, 1))
    lost = lambda n: F.array(*[one(F.col(f"f{n}") & F.col(f"m{m}")) for m in range(len(marks))]).cast("array<bigint>")
    # The same code for every state, so that Spark compiles it once; filters that a state has applied remove nothing and are left out when the edges are read.
    counted = [F.struct(F.lit(n).alias("n"), one(F.col(f"f{n}")).alias("removed"), lost(n).alias("lost")).alias(f"e{n}") for n in range(len(filters))]
    known: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        known.add(state)
        counts = survivors.groupBy("part").agg(F.count("*").alias("alive"), *counted)
        counts.select("part", "alive", F.explode(F.array(*[f"e{n}" for n in range(len(filters))])).alias("e")).select("part", "alive", "e.n", "e.removed", "e.lost").write.parquet(f"{path}/state={state}")
        left = [n for n in range(len(filters)) if not state >> n & 1]
        for n in left:
            after = state | 1 << n
            if after not in known and len(left) > 1:
                child = survivors.where(~F.col(f"f{n}")).persist()
                visit(after, child)
                child.unpersist()

    visit(0, base)
    drop_stored(base)
    names = F.array(*map(F.lit, filters))
    out = rows.sparkSession.read.schema("part string, alive long, n int, removed long, lost array<bigint>, state int").parquet(path)
    return out.where(F.call_function("getbit", F.col("state"), F.col("n")) == 0).select("part", "state", F.get(names, F.col("n")).alias("filter"), "alive", "removed", "lost")


def orders(found: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley) of all orders, zeros included.

    kept is what the step leaves, removed what it takes; redundant counts the rows that fail the step's filter and were
    taken before, unique_fails those that fail no other filter. shapley sums what the filter removes over all orders.
    """
    n = len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    full = (1 << n) - 1
    steps = []
    for order in itertools.permutations(filters):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": step, "edge": f"{state}{f}", "first": f"0{f}", "last": f"{full ^ bit[f]}{f}", "filter": f})
            state |= bit[f]
    grid = "array<struct<filter_order: string, step: int, edge: string, first: string, last: string, filter: string>>"
    # In so many orders exactly the filters of the state come before the edge's own.
    weight = sum((F.when(F.bit_count("state") == k, math.factorial(k) * math.factorial(n - 1 - k)).otherwise(0) for k in range(n)), F.lit(0))
    value = F.struct("alive", "removed", "lost")
    whole = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("state").cast("string"), "filter"), value))).alias("at"), *[F.sum(F.when(F.col("filter") == f, weight * F.col("removed")).otherwise(0)).alias(f"shapley_{i}") for i, f in enumerate(filters)])
    rows = whole.select("part", "at", *[f"shapley_{i}" for i in range(n)], F.explode(F.from_json(F.lit(json.dumps(steps)), grid)).alias("s"))
    got = lambda key, field: F.coalesce(F.try_element_at("at", F.col(f"s.{key}"))[field], F.lit(0))
    lost = lambda m: F.coalesce(F.get(F.try_element_at("at", F.col("s.edge"))["lost"], m), F.lit(0))
    shapley = F.coalesce(*[F.when(F.col("s.filter") == f, F.col(f"shapley_{i}")) for i, f in enumerate(filters)])
    return rows.select("part", "s.filter_order", "s.step", (got("edge", "alive") - got("edge", "removed")).alias("kept"), got("edge", "removed").alias("removed"), (got("first", "removed") - got("edge", "removed")).alias("redundant"), got("last", "removed").alias("unique_fails"), *[lost(i).alias(f"{m}_lost") for i, m in enumerate(marks)], shapley.cast("long").alias("shapley"))


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text is short (A), repeats its words (B), shouts (C) or holds signs (D). Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    counted = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), 1)
    return {"words": counted, "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Rows (part, A, B, C, D, E, good, toxic), one for each row of docs.

    E: the text is that of a row with a smaller id, whatever becomes of it; rows without id fail it never and make none fail.
    good and toxic: some row of labels with the id has quality or toxic 1. Texts are told apart by SHA-256.
    """
    found = text_failures(F.col(text))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit("")).alias("part"), found["words"].alias("w"), found["C"].alias("C"), found["D"].alias("D"), F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"))
    own = stored(own.select("id", "part", (F.col("w.n") < 100).alias("A"), (100 * F.col("w.d") < 80 * F.col("w.n")).alias("B"), "C", "D", "digest"), "audit-docs")
    # Both are written, so that the joins to all rows can split a text or an id that very many of them have.
    first = stored(own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "audit-first")
    marks = stored(labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "audit-marks")
    return own.join(first, "digest", "left").join(marks, "id", "left").select("part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"), "good", "toxic")
