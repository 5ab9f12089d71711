"""Repair of conversations whose turns were damaged, at the least cost, by a recursive DuckDB query in each task.

A repaired conversation is empty or an optional system turn and one or more pairs of user and assistant. Keeping
a turn is free, giving it the role that fits costs 3, deleting it 4, inserting an empty turn 3; a truncated turn
that stays costs 3 more; blank and repeated turns must go. After every turn only four states of this grammar
are possible (nothing yet, system, user, assistant last), so one step of the recursion advances all
conversations of a batch by one turn and keeps for each state the cheapest edits, of equal cost the least in ASCII.

Equal costs in one state never make one audit the prefix of another, so the least prefix stays the least. For the same
reason conversations are cut into pieces: a piece is solved from each state it may begin in, all pieces of a
batch at once, and the pieces of a conversation are joined in order. No task holds more than a batch of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"\x20\x09-\x0D"
PIECE = 512  # turns solved by one recursion
BATCH = 16384  # turns handed to DuckDB at once
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
DELETE, REROLE, INSERT, KEEP_TRUNCATED = 4, 3, 3, 3

STEPS = """
WITH RECURSIVE steps AS (
  SELECT piece, origin, state, 0 AS done, {'cost': cost, 'audit': audit} AS best FROM seeds
  UNION ALL
  SELECT p.piece, p.origin, m.after AS state, t.place AS done, min({'cost': p.best.cost + m.price, 'audit': p.best.audit || m.edits}) AS best
  FROM steps p JOIN turns t ON t.piece = p.piece AND t.place = p.done + 1 JOIN moves m ON m.state = p.state AND m.kind = t.kind
  GROUP BY p.piece, p.origin, m.after, t.place)
SELECT s.piece, s.origin, s.state, s.best.cost AS cost, s.best.audit AS audit
FROM steps s JOIN (SELECT piece, max(place) AS n FROM turns GROUP BY piece) e ON e.piece = s.piece AND e.n = s.done
ORDER BY s.piece"""


def forced(state: int) -> str:
    """The role that an inserted or renamed turn takes in a state."""
    return "assistant" if state == USER else "user"


def inserts(state: int) -> list[tuple[int, str]]:
    """States reached by no, one or two inserted turns; a third would lead back."""
    one = NEXT[state, forced(state)[0]]
    return [(state, ""), (one, "I"), (NEXT[one, forced(one)[0]], "II")]


def moves() -> dict[tuple[int, str, int], tuple[int, str]]:
    """(state, kind of turn, state after): the cheapest edit of the turn with the inserts that follow it, and its price.

    Kinds: s, u, a or x by the role's initial (x: any other), in capitals if truncated; d for turns that must go.
    """
    best: dict[tuple[int, str, int], tuple[int, str]] = {}
    for state in range(4):
        for kind in "suaxSUAXd":
            edits = [(DELETE, "D", state)]
            if kind != "d":
                extra, own = KEEP_TRUNCATED * kind.isupper(), NEXT.get((state, kind.lower()))
                edits.append((REROLE + extra, "R", NEXT[state, forced(state)[0]]))
                if own is not None:
                    edits.append((extra, "K", own))
            for price, edit, then in edits:
                for after, more in inserts(then):
                    found = (price + INSERT * len(more), edit + more)
                    best[state, kind, after] = min(best.get((state, kind, after), found), found)
    return best


def ordered(conv: Column, turn: Column, role: Column, text: Column):
    return Window.partitionBy(conv).orderBy(turn.asc_nulls_first(), role, text)


def faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, place, kind, gap, blank, duplicate, truncated, illegal): each turn's first fault; gap counts the turn numbers missing before it.

    Turns are in order of number, nulls first, then role and text. Null roles and texts count as empty.
    """
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    w = ordered(*(F.col(c) for c in ("conv", "turn", "role", "text")))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"place": F.row_number().over(w), "before": F.lag("turn").over(w), "pair": F.concat(F.lag(initial).over(w), initial)})
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    rows = rows.withColumn("fault", F.when(blank, "blank").when(seen, "duplicate").when(cut, "truncated").otherwise(""))
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    gap = F.when(F.col("turn") > F.col("before"), F.col("turn") - F.col("before") - 1).otherwise(0)
    flag = lambda c: c.cast("int")
    return rows.select("conv", "place", kind.alias("kind"), gap.cast("long").alias("gap"), *[flag(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], flag(F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))).alias("illegal"))


COUNTS = ["gap", "blank", "duplicate", "truncated", "illegal"]


def _solve(kinds: pa.Array, piece: np.ndarray, place: np.ndarray, first: np.ndarray, con) -> list[dict]:
    """For each piece: {(origin, state): (cost, audit)}; pieces that begin a conversation begin in the first state only."""
    seeds = []
    for n, head in enumerate(first):
        seeds += [(n, START, s, INSERT * len(e), e) for s, e in inserts(START)] if head else [(n, s, s, 0, "") for s in range(4)]
    for name, table in (("seeds", pa.table(list(map(pa.array, zip(*seeds, strict=True))), ["piece", "origin", "state", "cost", "audit"])), ("turns", pa.table([pa.array(piece), pa.array(place), kinds], ["piece", "place", "kind"]))):
        con.register(name, table)
    out: list[dict] = [{} for _ in first]
    for p, origin, state, cost, audit in con.execute(STEPS).fetchall():
        out[p][origin, state] = (cost, audit)
    return out


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    rows = [(s, k, t, *v) for (s, k, t), v in moves().items()]
    con.register("moves", pa.table(list(map(pa.array, zip(*rows, strict=True))), ["state", "kind", "after", "price", "edits"]))
    conv = best = sums = None

    def finished() -> pa.RecordBatch:
        cost, audit = min(best[s] for s in (START, ASSISTANT) if s in best)
        return pa.RecordBatch.from_arrays([conv, *(pa.array([int(x)], pa.int64()) for x in (*sums, cost)), pa.array([audit])], ["conv", *COUNTS, "cost", "audit"])

    def solved(table: pa.Table, open_end: bool):
        """Audits of the conversations that end in the table, and the rows of its last piece if that may go on."""
        nonlocal conv, best, sums
        place = table["place"].to_numpy()
        starts = np.flatnonzero((place - 1) % PIECE == 0)
        stop = int(starts[-1]) if open_end else len(place)
        starts = starts[starts < stop]
        done = []
        if len(starts):
            sizes = np.diff([*starts, stop])
            head = place[starts] == 1
            counts = np.stack([np.add.reduceat(table[c].to_numpy()[:stop].astype(np.int64), starts) for c in COUNTS])
            found = _solve(table["kind"].slice(0, stop).combine_chunks(), np.repeat(np.arange(len(starts)), sizes), np.arange(stop) - np.repeat(starts, sizes) + 1, head, con)
            for n, at in enumerate(starts):
                if head[n]:
                    if best is not None:
                        done.append(finished())
                    conv, best, sums = table["conv"].slice(int(at), 1).combine_chunks(), {START: (0, "")}, np.zeros(len(COUNTS), np.int64)
                after: dict[int, tuple[int, str]] = {}
                for (origin, state), (cost, audit) in found[n].items():
                    if origin in best:
                        option = (best[origin][0] + cost, best[origin][1] + audit)
                        after[state] = min(after.get(state, option), option)
                best, sums = after, sums + counts[:, n]
        return done, table.slice(stop)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH:
            done, rest = solved(pa.Table.from_batches(held), True)
            yield from done
            held, size = rest.to_batches(), 0
    held = [b for b in held if b.num_rows]
    if held:
        done, _ = solved(pa.Table.from_batches(held), False)
        yield from done
    if best is not None:
        yield finished()


def audits(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, gap, blank, duplicate, truncated, illegal, cost, audit), one for each conversation that has turns.

    audit holds the initials of the edits Keep, Rerole, Delete, Insert in order. Conversations are dealt out by a hash of
    their id, so one is streamed through one task, in pieces of PIECE turns; null is an id like others, repeated rows are
    turns like others, an empty table gives no rows, other columns take no part. Texts stay in the JVM.
    """
    rows = faults(turns, conv_id, turn, role, text)
    kind = T.StructType([rows.schema["conv"], *[T.StructField(c, T.LongType()) for c in (*COUNTS, "cost")], T.StructField("audit", T.StringType())])
    return rows.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_audits, kind)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, str, str, str]]:
    """(conversation, place, edit, role, text) of every repaired turn; place 0 marks the begin of a conversation."""
    conv, audit, state, at, place = None, "", START, 0, 0

    def inserted():
        nonlocal state, at, place
        while at < len(audit) and audit[at] == "I":
            role = forced(state)
            state, at, place = NEXT[state, role[0]], at + 1, place + 1
            yield conv, place, "I", role, ""

    for batch in batches:
        ids, plan, roles, texts = (batch[c] for c in ("conv", "audit", "role", "text"))
        for n, (told, role, text) in enumerate(zip(plan.to_pylist(), roles.to_pylist(), texts.to_pylist(), strict=True)):
            if told is not None:  # the audit comes before the turns
                conv, audit, state, at, place = ids.slice(n, 1), told, START, 0, 0
                yield conv, 0, "", "", ""
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    role = role if edit == "K" else forced(state)
                    state, place = NEXT[state, role[0]], place + 1
                    yield conv, place, edit, role, text
            yield from inserted()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def packed():
        ids, *rest = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, rest)], ["conv", "place", "edit", "role", "text"])

    size = 0
    for row in _walk(batches):
        if row[1]:
            held.append(row)
            size += len(row[4])
        if len(held) >= 1000 or size > 1 << 22:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest = None, None

    def packed():
        return pa.RecordBatch.from_arrays([conv, pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    for own, place, _, role, text in _walk(batches):
        if place:
            digest.update(("\n" * (place > 1) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        else:
            if digest is not None:
                yield packed()
            conv, digest = own, hashlib.sha256()
    if digest is not None:
        yield packed()


def _planned(turns: DataFrame, plans: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's audit and then its turns, in the order in which they were judged."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.lit(None).cast("string").alias("audit"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    first = plans.select("conv", "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    both = first.withColumn("after", F.lit(0)).unionByName(rows.withColumn("after", F.lit(1)))
    return both.repartition("conv").sortWithinPartitions("conv", "after", F.col("turn").asc_nulls_first(), "role", "text").select("conv", "audit", "role", "text")


def repaired(turns: DataFrame, plans: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns (conv, place, edit, role, text) that conversations have after the edits of their audits; deleted ones are left out."""
    rows = _planned(turns, plans, conv_id, turn, role, text)
    kind = T.StructType([rows.schema["conv"], T.StructField("place", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    return rows.mapInArrow(_turns, kind)


def digests(turns: DataFrame, plans: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, repaired_sha256): SHA-256 of each repaired conversation's `role:text`, joined by newlines, streamed."""
    rows = _planned(turns, plans, conv_id, turn, role, text)
    return rows.mapInArrow(_digests, T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())]))
