"""Exact top-k by inner product over norm-sorted blocks.

Vectors become whole numbers, floor(scale * x). Candidates are ordered by descending length and cut into
blocks; a rotation from the singular value decomposition of all candidates moves most of the length into
the first axes. Each query block first meets the longest candidates, which gives every query a k-th best
score so far. A candidate block is joined only if some query's length times the block's greatest length
reaches that score; inside, partial inner products over the first axes plus the Cauchy-Schwarz bound on
the rest skip vectors, and what is left is scored exactly in integers.

Blocks travel as the smallest integers that hold them and are turned where they arrive. Query blocks travel
in packs of PACK bytes, so that a candidate block travels once for each pack, not for each query block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, drop_stored, partitions, prepare, stored

PACK = 1 << 21  # bytes of a pack of query blocks; candidate blocks have at most twice as many
TILE = 2048  # candidates that a query block meets at once

_BLOCK = "dim int, blk long, max_norm double, ids binary, vecs binary"


def whole_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Adds v (array<long>), dim and norm; drops null or empty vectors and those with a null or non-finite component."""
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    out = df.where(ok).withColumn("v", v)
    return out.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _gram(batches):
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for dim, part in pdf.groupby("dim"):
            m = np.stack(part["v"].to_numpy()).astype(np.float64)
            total[dim] = total.get(dim, 0) + m.T @ m
    for dim, g in total.items():
        yield pd.DataFrame({"dim": dim, "row": np.arange(dim), "g": list(g)})


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The right singular vectors of all vectors by dimension, from dim x dim sums (the size is that of one dimension squared)."""
    rows = vectors.select("dim", "v").mapInPandas(_gram, "dim int, row int, g array<double>")
    sums = rows.groupBy("dim", "row", F.lit(0).alias("z")).agg(F.array_agg("g").alias("all")).select(
        "dim", "row", F.aggregate(F.slice("all", 2, 1 << 30), F.element_at("all", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("g"))
    out = {}
    for dim, part in sums.toPandas().groupby("dim"):
        g = np.stack(part.sort_values("row")["g"].to_numpy())
        _, vecs = np.linalg.eigh(g)
        out[int(dim)] = np.ascontiguousarray(vecs[:, ::-1])
    return out


def _packed(v: np.ndarray) -> bytes:
    """Vectors in the smallest integers that hold them."""
    low, high = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _unpacked(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vecs, f"i{len(vecs) // (len(own) * dim)}").reshape(-1, dim).astype(np.int64)


def _blocks(key, pdf):
    pdf = pdf.sort_values(["norm", "id"], ascending=[False, True])
    v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
    return pd.DataFrame([{"dim": key[0], "blk": key[1], "max_norm": float(pdf["norm"].iloc[0]), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "vecs": _packed(v)}])


def blocks(vectors: DataFrame, size: int, parts: int) -> DataFrame:
    """Packs rows (id, v, dim, norm) into blocks of at most size vectors; block 0 has the longest.

    Range partitioning by length makes the rows of each of the parts neighbours in length; inside, rows are numbered. blk >> 32 is the part.
    """
    ranged = vectors.select("id", "v", "dim", "norm").repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("dim"), F.col("norm").desc(), F.col("id"))  # a task that runs again numbers alike
    numbered = ranged.withColumn("part", F.spark_partition_id().cast("long")).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    blk = (F.col("part") * (1 << 32) + F.floor(F.col("nth") / size)).cast("long")
    return numbered.withColumn("blk", blk).groupBy("dim", "blk").applyInPandas(_blocks, _BLOCK)


def _longest(batches, n):
    """Blocks without what comes after their n first vectors."""
    for pdf in batches:
        size = pdf["ids"].map(len) // 8
        yield pdf.assign(ids=[x[: 8 * n] for x in pdf["ids"]], vecs=[x[: len(x) // k * min(n, k)] for x, k in zip(pdf["vecs"], size, strict=True)])


def _tile(qi, qv, qa, ci, cv, ca, low, k, head):
    """Top k of some queries among some candidates, given each query's k-th best score so far, which rises where this finds a better one."""
    small = float(np.abs(qv).max(initial=0)) * float(np.abs(cv).max(initial=0)) * qv.shape[1] < 2**52
    part = qa[:, :head] @ ca[:, :head].T
    rest = np.linalg.norm(qa[:, head:], axis=1)[:, None] * np.linalg.norm(ca[:, head:], axis=1)[None, :]
    bound = part + rest
    bound += 1e-9 * (np.abs(part) + rest) + 1e-6
    cf = cv.astype(np.float64) if small else cv
    out = []
    for i in range(len(qi)):
        at = np.flatnonzero((bound[i] >= low[i]) & (ci != qi[i]))
        if len(at) > k:  # the k best by bound give a score that all others must reach
            first = at[np.argpartition(-bound[i][at], k - 1)[:k]]
            floor = (cf[first] @ (qv[i].astype(cf.dtype))).min()
            at = at[bound[i][at] >= floor]
        if not len(at):
            continue
        s = (cf[at] @ qv[i].astype(cf.dtype)).astype(np.int64)
        best = np.lexsort((ci[at], -s))[:k]
        if len(best) == k and len(np.unique(ci[at][best])) == k:
            low[i] = max(low[i], s[best[-1]])
        out.append((np.full(len(best), qi[i]), ci[at][best], s[best]))
    return out


def _pair(pack, ids, vecs, max_norm, dim, rot, k, head):
    """Top k of a pack of query blocks against one candidate block."""
    ci, cv = _unpacked(ids, vecs, dim)
    ca = cv.astype(np.float64) @ rot[dim]
    out = []
    for q in pack:
        if q.get("need") is not None and max_norm < q["need"]:
            continue
        qi, qv = _unpacked(q["q_ids"], q["q_vecs"], dim)
        qa = qv.astype(np.float64) @ rot[dim]
        low = np.frombuffer(q["low"], np.float64).copy() if q.get("low") is not None else np.full(len(qi), -np.inf)
        rows = [x for a in range(0, len(ci), TILE) for x in _tile(qi, qv, qa, ci[a : a + TILE], cv[a : a + TILE], ca[a : a + TILE], low, k, head)]
        if not rows:
            continue
        own, other, s = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((other, -s, own))
        first = np.searchsorted(own[order], own[order])  # where the query's rows begin
        order = order[np.arange(len(order)) - first < k]
        out.append((own[order], other[order], s[order]))
    return out


def _score(batches, rot, k, head):
    for pdf in batches:
        rows = [x for r in pdf.to_dict("records") for x in _pair(r["pack"] if "pack" in r else [r], r["ids"], r["vecs"], r["max_norm"], int(r["dim"]), rot, k, head)]
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
        yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding", query_block: int = 256, block: int = TILE, head: int = 16) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k greatest integer inner products with candidates of other ids.

    Ties go to the smaller id. Vectors of unlike dimension are never compared. Null ids, null vectors and
    vectors with null or non-finite components take no part; rows repeated under one id count once each
    candidate id (the best score). Scores must fit in 64 bits. Empty inputs give no rows.
    """
    spark = candidates.sparkSession
    prepare(spark)
    take = lambda df: whole_vectors(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("e")), "e", scale).dropDuplicates(["id", "v"])
    cand = stored(take(candidates), "topk-v")
    rot = rotations(cand)
    query = stored(take(queries), "topk-v")
    for dim in [r.dim for r in query.select("dim").distinct().collect() if r.dim not in rot]:
        rot[dim] = np.eye(dim)
    n, n_query, widest = cand.count(), query.count(), max(rot, default=1)
    most = max(query_block, PACK // (2 * widest))  # queries of a pack
    size = max(block, min(2 * most, n // (2 * partitions(spark))))  # as large as leaves every core a block
    with arrow_rows(spark, 4):
        cb = stored(blocks(cand, size, max(1, -(-n // size))), "topk-c")
        qb = blocks(query, query_block, max(1, -(-n_query // most))).select("dim", F.col("blk").alias("q_blk"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
        qb = stored(qb, "topk-q")
        drop_stored(cand, query)
        out = "query_id long, vec_id long, score long"
        first = cb.groupBy("dim").agg(F.min("blk").alias("blk"))
        longest = cb.join(first, ["dim", "blk"]).mapInPandas(lambda it: _longest(it, block), _BLOCK)
        seed = qb.join(longest, "dim").mapInPandas(lambda it: _score(it, rot, k, head), out)
        seed = stored(seed, "topk-s")
        kth = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))

        def lows(batches):
            for pdf in batches:
                got = []
                for r in pdf.to_dict("records"):
                    known = {int(x["query_id"]): x["kth"] for x in (r.pop("known") if r["known"] is not None else []) if x["kth"] is not None}
                    qi = np.frombuffer(r["q_ids"], np.int64)
                    low = np.array([known.get(int(x), -np.inf) for x in qi], np.float64)
                    norm = np.linalg.norm(_unpacked(r["q_ids"], r["q_vecs"], int(r["dim"]))[1].astype(np.float64), axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        need = np.where(np.isfinite(low) & (low > 0), low / np.maximum(norm, 1e-300), -np.inf)
                    got.append(r | {"low": low.tobytes(), "need": float(need.min()) * (1 - 1e-9)})
                yield pd.DataFrame(got, columns=["dim", "q_blk", "q_ids", "q_vecs", "low", "need"])

        owner = qb.mapInPandas(_owners, "dim int, q_blk long, query_id long")
        known = owner.join(kth, "query_id").groupBy("dim", "q_blk").agg(F.collect_list(F.struct("query_id", "kth")).alias("known"))  # at most query_block entries
        armed = qb.join(known, ["dim", "q_blk"], "left").mapInPandas(lows, "dim int, q_blk long, q_ids binary, q_vecs binary, low binary, need double")
        # A pack holds the query blocks of one part.
        packs = armed.groupBy("dim", F.shiftright("q_blk", 32).alias("part")).agg(F.min("need").alias("need"), F.collect_list(F.struct("q_ids", "q_vecs", "low", "need")).alias("pack"))
        packs = stored(packs, "topk-a")
        keys, tasks = ["dim", "part", "blk"], 4 * partitions(spark)
        meets = packs.select("dim", "part", "need").join(cb.select("dim", "blk", "max_norm"), "dim").where("max_norm >= need").select(*keys)
        left = meets.join(packs.drop("need"), ["dim", "part"]).repartition(tasks, *keys)
        right = meets.join(cb, ["dim", "blk"]).repartition(tasks, *keys)
        rest = stored(left.join(right.hint("merge"), keys).mapInPandas(lambda it: _score(it, rot, k, head), out), "topk-r")
        drop_stored(cb, qb, packs)
    every = seed.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _owners(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            ids = np.unique(np.frombuffer(r.q_ids, np.int64))
            yield pd.DataFrame({"dim": r.dim, "q_blk": r.q_blk, "query_id": ids})
