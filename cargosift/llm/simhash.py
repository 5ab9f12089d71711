"""SimHash fingerprints, and their self-join over a binary trie.

Fingerprints that differ in at most budget bits agree in one of budget + 1 pieces of their bits. Each is turned so that every
piece leads once, and dealt out by the first bits of that piece: subtrees of a trie, as many as make blocks of bounded size.
A task walks a block's trie against itself, adds up differing bits and drops a pair of nodes once the budget is exceeded. So
each fingerprint travels budget + 1 times, however many there are, until whole pieces make subtrees larger than a block;
then they are cut further down, and blocks meet whose prefixes differ in no more bits than the budget. A task reports a
spanning forest of the links it finds, so rows grow with fingerprints, not with pairs.

similar() verifies what the trie links by exact similarity. At a Jaccard similarity of 0.8 fingerprints differ in about
ten bits, which no trie budget reaches; texts that far apart also meet by their MinHash bands.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, drop_stored, partitions, prepare, stored
from .paragraphs import ROWS, bands, joined
from .text import minima, sequence_keys, shingle_hashes, word_hashes

BLOCK = 1 << 13
_PAIRS = 1 << 20
_RUN = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if set in over half of the shingles' XXH64; zero for texts without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    n = max(1, len(found) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, _RUN):
        part = found[a : a + _RUN + shingle - 1]
        runs = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(found) >= shingle else [b" ".join(found)]
        h = np.array([digest(s, seed) for s in runs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


class _Trie:
    """The nodes of each level of a sorted array's binary trie, with their children."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, {}

    def nodes(self, depth: int) -> np.ndarray:
        """First key of each node at that depth, and the end."""
        if depth not in self.levels:
            head = self.keys >> np.uint64(64 - depth) if depth else np.zeros(len(self.keys), np.uint64)
            self.levels[depth] = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(self.keys)]])
        return self.levels[depth]

    def children(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' 0 and 1 children in the next level, or -1."""
        now, below = self.nodes(depth), self.nodes(depth + 1)
        first = np.searchsorted(below, now[node])
        last = np.searchsorted(below, now[node + 1]) - 1
        bit = (self.keys[now[node]] >> np.uint64(63 - depth)) & np.uint64(1)
        zero = np.where(bit == 0, first, -1)
        one = np.where(last > first, last, np.where(bit == 1, first, -1))
        return zero, one


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        r = self.root
        while True:
            a, b = r[u], r[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(r, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = r[r]
                if (up == r).all():
                    break
                r[:] = up


def forest(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside left (right None) or between left and right, sorted distinct uint64.

    All of left share their first depth bits, and so do all of right.
    """
    same = right is None
    a, b = _Trie(left), _Trie(left if same else right)
    if not len(a.keys) or not len(b.keys):
        return []
    keys = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    linked = _Forest(len(keys))
    start = (int(left[0]) >> (64 - depth)) ^ (int(b.keys[0]) >> (64 - depth)) if depth else 0
    if start.bit_count() > budget:
        return []
    todo = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([start.bit_count()], np.int8))]
    while todo:
        depth, x, y, d = todo.pop()
        na, nb = a.nodes(depth), b.nodes(depth)
        single = (na[x + 1] - na[x] == 1) & (nb[y + 1] - nb[y] == 1)
        if depth == 64:
            single[:] = True
        if single.any():
            u, v = na[x[single]], nb[y[single]]
            near = (np.bitwise_count(a.keys[u] ^ b.keys[v]) <= budget) & ((u != v) if same else True)
            linked.link(u[near], v[near] + shift)
            x, y, d = x[~single], y[~single], d[~single]
        if not len(x):
            continue
        (x0, x1), (y0, y1) = a.children(depth, x), b.children(depth, y)
        nx, ny, nd = np.concatenate([x0, x1, x0, x1]), np.concatenate([y0, y1, y1, y0]), np.concatenate([d, d, d + 1, d + 1])
        keep = (nx >= 0) & (ny >= 0) & (nd <= budget)
        if same:
            keep &= nx <= ny
            twice = np.concatenate([np.zeros(3 * len(x), bool), x == y])  # (1, 0) of one node with itself is (0, 1) again
            keep &= ~twice
        nx, ny, nd = nx[keep], ny[keep], nd[keep]
        for i in range(0, len(nx), _PAIRS):
            todo.append((depth + 1, nx[i : i + _PAIRS], ny[i : i + _PAIRS], nd[i : i + _PAIRS]))
    moved = np.flatnonzero(linked.root != np.arange(len(keys)))
    return [(int(keys[i]), int(keys[linked.root[i]])) for i in moved]


def links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints (column fp, long) into their components."""
    spark = prints.sparkSession
    n = prints.count()
    want = math.ceil(math.log2(n / (BLOCK / 2))) if n > BLOCK else 0
    width = 64 // (budget + 1)
    whole, below = min(want, width), min(max(0, want - width), 20)  # bits that a piece gives, and bits cut further down
    depth, turns = whole + below, budget + 1 if want else 1
    turned = lambda r: F.col("fp") if not r else F.expr(f"shiftleft(fp, {width * r}) | shiftrightunsigned(fp, {64 - width * r})")
    each = prints.select(F.explode(F.array(*[F.struct(F.lit(r).alias("turn"), turned(r).alias("key")) for r in range(turns)])).alias("e")).select("e.*")
    each = each.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long"))
    sizes = each.groupBy("turn", "prefix").agg(F.count("*").alias("n"))
    salted = each.join(F.broadcast(sizes) if turns << depth <= 1 << 19 else sizes, ["turn", "prefix"])
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK).cast("long")).cast("int")
    blocks = stored(salted.withColumn("salt", salt).groupBy("turn", "prefix", "salt", "n").agg(F.sort_array(F.collect_list("key")).alias("keys")), "simhash-b")
    none = F.array().cast("array<long>")
    filled = blocks.where((F.col("n") <= BLOCK) & F.lit(below == 0)).select("turn", "keys", none.alias("keys2"))
    tasks = 4 * partitions(spark)
    if not below and (blocks.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        tasks = min(tasks, max(partitions(spark), turns << depth))  # each subtree is one block
    else:
        # Blocks of one subtree, and below whole pieces also of near subtrees, meet.
        several = blocks.where((F.col("n") > BLOCK) | F.lit(below > 0)).select("turn", "prefix", "salt")
        masks = spark.createDataFrame([(m,) for m in range(1 << below) if m.bit_count() <= budget], "mask long")
        meets = several.join(F.broadcast(masks)).select("turn", "prefix", "salt", F.col("prefix").bitwiseXOR(F.col("mask")).alias("p2")).where("p2 >= prefix")  # at most 2 ** below masks
        pairs = meets.join(several.select("turn", F.col("prefix").alias("p2"), F.col("salt").alias("s2")), ["turn", "p2"]).where("p2 > prefix or s2 >= salt")
        other = blocks.select("turn", F.col("prefix").alias("p2"), F.col("salt").alias("s2"), F.col("keys").alias("keys2"))
        same = (F.col("prefix") == F.col("p2")) & (F.col("salt") == F.col("s2"))
        met = pairs.join(blocks.select("turn", "prefix", "salt", "keys"), ["turn", "prefix", "salt"]).join(other, ["turn", "p2", "s2"]).select("turn", "keys", F.when(same, none).otherwise(F.col("keys2")).alias("keys2"))
        filled = filled.unionByName(met)
    filled = filled.repartition(tasks)

    def walk(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                left, right = (np.sort(np.asarray(k, np.int64).view(np.uint64)) for k in (r.keys, r.keys2))
                got = np.array(forest(left, right if len(right) else None, depth, budget), np.uint64).reshape(-1, 2)
                back = np.uint64(width * r.turn)
                got = got >> back | got << np.uint64(64) - back if r.turn else got
                yield pd.DataFrame({"a": got[:, 0].view(np.int64), "b": got[:, 1].view(np.int64)})

    with arrow_rows(spark, 16):
        found = stored(filled.mapInPandas(walk, "a long, b long"), "simhash-l")
    drop_stored(blocks)
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, fp, and columns keep): the fingerprint as a long. Null and empty texts have fingerprint zero."""
    prepare(docs.sparkSession)
    made = F.pandas_udf(lambda s: pd.Series(np.array([fingerprint(x if isinstance(x, str) else None, shingle, seed) for x in s], np.uint64).view(np.int64)), "long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), made(F.col(text)).alias("fp"), *keep)


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, and columns keep) for every row of docs.

    fingerprint is in 16 hex digits; component_id the smallest doc_id reachable over fingerprints that differ
    in at most budget bits. Rows of one id each appear; null ids keep their fingerprint and never name a
    component unless it has no other id. Empty input gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text, keep=keep), "simhash-f")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    prints = stored(prints, "simhash-d")
    comp = components(links(prints.select("fp"), budget)).withColumnRenamed("node", "fp")
    named = prints.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = stored(named.select("fp", "component").join(low, "component").select("fp", "component_id"), "simhash-c")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


def majorities(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints of the hashes between each two offsets: 64 bits, each set if set in over half of them; zero for none."""
    out = np.zeros(len(off) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        counts = np.zeros(64, np.int64)
        for at in range(a, b, _RUN):
            counts += np.unpackbits(h[at : min(b, at + _RUN)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > b - a, bitorder="little").view("<u8")[0]
    return out


def _signed(batches, shingle, n_bands):
    """Keys of the word sequences, zero without words, the fingerprint of the runs of words, and one hash for each band."""
    for pdf in batches:
        w, off = word_hashes([t if isinstance(t, str) else None for t in pdf["text"]], ascii_case=True)
        key = sequence_keys(w, off)
        some = np.flatnonzero(np.diff(off))
        h, so = shingle_hashes(w, off, shingle)
        found = np.zeros((len(key), n_bands), np.int64)
        if len(some):
            found[some] = minima(h, so[np.append(some, len(off) - 1)], n_bands, ROWS).view(np.int64)
        yield pd.DataFrame({"row": pdf["row"].to_numpy(), "key": key.view(np.int64), "fp": majorities(h, so).view(np.int64), "bands": list(found)})


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, component_id, and columns keep) for every row of docs, by verified similarity.

    Texts meet if the trie links their fingerprints within budget bits, or in a MinHash band where they differ in more. They are linked if their sets of runs of shingle words (white space between, A-Z in lower case) have a
    Jaccard similarity of at least similarity; a pair just there is found with probability 0.9999. component_id
    is the smallest doc_id reachable. Texts without words are one component. Null ids as in groups().
    """
    spark = docs.sparkSession
    prepare(spark)
    n_bands = bands(similarity)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("row"), *[F.col(k).alias(f"_keep{i}") for i, k in enumerate(keep)])
    signed = stored(source.select("row", "text").mapInPandas(lambda it: _signed(it, shingle, n_bands), "row long, key long, fp long, bands array<long>"), "simhash-p")
    rows = signed.groupBy("row").agg(F.min("key").alias("key"))
    distinct = stored(signed.where("key <> 0").groupBy("key").agg(F.min_by("bands", "row").alias("bands"), F.min_by("fp", "row").alias("fp"), F.min("row").alias("row")), "simhash-u")
    near = components(links(stored(distinct.select("fp").distinct(), "simhash-d"), budget)).withColumnRenamed("node", "fp")
    linked = distinct.select("key", "fp").join(near, "fp", "left").select("key", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("bucket"))
    opened = linked.unionByName(distinct.select("key", F.explode("bands").alias("bucket")))

    def shingled(batches):
        for pdf in batches:
            w, off = word_hashes(pdf["text"].tolist(), ascii_case=True)
            h, so = shingle_hashes(w, off, shingle)
            yield pd.DataFrame({"key": pdf["key"].to_numpy(), "shingles": [np.unique(h[a:b]).view(np.int64) for a, b in zip(so[:-1], so[1:], strict=True)]})

    def sets_of(keys: DataFrame) -> DataFrame:
        wanted = distinct.select("key", "row").join(keys, "key", "left_semi")
        return source.select("row", "text").join(wanted, "row").select("key", "text").mapInPandas(shingled, "key long, shingles array<long>").dropDuplicates(["key"])

    part, comp = joined(opened, sets_of, similarity, block=32, batch=16)  # texts are longer than paragraphs
    drop_stored(distinct)
    own = rows.join(part.withColumnRenamed("node", "key"), "key", "left").select("row", F.coalesce("component", "key").alias("part"))
    named = own.join(comp.withColumnRenamed("node", "part"), "part", "left").select("row", F.coalesce("component", "part").alias("component"))
    placed = stored(source.drop("text").join(named, "row"), "simhash-c")
    low = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(low, "component").select("doc_id", "component_id", *[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)])
