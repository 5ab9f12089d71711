"""Test items inside documents, by size-partitioned MinHash containment search with exact verification.

Items and documents are parted by their number of shingles, in powers of two. For each pair of parts the
hash space is cut into as many bins as the parts' sizes ask for, and the smallest hash of every bin is kept
(one-permutation MinHash). The number of bins is the least that finds an item contained to the threshold
with probability 1 - miss: an item's shingle is its bin's least hash in the document too with probability
(1 - exp(-x)) / x at x shingles a bin. Parts of very short items, for which no number of bins will do, keep
every shingle. A document and an item that agree in any bin are compared shingle by shingle.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .text import U, shingle_hashes, word_hashes

_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
SIZE = 5


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


def shingles(found: list[bytes], size: int = SIZE) -> set[bytes]:
    """Runs of size words; of fewer words the whole sequence; none without words."""
    if not found:
        return set()
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


def load(item_shingles: int, threshold: float, miss: float) -> float:
    """Most document shingles a bin that find an item of that size with probability 1 - miss; 0 if none does."""
    least = 1 - miss ** (1 / max(1, math.ceil(threshold * item_shingles)))
    lo, hi = 0.0, 64.0
    for _ in range(50):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if (1 - math.exp(-x)) / max(x, 1e-12) >= least else (lo, x)
    return lo if lo >= 0.25 else 0.0


def minima(h: np.ndarray, bins: int) -> np.ndarray:
    """The least of sorted hashes in each bin; 0 bins keeps all."""
    if not bins or not len(h):
        return h
    b = ((h >> U(32)) * U(bins)) >> U(32)
    return h[np.concatenate([[True], b[1:] != b[:-1]])]


def size_class(n: int) -> int:
    return max(0, (n - 1).bit_length())


class Items:
    """A bounded block of test items with their sketches by pair of size classes, made as documents ask for them."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, miss: float):
        self.threshold, self.miss = threshold, miss
        self.ids = [i for i, _ in rows]
        self.sets = [shingles(words(t)) for _, t in rows]
        w, off = word_hashes([t for _, t in rows], punctuation=False)
        self.short = sorted({int(n) for n in np.diff(off) if 0 < n < SIZE})
        h, so = shingle_hashes(w, off, SIZE)
        self.hashes = [np.unique(h[a:b]) for a, b in zip(so[:-1], so[1:], strict=True)]
        self.parts: dict[int, list[int]] = {}
        self.brief: dict[int, list[int]] = {}
        for i, x in enumerate(self.hashes):
            n = int(off[i + 1] - off[i])
            if 0 < n < SIZE:
                self.brief.setdefault(n, []).append(i)
            elif n:
                self.parts.setdefault(size_class(len(x)), []).append(i)
        self.made: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}

    def index(self, part: int, doc_class: int) -> tuple[int, np.ndarray, np.ndarray]:
        if (part, doc_class) not in self.made:
            x = load(2 ** (part - 1) + 1 if part else 1, self.threshold, self.miss)
            bins = math.ceil(2**doc_class / x) if x else 0
            mins = [minima(self.hashes[i], bins) for i in self.parts[part]]
            h, own = np.concatenate(mins), np.repeat(self.parts[part], [len(m) for m in mins])
            order = np.argsort(h, kind="stable")
            self.made[part, doc_class] = bins, h[order], own[order]
        return self.made[part, doc_class]

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that agree with a document's sorted distinct shingle hashes in a bin."""
        found: set[int] = set()
        for part in self.parts:
            bins, index, own = self.index(part, size_class(len(h)))
            m = minima(h, bins)
            a, z = np.searchsorted(index, m), np.searchsorted(index, m, "right")
            for i in np.flatnonzero(z > a):
                found.update(own[a[i] : z[i]].tolist())
        return found

    def inside(self, text: str, candidates: set[int]) -> list[tuple[int, int, int]]:
        """(item, its shingles, those found) of the candidates that the text really holds."""
        got, out = words(text), []
        own = shingles(got)
        for i in candidates:
            s = self.sets[i]
            n = len(next(iter(s)).split(b" "))
            hit = len(s & (own if n == SIZE else shingles(got, n)))
            if hit >= self.threshold * len(s) - 1e-9:
                out.append((self.ids[i], len(s), hit))
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, miss: float = 1e-4, block: int = 20000) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found, containment): documents holding at least threshold of an item's shingles.

    Shingles are five lower-case words (letters, digits, _; all non-ASCII counts as letters), distinct; an
    item of fewer words is one shingle, its whole sequence, found anywhere in a document. Null and empty
    texts hold and make no shingles. Items go out in blocks of at most about block, one pass over the
    documents each. Repeated rows give their pairs once.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    n_blocks = max(1, -(-own.count() // block))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, n_shingles long, n_found long"
    out = None
    for b in range(n_blocks):
        rows = [(r.i, r.t) for r in own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).orderBy("i", "t").collect()]
        shared = spark.sparkContext.broadcast(Items(rows, threshold, miss))

        def search(batches, shared=shared):
            ix: Items = shared.value
            for pdf in batches:
                texts = pdf["text"].tolist()
                w, off = word_hashes(texts, punctuation=False)
                h, so = shingle_hashes(w, off, SIZE)
                brief = {n: shingle_hashes(w, off, n) for n in ix.short}
                got = []
                for k, (a, z) in enumerate(zip(so[:-1], so[1:], strict=True)):
                    if a == z:
                        continue
                    near = ix.candidates(np.unique(h[a:z]))
                    for n, (bh, bo) in brief.items():
                        near |= {i for i in ix.brief[n] if ix.hashes[i][0] in bh[bo[k] : bo[k + 1]]}
                    if near:
                        got += [(pdf["doc_id"].iloc[k], *x) for x in ix.inside(texts[k], near)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "n_shingles", "n_found"])

        part = source.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct().withColumn("containment", F.col("n_found") / F.col("n_shingles"))
