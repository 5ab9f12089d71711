"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples live in an inverted index over all their terms, cut into blocks of neighbours. Rarer terms are added
up from their postings; the postings of the most frequent ones, full or nearly so, lie block by block in a table and keep
their greatest weight in each block. What a block's best example has of the rarer terms, and the sum of a text's weights
times those maxima, bound every cosine in it. A few hundred texts are read at once: each opens its blocks of greatest bound,
then every block whose bound reaches its k-th best cosine, and texts that open one block share its product.
A term's weight is (1 + log tf) idf times its bearing on the label among the examples, a tenth where it has none: by plain
TF-IDF the few words that make a text toxic drown among hundreds of others.
The neighbours' labels vote by the square of their cosine over the nearest one's, and a monotone map fitted on the examples
themselves (each without its own vote) turns votes into probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, prepare, stored
from .text import STEM as STEM_MARK
from .text import Slots, U, mix, word_and_stem_hashes, word_hashes

_WORD = re.compile(r"[0-9a-z_\x80-\U0010FFFF]+")
STEM = 6
BLOCK = 64
OPENED = 4
BINS = 50
EVIDENCE = 5
DENSE = 512  # most frequent terms whose weights lie in a table
TEXTS = 128  # read at once
CHANCE = 10.8  # log-likelihood ratio that one of a thousand terms without bearing reaches
FLOOR = 0.1  # weight of a term without bearing on the label


def terms(text: str | None) -> Counter:
    """Counts of lower-case words, and of the first letters of longer words marked with a star."""
    found = Counter(_WORD.findall(text.lower())) if text else Counter()
    for w in [w for w in found if len(w) > STEM]:
        found[w[:STEM] + "*"] += found[w]
    return found


def term_hashes(vocab: list[str]) -> np.ndarray:
    """Hashes of terms, as Reader finds them in texts."""
    h = word_hashes([t.removesuffix("*") for t in vocab], punctuation=False)[0]
    return np.where([t[-1] == "*" for t in vocab], mix(h ^ STEM_MARK), h)


class Reader:
    """Counts in many texts of the terms of these hashes."""

    def __init__(self, hashes: np.ndarray):
        self.slots, self.size = Slots(hashes), len(hashes)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, term and count, in order of texts and terms; the counts of terms() that are known."""
        words, stems, off = word_and_stem_hashes(texts, STEM, punctuation=False)
        owner = np.repeat(np.arange(len(texts)) * self.size, np.diff(off))
        long = np.flatnonzero(stems)
        at, owner = self.slots.find(np.concatenate([words, stems[long]])), np.concatenate([owner, owner[long]])
        known = at >= 0
        key, n = np.unique(owner[known] + at[known], return_counts=True)
        return *np.divmod(key, max(self.size, 1)), n


class Postings:
    """Weights of each term's examples, by term; postings[at] are the dense rows of terms."""

    def __init__(self, start: np.ndarray, place: np.ndarray, value: np.ndarray, examples: int):
        """Places and weights by term, start where each term's begin, a number more than terms; place in rising order in each term."""
        self.start, self.place, self.value, self.examples = start, place, value, examples

    def _of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings, and how many each term has."""
        n = self.start[at + 1] - self.start[at]
        return np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        where, n = self._of(at)
        out = np.zeros((len(at), self.examples))
        out[np.repeat(np.arange(len(at)), n), self.place[where]] = self.value[where]
        return out

    def dots(self, texts: int, text: np.ndarray, at: np.ndarray, v: np.ndarray, wide: int) -> np.ndarray:
        """Sums of products of texts' weights v with the examples', wide numbers for each text."""
        out, edge = np.zeros((texts, wide)), np.searchsorted(text, np.arange(texts + 1))
        for i in range(texts):  # a text's postings stay in cache
            own = slice(edge[i], edge[i + 1])
            where, n = self._of(at[own])
            out[i] = np.bincount(self.place[where], self.value[where] * np.repeat(v[own], n), wide)
        return out


@dataclass
class Index:
    """Postings of examples in block order, labels, and the most frequent terms' table and greatest weights by block."""

    names: pa.Array | None  # the terms in order of their numbers; where texts are read, hashes stand for them
    idf: np.ndarray
    bearing: np.ndarray  # of each term on the label, see relevance()
    weights: Postings
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    bare: float  # share of label 1 among examples without a term
    k: int
    hashes: np.ndarray  # of the terms, in order of their numbers
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def _open(self) -> None:
        """The table is made from the postings where the index is used."""
        n = np.diff(self.weights.start)
        common = np.argsort(-n, kind="stable")[:DENSE]
        common = common[n[common] * 16 >= self.weights.examples]
        self._row = np.full(len(n), -1)
        self._row[common] = np.arange(len(common))
        self._blocks = max(1, -(-self.weights.examples // BLOCK))
        table = np.zeros((len(common), self._blocks * BLOCK))
        table[:, : self.weights.examples] = self.weights[common]
        self._table = np.ascontiguousarray(table.reshape(len(common), self._blocks, BLOCK).transpose(1, 0, 2))
        self._top = np.ascontiguousarray(self._table.max(axis=2).T)
        self._reader = Reader(self.hashes)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"names": None}

    @property
    def vocab(self) -> dict[str, int]:
        """Numbers of the terms, where the index was made."""
        if not hasattr(self, "_vocab"):
            self._vocab = {t: i for i, t in enumerate(self.names.to_pylist() if self.names is not None else ())}
        return self._vocab

    def vector(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of one text, of length 1 over the terms that some example holds."""
        known = [(self.vocab[t], n) for t, n in found.items() if t in self.vocab]
        at, n = (np.array(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0))
        v = (1 + np.log(n)) * self.idf[at] * self.bearing[at]
        return at, v / np.linalg.norm(v) if len(v) else v

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, term and weight of many texts, as vector() weighs one."""
        if not hasattr(self, "_table"):
            self._open()
        text, at, n = self._reader.counts(texts)
        v = (1 + np.log(n)) * self.idf[at] * self.bearing[at]
        return text, at, v / np.sqrt(np.bincount(text, v * v, len(texts)))[text]

    def nearest(self, at: np.ndarray, v: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine, ties to the earlier one, and their cosines; skip is left out."""
        near, cos = self.nearest_of(1, np.zeros(len(at), np.int64), at, v, np.array([skip]))
        return near[0][near[0] >= 0], cos[0][near[0] >= 0]

    def nearest_of(self, texts: int, text: np.ndarray, at: np.ndarray, v: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """nearest() of many texts, a row for each: examples and cosines, -1 and 0 where there are fewer than k."""
        if not hasattr(self, "_table"):
            self._open()
        n, wide = len(self.labels), self._blocks * BLOCK
        row, dense = self._row[at], np.zeros((texts, self._table.shape[1]))
        common = row >= 0
        dense[text[common], row[common]] = v[common]
        rare = self.weights.dots(texts, text[~common], at[~common], v[~common], wide).reshape(texts, self._blocks, BLOCK)
        bound = dense @ self._top + rare.max(axis=2) + 1e-9
        cos = np.full((texts, self._blocks, BLOCK), -1.0)
        shut = np.ones((texts, self._blocks), bool)
        whole = cos.reshape(texts, wide)

        def open_(these: np.ndarray) -> None:
            for b in np.flatnonzero(these.any(axis=0)).tolist():
                who = np.flatnonzero(these[:, b])
                cos[who, b] = np.round(dense[who] @ self._table[b] + rare[who, b], 12)
            shut[these] = False
            whole[:, n:] = -1.0
            left_out = np.flatnonzero(skip >= 0)
            whole[left_out, skip[left_out]] = -1.0

        first = np.zeros_like(shut)
        np.put_along_axis(first, np.argpartition(-bound, min(OPENED, self._blocks) - 1, axis=1)[:, :OPENED], True, axis=1)
        open_(first)
        k = min(self.k, wide)
        opened = cos[first].reshape(texts, -1)
        least = np.partition(opened, -min(k, opened.shape[1]), axis=1)[:, -min(k, opened.shape[1])] if opened.shape[1] >= k else np.full(texts, -1.0)
        open_(shut & (bound >= least[:, None]))
        near, best = np.full((texts, self.k), -1), np.zeros((texts, self.k))
        who, place = np.nonzero((whole >= least[:, None]) & (whole >= 0))
        order = np.lexsort((place, -whole[who, place], who))
        who, place = who[order], place[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < self.k
        near[who[kept], rank[kept]] = place[kept]
        best[who[kept], rank[kept]] = whole[who[kept], place[kept]]
        return near, best

    def votes(self, texts: list[str | None], skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The share of label 1 that each text's neighbours vote for, the neighbours (-1 for none) and their cosines."""
        near, cos, votes = np.full((len(texts), self.k), -1), np.zeros((len(texts), self.k)), np.full(len(texts), self.bare)
        if not len(self.labels):
            return votes, near, cos
        text, at, v = self.vectors(texts)
        held = np.unique(text)  # texts with a term of the examples
        if len(held):
            near[held], cos[held] = self.nearest_of(len(held), np.searchsorted(held, text), at, v, np.full(len(held), -1) if skip is None else skip[held])
            w = (cos[held] / np.maximum(cos[held].max(axis=1), 1e-9)[:, None]) ** 2  # of the nearest: with all terms every cosine of unlike texts is small
            w[near[held] < 0] = 0
            votes[held] = ((w * self.labels[near[held]]).sum(axis=1) + self.prior) / (w.sum(axis=1) + 1)
        return votes, near, cos

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(votes, 0.0, 1.0) if self.steps is None else np.interp(votes, *self.steps)


def _monotone(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest rising means."""
    out: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        out.append([value, weight, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([v for v, _, m in out for _ in range(int(m))])


def relevance(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Factor of each term's weight: FLOOR where examples of both labels hold it alike, near 1 where the label decides.

    It follows the log-likelihood ratio of term and label, above what one term of a thousand reaches by chance.
    """
    n = max(n1 + n0, 1)
    total = np.zeros(len(with_1))
    for seen, rows, size in ((with_1, with_1 + with_0, n1), (with_0, with_1 + with_0, n0), (n1 - with_1, n - with_1 - with_0, n1), (n0 - with_0, n - with_1 - with_0, n0)):
        total += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1) * n / np.maximum(rows * size, 1)), 0)
    return FLOOR + (1 - FLOOR) * np.maximum(0, 1 - CHANCE / np.maximum(total, 1e-9))


def built(names: pa.Array, hashes: np.ndarray, df: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ids: np.ndarray, k: int) -> Index:
    """The index of examples, each the numbers of its terms and their counts; df by term, the last the number of documents.

    Examples are weighed one by one and written to their postings, so that beside these nothing is as long as all postings.
    """
    n1, held, with_1 = int(y.sum()), np.zeros(len(names)), np.zeros(len(names))
    for (term, _), label in zip(examples, y.tolist(), strict=True):
        held[term] += 1
        with_1[term] += label > 0
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    bearing = relevance(with_1, held - with_1, n1, len(y) - n1)
    factor = idf * bearing

    def weighed(i: int) -> np.ndarray:
        term, counts = examples[i]
        value = (np.log(counts.astype(np.float64)) + 1) * factor[term]
        return value / np.sqrt(np.bincount(np.zeros(len(value), np.int64), value * value))

    full = np.array([i for i, (term, _) in enumerate(examples) if len(term)], np.int64)
    strongest = np.array([examples[i][0][np.argmax(weighed(i))] for i in full.tolist()], np.int64)
    full = full[np.lexsort((ids[full], y[full], strongest))]  # neighbours share their strongest term
    bare = [label for (term, _), label in zip(examples, y.tolist(), strict=True) if not len(term)]
    prior = n1 / max(len(y), 1)
    start = np.append(0, np.cumsum(held.astype(np.int64)))
    place, value, free = np.empty(start[-1], np.int32), np.empty(start[-1]), start[:-1].copy()
    for i, e in enumerate(full.tolist()):
        term = examples[e][0]
        place[free[term]], value[free[term]] = i, weighed(e)
        free[term] += 1
    return Index(names, idf, bearing, Postings(start, place, value, len(full)), y[full].astype(np.float64), ids[full], prior, (sum(bare) + prior) / (len(bare) + 1), k, hashes)


def _dealt(texts: pd.Series):
    """Lists of at most TEXTS texts, null for what is no text."""
    for a in range(0, len(texts), TEXTS):
        yield [t if isinstance(t, str) else None for t in texts.iloc[a : a + TEXTS]]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = 8192, k: int = 15) -> Index:
    """Fits the index on labelled documents.

    The fit is bounded by max_examples labelled rows, about so many, an even share by hash if there are more. All
    their terms count; each term's document frequency is of all of docs, its bearing of the examples. Rows without label or document do not
    count; of several labels of one document the greatest holds. Without examples every score is 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    n = own.count()
    if n > max_examples:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1 << 32)) < int(max_examples / n * (1 << 32)))
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"), "toxicity-e")  # at most about max_examples pairs of numbers

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([list(terms(x)) for x in texts], dtype=object)

    if rows.isEmpty():
        return Index(None, np.zeros(0), np.zeros(0), Postings(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), 0), np.zeros(0), np.zeros(0, np.int64), 0.0, 0.0, k, np.zeros(0, U))
    names = rows.select(F.explode(held("text")).alias("t")).distinct().toArrow()["t"].combine_chunks()  # terms of the bounded examples
    names = names.take(pc.sort_indices(names))
    hashes = np.concatenate([np.zeros(0, U), *(term_hashes(names[a : a + (1 << 15)].to_pylist()) for a in range(0, len(names), 1 << 15))])
    words = spark.sparkContext.broadcast(hashes)

    def seen(batches):
        reader, df, n = Reader(words.value), np.zeros(len(words.value), np.int64), 0
        for pdf in batches:
            for texts in _dealt(pdf["text"]):
                df += np.bincount(reader.counts(texts)[1], minlength=len(df))
            n += len(pdf)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"i": np.append(at, -1), "n": np.append(df[at], n)})

    counted = docs.select("text").mapInPandas(seen, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # of all documents
    df = np.zeros(len(names) + 1, np.int64)
    for part in counted.to_batches():
        df[part["i"].to_numpy()] = part["n"].to_numpy()  # the last is the number of documents
    del counted

    @F.pandas_udf("struct<i:array<int>,n:array<int>>")
    def kept(texts: pd.Series) -> pd.DataFrame:
        reader, i, n = Reader(words.value), [], []
        for part in _dealt(texts):
            text, at, count = reader.counts(part)
            edge = np.searchsorted(text, np.arange(1, len(part)))
            i += np.split(at.astype(np.int32), edge)
            n += np.split(count.astype(np.int32), edge)
        return pd.DataFrame({"i": i, "n": n})

    got = rows.select("doc_id", "y", kept("text").alias("terms")).select("doc_id", "y", "terms.i", "terms.n").toArrow()  # the bounded examples
    y, ids = got["y"].to_numpy().astype(np.int64), got["doc_id"].to_numpy().astype(np.int64)
    examples = []
    for part in got.to_batches():  # as they lie, without a copy
        edge = np.cumsum(part["i"].value_lengths().to_numpy(zero_copy_only=False))[:-1]
        examples += zip(*(np.split(part[c].flatten().to_numpy(), edge) for c in ("i", "n")), strict=True)
    index = built(names, hashes, df, examples, y, ids, k)
    del got, part, examples
    pa.default_memory_pool().release_unused()
    words.destroy()
    if len(index.labels):
        places = {int(d): i for i, d in enumerate(index.ids)}
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("double")
        def without_own(ids: pd.Series, texts: pd.Series) -> pd.Series:
            own = np.array([places.get(int(d), -1) for d in ids], np.int64)
            parts = [shared.value.votes(part, own[i * TEXTS : i * TEXTS + len(part)])[0] for i, part in enumerate(_dealt(texts))]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        bins = rows.select("y", without_own("doc_id", "text").alias("v")).groupBy(F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("v").alias("v")).orderBy("v").collect()
        shared.destroy()  # the driver's copy too
        x, c = np.array([r.v for r in bins]), np.array([r.n for r in bins], float)
        index.steps = (x, _monotone(x, (np.array([float(r.y) for r in bins]) + index.prior) / (c + 1), c))
    drop_stored(rows)
    return index


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 if score >= 0.5) and evidence (the nearest examples: doc_id, cosine, label).

    Columns of these names are replaced. Null and empty texts, and texts without a term of the examples, get
    the share of label 1 among such examples and no evidence.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(index)  # bounded by max_examples

    @F.pandas_udf("struct<score:double,evidence:array<struct<doc_id:long,cosine:double,label:int>>>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        ix = shared.value
        scores, why = [], []
        for part in _dealt(texts):
            votes, near, cos = ix.votes(part)
            scores.append(ix.calibrated(votes))
            ids, labels = (x[near[:, :EVIDENCE]].tolist() if len(x) else [[]] * len(part) for x in (ix.ids, ix.labels.astype(np.int64)))
            for d, c, y in zip(ids, cos[:, :EVIDENCE].tolist(), labels, strict=True):
                why.append([{"doc_id": a, "cosine": b, "label": z} for a, b, z in zip(d, c, y, strict=False) if b > 0])
        return pd.DataFrame({"score": np.concatenate(scores) if scores else [], "evidence": why})

    kept = [c for c in docs.columns if c not in ("score", "predicted", "evidence")]
    own = fresh(docs, "_tox")
    out = docs.select(*kept, judged(F.col(text)).alias(own))
    return out.select(*kept, F.col(f"{own}.score").alias("score"), (F.col(f"{own}.score") >= 0.5).cast("int").alias("predicted"), F.col(f"{own}.evidence").alias("evidence"))
