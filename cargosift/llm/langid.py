"""Language of texts by letter n-grams in bit-sliced Bloom filters.

Every language has a Bloom filter of its n-grams, all of one size. The filters are stored by position: the
word at a position has one bit for each language, so the words at an n-gram's positions, combined with AND,
name every language that holds it. Counts by language, less the false positives expected from each filter's
fill, decide. Pairs of letters tell languages of large alphabets apart, runs of four those of one alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare
from .text import U, mix

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHUNK = 1 << 19
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


ORDERS = (2, 4)


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of each run of order code points."""
    m = len(codes) - order + 1
    key = np.full(m, order, U)
    for j in range(order):
        key = mix(key) ^ codes[j : j + m]
    return key


def grams(texts: list[str | None]):
    """Yields (keys, place of each key's text) for runs of texts and each order; long texts come in several runs.

    Letters in lower case; all else counts as one space between words. Runs with a space inside are left out.
    """
    table, more = _letter_table(), max(ORDERS) - 1
    at = 0
    pieces = [(i, t[a : a + _CHUNK + more], a + _CHUNK < len(t)) for i, t in enumerate(texts) if t for a in range(0, len(t), _CHUNK)]
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) < _CHUNK):
            size += len(pieces[end][1]) + 2
            end += 1
        low = [t.lower() for _, t, _ in pieces[at:end]]
        codes = np.frombuffer(("  ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array([i for i, _, _ in pieces[at:end]]), [len(t) + 2 for t in low])
        # Of a piece that another follows only the runs that begin before the next one count.
        ends = np.cumsum([0] + [len(t) + 2 for t in low])
        begins = np.ones(len(codes), bool)
        for (_, _, followed), start in zip(pieces[at:end], ends[:-1], strict=True):
            if followed:
                begins[start + _CHUNK : start + _CHUNK + more + 2] = False
        codes = np.where(table[codes], codes, 32)
        keep = (codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)
        codes, owner, begins = codes[keep].astype(U), owner[keep], begins[keep]
        for order in ORDERS:
            m = len(codes) - order + 1
            if m > 0:
                good = (owner[order - 1 :] == owner[:m]) & begins[:m]
                for j in range(1, order - 1):
                    good &= codes[j : j + m] != 32
                yield _keys(codes, order)[good], owner[:m][good]
        at = end


def positions(keys: np.ndarray, slots: int):
    return [(mix(keys ^ U(s)) % U(slots)).astype(np.int64) for s in _SEEDS]


def _counts(batches):
    held: dict[str, list] = {}

    def merge(parts):
        keys, n = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        u, inv = np.unique(keys, return_inverse=True)
        return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)

    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            for keys, _ in grams(part["text"].tolist()):
                held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
            if len(held.get(lang, ())) > 64:
                held[lang] = [merge(held[lang])]
    for lang, parts in held.items():
        keys, n = merge(parts)
        yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n})


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # slots x words of 63 languages
    fill: np.ndarray  # share of set bits by language
    default: int  # place of the most frequent language


def learn(docs: DataFrame, least_rate: float = 1e-5, bits: int = 32) -> Filters:
    """Builds the filters from columns text and lang of all rows with both.

    A language holds an n-gram that makes up least_rate of all its n-grams, whatever the others hold, so 1 / least_rate of them at most. Filters have
    bits slots for each n-gram of the language that holds most of them, up to a power of two. The driver receives the filters alone.
    Without learnable rows there is no language.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counted = own.mapInPandas(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    sizes = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        counted.unpersist()
        return Filters([], np.zeros((1, 1), np.int64), np.zeros(0), 0)
    size = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(sizes[lang]))])
    held = counted.where(F.col("n") >= least_rate * size[F.col("lang")])
    slots = 1 << 16
    while slots < bits * max(r["count"] for r in held.groupBy("lang").count().collect()):
        slots *= 2
    place = {lang: i for i, lang in enumerate(langs)}

    def slotted(batches):
        for pdf in batches:
            lang = pdf["lang"].map(place).to_numpy(np.int64)
            for pos in positions(pdf["gram"].to_numpy(np.int64).astype(U), slots):
                yield pd.DataFrame({"pos": pos, "word": lang // 63, "bits": np.int64(1) << (lang % 63)})

    rows = held.select("lang", "gram").mapInPandas(slotted, "pos long, word long, bits long").groupBy("pos", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    counted.unpersist()
    masks = np.zeros((slots, len(langs) // 63 + 1), np.int64)
    masks[rows["pos"], rows["word"]] = rows["bits"]
    fill = np.array([((masks[:, i // 63] >> (i % 63)) & 1).mean() for i in range(len(langs))])
    return Filters(langs, masks, fill, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)))


def popcounts(texts: list[str | None], f: Filters) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in all, and n-grams by language whose filter holds them, of each text."""
    total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(f.langs)))
    for keys, owner in grams(texts):
        found = None
        for pos in positions(keys, len(f.masks)):
            found = f.masks[pos] if found is None else found & f.masks[pos]
        total += np.bincount(owner, minlength=len(texts))
        for i in range(len(f.langs)):
            bit = (found[:, i // 63] >> (i % 63)) & 1
            hits[:, i] += np.bincount(owner, weights=bit, minlength=len(texts))
    return total, hits


def predict(docs: DataFrame, f: Filters, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1, the language's share of the corrected counts), replacing such columns.

    Null texts and texts without a letter are 'und' with score 0, as is every text if no language was
    learned. A text whose n-grams are all unknown gets the most frequent language and score 0; ties go to
    the language first in order.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(f)  # slots words a 63 languages

    @F.pandas_udf("struct<lang:string,score:double>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        listed = [None if t is None or not isinstance(t, str) else t for t in texts]
        if not own.langs:
            return pd.DataFrame({"lang": ["und"] * len(listed), "score": 0.0})
        total, hits = popcounts(listed, own)
        false = own.fill ** len(_SEEDS)
        true = np.maximum((hits - total[:, None] * false) / (1 - np.minimum(false, 0.999)), 0)
        best, whole = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(whole > 0, true.max(axis=1) / np.maximum(whole, 1e-12), 0.0)
        best = np.where(whole > 0, best, own.default)
        table = _letter_table()
        out = []
        for i, t in enumerate(listed):
            letters = total[i] > 0 or bool(t and any(table[ord(c)] for c in t))
            out.append((own.langs[best[i]], float(score[i])) if letters else ("und", 0.0))
        return pd.DataFrame(out, columns=["lang", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = fresh(docs, "_lang")
    return docs.select(*kept, judged(F.col(text)).alias(own)).select(*kept, F.col(f"{own}.lang").alias("lang_pred"), F.col(f"{own}.score").alias("score"))
