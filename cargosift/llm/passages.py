"""Passages that documents share inside differing paragraphs: winnowed word windows, spans and connected components.

A text is one run of words, whatever its lines. Of every GAP neighbouring windows of SIZE words the one of least hash
is kept, so any run of SIZE + GAP - 1 equal words in two documents keeps at least one window of equal words in both.
Equal windows of unlike documents are shared; a document's overlapping shared windows are one passage, and passages
that hold a window in common, directly or over others, are one class.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, fresh, prepare, stored
from .text import U, mix, powers, word_hashes

SIZE = 40
GAP = 12
_WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010FFFF]+")


def _least(h: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each n neighbouring numbers, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = pick(h[:-step], h[step:])
        size += step
    return h


def windows(texts: list[str | None], size: int = SIZE, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and hash of the kept windows of size words; texts of fewer words have none."""
    w, off = word_hashes(texts, punctuation=False)
    n = np.maximum(np.diff(off) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(start):
        return owner, start, np.zeros(0, np.int64)
    p, inverse = powers(len(w) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(w * p[: len(w)])])
    at = off[owner] + start
    h = mix((total[at + size] - total[at]) * inverse[at])
    # Between texts lie gap - 1 places of no window: a window at either end is kept if least among those inside.
    padded = np.full(len(h) + (len(n) + 1) * (gap - 1), np.iinfo(U).max, U)
    place = np.arange(len(h)) + (owner + 1) * (gap - 1)
    padded[place] = h
    kept = _least(_least(padded, gap, np.minimum), gap, np.maximum)[place - gap + 1] == h
    return owner[kept], start[kept], h[kept].view(np.int64)


def shared_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, gap: int = GAP) -> DataFrame:
    """Rows (row, doc_id, start, key, first) of kept windows that another document holds too; first: of all of its key."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def cut(batches):
        for pdf in batches:
            owner, start, key = windows(pdf["text"].tolist(), size, gap)
            yield pd.DataFrame({"row": pdf["row"].to_numpy()[owner], "doc_id": pdf["doc_id"].to_numpy()[owner], "start": start, "key": key})

    each = source.mapInPandas(cut, "row long, doc_id long, start int, key long")
    # Counts fold in each task before they are dealt out, and the join can split a window that very many documents hold.
    again = each.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min(F.struct("doc_id", "start", "row")).alias("lead")).where("low <> high")
    again = stored(again.select("key", "lead"), "passages-k")
    first = (F.col("row") == F.col("lead.row")) & (F.col("start") == F.col("lead.start"))
    found = stored(each.join(again, "key").select("row", "doc_id", "start", "key", first.alias("first")), "passages-w")
    drop_stored(again)
    return found


def spans(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (row, island, doc_id, start, n_words, keys): each document's windows, overlapping and adjacent ones joined."""
    w = Window.partitionBy("row").orderBy("start")
    own = found.dropDuplicates(["row", "start"]).withColumn("new", F.coalesce((F.col("start") > F.lag("start").over(w) + size).cast("int"), F.lit(1)))
    own = own.withColumn("island", F.sum("new").over(w))
    return own.groupBy("row", "island").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), (F.max("start") + size - F.min("start")).alias("n_words"), F.sort_array(F.collect_set("key")).alias("keys"), F.max(~F.col("first")).alias("removed"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, gap: int = GAP) -> DataFrame:
    """Rows (doc_id, row, start, n_words, class_doc_id, class_start, n_class, removed): passages that other documents share.

    Words are letters, digits, _ in lower case; start is the number of the first one. Every run of size + gap - 1 words that two
    documents share lies in a passage of both, and each passage holds size shared words at least. A class is named by its first passage in
    order of (doc_id, start). removed tells whether some of its words came before, in order of (doc_id, start); those are
    what without_repeats() cuts. Null and shorter texts take no part; repeated rows of one id and text count as one.
    """
    found = shared_windows(docs, id_col, text, size, gap)
    each = stored(spans(found, size).withColumn("sign", F.xxhash64("keys")), "passages-s")
    drop_stored(found)
    edges = each.select(F.col("sign").alias("a"), F.explode("keys").alias("b")).distinct()
    comp = components(edges).select(F.col("node").alias("sign"), F.col("component").alias("class"))
    signs = each.groupBy("sign").agg(F.min(F.struct("doc_id", "start", "row")).alias("lead"), F.count("*").alias("n"))
    named = signs.join(comp, "sign")
    whole = named.groupBy("class").agg(F.min("lead").alias("lead"), F.sum("n").alias("n_class"))
    known = named.select("sign", "class").join(whole, "class").select("sign", "lead", "n_class")
    return each.join(known, "sign").select("doc_id", "row", "start", "n_words", F.col("lead.doc_id").alias("class_doc_id"), F.col("lead.start").alias("class_start"), "n_class", "removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, gap: int = GAP) -> DataFrame:
    """docs without the words of shared windows that came before in order of (doc_id, start); other columns stay as they were.

    Each cut run goes with the marks and white space up to the next word. The first place of every window stays, save for words of
    it that another window had earlier. Null texts stay null, texts without shared windows as they are; repeated rows of one id and text lose the same words.
    """
    row, at_cut = fresh(docs, "_row"), fresh(docs, "_cuts")
    cuts = spans(shared_windows(docs, id_col, text, size, gap).where(~F.col("first")), size)
    cuts = cuts.groupBy("row").agg(F.collect_list(F.struct("start", "n_words")).alias(at_cut))  # of one text

    @F.pandas_udf("string")
    def cut(texts: pd.Series, each: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, each, strict=True):
            if own is not None:
                at = [m.start() for m in _WORD.finditer(t)] + [len(t)]
                for c in sorted(own, key=lambda c: -c["start"]):
                    t = t[: at[c["start"]]] + t[at[c["start"] + c["n_words"]] :]
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text))).join(cuts.withColumnRenamed("row", row), row, "left")
    return joined.withColumn(text, F.when(F.col(at_cut).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(at_cut)))).select(*docs.columns)
