"""Repeated paragraphs by MinHash banding, exact Jaccard similarity and connected components.

Equal paragraphs fold into one row first. Bands are tuned for recall at the threshold; distinct paragraphs
that share a band meet in its bucket. Each is first compared with its buckets' heads, which joins most of a large
group at a linear price. Buckets that still hold several components are cut into blocks; blocks meet unless
both are of one component, and a task compares shingle sets of components it has not joined yet, so that it
reports a spanning forest of the verified links and not every pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, drop_stored, fresh, partitions, prepare, stored
from .text import U, minima, sequence_keys, shingle_hashes, word_hashes

SIZE = 5
ROWS = 3
BUCKET = 128


def bands(threshold: float, recall: float = 0.9999, rows: int = ROWS) -> int:
    """Least number of bands of that many rows that find a pair at the threshold with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def paragraphs(texts: list[str | None], min_words: int):
    """For all paragraphs of min_words or more: text number, place, words, key, and shingles with offsets."""
    owner, place, parts = [], [], []
    for i, t in enumerate(texts):
        if isinstance(t, str):
            for k, line in enumerate(t.split("\n")):
                if len(line) >= 2 * min_words - 1:
                    owner.append(i)
                    place.append(k)
                    parts.append(line)
    w, off = word_hashes(parts, punctuation=False)
    n = np.diff(off)
    keep = np.flatnonzero(n >= max(1, min_words))
    owner, place, n = np.array(owner, np.int64)[keep], np.array(place, np.int64)[keep], n[keep]
    take = np.repeat(off[keep] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(keep) else np.zeros(0, np.int64), n) + np.arange(n.sum())
    w, off = w[take.astype(np.int64)], np.concatenate([[0], np.cumsum(n)])
    if not len(n):
        return owner, place, n, np.zeros(0, np.int64), np.zeros(0, U), np.zeros(1, np.int64)
    key = sequence_keys(w, off)
    h, so = shingle_hashes(w, off, SIZE)
    return owner, place, n, key.view(np.int64), h, so


def _signed(batches, min_words, n_bands):
    """Paragraph rows with one hash for each band."""
    for pdf in batches:
        owner, place, n, key, h, so = paragraphs(pdf["text"].tolist(), min_words)
        out = {"row": pdf["row"].to_numpy()[owner], "doc_id": pdf["doc_id"].to_numpy()[owner], "paragraph": place, "n_words": n, "key": key}
        found = minima(h, so, n_bands, ROWS).view(np.int64) if len(n) else np.zeros((0, n_bands), np.int64)
        out |= {f"b{b}": found[:, b] for b in range(n_bands)}
        yield pd.DataFrame(out)


def _verified(batches, threshold):
    """Pairs of components that a pair at the threshold joins, in a block of paragraphs or between two."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            left = [(m["component"], m["key"], frozenset(m["shingles"])) for m in r.m1]
            right = left if r.c1 == r.c2 else [(m["component"], m["key"], frozenset(m["shingles"])) for m in r.m2]
            root = {c: c for c, _, _ in left} | {c: c for c, _, _ in right}

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, (f, _, s) in enumerate(left):
                for g, _, t in right[i + 1 :] if right is left else right:
                    if min(len(s), len(t)) < threshold * max(len(s), len(t)) or (x := find(f)) == (y := find(g)):
                        continue
                    both = len(s & t)
                    if both >= threshold * (len(s) + len(t) - both) - 1e-12:
                        out.append((f, g))
                        root[max(x, y)] = min(x, y)
        yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def joined(opened: DataFrame, sets_of, threshold: float, block: int | None = None, batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """Components of keys by similarity: first (node, component) of keys, then of those components.

    opened: distinct keys (key, bucket) by band; sets_of gives (key, shingles) of a table of keys. Only pairs whose
    shingle sets have a Jaccard similarity of at least threshold are linked.
    """
    spark, block = opened.sparkSession, block or BUCKET
    heads = opened.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(opened.join(heads, "bucket"), "paragraphs-m")
    sets = stored(sets_of(met.select("key").distinct()), "paragraphs-s")
    # First each paragraph against the head of its buckets: what that joins needs no further pairs in a bucket.
    head_sets = sets.select(F.col("key").alias("head"), F.col("shingles").alias("head_shingles"))
    stars = met.where("key <> head").select("key", "head").distinct().join(sets, "key").join(head_sets, "head")
    shared, total = F.size(F.array_intersect("shingles", "head_shingles")), F.size("shingles") + F.size("head_shingles")
    near = stored(stars.where(shared >= threshold * (total - shared) - 1e-12).select(F.col("key").alias("a"), F.col("head").alias("b")), "paragraphs-n")
    part = stored(components(near), "paragraphs-c")
    own = met.join(part.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("n") <= block, F.col("n"))).alias("small")).where("parts > 1")
    # Chunks of about block paragraphs: large parts have their own, small ones share; chunks of one part do not meet.
    large = F.when(F.col("n") > block, F.col("component"))
    chunk = F.when(large.isNotNull(), F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block).cast("long"))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("small") / block).cast("long")))
    dealt = own.join(sizes.join(mixed, "bucket"), ["bucket", "component"]).select("bucket", "key", "component", large.alias("part"), F.concat_ws(":", large.cast("string"), chunk.cast("string")).alias("chunk"))
    blocks = dealt.join(sets, "key").groupBy("bucket", "part", "chunk").agg(F.collect_list(F.struct("key", "component", "shingles")).alias("m"))
    blocks = stored(blocks, "paragraphs-b")
    side = lambda n: blocks.select("bucket", F.col("part").alias(f"p{n}"), F.col("chunk").alias(f"c{n}"), F.col("m").alias(f"m{n}"))
    pairs = side(1).where("p1 is null and size(m1) > 1").select("bucket", "c1", "m1", F.col("c1").alias("c2"), F.slice("m1", 1, 0).alias("m2"))
    more = side(1).join(side(2), "bucket").where("c1 < c2 and (p1 is null or p2 is null or p1 <> p2)").select("bucket", "c1", "m1", "c2", "m2")
    both = pairs.unionByName(more).repartition(2 * partitions(spark), "bucket", "c1", "c2")
    with arrow_rows(spark, batch):
        links = stored(both.mapInPandas(lambda it: _verified(it, threshold), "a long, b long"), "paragraphs-l")
    drop_stored(blocks, met, sets, near)
    comp = stored(components(links), "paragraphs-c")
    drop_stored(links)
    return part, comp


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, min_words: int = 10) -> DataFrame:
    """Rows (doc_id, row, paragraph, n_words, class_doc_id, class_paragraph, n_class, removed): paragraphs that occur again.

    Paragraphs are lines of at least min_words words (letters, digits, _, in lower case). Those with equal
    words, or with a Jaccard similarity of distinct five-word shingles of at least threshold, are one class,
    also over others between. The class is named by its first paragraph in order of (doc_id, paragraph),
    which alone stays (removed is false). Only classes of two paragraphs or more are returned. Null and short
    texts take no part; repeated rows of one id and text count as one.
    """
    spark = docs.sparkSession
    prepare(spark)
    n_bands = bands(threshold)
    source = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cols = [f"b{b}" for b in range(n_bands)]
    schema = "row long, doc_id long, paragraph long, n_words long, key long, " + ", ".join(f"{c} long" for c in cols)
    signed = stored(source.mapInPandas(lambda it: _signed(it, min_words, n_bands), schema), "paragraphs-p")
    distinct = signed.groupBy("key").agg(*[F.min(c).alias(c) for c in cols], F.min("row").alias("row"))  # equal keys have equal bands
    opened = distinct.select("key", F.explode(F.array(*cols)).alias("bucket"))

    def shingled(batches):
        for pdf in batches:
            owner, _, _, key, h, so = paragraphs(pdf["text"].tolist(), min_words)
            want = [set(x.tolist()) for x in pdf["keys"]]
            out, seen = [], set()
            for i, k in enumerate(key.tolist()):
                if k in want[owner[i]] and k not in seen:
                    seen.add(k)
                    out.append((k, np.unique(h[so[i] : so[i + 1]]).view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "shingles"])

    def sets_of(met_keys: DataFrame) -> DataFrame:
        # One place of each paragraph that met, then the texts of those places.
        wanted = distinct.select("key", "row").join(met_keys, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys"))
        return source.join(wanted, "row").select("text", "keys").mapInPandas(shingled, "key long, shingles array<long>").dropDuplicates(["key"])

    part, comp = joined(opened, sets_of, threshold)
    places = signed.select("key", "row", "doc_id", "paragraph", "n_words").distinct()
    per = places.groupBy("key").agg(F.min(F.struct("doc_id", "paragraph", "row")).alias("first"), F.count("*").alias("n"))
    first_part = per.join(part.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")
    named = first_part.join(comp.withColumnRenamed("node", "part"), "part", "left").withColumn("class", F.coalesce("component", "part"))
    whole = named.groupBy("class").agg(F.min("first").alias("lead"), F.sum("n").alias("n_class")).where("n_class > 1")
    known = named.join(whole, "class").select("key", "lead", "n_class")
    first = (F.col("row") == F.col("lead.row")) & (F.col("paragraph") == F.col("lead.paragraph"))
    return places.join(known, "key").select("doc_id", "row", "paragraph", "n_words", F.col("lead.doc_id").alias("class_doc_id"), F.col("lead.paragraph").alias("class_paragraph"), "n_class", (~first).alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, min_words: int = 10) -> DataFrame:
    """docs with repeated paragraphs cut from their texts; every row stays, with its other columns, of any name, as they were.

    Null texts stay null, texts without a repeat as they are; of repeated rows of one id and text each loses the same paragraphs.
    """
    row, cut = fresh(docs, "_row"), fresh(docs, "_gone")
    gone = repeated(docs, id_col, text, threshold, min_words).where("removed").groupBy("row").agg(F.collect_set(F.col("paragraph").cast("int")).alias(cut))
    joined = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text))).join(gone.withColumnRenamed("row", row), row, "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(cut), i))
    return joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
