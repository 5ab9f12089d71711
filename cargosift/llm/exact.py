"""Exact duplicates by an index of cuckoo filters over live digests, one filter to each bucket of the kept texts.

A text is known by the SHA-256 of its normalised form. The digest's hash deals it to one of a fixed number of
buckets; a bucket has a cuckoo filter (16-bit fingerprints, four to a slot, two slots to a key) and a file of the
texts that are live in it. A text that its filter does not hold is new: its fingerprint goes in, its text into the
bucket. A text that the filter holds is compared with the bucket's texts, file by file without a shuffle, as
both sides are bucketed by digest; what only looked alike goes in after all. A filter with no way left for a
fingerprint is built anew at twice the size from the keys stored beside it. Taking out the last row of a text
deletes its fingerprint, so the filters hold live digests alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, partitions, prepare, scratch_dir
from .text import U, mix

FILTER, TEXT, GONE = range(3)
SEEN = 200_000  # digests that a task remembers to fold its copies
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """Set of 64-bit keys that may say yes wrongly, never no; distinct keys only, and only keys that are in are deleted."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int, table: bytes | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy()
        self.mask = U(len(self.table) - 1)
        self.rng = np.random.default_rng(len(self.table))

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        return (keys >> U(48)).astype(np.uint16) | np.uint16(1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys & self.mask).astype(np.int64)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix(prints.astype(U)) & self.mask).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p, a = self.prints(keys), self._first(keys)
        return ((self.table[a] == p[:, None]) | (self.table[self._other(a, p)] == p[:, None])).any(axis=1)

    def _fill(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free places of their buckets; which ones found none."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        nth = free.cumsum(axis=1)
        ok = rank < nth[:, -1]
        place = (free & (nth == rank[:, None] + 1)).argmax(axis=1)
        self.table[b[ok], place[ok]] = p[order[ok]]
        left = np.ones(len(p), bool)
        left[order[ok]] = False
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """False if some fingerprint finds no place: the table is then to be built anew."""
        p, at = self.prints(keys), self._first(keys)
        for _ in range(2):
            left = self._fill(p, at)
            p, at = p[left], at[left]
            at = self._other(at, p)
        for _ in range(self.KICKS):
            if not len(p):
                return True
            _, one = np.unique(at, return_index=True)  # one a bucket takes another's place
            place = self.rng.integers(0, self.SLOTS, len(one))
            out = self.table[at[one], place]
            self.table[at[one], place] = p[one]
            rest = np.ones(len(p), bool)
            rest[one] = False
            p, at = np.concatenate([out, p[rest]]), np.concatenate([self._other(at[one], out), at[rest]])
            left = self._fill(p, at)
            p, at = p[left], at[left]
        return not len(p)

    def delete(self, keys: np.ndarray) -> None:
        p, a = self.prints(keys), self._first(keys)
        for own, first, second in zip(p, a, self._other(a, p), strict=True):
            at = first if (self.table[first] == own).any() else second
            self.table[at, int((self.table[at] == own).argmax())] = 0


class Bucket:
    """A cuckoo filter with the keys of its live digests."""

    def __init__(self, table: bytes | None = None, keys: bytes = b""):
        self.filter = Cuckoo(256, table)
        self.keys = np.frombuffer(keys, U)

    def insert(self, keys: np.ndarray) -> None:
        self.keys = np.concatenate([self.keys, keys])
        done = self.filter.insert(keys)
        while not done:
            self.filter = Cuckoo(2 * len(self.filter.table))
            done = self.filter.insert(self.keys)

    def delete(self, keys: np.ndarray) -> None:
        keys = keys[np.isin(keys, self.keys)]
        self.filter.delete(keys)
        self.keys = self.keys[~np.isin(self.keys, keys)]


def normalised(text: Column) -> Column:
    """Null as empty; A-Z, and nothing else, in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops copies that the task has seen; forgetting some costs time only."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for n, key in enumerate(batch["digest"].to_pylist()):
            if key not in seen:
                seen.add(key)
                fresh.append(n)
        if len(seen) > SEEN:
            seen = set()
        yield batch.take(pa.array(fresh, pa.int64()))


COLUMNS = "kind int, bucket int, digest binary, key long, text string, hit boolean, live long, slots binary, keys binary"


def _screened(certain: bool):
    """Rows that come in, texts with whether their filter held them before, and at last the filters. certain: texts are new, whatever the filter says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Bucket] = {}
        home: dict[int, bytes] = {}
        for batch in batches:
            kind, bucket, key = (batch[c].to_numpy(zero_copy_only=False) for c in ("kind", "bucket", "key"))
            key, hit = key.view(U), np.zeros(len(kind), bool)
            for b in np.unique(bucket).tolist():
                of = np.flatnonzero(bucket == b)
                home.setdefault(b, batch["digest"][int(of[0])].as_py())
                for n in of[kind[of] == FILTER].tolist():  # sorted, so that filters come before the rest
                    held[b] = Bucket(batch["slots"][n].as_py(), batch["keys"][n].as_py())
                own = held.setdefault(b, Bucket())
                text = of[kind[of] == TEXT]
                known = np.zeros(len(text), bool) if certain else own.filter.holds(key[text])
                _, first = np.unique(key[text], return_index=True)
                again = np.ones(len(text), bool)
                again[first] = False
                hit[text] = known | again
                own.insert(key[text[~hit[text]]])
                own.delete(key[of[kind[of] == GONE]])
            passed = batch.filter(pa.array(kind != FILTER))
            yield pa.RecordBatch.from_arrays([*(passed[c] for c in ("kind", "bucket", "digest", "key", "text")), pa.array(hit[kind != FILTER]), *(pa.nulls(passed.num_rows, t) for t in (pa.int64(), pa.binary(), pa.binary()))], [c.split()[0] for c in COLUMNS.split(", ")])
        for b, own in held.items():
            values = [FILTER, b, home[b], 0, None, False, len(own.keys), own.filter.table.tobytes(), own.keys.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


class ExactIndex:
    """An index of texts in the shared folder, to which documents are added and from which they are taken.

    buckets: a fixed number of parts, each of which fits a task (its filter and eight bytes for each live text; about
    a quarter of a million texts each is a good size). Every change writes a table of its own, bucketed by digest.
    """

    def __init__(self, spark: SparkSession, buckets: int, path: str | None = None):
        prepare(spark)
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{scratch_dir(spark)}/exact-{uuid.uuid4().hex}"
        self.changes: list[DataFrame] = []
        self.members: DataFrame | None = None

    def _keyed(self, docs: DataFrame, id_col: str, text: str) -> DataFrame:
        own = docs.select(F.col(id_col).alias("doc"), normalised(F.col(text)).alias("text"))
        return own.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def _change(self, rows: DataFrame, certain: bool = False) -> DataFrame:
        """Passes rows (kind, digest, text) by the filters and writes what comes out as the next table of the index."""
        rows = rows.select(F.col("kind"), F.pmod(F.hash("digest"), F.lit(self.buckets)).alias("bucket"), "digest", F.xxhash64("digest").alias("key"), "text", F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("binary").alias("keys"))
        if self.changes:
            # Only filters that the rows reach are read into tasks with them.
            rows = rows.unionByName(self.filters().select(F.lit(FILTER).alias("kind"), "bucket", "digest", F.lit(0).cast("long").alias("key"), F.lit(None).cast("string").alias("text"), "slots", "keys"))
        dealt = rows.repartition(self.buckets, "digest")
        if self.changes:
            dealt = dealt.sortWithinPartitions("kind")
        name = f"exact_{uuid.uuid4().hex}"
        dealt.mapInArrow(_screened(certain), COLUMNS).write.bucketBy(self.buckets, "digest").option("path", f"{self.path}/change-{len(self.changes)}").saveAsTable(name)
        self.changes.append(self.spark.table(name).withColumn("change", F.lit(len(self.changes))))
        return self.changes[-1]

    def _all(self) -> DataFrame:
        out = self.changes[0]
        for more in self.changes[1:]:
            out = out.unionByName(more)
        return out

    def filters(self) -> DataFrame:
        """Rows (bucket, digest, live, slots, keys): each bucket's filter as its last change left it, with one digest that lies there."""
        w = Window.partitionBy("bucket").orderBy(F.col("change").desc())
        rows = self._all().where(F.col("kind") == FILTER)
        if len(self.changes) > 1:
            rows = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
        return rows.select("bucket", "digest", "live", "slots", "keys")

    def texts(self) -> DataFrame:
        """Rows (digest, text): the live texts."""
        kept = self._all().where((F.col("kind") == TEXT) & ~F.col("hit"))
        if len(self.changes) == 1:
            return kept.select("digest", "text")
        ended = self._all().where(F.col("kind") == GONE).groupBy("digest").agg(F.max("change").alias("ended"))
        return kept.join(ended, "digest", "left").where("ended is null or ended < change").select("digest", "text")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> None:
        """Adds every row. Null texts count as empty; repeated rows are rows like others."""
        before = self.texts() if self.changes else None
        keyed = self._keyed(docs, id_col, text)
        at = f"{self.path}/members-{uuid.uuid4().hex}"
        keyed.select("doc", F.monotonically_increasing_id().alias("row"), F.lit(len(self.changes)).alias("of"), "digest").write.parquet(at)
        own = self.spark.read.parquet(at)
        self.members = own if self.members is None else self.members.unionByName(own)
        folded = keyed.select("digest", "text").mapInArrow(_folded, "digest binary, text string")
        change = self._change(folded.select(F.lit(TEXT).alias("kind"), "digest", "text"))
        content = change.where((F.col("kind") == TEXT) & ~F.col("hit")).select("digest", "text")
        content = content if before is None else content.unionByName(before)
        # A hit is a copy if the bucket has its text; with a filter's false yes it has none.
        hits = change.where((F.col("kind") == TEXT) & F.col("hit")).select("digest", F.col("text").alias("again"))
        wrong = hits.join(content.withColumnRenamed("text", "known"), "digest", "left").where("known is null or known <> again")
        at = f"{self.path}/wrong-{uuid.uuid4().hex}"
        wrong.select("digest", F.col("again").alias("text"), "known").write.parquet(at)
        wrong = self.spark.read.parquet(at)
        if wrong.where("known is not null").limit(1).count():
            raise ValueError("two texts have one SHA-256")
        if wrong.limit(1).count():
            self._change(wrong.select(F.lit(TEXT).alias("kind"), "digest", "text").dropDuplicates(["digest"]), certain=True)

    def remove(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> None:
        """Takes out the rows that have the id and text of a row of docs; texts without a row left leave their filter. Unknown rows change nothing."""
        gone = self._keyed(docs, id_col, text).select(F.col("doc").alias("id"), F.col("digest").alias("gone")).distinct()
        at = f"{self.path}/members-{uuid.uuid4().hex}"
        self.members.join(gone, self.members["doc"].eqNullSafe(gone["id"]) & (F.col("digest") == F.col("gone")), "left_anti").write.parquet(at)
        self.members = self.spark.read.parquet(at)
        dead = self.texts().join(gone.select(F.col("gone").alias("digest")).distinct(), "digest", "left_semi").join(self.members.select("digest").distinct(), "digest", "left_anti")
        self._change(dead.select(F.lit(GONE).alias("kind"), "digest", F.lit(None).cast("string").alias("text")))

    def groups(self) -> DataFrame:
        """Rows (doc, digest, keep, size, kept): every row of the index; of equal texts the row with the largest id stays, one if it is repeated, one without id only if all are."""
        best = self.members.groupBy("digest").agg(F.max(F.struct("doc", "of", "row")).alias("best"), F.count("*").alias("size"))
        at = f"{self.path}/groups-{uuid.uuid4().hex}"
        best.join(self.texts().select("digest"), "digest", "left_semi").write.parquet(at)  # written, so that a text with very many copies can be split in the join
        rows = self.members.join(self.spark.read.parquet(at), "digest")
        mine = F.struct("doc", "of", "row")
        return rows.select("doc", "digest", F.col("best.doc").alias("keep"), "size", mine.eqNullSafe(F.col("best")).alias("kept"))

    def drop(self) -> None:
        for change in self.changes:
            drop_stored(change)


def buckets_for(docs: DataFrame, texts: int = 1 << 18) -> int:
    """Buckets of about so many texts, and no fewer than the session's shuffle partitions."""
    return max(partitions(docs.sparkSession), -(-docs.count() // texts))
