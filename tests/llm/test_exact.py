"""The exact index against plain sets, its cuckoo filter, and odd rows."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cargosift.llm import exact

ROW = "doc_id long, text string"


def keys(n, seed=1):
    return np.random.default_rng(seed).integers(0, (1 << 64) - 1, n, np.uint64)


def test_cuckoo_inserts_deletes_and_overflows():
    own, other = keys(3500), keys(20000, 2)
    f = exact.Cuckoo(1024)
    assert f.insert(own) and f.holds(own).all() and f.holds(other).mean() < 0.01
    f.delete(own[:1000])
    assert f.holds(own[1000:]).all() and f.holds(own[:1000]).mean() < 0.01
    assert (f.table > 0).sum() == 2500
    again = exact.Cuckoo(0, f.table.tobytes())
    assert again.holds(own[1000:]).all()
    assert not exact.Cuckoo(256).insert(keys(1100))


def test_bucket_is_built_anew_from_its_keys():
    b = exact.Bucket()
    for part in np.array_split(keys(30000), 100):
        b.insert(part)
    assert len(b.filter.table) > 256 and b.filter.holds(keys(30000)).all()
    b.delete(keys(30000)[:29000])
    assert len(b.keys) == 1000 and b.filter.holds(b.keys).all() and (b.filter.table > 0).sum() == 1000
    same = exact.Bucket(b.filter.table.tobytes(), b.keys.tobytes())
    same.delete(keys(5, 3))
    assert (same.filter.table > 0).sum() == 1000


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return sorted(((d is None, d or 0), (best[lower(t)] is None, best[lower(t)] or 0), len(groups[lower(t)])) for d, t in rows)


def found(index):
    rows = index.groups().collect()
    stay = [r for r in rows if r["kept"]]
    assert len(stay) == len({r["digest"] for r in rows}) and all(r["doc"] == r["keep"] for r in stay)
    return sorted(((r["doc"] is None, r["doc"] or 0), (r["keep"] is None, r["keep"] or 0), r["size"]) for r in rows)


def test_index_grows_and_shrinks_like_plain_sets(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice(["Same Words", "SAME words", "other", None, "", f"text {rng.randint(0, 300)}", "É", "é"])) for n in range(900)]
    rows += [(7, "repeated"), (7, "repeated"), (None, "no id"), (None, "no id"), (None, "other"), (3, "long " * 60000)]
    first, second = rows[::2], rows[1::2]
    index = exact.ExactIndex(spark, 5)
    index.insert(spark.createDataFrame(first, ROW).withColumn("digest", F.lit("mine")).withColumn("kind", F.lit(9)))
    assert found(index) == plain(first)
    index.insert(spark.createDataFrame(second, ROW))
    assert found(index) == plain(rows)
    out = [r for r in rows if r[1] is None or r[1].startswith("text 1") or r[0] is None or r[0] > 800]
    index.remove(spark.createDataFrame([*out, (12345, "never there")], ROW))
    gone = {(d, lower(t)) for d, t in out}
    left = [r for r in rows if (r[0], lower(r[1])) not in gone]
    assert found(index) == plain(left)
    live = {lower(t) for _, t in left}
    assert {r["text"] for r in index.texts().collect()} == live and index.filters().agg(F.sum("live")).first()[0] == len(live)
    index.insert(spark.createDataFrame(out, ROW))
    assert found(index) == plain(left + out)
    index.drop()


def test_false_yes_goes_in_after_all(spark, monkeypatch):
    """If every text looks held, each is compared with the bucket and goes in once."""
    screened = exact._screened
    monkeypatch.setattr(exact, "_screened", lambda certain: screened(True) if certain else _always(screened))
    rows = [(n, f"text {n % 40}") for n in range(100)]
    index = exact.ExactIndex(spark, 3)
    index.insert(spark.createDataFrame(rows, ROW))
    assert found(index) == plain(rows) and index.texts().count() == 40


def _always(screened):
    def run(batches):
        for out in screened(False)(batches):
            n = out.schema.get_field_index("hit")
            yield out.set_column(n, "hit", pa.array([True] * out.num_rows))

    return run


def test_empty_table(spark):
    index = exact.ExactIndex(spark, 2)
    index.insert(spark.createDataFrame([], ROW))
    assert index.groups().count() == 0
    index.remove(spark.createDataFrame([], ROW))
    index.insert(spark.createDataFrame([(1, "a")], ROW))
    assert index.groups().count() == 1
