"""The text operators against brute force and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import itertools
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cargosift.llm import decontam, html, langid, lines, ngrams, paragraphs, passages, pieces, queries, simhash, topk, toxicity
from cargosift.llm.common import components
from cargosift.llm.eliasfano import EliasFano
from cargosift.llm.text import shingle_hashes, word_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60000 + "x" * 200000


def odd(spark, extra=()):
    """Documents with nulls in every column, empty and very long texts, and repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, None, None, 5), (None, "some words without an id here", None, "s", 1), (5, "\n\n \t\n", "de", "s", 4), (6, "same text of a row that is here twice over and again", "en", "s", 9), (6, "same text of a row that is here twice over and again", "en", "s", 9), *extra]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit("k"))


def none(spark, schema=DOC):
    return spark.createDataFrame([], schema)


def prose(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_words_and_shingles():
    h, off = word_hashes(["Ab c, Ab", None, "", "ab C", "y" * 600000 + " c"])
    assert off.tolist() == [0, 3, 3, 3, 5, 7] and h[0] == h[2] == h[3] and h[1] != h[4] and h[4] == h[6]
    s, so = shingle_hashes(h, off, 2)
    assert so.tolist() == [0, 2, 2, 2, 3, 4]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(none(spark, "a long, b long")).count() == 0


# 1 language
def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = queries.op1_langid(spark, sf_dir).toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(docs)).mean() >= 0.97 and got.score.between(0, 1).all() and len(got) == len(docs)
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(got.doc_id, got.held_out, strict=True))


def test_language_odd(spark):
    f = langid.learn(odd(spark, [(9, "der die das und nicht", "de", "s", 3), (10, "the and with from", "en", "s", 3)]))
    assert f.langs == ["de", "en"] and (f.fill < 0.5).all()
    got = langid.predict(odd(spark, [(11, "123 !!", "en", "s", 3), (12, "ωωω", None, None, None), (13, "the and from", None, None, None)]), f)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[5].lang_pred == by[11].lang_pred == "und" and by[12].lang_pred == "en" and by[12].score == 0 and by[13].lang_pred == "en"
    assert got.count() == 10 and by[6].source == "s" and isinstance(by[6].score, float)
    assert langid.predict(odd(spark), langid.learn(none(spark))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none(spark), f).count() == 0


# 2 toxicity
def test_toxicity(spark, sf_dir):
    got = queries.op2_toxicity(spark, sf_dir).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_nearest_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30, "abcd") + (" vile" if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    ix = toxicity.learn(docs, labels, k=7)
    assert "vile" in ix.vocab
    for _, text, *_ in rows[:60]:
        at, v = ix.vector(toxicity.terms(text))
        cos = np.round(v @ ix.weights[at], 12)
        assert ix.nearest(at, v)[0].tolist() == np.lexsort((np.arange(len(cos)), -cos))[:7].tolist()
    got = {r.doc_id: r for r in toxicity.score(docs, ix).collect()}
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(400)) > 390 and got[0].evidence[0].cosine == pytest.approx(1)
    again = toxicity.score(odd(spark), ix)
    assert again.count() == 7 and again.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(odd(spark), toxicity.learn(none(spark), labels)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(none(spark), ix).count() == 0


# 3 top-k
def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(400, None), (401, [1.0] * 7 + [float("nan")]), (402, [1.0] * 7 + [None]), (403, [0.5] * 8), (404, [0.5] * 8), (405, [1.0, 2.0]), (7, rows[7][1]), (None, [1.0] * 8), (406, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 20 = 0 or vec_id = 405"), df, k=5, block=32, query_block=4, head=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: np.floor(1024 * np.array(e, np.float32).astype(np.float64)).astype(np.int64) for i, e in rows if i is not None and e is not None and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e)}
    for q in [i for i in v if i % 20 == 0]:
        assert got[q] == sorted(((c, int(v[q] @ v[c])) for c in v if c != q), key=lambda x: (-x[1], x[0]))[:5]
    assert 405 not in got
    empty = none(spark, "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0 and topk.top_k(df, empty).count() == 0


def test_topk_travels_in_packs(spark, monkeypatch):
    """Query blocks come to a candidate block in packs, vectors in the smallest integers; large numbers, several packs and tiles give the same rows."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 8)).round(3)
    seen = {}

    def kept(df, name, own=topk.stored):
        seen[name] = own(df, name)
        return seen[name]

    monkeypatch.setattr(topk, "stored", kept)
    monkeypatch.setattr(topk, "drop_stored", lambda *tables: None)
    for scale, width in ((1024, 2), (1 << 20, 4)):
        whole = np.floor(v * scale).astype(np.int64)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        for pack, tile in ((1 << 21, 2048), (128, 100)):
            monkeypatch.setattr(topk, "PACK", pack)
            monkeypatch.setattr(topk, "TILE", tile)
            got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 100 = 0"), df, scale=scale, query_block=8).collect()}
            assert len(got) == 300
            for q in range(0, 3000, 100):
                s = whole @ whole[q]
                best = sorted((-int(s[i]), i) for i in range(3000) if i != q)[:10]
                assert [got[q, k + 1] for k in range(10)] == [(i, -n) for n, i in best]
            parts = seen["topk-a"].count()
            assert parts == 1 if pack > 128 else parts > 1
            assert all(len(r.vecs) == len(r.ids) // 8 * 8 * width for r in seen["topk-c"].collect())



# 4 decontamination
def brute_containment(docs, items):
    out = {}
    for d, t in docs:
        w = decontam.words(t)
        for i, s in items:
            x = decontam.shingles(decontam.words(s))
            if x:
                size = len(next(iter(x)).split(b" "))
                n = len(x & decontam.shingles(w, size)) if w else 0
                if n >= 0.8 * len(x) - 1e-9 and n:
                    out[d, i] = (len(x), n)
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([3, 5, 8, 20, 60]))) for i in range(60)] + [(98, None), (99, ""), (97, "One, TWO three")]
    docs = []
    for d in range(120):
        text = prose(rng, rng.choice([10, 300, 4000]))
        for i in rng.sample(range(60), 2) if d % 3 == 0 else []:
            w = items[i][1].split()
            if rng.random() < 0.5 and len(w) > 30:
                w[rng.randrange(len(w))] = "zzz"
            text = " ".join([*text.split()[: len(text) // 20], *w, *text.split()[len(text) // 20 :]]).upper()
        docs.append((d, text))
    docs += [(200, "zero one two. Three four"), (201, None), (202, "")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), block=25)
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got.collect()} == brute_containment(docs, items)
    items = spark.createDataFrame([(1, "same text of a row that is here twice over")], "item_id long, text string")
    assert {(r.doc_id, r.containment) for r in decontam.contaminated(odd(spark), items).collect()} == {(6, 1.0)}
    assert decontam.contaminated(none(spark), items).count() == 0 and decontam.contaminated(odd(spark), none(spark, "item_id long, text string")).count() == 0


# 5 language model
def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (7, 7), (500, 1 << 20), (3000, 1 << 63)):
        v = np.unique(rng.integers(0, u, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        e = EliasFano.build(v, u)
        place = {int(x): i for i, x in enumerate(v)}
        q = np.concatenate([v, rng.integers(0, u, 200, dtype=np.uint64)])
        assert (e.get(np.arange(len(v))) == v).all() and e.find(q).tolist() == [place.get(int(x), -1) for x in q]
        if len(v) > 1:
            a, b = e.pair(np.arange(len(v) - 1))
            assert (a == v[:-1]).all() and (b == v[1:]).all()


def test_language_model(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "É"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "A b", "qq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(0))
    model = ngrams.train(docs)
    toks = [(t or "").encode().lower().split() + ["end"] for t in texts]
    uni, bi, tri = Counter(), Counter(), Counter()
    for w in toks:
        x = ["start", *w]
        uni.update(w), bi.update(zip(x, x[1:])), tri.update(zip(x, x[1:], x[2:]))
    n, v = sum(uni.values()), len(uni)
    code = ngrams._CODE
    floor = lambda s: max(c for c in code if c <= s * (1 + 1e-12))
    s2 = {k: floor((c - 0.75) / (len(toks) if k[0] == "start" else uni[k[0]])) for k, c in bi.items() if c >= 2}
    s3 = {k: floor((c - 0.75) / bi[k[:2]]) for k, c in tri.items() if c >= 2}
    used2, used3 = Counter(), Counter()
    for k, s in s2.items():
        used2[k[0]] += s
    for k, s in s3.items():
        used3[k[:2]] += s
    got = {r.doc_id: r for r in ngrams.score(docs.unionByName(spark.createDataFrame([(1000, "zz A", 0)], docs.schema)), model).collect()}
    for d, w in [*enumerate(toks), (1000, [b"zz", b"a", "end"])]:
        x, total, base = ["start", *w], 0.0, 0.0
        for i, t in enumerate(w):
            p1 = (uni[t] + 0.5) / (n + 0.5 * (v + 1))
            p = s2.get((x[i], t), 0) + (1 - used2[x[i]]) * p1
            if i and (x[i - 1], x[i]) in s2:
                p = s3.get((x[i - 1], x[i], t), 0) + (1 - used3[x[i - 1], x[i]]) * p
            total, base = total + math.log10(p), base + math.log10(p1)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(t in uni for t in w), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total, rel=1e-4)
    # a context's probabilities add up to one
    vocab = [w for w in uni] + ["unknown"]
    for ctx in list({k[:2] for k in s3})[:20]:
        p1 = {w: (uni[w] + 0.5) / (n + 0.5 * (v + 1)) for w in vocab}
        p2 = {w: s2.get((ctx[1], w), 0) + (1 - used2[ctx[1]]) * p1[w] for w in vocab}
        assert sum(s3.get((*ctx, w), 0) + (1 - used3[ctx]) * p2[w] for w in vocab) == pytest.approx(1)
    assert ngrams.score(odd(spark), model).count() == 7 and ngrams.score(none(spark), model).count() == 0
    assert ngrams.score(odd(spark), ngrams.train(none(spark))).agg(F.max("train_tokens")).first()[0] == 0
    assert ngrams.score(odd(spark), ngrams.train(odd(spark))).where("score is null").count() == 0


# 6 pieces
def test_pieces():
    lat = pieces.Lattice()

    def every(unit):
        out = []

        def go(end, s, path):
            if not end:
                out.append((s, path))
            for a, i, c in lat.arcs(unit, end) if end else ():
                go(a, s + c, ([i] if i is not None else [lat.bytes[b] for b in unit[a:end].encode()]) + path)

        go(len(unit), 0.0, [])
        return sorted((round(s, 9) for s, _ in out), reverse=True)

    for text in ("a", "the cat", "ab  c", "naïve 漢", "x\ny", "▁z"):
        got, ids = lat.encode([text], 6)
        whole = [0.0]
        for u in re.findall(r" +[^ \n]*|[^ \n]+|\n", " " + text):
            whole = sorted((a + b for a in whole for b in every(u)[:6]), reverse=True)[:6]
        assert [round(s, 6) for s, _ in got[0]] == [round(s, 6) for s in whole]
        assert all(lat.decode(pieces.expand(o, ids)) == text for _, o in got[0])
        assert len({tuple(pieces.expand(o, ids)) for _, o in got[0]}) == len(got[0])


def test_pieces_rows(spark):
    got = pieces.decode(pieces.encode(odd(spark, [(7, " two  spaces ", None, None, None)]), all_ids=True))
    for r in got.collect():
        assert r.decoded == (r.text or "") and r.n_pieces == len(r.ids) and r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == pytest.approx(r.piece_score) and len(r.nbest_ids) == len(r.nbest_scores)
    assert got.count() == 8 and pieces.encode(none(spark)).count() == 0


def test_pieces_query(spark, sf_dir):
    got = queries.op6_pieces(spark, sf_dir)
    assert got.where("not same_text").count() == 0 and got.count() > 0


def test_op6_makes_all_segmentations(spark, sf_dir):
    """op6 makes the ids of every one of the n best segmentations, which the operator's own lattice gives too."""
    got = queries.op6_pieces(spark, sf_dir)
    assert got.where("n_best <> size(nbest_scores) or nbest_hash is null").count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    coded = pieces.encode(docs, all_ids=True).orderBy("doc_id").collect()
    lattice = pieces.Lattice()
    want, own = lattice.encode([r.text for r in coded], 4)
    assert [r.nbest_ids for r in coded] == [[pieces.expand(o, own) for _, o in options] for options in want]
    assert all(lattice.decode(ids) == (r.text or "") for r in coded for ids in r.nbest_ids)


def test_pieces_of_a_batch_are_decoded_at_once():
    """decode_all() gives what decode() gives: nulls, ids that are no piece, bytes of no letter, and spaces at the start."""
    import pyarrow as pa

    lat = pieces.Lattice()
    best = lambda t: lat.encode([t], 1)[0][0][0][1]
    whole = pa.array([best("two  words\n é 漢"), None, [], best(" led"), [-1, 10**9, None, *best("late")]], pa.list_(pa.int64()))
    torn = pa.array([[lat.bytes[0xC3]], [lat.bytes[0xA9], 500], best("ok")], pa.list_(pa.int32()))
    for lists in (whole, whole[2:], whole[:0], torn, torn[1:]):
        assert lat.decode_all(lists).to_pylist() == [None if x is None else lat.decode(x) for x in lists.to_pylist()]
    assert lat.decode_all(whole)[0].as_py() == "two  words\n é 漢"


def test_units_are_cut_as_the_pattern_cuts_them():
    texts = [None, "", "a b", "  a\n\n b ", "\n", "x" * 50, "é\u3000漢 \ud800 z", "tab\t and\r\n"]
    for some in (texts, [t for t in texts if t is None or "\ud800" not in t], []):
        codes, units, edge = pieces.units_of(some)
        assert [[units[c] for c in codes[a:b]] for a, b in zip(edge, edge[1:])] == [pieces._UNIT.findall(" " + t) if t else [] for t in some]


def test_only_units_among_the_n_best_are_searched():
    """A unit's margin is the loss of its second best, so no unit is searched whose second best comes too late."""
    lat, asked = pieces.Lattice(), []
    own = lat.n_best
    lat.n_best = lambda unit, n: asked.append(unit) or own(unit, n)
    text = "the quick brown fox jumps over the lazy dog and others"
    got, ids = lat.encode([text], 2)
    assert len(got[0]) == 2 and len(set(asked)) == 1
    asked.clear()
    lat.encode([text], 4)
    assert len(set(asked)) < 4 and all(lat.decode(pieces.expand(o, ids)) == text for _, o in got[0])


# 7 paragraphs
def test_paragraphs(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randint(12, 60)) for _ in range(30)]
    docs = []
    for d in range(90):
        parts = []
        for _ in range(3):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "new"
            parts.append(" ".join(w) if rng.random() < 0.7 else prose(rng, 20))
        docs.append((d, "\n".join([*parts, "short line"])))
    docs += [docs[0], (500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("row", F.lit(0))
    paras = {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            w = tuple(re.findall(r"\w+", line.lower()))
            if len(w) >= 10:
                paras[d, i] = w
    sets, shingle = Sets(), {w: set(zip(*(w[k:] for k in range(5)))) for w in paras.values()}
    for a, b in itertools.combinations(sorted(shingle), 2):
        n = len(shingle[a] & shingle[b])
        if n >= 0.8 * (len(shingle[a]) + len(shingle[b]) - n):
            sets.join(a, b)
    classes = defaultdict(list)
    for k, w in paras.items():
        classes[sets.find(w)].append(k)
    want = {k: min(c) for c in classes.values() if len(c) > 1 for k in c}
    got = {(r.doc_id, r.paragraph): ((r.class_doc_id, r.class_paragraph), r.removed) for r in paragraphs.repeated(df).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(r == (k != c) for k, (c, r) in got.items())
    assert paragraphs.without_repeats(df).count() == len(docs)
    assert paragraphs.repeated(none(spark)).count() == 0 and paragraphs.repeated(odd(spark)).count() == 0


def test_paragraphs_that_drift_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET", 3)  # large parts, small parts and many chunks on few rows
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for chain in range(4):
        w = list(base)
        for i in range(chain * 6):
            w[5 * i % 60] = f"start{chain}"
        for step in range(20):
            w[rng.randrange(60)] = f"x{chain}y{step}"
            docs.append((len(docs), " ".join(w)))
    found = [t.split() for _, t in docs]
    sets, shingle = Sets(), [set(zip(*(w[k:] for k in range(5)))) for w in found]
    for a, b in itertools.combinations(range(len(docs)), 2):
        n = len(shingle[a] & shingle[b])
        if n >= 0.8 * (len(shingle[a]) + len(shingle[b]) - n):
            sets.join(a, b)
    sizes = Counter(sets.find(i) for i in range(len(docs)))
    first = {}
    for i in range(len(docs)):
        first.setdefault(sets.find(i), i)
    want = {i: first[sets.find(i)] for i in range(len(docs)) if sizes[sets.find(i)] > 1}
    got = {r.doc_id: r.class_doc_id for r in paragraphs.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_bands():
    b = paragraphs.bands(0.8)
    assert 1 - (1 - 0.8**paragraphs.ROWS) ** b >= 0.9999 > 1 - (1 - 0.8**paragraphs.ROWS) ** (b - 1)


# 8 lines
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(last[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def changed(rng, t, n):
    t = list(t)
    for _ in range(n):
        i, k = rng.randrange(len(t)), rng.randrange(3)
        t[i : i + (k != 0)] = [rng.choice("xyñ漢")] if k < 2 else []
    return "".join(t)


def test_lines(spark):
    rng = random.Random(8)
    base = [prose(rng, 8) for _ in range(12)]
    every = base + [changed(rng, b, rng.randint(1, 4)) for b in base for _ in range(6)] + ["short", "shorx"]
    docs = [(d, "\n".join(rng.sample(every, 3))) for d in range(120)] + [(500, None), (501, ""), (502, every[0] + "\n" + every[0])]
    docs += [docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(0)).withColumn("line", F.lit(""))
    places = {(d, i): x for d, t in docs for i, x in enumerate((t or "").split("\n")) if len(x) >= 20}
    texts, sets, links = sorted(set(places.values())), Sets(), Counter()
    for a, b in itertools.combinations(texts, 2):
        if edits(a, b) <= 2:
            sets.join(a, b)
            links[a] += 1
            links[b] += 1
    classes = defaultdict(list)
    for k, x in places.items():
        classes[sets.find(x)].append(k)
    want = {k: (*min(c), links[places[k]], k != min(c)) for c in classes.values() if len(c) > 1 for k in c}
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in lines.repeated(df).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in lines.without_repeats(df).collect()}
    assert kept[500] is None and kept[501] == "" and set(kept) == {d for d, _ in docs}
    for d, t in docs:
        if t:
            assert kept[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if not want.get((d, i), (0,) * 4)[3])
    assert lines.repeated(none(spark)).count() == 0
    assert lines.without_repeats(odd(spark)).count() == 7


def test_edit_distance(spark):
    rng = random.Random(9)
    pairs = [(a, changed(rng, a, rng.randint(0, 4))) for a in (prose(rng, 4) for _ in range(150))] + [("", "ab"), ("ab", ""), ("", "")]
    pairs = [p for p in pairs if abs(len(p[0]) - len(p[1])) <= 2]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_distance(F.filter(F.split("a", ""), lambda x: x != ""), F.filter(F.split("b", ""), lambda x: x != ""), 2).alias("d")).collect()
    for r in got:
        assert (r.d == edits(r.a, r.b)) if edits(r.a, r.b) <= 2 else (r.d > 2)


def test_lines_run_no_python(spark):
    df = spark.createDataFrame([(1, "a line of more than twenty characters\nanother")], "doc_id long, text string")
    assert "Python" not in lines.repeated(df)._jdf.queryExecution().toString()


# 9 SimHash
def slow_print(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(10)
    docs = []
    for i in range(150):
        w = prose(rng, 40).split()
        docs.append((i, " ".join(w)))
        if i % 5 == 0:
            for j in range(3):
                x = list(w)
                x[rng.randrange(len(x))] = "new"
                docs.append((1000 + 10 * i + j, " ".join(x)))
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE two"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("component", F.lit(0))
    prints = {d: slow_print(t) for d, t in docs}
    sets = Sets()
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            sets.join(a, b)
    got = simhash.groups(df).collect()
    assert len(got) == len(docs) and all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == sets.find(r.doc_id) for r in got)
    assert simhash.groups(none(spark)).count() == 0 and simhash.groups(odd(spark)).count() == 7


def test_trie_forest():
    rng = np.random.default_rng(11)
    near = [int(rng.integers(0, 2**63)) for _ in range(6)]
    keys = {0, 2**64 - 1, *near, *(int(x) for x in rng.integers(0, 2**64, 80, dtype=np.uint64))}
    for x in near:
        for _ in range(30):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                y ^= 1 << int(b)
            keys.add(y)
    k = np.array(sorted(keys), np.uint64)
    want, one, two = Sets(), Sets(), Sets()
    for a, b in itertools.combinations(map(int, k), 2):
        if (a ^ b).bit_count() <= 3:
            want.join(a, b)
    for a, b in simhash.forest(k, None, 0, 3):
        one.join(a, b)
    for a, b in simhash.forest(k[::2], None, 0, 3) + simhash.forest(k[1::2], None, 0, 3) + simhash.forest(k[::2], k[1::2], 0, 3):
        two.join(a, b)
    assert [want.find(int(x)) for x in k] == [one.find(int(x)) for x in k] == [two.find(int(x)) for x in k]


# 10 HTML
@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b<br>c</div>", "a\nb\nc"), ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n  1. z"),
        ("<table><tr><th>A<th>Bee<tr><td>long<td>1</table>", "A    | Bee\nlong | 1"), ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"), ("<style>.x{display:none}</style><p class='x y'>no<p>yes", "yes"),
        ("<script>var a='</p>';</script><title>t</title>ok", "ok"), ("<details><summary>S</summary>shut</details><details open>open</details>", "S\nopen"), ("<pre>a\n  b</pre>", "a\n  b"),
        ("a&amp;b &lt; <!-- c --> d", "a&b < d"), ("<b>a</b><i> b</i>c", "a bc"), ("x<textarea>kept</textarea>", "xkept"), ("<table><tr><td>a<table><tr><td>in</table></table>", "a\nin"), ("a < b", "a < b"),
    ],
)
def test_html(page, text):
    assert html.render(page) == text


def test_html_rows(spark, sf_dir):
    deep = "<div>" * 5000 + "deep" + "<p>" * 10
    df = spark.createDataFrame([(1, None), (2, deep), (None, "<p>" + "w " * 100000), (4, "<table>" * 50 + "x")], "page_id long, html string").withColumn("text", F.lit(1))
    got = [r.text for r in html.extract(df).collect()]
    assert got[0] == "" and got[1] == "deep" and len(got[2]) == 199999 and got[3] == "x"
    pages = queries.op10_html(spark, sf_dir).toPandas()
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas().set_index("page_id").html
    for r in pages.head(20).itertuples():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", raw[r.page_id])
        want = re.sub(r"<[^>]*>", " ", body)
        import html as h

        # pages write bars between links themselves, and cells are parted by more of them
        want, got = Counter(h.unescape(want).split()), Counter(re.sub(r"(?m)^\s*- ", "", r.text).split())
        assert want.pop("|", 0) <= got.pop("|", 0) and want == got


def test_oracles(spark, sf_dir):
    import compare

    for name, sql in queries.ORACLES.items():
        assert compare.differ(queries.QUERIES[name], sql, spark, sf_dir) is None


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, "\n".join(prose(rng, 25) for _ in range(4)), "en", "s", 1) for i in range(60)]
    item = prose(rng, 20)
    rows += [(100, rows[0][1], "en", "s", 1), (101, rows[1][1] + "\n" + item, "en", "s", 1), (102, None, None, None, None)]
    rows += [(200 + i, prose(rng, 20) + " vile", "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOC)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {d for d in seen["toxicity"] if d and d >= 200} and set(range(60)) <= seen["toxicity"]
    assert seen["line_dedup"] == seen["toxicity"] and set(range(60)) <= seen["simhash_near_dedup"]
    assert 101 not in seen["decontamination"] and set(range(60)) <= seen["sentencepiece"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["sentencepiece"]


def five_words(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_pipeline_near_copies(spark, tmp_path):
    """Copies with two to five words replaced, at a similarity of 0.8 or more, go; those below stay."""
    import corpus_pipeline

    rng = random.Random(31)
    docs = []
    for i in range(40):
        w = prose(rng, rng.randint(120, 300)).split()
        docs.append((i, " ".join(w)))
        for j, n in enumerate((2, 3, 5, 30)):
            x = list(w)
            for at in rng.sample(range(len(x)), n):
                x[at] = f"new{at}"
            docs.append((1000 + 10 * i + j, " ".join(x)))
    docs += [(5000, None), (5001, ""), (5002, docs[0][1].upper()), (None, docs[0][1]), docs[1]]
    sets = Sets()
    by_id = {d: t for d, t in docs if d is not None and t}
    for a, b in itertools.combinations(sorted(by_id), 2):
        x, y = five_words(by_id[a]), five_words(by_id[b])
        if len(x & y) >= 0.8 * len(x | y):
            sets.join(a, b)
    want = sorted({sets.find(d) for d in by_id} | {5000})
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect()]
    assert got.count(None) == 1 and sorted(d for d in got if d is not None) == want
    assert len(want) < 120
    assert corpus_pipeline.drop_near_duplicates(spark, none(spark), str(tmp_path)).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, odd(spark), str(tmp_path)).count() == 4  # texts without words are one


def test_pipeline_near_copies_by_trie(spark, tmp_path, monkeypatch):
    """Without MinHash bands the trie alone brings copies together whose fingerprints differ in at most three bits; those below the similarity stay."""
    import corpus_pipeline

    rng = random.Random(47)
    docs = []
    for i in range(12):
        w = prose(rng, 1500).split()
        docs += [(i, " ".join(w)), (100 + i, " ".join([*w[:700], "changed", *w[701:]])), (200 + i, " ".join(w[:750]))]
    w, off = word_hashes([t for _, t in docs], ascii_case=True)
    h, so = shingle_hashes(w, off, 5)
    prints = simhash.majorities(h, so)
    assert all(int(prints[i]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[so[i] : so[i + 1]]) > so[i + 1] - so[i]) for i in range(3))
    fp = {d: int(x) for (d, _), x in zip(docs, prints, strict=True)}
    gone = {100 + i for i in range(12) if (fp[i] ^ fp[100 + i]).bit_count() <= 3}
    assert len(gone) > 6
    monkeypatch.setattr(simhash, "bands", lambda similarity: 0)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()}
    assert got == set(fp) - gone


def test_language_model_keeps_all(spark, tmp_path):
    """op5 scores bigrams and trigrams that training holds once as the plain model does."""
    rng = random.Random(32)
    texts = [prose(rng, 12, "abc") for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_ngrams(spark, str(tmp_path)).collect()}
    toks = {i: [*t.encode().split(), "end"] for i, t in enumerate(texts)}
    uni, bi, tri, starts = Counter(), Counter(), Counter(), 0
    for i, w in toks.items():
        if not got[i].held_out:
            x, starts = ["start", *w], starts + 1
            uni.update(w), bi.update(zip(x, x[1:])), tri.update(zip(x, x[1:], x[2:]))
    n, v = sum(uni.values()), len(uni)
    floor = lambda s: max(c for c in ngrams._CODE if c <= s * (1 + 1e-12))
    s2 = {k: floor((c - 0.75) / (starts if k[0] == "start" else uni[k[0]])) for k, c in bi.items()}
    s3 = {k: floor((c - 0.75) / bi[k[:2]]) for k, c in tri.items()}
    used2, used3 = Counter(), Counter()
    for k, s in s2.items():
        used2[k[0]] += s
    for k, s in s3.items():
        used3[k[:2]] += s
    assert sum(c == 1 for c in tri.values()) > 100
    for i, w in toks.items():
        x, total = ["start", *w], 0.0
        for j, t in enumerate(w):
            p = s2.get((x[j], t), 0) + (1 - used2[x[j]]) * (uni[t] + 0.5) / (n + 0.5 * (v + 1))
            if j and (x[j - 1], x[j]) in s2:
                p = s3.get((x[j - 1], x[j], t), 0) + (1 - used3[x[j - 1], x[j]]) * p
            total += math.log10(p)
        assert got[i].score == pytest.approx(total, rel=1e-4)


def test_short_lines(spark, tmp_path):
    """op8 and the pipeline cut copies of short lines, not their near copies and not blank lines."""
    import corpus_pipeline

    rows = [(1, "short\n\n  \n漢字の行\none"), (2, "shorx\n\n  \n漢字の行"), (3, "short\nshort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_copies, r.removed) for r in queries.op8_lines(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 0, 3, False), (3, 0): (1, 0, 3, True), (3, 1): (1, 0, 3, True), (1, 3): (1, 3, 2, False), (2, 3): (1, 3, 2, True)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path)).collect()}
    assert kept == {1: rows[0][1], 2: "shorx\n\n  ", 3: ""}


@pytest.mark.parametrize("n", [300, 350])
def test_nearest_of_five_and_six_blocks(spark, n):
    """No example is among the nearest twice where the first blocks are most of all blocks."""
    rng = random.Random(n)
    docs = spark.createDataFrame([(i, prose(rng, 40, "abc") + (" vile" if i % 4 == 0 else "")) for i in range(n)], "doc_id long, text string")
    ix = toxicity.learn(docs, docs.selectExpr("doc_id", "int(doc_id % 4 = 0) toxic"), k=15)
    assert len(ix.labels) == n
    for r in docs.limit(100).collect():
        at, v = ix.vector(toxicity.terms(r.text))
        cos = np.round(v @ ix.weights[at], 12)
        assert ix.nearest(at, v)[0].tolist() == np.lexsort((np.arange(n), -cos))[:15].tolist()


def test_toxicity_index_is_made_in_little_memory():
    """Beside the postings nothing is held that is as long as they are; before, sorting them took several times their memory."""
    import tracemalloc

    rng = np.random.default_rng(5)
    each = [(np.sort(rng.choice(20_000, 400, replace=False)).astype(np.int32), rng.integers(1, 9, 400).astype(np.int32)) for _ in range(1500)]
    y, df = rng.integers(0, 2, len(each)), np.append(rng.integers(1, 1500, 20_000), 1500)
    tracemalloc.start()
    ix = toxicity.built(range(20_000), np.zeros(20_000, np.uint64), df, each, y, np.arange(len(each)), 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ix.weights.value) == 600_000 and peak < 1.5 * (ix.weights.value.nbytes + ix.weights.place.nbytes)
    for e in (0, 700, 1499):
        i, (term, n) = int(np.flatnonzero(ix.ids == e)[0]), each[e]
        v = (1 + np.log(n)) * (ix.idf * ix.bearing)[term]
        assert np.allclose(ix.weights[term][:, i], v / np.linalg.norm(v), rtol=1e-12)


def test_toxicity_uses_all_terms(spark):
    """Terms of one example alone find it, and term weights are of all documents, not of the labelled ones."""
    rng = random.Random(33)
    rows = [(i, prose(rng, 20, "abcd") + f" only{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ix = toxicity.learn(docs, docs.where("doc_id < 300").selectExpr("doc_id", "int(doc_id % 4 = 0) toxic"))
    df = Counter(t for _, x in rows for t in toxicity.terms(x))
    assert set(ix.vocab) == {t for _, x in rows[:300] for t in toxicity.terms(x)}
    for t, i in ix.vocab.items():
        assert ix.idf[i] == pytest.approx(math.log(601 / (df[t] + 1)) + 1)
    got = toxicity.score(spark.createDataFrame([(1, "only7"), (2, "only8 only8")], "doc_id long, text string"), ix).orderBy("doc_id").collect()
    assert [[e.doc_id for e in r.evidence] for r in got] == [[7], [8]]


def test_toxicity_against_plain_lists(spark):
    """Weights, cosines, votes and calibrated scores from word counts in dictionaries, without the index."""
    rng = random.Random(34)
    rows = [(i, prose(rng, rng.randint(3, 50), "abcd") + rng.choice(["", " vile beastly", " vilest"]) * (i % 3 == 0)) for i in range(260)] + [(900, None), (901, "!"), (902, "zzz unheard")]
    labels = {i: int(i % 3 == 0) for i in range(0, 200)} | {901: 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ix = toxicity.learn(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), k=9)
    got = {r.doc_id: r for r in toxicity.score(docs, ix).collect()}
    counts = {d: toxicity.terms(t) for d, t in rows}
    df = Counter(t for c in counts.values() for t in c)
    examples = [d for d in labels if counts[d]]
    n1, n = sum(labels.values()), len(labels)

    def weight(t):
        table = [[sum(1 for d in labels if labels[d] == y and (t in counts[d]) == held) for held in (1, 0)] for y in (1, 0)]
        g2 = sum(2 * o * math.log(o * n / (sum(row) * sum(r[j] for r in table))) for row in table for j, o in enumerate(row) if o)
        return (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * (0.1 + 0.9 * max(0, 1 - 10.8 / max(g2, 1e-9)))

    weights = {t: weight(t) for t in {t for d in labels for t in counts[d]}}

    def vector(c):
        v = {t: (1 + math.log(k)) * weights[t] for t, k in c.items() if t in weights}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    held = {d: vector(counts[d]) for d in examples}

    def vote(c, skip=None):
        v = vector(c)
        if not v:
            return (0 + n1 / n) / 2, []
        cos = sorted(((sum(x * held[d].get(t, 0) for t, x in v.items()), d) for d in examples if d != skip), reverse=True)[:9]
        w = [(c / cos[0][0]) ** 2 for c, _ in cos]
        return (sum(a * labels[d] for a, (_, d) in zip(w, cos)) + n1 / n) / (sum(w) + 1), cos

    bins = defaultdict(list)
    for d in labels:
        own = vote(counts[d], d)[0]
        bins[min(49, math.floor(own * 50))].append((own, labels[d]))
    steps = [[[(sum(y for _, y in b) + n1 / n) / (len(b) + 1), len(b)] for b in [bins[k]]] for k in sorted(bins)]
    means = []
    for (value, size), *_ in steps:
        means.append([value, size, 1])
        while len(means) > 1 and means[-2][0] >= means[-1][0]:
            b, a = means.pop(), means.pop()
            means.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    y = [v for v, _, m in means for _ in range(m)]
    x = [sum(v for v, _ in bins[k]) / len(bins[k]) for k in sorted(bins)]
    for d, c in counts.items():
        own, cos = vote(c)
        assert got[d].score == pytest.approx(float(np.interp(own, x, y)), abs=1e-6)
        assert [e.cosine for e in got[d].evidence] == pytest.approx([v for v, _ in cos[:5] if v > 0])
    assert sum(got[d].predicted == int(d % 3 == 0 and "vil" in t) for d, t in rows[200:260]) >= 58


# 7 passages inside paragraphs
def test_passages(spark):
    """Runs of 51 words and more that documents share are in passages of both, wherever lines end; nothing else is."""
    rng = random.Random(35)
    pasted = [prose(rng, n, "abcdefgh").split() for n in (51, 52, 60, 90, 200, 39)]
    docs = []
    for d in range(60):
        w = prose(rng, rng.randint(0, 80), "abcdefgh").split()
        for p in rng.sample(pasted, rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, "".join(x.upper() + rng.choice([" ", " ", ", ", "\n"]) if d % 2 else x + " " for x in w)))
    docs += [(100, docs[3][1]), docs[4], (101, None), (102, ""), (103, "same " * 300), (104, "x " + "same " * 250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("row", F.lit("r")).withColumn("start", F.lit(1))
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    held = lambda n: {k: {d for d, _ in v} for k, v in runs(n).items()}

    def runs(n):
        out = defaultdict(set)
        for d, w in words.items():
            for i in range(len(w) - n + 1):
                out[tuple(w[i : i + n])].add((d, i))
        return out

    got = passages.repeated(df).collect()
    spans, forty = defaultdict(list), held(40)
    for r in got:
        spans[r.doc_id].append((r.start, r.start + r.n_words))
        assert r.n_words >= 40 and r.n_class >= 2
        w = words[r.doc_id]
        for i in (r.start, r.start + r.n_words - 40):
            assert len(forty[tuple(w[i : i + 40])]) > 1
    places = 0
    for each in runs(51).values():
        if len({d for d, _ in each}) > 1:
            for d, i in each:
                places += 1
                assert any(a < i + 51 and i < b and min(b, i + 51) - max(a, i) >= 40 for a, b in spans[d])
    assert places > 500
    # classes: passages that share a window, over others too
    by_class = defaultdict(set)
    for r in got:
        by_class[r.class_doc_id, r.class_start].add((r.doc_id, r.start))
    assert all(k == min(v) for k, v in by_class.items()) and sum(len(v) for v in by_class.values()) == len({(r.doc_id, r.start) for r in got})
    kept = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert kept[101] is None and kept[102] == "" and len(kept) == len(words)
    for d, w in words.items():
        if not spans[d]:
            assert kept[d] == dict(docs)[d]
    every = " | ".join(" ".join(re.findall(r"\w+", (t or "").lower())) for t in kept.values())
    for p in pasted:
        n = sum(" ".join(p) in " ".join(w) for w in words.values())
        left = sum(" ".join(p[5:-5]) in " ".join(re.findall(r"\w+", (t or "").lower())) for t in kept.values())
        assert left <= 1 < n or len(p) < 40
        for a in range(0, len(p) - 10, 5):
            assert n == 0 or " ".join(p[a : a + 5]) in every
    assert passages.repeated(none(spark)).count() == 0 and passages.repeated(odd(spark)).count() == 0
    assert passages.without_repeats(odd(spark)).count() == 7


def test_windows_are_guaranteed():
    """Two texts with a run of SIZE + GAP - 1 equal words keep a window in common, for every place of the run."""
    rng = random.Random(36)
    for _ in range(200):
        run = prose(rng, 51, "abc").split()
        a, b = (" ".join([*prose(rng, rng.randint(0, 40), "xyz").split(), *run, *prose(rng, rng.randint(0, 40), "xyz").split()]) for _ in range(2))
        owner, start, key = passages.windows([a, None, b, "short"])
        assert set(key[owner == 0]) & set(key[owner == 2]) and not (owner % 2).any()


@pytest.mark.parametrize("block", [512, 64, 8])
def test_simhash_blocks(spark, monkeypatch, block):
    """Turned pieces, subtrees below them and salted blocks give the components of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(12)
    keys = {int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)} | {(0xABCD << 48) | int(x) for x in rng.integers(0, 2**12, 60)}
    for x in list(keys)[:120]:
        for _ in range(4):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= 1 << int(b)
            keys.add(y)
    if block == 8:
        monkeypatch.setattr(simhash, "BLOCK", 1)  # subtrees below whole pieces need more fingerprints than a test has
        monkeypatch.setattr(simhash.math, "log2", lambda x, own=math.log2: own(x) + 9)
    k = sorted(keys)
    want, got = Sets(), Sets()
    for a, b in itertools.combinations(k, 2):
        if (a ^ b).bit_count() <= 3:
            want.join(a, b)
    found = simhash.links(spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in k], "fp long"))
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    assert all((a ^ b).bit_count() > 0 and a in keys and b in keys for a, b in pairs)
    for a, b in pairs:
        got.join(a, b)
    assert [want.find(x) for x in k] == [got.find(x) for x in k]


def test_components_raise_when_rounds_run_out(spark):
    chain = spark.range(400).selectExpr("id a", "id + 1 b")
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=1)
    assert components(chain).where("component <> 0").count() == 0


def test_session_batches_come_back(spark):
    from cargosift.llm.common import ARROW_ROWS

    topk.top_k(*[spark.createDataFrame([(1, [0.1, 0.2])], "vec_id long, embedding array<float>")] * 2).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(ARROW_ROWS)


def test_pipeline_odd_tables(spark, tmp_path):
    """Rows without id that hold an item go, rows of one id fall apart by text, columns of any name stay, empty tables do."""
    import corpus_pipeline

    rng = random.Random(37)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(12)] + [(None, prose(rng, 10) + "\n" + item, "en", "s", 1), (3, item + "\n" + prose(rng, 9), "en", "s", 1), (None, None, None, None, None), (20, "", None, None, 0), (21, LONG, None, None, 5)]
    clash = {"score": "mine", "predicted": "p", "evidence": "e", "row": "r", "key": "k", "k": "k", "line": "l", "fp": "f", "component": "c", "start": "s"}
    for name, own in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        docs = spark.createDataFrame(own, DOC).withColumns({c: F.lit(v) for c, v in clash.items()})
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(12)] if own else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, item)] if own else [], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        kept = corpus_pipeline.drop_benchmark(spark, docs, str(folder))
        assert kept.columns == docs.columns and kept.count() == max(0, len(own) - 2)
        assert kept.where("doc_id = 3").count() == bool(own)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(folder))
            assert got.columns == docs.columns and all(r[c] == v for r in got.collect() for c, v in clash.items())
        got = corpus_pipeline.run(spark, str(folder))
        assert set(docs.columns) <= set(got.columns) and got.where("n_pieces is null").count() == 0
        assert bool(got.count()) == bool(own) and got.where("doc_id is null and text is not null").count() == 0


def test_null_ids_are_training_rows(spark, tmp_path):
    """held_out is false where the id is null, and those rows are learned from."""
    rows = [(None, "one two three", "en", "s", 1), (1, "one two four", "en", "s", 1), (4, "uno dos tres", "es", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (queries.op1_langid, queries.op2_toxicity, queries.op5_ngrams):
        got = {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}
        assert got[None] is False and None not in got.values()
    tokens = sum(len(t.split()) + 1 for d, t, *_ in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1)
    assert queries.op5_ngrams(spark, str(tmp_path)).first().train_tokens == tokens


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><td rowspan=2>A<td>b<td>c<tr><td>dd<td>e<tr><td>f<td>g<td>h</table>", "A | b  | c\n  | dd | e\nf | g  | h"),
        ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>", "wide one | x\na | b | c"), ("<table><tr><td>" + "y" * 61 + "<td>b<tr><td>a<td>c</table>", "y" * 61 + " | b\na | c"),
        ("<p title=\"a > b\">one</p>two", "one\n\ntwo"), ("<a href=x\">one</a> \"two\"", "one \"two\""), ("one<a href=\"x>two</a>", "one"), ("a<b title='", "a"),
    ],
)
def test_html_spans_and_quotes(page, text):
    assert html.render(page) == text


def test_html_deep_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        assert html.render("<div>" * n + "x" + "<section>y" * n).count("y") == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_html_tables_against_a_plain_grid():
    """Random tables without spans: the columns of every line start where the widest cells before them end."""
    rng = random.Random(38)
    for _ in range(100):
        rows = [[prose(rng, rng.randint(1, 3)) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(rng.choice(["<td>", "<th>"]) + c + rng.choice(["", "</td>"]) for c in r) for r in rows) + "</table>"
        wide = [max(len(r[i]) for r in rows if len(r) > i) for i in range(max(map(len, rows)))]
        want = ["".join(c.ljust(wide[i]) + " | " for i, c in enumerate(r))[:-3].rstrip() for r in rows]
        assert html.render(page) == "\n".join(want)


def test_language_against_plain_sets(spark):
    """Filters, popcounts and the decision against sets of n-grams by language; a filter may only say too much, and rarely."""
    from cargosift.llm import langid

    rng = random.Random(39)
    alphabet = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "éçñабв"}
    rows = [(i, prose(rng, rng.randint(1, 60), alphabet[lang]), lang) for i in range(240) for lang in [sorted(alphabet)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.learn(docs.where("doc_id < 180"))

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in "".join(t.lower()))
        s = re.sub(" +", " ", s + "  ")
        return [s[i : i + n] for n in (2, 4) for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1]]

    counts = {lang: Counter(g for i, t, own in rows if i < 180 and own == lang for g in grams(t)) for lang in alphabet}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, x in r.items() if x >= 1e-5} for lang, r in rate.items()}
    assert f.langs == sorted(alphabet)
    texts = [t for i, t, _ in rows if i >= 180]
    total, hits = langid.popcounts(texts, f)
    for k, t in enumerate(texts):
        own = grams(t)
        assert total[k] == len(own)
        for i, lang in enumerate(f.langs):
            plain = sum(g in held[lang] for g in own)
            assert plain <= hits[k, i] <= plain + max(2, 0.02 * len(own))
    got = {r.doc_id: r for r in langid.predict(docs.where("doc_id >= 180"), f).collect()}
    for i, t, _ in rows[180:]:
        own = grams(t)
        plain = [sum(g in held[lang] for g in own) for lang in f.langs]
        if sorted(plain)[-1] > sorted(plain)[-2] + 2:
            assert got[i].lang_pred == f.langs[plain.index(max(plain))] and got[i].score == pytest.approx(max(plain) / sum(plain), abs=0.05)


def test_language_of_large_alphabets(spark):
    """Languages that share thousands of letters and differ in how these follow one another, held out; texts of ten letters too."""
    rng = random.Random(47)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    after = {lang: [rng.sample(range(3000), 12) for _ in range(3000)] for lang in ("p", "q", "r")}

    def text(lang, n):
        at, out = rng.randrange(3000), []
        for _ in range(n):
            out.append(letters[at])
            at = after[lang][at][min(int(rng.expovariate(0.4)), 11)] if rng.random() < 0.9 else int(3000 * rng.random() ** 3)
        return "".join(out)

    rows = [(i, text("pqr"[i % 3], 10 if i % 2 else 400), "pqr"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    f = langid.learn(docs.where("doc_id % 5 > 0"))
    got = langid.predict(docs.where("doc_id % 5 = 0"), f).collect()
    for odd_ in (0, 1):
        own = [r for r in got if r.doc_id % 2 == odd_]
        assert sum(r.lang == r.lang_pred for r in own) / len(own) >= 0.97


def test_long_texts_give_each_run_once(monkeypatch):
    text = "ab, CDÉf 12 gh\nijkl mnopq--r st" * 7
    whole = sorted(k for keys, _ in langid.grams([text]) for k in keys.tolist())
    for chunk in (5, 6, 7, 31):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        assert abs(len(whole) - sum(len(keys) for keys, _ in langid.grams([text, None, ""]))) <= 2 * len(text) // chunk  # spaces at a cut alone


def test_columns_of_the_operators_own_names_stay(spark):
    text = "a line that comes twice in this table for sure\nand one that does not, as it ends in {}"
    rows = spark.createDataFrame([(n, text.format(n), "en") for n in range(3)], "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in ("_row", "_gone", "_cuts", "_lang", "_tox", "_lm", "_cut", "_row_")})
    filters = langid.learn(rows.select("text", "lang"))
    index = toxicity.learn(rows, spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int"))
    model = ngrams.train(rows, least=1)
    for out in (lines.without_repeats(rows), paragraphs.without_repeats(rows, min_words=5), passages.without_repeats(rows), langid.predict(rows, filters), toxicity.score(rows, index), ngrams.score(rows, model), pieces.encode(rows)):
        assert out.count() == 3 and out.where("_row <> '_row' or _gone <> '_gone' or _cuts <> '_cuts' or _lang <> '_lang' or _tox <> '_tox' or _lm <> '_lm' or _cut <> '_cut' or _row_ <> '_row_'").count() == 0


def jobs_of(spark, run):
    """Result of run, and how many Spark jobs it took."""
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_end_by_what_their_writes_count(spark):
    """Stars are done after one round that changes nothing, without a job that compares two rounds."""
    stars = spark.createDataFrame([(10 * c, 10 * c + i) for c in range(5) for i in range(1, 4)], "a long, b long")
    comp, jobs = jobs_of(spark, lambda: components(stars))
    assert {r.node: r.component for r in comp.collect()} == {10 * c + i: 10 * c for c in range(5) for i in range(4)}
    assert jobs <= 14, jobs


def test_trie_joins_blocks_only_where_some_are_large(spark):
    """Where each subtree is one block nothing is joined, and tasks are no more than subtrees or shuffle partitions."""
    prints = spark.createDataFrame([(0,), (1,), (-1,)], "fp long")
    found, jobs = jobs_of(spark, lambda: simhash.links(prints))
    assert sorted({abs(r.a - r.b) for r in found.collect()}) == [1]
    assert jobs <= 10, jobs
