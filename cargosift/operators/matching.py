"""Taxonomy hits, denied-party matches and similarity signals of shipments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargosift import schemas
from cargosift.config import DUAL_USE_CONCEPTS, HS_CHAPTERS, HYPOTHESES, Screening
from cargosift.functions import expressions as E
from cargosift.functions import keywords

Embedder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]  # of premise and hypothesis: a score, or the three of contradiction, neutral and entailment


def hashing_embedder(dim: int = 64) -> Embedder:
    """Unit vectors of hashed words and word pairs; a stand-in where no sentence model is at hand."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            words = (t or "").lower().split()
            v = np.zeros(dim, np.float32)
            for g in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(g.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return lambda c: embed(c)


def keyword_hits(description: Column, groups: list[dict]) -> Column:
    """One hit for each group, in order, whose first hard keyword contained in the lower-case description is named."""
    low = F.lower(F.coalesce(description, F.lit("")))
    if sum(len(g["hard_keywords"]) for g in groups) > keywords.CHAINED:
        return keywords.first_of_groups(low, groups, schemas.HIT)
    hits = []
    for g in groups:
        words = [k.lower() for k in g["hard_keywords"] if k]
        if words:
            first = F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in words], F.lit(None).cast("string"))
            hits.append(F.when(first.isNotNull(), F.array(F.struct(F.lit(g["group_id"]).alias("group_id"), F.lit(g["name"]).alias("group_name"), F.lit(g["risk_level"]).alias("risk_level"), F.lit(None).cast("string").alias("matched_phrase"), first.alias("matched_keyword"), F.lit(None).cast("double").alias("similarity_score")))))
    if not hits:
        return F.array().cast(f"array<{schemas.HIT}>")
    return E.signals(*hits).cast(f"array<{schemas.HIT}>")


PHRASES = 10_000  # configured phrases that every row may be held against


def semantic_pairs(facts: DataFrame, phrases: DataFrame, thresholds: dict[str, float], taken: DataFrame | None = None) -> DataFrame:
    """Best phrase of each group for each fact row: (row_id, group_id, phrase_idx, phrase, similarity) at or above its level's threshold.

    facts (row_id, vec), phrases (group_id, risk_level, phrase_idx, phrase, vec): a configured table, of more than PHRASES rows an error. taken
    (row_id, group_id) holds pairs that need no phrase. Ties go to the first phrase.
    """
    level = F.coalesce(*[F.when(F.col("risk_level") == k, F.lit(v)) for k, v in thresholds.items()], F.lit(1.1))
    if phrases.limit(PHRASES + 1).count() > PHRASES:
        raise ValueError(f"more than {PHRASES} phrases")
    pairs = facts.join(F.broadcast(phrases.withColumnRenamed("vec", "pvec")))
    if taken is not None:
        pairs = pairs.join(taken, ["row_id", "group_id"], "left_anti")
    scored = pairs.select("row_id", "group_id", "risk_level", "phrase_idx", "phrase", E.cosine(F.col("vec"), F.col("pvec")).alias("similarity"))
    best = scored.groupBy("row_id", "group_id", "risk_level").agg(F.max(F.struct("similarity", (-F.col("phrase_idx")).alias("first"), "phrase")).alias("b"))
    return best.select("row_id", "group_id", "risk_level", (-F.col("b.first")).alias("phrase_idx"), F.col("b.phrase").alias("phrase"), F.col("b.similarity").alias("similarity")).where(F.col("similarity") >= level)


def semantic_signals(vec: Column, groups: list[dict], phrase_vectors: np.ndarray, chapter_vectors: np.ndarray, concept_vectors: np.ndarray, chapter: Column, settings: Screening) -> Column:
    """Struct (hits, ai) of a vector column against the configured phrases, chapters and concepts: one product for each Arrow batch."""
    owner = np.array([i for i, g in enumerate(groups) for _ in g["semantic_phrases"]])
    phrases = [p for g in groups for p in g["semantic_phrases"]]
    limit = [settings.similarity.get(g["risk_level"], 1.1) for g in groups]
    codes, titles = list(HS_CHAPTERS), list(HS_CHAPTERS.values())
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    pv, cv, dv = unit(phrase_vectors), unit(chapter_vectors), unit(concept_vectors)

    @F.pandas_udf(f"struct<hits:array<{schemas.HIT}>,ai:{schemas.AI}>")
    def judged(vectors: pd.Series, declared: pd.Series) -> pd.DataFrame:
        x = unit(np.stack([np.asarray(v, np.float64) for v in vectors])) if len(vectors) else np.zeros((0, pv.shape[1]))
        p, c, d = x @ pv.T, x @ cv.T, x @ dv.T
        hits, ai = [], []
        for i, own in enumerate(declared):
            row = []
            for g, group in enumerate(groups):
                at = np.flatnonzero(owner == g)
                if len(at):
                    best = at[np.argmax(p[i, at])]
                    if p[i, best] >= limit[g]:
                        row.append({"group_id": group["group_id"], "group_name": group["name"], "risk_level": group["risk_level"], "matched_phrase": phrases[best], "matched_keyword": None, "similarity_score": float(p[i, best])})
            hits.append(row)
            k = max(1, min(settings.hs_top_k, len(codes)))
            top = np.lexsort((-np.arange(len(codes)), -c[i]))[:k]
            near = np.flatnonzero(d[i] >= settings.dual_use_similarity)
            near = near[np.argsort(-d[i, near], kind="stable")]
            ai.append({
                "hs_predictions": [{"chapter": codes[j], "title": titles[j], "similarity": float(c[i, j])} for j in top],
                "declared_similarity": float(c[i, codes.index(own)]) if own in HS_CHAPTERS else None,
                "dual_use": [{"concept": DUAL_USE_CONCEPTS[j], "similarity": float(d[i, j])} for j in near],
                "coherence": float(c[i, top[0]]),  # of the description with the chapter nearest to it
            })
        return pd.DataFrame({"hits": hits, "ai": ai})

    return judged(vec, chapter)


def common_subsequence(s: str, t: str) -> int:
    """Length of the longest common subsequence, a whole row of the table at once as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(s):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(s)) - 1
    row = full
    for c in t:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(s) - row.bit_count()


def token_set_similarity(a: str, b: str) -> float:
    """Similarity of two names as sets of words, 0 to 1: 1 if one set holds the other, else the best indel ratio."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    ratio = lambda s, t: 2 * common_subsequence(s, t) / (len(s) + len(t)) if s or t else 1.0
    common = " ".join(both)
    s, t = (" ".join(both + side) for side in (left, right))
    return max([ratio(s, t)] + ([ratio(common, s), ratio(common, t)] if both else []))


LISTED = 20_000  # names of a denied-party list that one index holds; longer lists are cut into so many
KNOWN = 100_000  # names whose match a Python worker remembers
HELD = 256  # names of an index that a whole batch of names is held against at once


class NameIndex:
    """The names of a list by letter pairs and words, to find every one whose token-set similarity reaches a threshold.

    A similarity of t comes from one of two things. Either the spaced words of both names, of S characters together, have
    an indel ratio of t: then all but (1 - t) S characters are matched, each of those parts at most one neighbouring
    pair, (1.5 t - 1) S - 1 letter pairs are shared (or a letter, where that is none), and t S / 2 characters are in both.
    Or the words in common, with their spaces, cover t / (2 - t) of one name. Both are counted over the places of a name's
    pairs and words, all names of the list at once, so that only names that pass are compared.
    """

    def __init__(self, names: list[str], threshold: float):
        self.names, self.t = names, threshold
        self.gain, self.cover = 1.5 * threshold - 1, threshold / (2 - threshold)
        own = [self.parts(n) for n in names]
        self.size = np.array([p[0] for p in own], np.int64)
        self.repeats = np.array([p[1] for p in own], np.int64)
        self.letters = np.stack([p[4] for p in own]) if own else np.zeros((0, 64), np.int16)
        pairs: dict[str, list[int]] = {}
        words: dict[str, list[int]] = {}
        for i, p in enumerate(own):
            for of, grams in ((pairs, p[2]), (words, p[3])):
                for g in grams:
                    of.setdefault(g, []).append(i)
        self.pairs, self.words = ({g: np.array(at, np.int64) for g, at in of.items()} for of in (pairs, words))
        texts = [" ".join(p[3]).encode() for p in own] if len(names) <= HELD else []
        used = sorted({b for text in texts for b in text if b < 128})
        self.kind = np.full(256, len(used), np.int64)  # of a byte: its place among the list's, the last for all others
        self.kind[used] = np.arange(len(used))
        self.spelled = np.array([np.bincount(self.kind[np.frombuffer(text, np.uint8)], minlength=len(used) + 1)[:-1] for text in texts], np.int64).reshape(len(texts), len(used))
        self.covered = np.zeros((len(words), len(texts)), np.int64)  # characters of a word and its space in each name
        for w, (word, at) in enumerate(self.words.items() if texts else ()):
            self.covered[w, at] = len(word) + 1
        self.listed = pa.array(list(self.words), pa.large_string())

    def parts(self, name: str) -> tuple:
        """(size, repeated pairs, pairs, words, counts of characters) of a normal name's distinct words."""
        words = {w for w in name.split(" ") if w}
        text = " ".join(words)
        every = [f" {w} "[i : i + 2] for w in words for i in range(len(w) + 1)]
        pairs = set(every)
        if self.gain <= 0 or len(text) <= 1 / self.gain:
            pairs |= set(text)
        letters = np.bincount(np.array([ord(c) % 64 for c in text], np.int64), minlength=64).astype(np.int16)  # folded: counts in common can only grow
        return len(text), len(every) - len(set(every)), pairs, words, letters

    def _least(self, size, other, repeats):
        """Pairs that names of two sizes must share."""
        return np.maximum(np.ceil(self.gain * (size + other) - 1 - 1e-9) - repeats, 1)

    def near(self, name: str) -> np.ndarray:
        """Places of all names that may reach the threshold, in order."""
        n, (size, repeats, pairs, words, letters) = len(self.names), self.parts(name)
        lists = [self.pairs[p] for p in pairs if p in self.pairs]
        found = np.zeros(0, np.int64)
        if lists:
            count = np.bincount(np.concatenate(lists), minlength=n)
            some = np.flatnonzero(count >= self._least(size, np.ceil(size * self.cover - 1e-9), repeats))  # with the shortest name that may match
            total = size + self.size[some]
            ok = (count[some] >= self._least(size, self.size[some], np.minimum(repeats, self.repeats[some]))) & (2 * np.minimum(size, self.size[some]) >= self.t * total - 1e-9)
            some, total = some[ok], total[ok]
            found = some[2 * np.minimum(self.letters[some], letters).sum(axis=1) >= self.t * total - 1e-9]
        shared = [(self.words[w], len(w) + 1) for w in words if w in self.words]
        if shared:
            common = np.bincount(np.concatenate([at for at, _ in shared]), np.repeat([k for _, k in shared], [len(at) for at, _ in shared]), n) - 1
            found = np.union1d(found, np.flatnonzero((common > 0) & (common >= self.cover * np.minimum(size, self.size) - 1e-9)))
        return found

    def likely(self, names: pa.Array) -> np.ndarray:
        """Whether each of a batch of names (distinct or not, no nulls) may reach the threshold with any listed name, by near()'s counts of characters and of words.

        All names are counted at once. Of a list of more than HELD names every name is likely, and so is one that is no plain normal name of
        distinct words.
        """
        n, names = len(names), names.cast(pa.large_string())
        if not n or not self.spelled.size:
            return np.full(n, len(self.names) > 0)
        at = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + n + 1]
        data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        size, row = np.diff(at), np.repeat(np.arange(n), np.diff(at))
        likely = np.bincount(row[data > 127], minlength=n) > 0
        kinds = self.spelled.shape[1]
        letters = np.bincount(self.kind[data] * n + row, minlength=(kinds + 1) * n).reshape(kinds + 1, n).astype(np.int32)
        for own, other in zip(self.spelled, self.size.tolist(), strict=True):
            both = sum(np.minimum(letters[k], own[k]) for k in np.flatnonzero(own))
            likely |= 2 * both >= self.t * (size + other) - 1e-9
        parted = pc.split_pattern(names, " ")
        owner = np.repeat(np.arange(n), np.diff(parted.offsets.to_numpy()))
        words = parted.flatten().dictionary_encode()
        code, texts = words.indices.to_numpy(), words.dictionary
        each = np.sort(owner * len(texts) + code)
        likely[each[1:][each[1:] == each[:-1]] // len(texts)] = True
        likely[owner[pc.equal(texts, "").to_numpy(zero_copy_only=False)[code]]] = True
        place = pc.fill_null(pc.index_in(texts, self.listed), -1).to_numpy()[code]
        some, back = np.unique(owner[place >= 0], return_inverse=True)
        common = np.zeros((len(some), len(self.names)), np.int64)
        np.add.at(common, back, self.covered[place[place >= 0]])
        likely[some] |= ((common > 1) & (common - 1 >= self.cover * np.minimum(size[some, None], self.size) - 1e-9)).any(axis=1)
        return likely

    def best(self, name: str) -> tuple[int, float] | None:
        """(place, score) of the most similar name that reaches the threshold, the first of equals; None without one."""
        best = None
        for i in self.near(name).tolist():
            score = token_set_similarity(name, self.names[i])
            if score >= self.t and (best is None or score > best[1]):
                best = (i, score)
        return best


_indexes: dict[tuple, tuple[NameIndex, dict, dict]] = {}  # of this Python worker


def name_matcher(listed: list[tuple], threshold: float):
    """A column function from normal names to struct (ord, score, exact_match, matched_party, list_name) of their match on a list of at most LISTED rows, else null.

    The list has rows (ord, key, matched_party, list_name). Of equal keys the last is the exact match, of equal scores the first name. A worker
    compares a name once, as long as it remembers it. Nothing is joined, so that Spark leaves the matching out where no match is read.
    """
    token = (hash(tuple(listed)), len(listed), threshold)

    def matched(keys: pa.Array) -> pa.Array:
        if token not in _indexes:
            if len(_indexes) > 8:
                _indexes.clear()
            _indexes[token] = NameIndex([x[1] for x in listed], threshold), {x[1]: i for i, x in enumerate(listed)}, {}
        index, exact, known = _indexes[token]
        if len(known) > KNOWN:
            known.clear()
        coded = keys.dictionary_encode()
        names = coded.dictionary
        found, place = [(None,) * 5], np.zeros(len(names) + 1, np.int64)  # the last place is that of nulls
        for i in np.flatnonzero(index.likely(names)).tolist():
            key = names[i].as_py()
            if key and key not in known:
                known[key] = (exact[key], 1.0) if key in exact else index.best(key)
            best = known.get(key)
            if best is not None:
                place[i] = len(found)
                found.append((listed[best[0]][0], best[1], key in exact, *listed[best[0]][2:]))
        rows = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), _MATCHED, strict=True)], fields=list(_MATCHED))
        return rows.take(pa.array(place[pc.fill_null(coded.indices, len(names)).to_numpy()]))

    return F.arrow_udf(matched, "struct<ord:bigint,score:double,exact_match:boolean,matched_party:string,list_name:string>").asNondeterministic()  # filters on a match stay above it


_MATCHED = pa.schema([("ord", pa.int64()), ("score", pa.float64()), ("exact_match", pa.bool_()), ("matched_party", pa.string()), ("list_name", pa.string())])


def _blocks(denied: DataFrame) -> list[list[tuple]]:
    """The list (ord, key, matched_party, list_name) in order, in pieces of LISTED names; it is a configured table, read piece by piece."""
    rows = denied.select(F.col("ord").cast("long").alias("ord"), "key", "matched_party", "list_name").where("key <> ''")
    n = rows.count()
    own = lambda part: sorted((tuple(r) for r in part.collect()), key=lambda r: r[:2])
    if n <= LISTED:
        return [own(rows)]
    pieces = -(-2 * n // LISTED)  # by hash, with room for uneven ones
    return [own(rows.where(F.pmod(F.xxhash64("ord"), F.lit(pieces)) == i)) for i in range(pieces)]


def _matched(rows: DataFrame, keys: dict[str, Column], denied: DataFrame, threshold: float) -> DataFrame:
    """Adds struct columns (ord, score, exact_match, matched_party, list_name) by name, of the best match of each key over all pieces of the list; fields are null without one."""
    udfs = [name_matcher(b, threshold) for b in _blocks(denied)]
    if len(udfs) == 1:
        return rows.withColumns({n: udfs[0](key) for n, key in keys.items()})
    out = rows.withColumns({f"_m_{n}_{i}": udf(key) for n, key in keys.items() for i, udf in enumerate(udfs)})
    rank = lambda m: F.struct(m["exact_match"].alias("exact"), m["score"].alias("score"), F.when(m["exact_match"], m["ord"]).otherwise(-m["ord"]).alias("place"), m.alias("m"))
    for n in keys:
        each = [F.when(m["ord"].isNotNull(), rank(m)) for m in (F.col(f"_m_{n}_{i}") for i in range(len(udfs)))]
        out = out.withColumn(n, F.greatest(*each)["m"]).drop(*[f"_m_{n}_{i}" for i in range(len(udfs))])
    return out


def match_names(names: DataFrame, denied: DataFrame, threshold: float = 0.80) -> DataFrame:
    """For distinct normal names (key): (key, matched_party, list_name, score, exact_match), exact first, then the best fuzzy one.

    denied (ord, matched_party, key, list_name) is the configured list. Of equal exact keys the last holds, of equal fuzzy
    scores the first. Names without a match are left out. Each name meets an index of the list, or of every LISTED names of it, in
    its own task: nothing is shuffled, and only names that NameIndex.near gives are compared.
    """
    return _matched(names.select("key"), {"m": F.col("key")}, denied, threshold).where("m.ord is not null").select("key", "m.matched_party", "m.list_name", "m.score", "m.exact_match")


ROLES = ("consignee", "shipper")


def name_matches(names: DataFrame, denied: DataFrame, threshold: float = 0.80) -> DataFrame:
    """match_names() with every name (key): ord and the other columns are null where there is no match."""
    return _matched(names.select("key"), {"m": F.col("key")}, denied, threshold).select("key", "m.ord", "m.score", "m.exact_match", "m.matched_party", "m.list_name")


def with_matches(rows: DataFrame) -> DataFrame:
    """Makes matches (consignee first, then shipper) of the structs _party_consignee and _party_shipper, which go."""
    one = lambda m, role: F.when(m["ord"].isNotNull(), F.array(F.struct(m["matched_party"].alias("matched_party"), F.col(role).alias("input_party"), F.lit(role).alias("role"), m["score"].alias("score"), m["list_name"].alias("list_name"), m["exact_match"].alias("exact_match"))))
    return rows.withColumn("matches", E.signals(*[one(F.col(f"_party_{r}"), r) for r in ROLES]).cast(f"array<{schemas.MATCH}>")).drop(*[f"_party_{r}" for r in ROLES])


def party_matches(rows: DataFrame, denied: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Adds matches (consignee first, then shipper); empty and null names make none.

    Rows stay where they are: their names are matched in their own task against the list.
    """
    return with_matches(_matched(rows, {f"_party_{r}": E.normal_name(F.col(r)) for r in ROLES}, denied, threshold))


def classify(logits: Column) -> Column:
    """Struct (label, confidence): softmax over the three hypotheses' scores and its first maximum."""
    labels = ("allowed", "restricted", "needs_review")
    p = E.softmax(logits)
    top = F.array_max(p)
    general = F.struct(F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, top).cast("int")).alias("label"), top.alias("confidence"))
    # Three numbers, as they come, take plain arithmetic, which Spark compiles; what takes a lambda is interpreted.
    scores = [F.get(logits, F.lit(i)).cast("double") for i in range(len(labels))]
    whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in scores], F.size(logits) == len(labels))
    # Nothing is shared among the branches of a condition, so the three powers are written once: the greatest one is exp(0), which is 1.
    best = F.greatest(*scores)
    power = [F.exp(x - best) for x in scores]
    total = power[0] + power[1] + power[2]
    odd = ~(F.abs(best) < float("inf"))  # all shares are NaN, and the first is the greatest
    same = lambda x, p: odd | (x == best) | ((best - x < 1e-9) & (p / total == F.lit(1.0) / total))
    most = F.lit(1.0) / total
    first = F.coalesce(*[F.when(same(x, p), F.lit(name)) for x, p, name in zip(scores, power, labels, strict=True)])
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(first.alias("label"), most.alias("confidence"))).otherwise(general)


def word_overlap(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' distinct words, in lower case, that the premise has; a stand-in where no entailment model is at hand."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), ""))
    own = words(hypothesis)
    return F.size(F.array_intersect(own, words(premise))) / F.size(own)


Predictor = Callable[[list[str], tuple[str, ...]], np.ndarray]  # of texts and hypotheses: a score each, or the three of contradiction, neutral and entailment


@dataclass(frozen=True)
class BatchScorer:
    """A model that scores batches of texts against all hypotheses at once; load is called once in each Python worker and gives the predictor."""

    load: Callable[[], Predictor]
    batch_size: int = 64

    def scores(self, premise: Column, hypotheses: tuple[str, ...], triples: bool = False) -> Column:
        """Array of the score of each hypothesis; of a model that gives triples the entailment, the last of three. Null texts count as empty."""
        load, shape = self.load, (len(hypotheses), 3) if triples else (len(hypotheses), 1)

        def make():
            model = load()

            def predict(texts: np.ndarray) -> np.ndarray:
                return np.asarray(model([str(t) for t in texts], hypotheses), np.float64).reshape(len(texts), *shape)[:, :, -1]

            return predict

        return predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=self.batch_size)(F.coalesce(premise, F.lit("")))


def overlap_model() -> Predictor:
    """word_overlap() for BatchScorer."""
    import re

    words = lambda t: {w for w in re.split("[^a-z0-9]+", t.lower()) if w}
    return lambda texts, hypotheses: np.array([[len(words(h) & own) / len(words(h)) for h in hypotheses] for own in map(words, texts)])


def hypothesis_scores(premise: Column, scorer: Scorer | BatchScorer, triples: bool = False, hypotheses: tuple = HYPOTHESES) -> Column:
    """Array of the scores of a text against each hypothesis; of scorers that give triples the entailment."""
    if isinstance(scorer, BatchScorer):
        return scorer.scores(premise, tuple(hypotheses), triples)
    scores = F.array(*[scorer(premise, F.lit(h)) for h in hypotheses])
    return entailment(scores) if triples else scores


def entailment(scores: Column) -> Column:
    """Score of each hypothesis from rows (contradiction, neutral, entailment): the third, of shorter rows the last."""
    return F.transform(scores, lambda r: F.coalesce(F.get(r, F.lit(2)), F.element_at(r, -1)))


def best_match(matches: Column) -> Column:
    """The match of highest score, the first of equals; null without any."""
    return F.reduce(matches, F.lit(None).cast(schemas.MATCH), lambda a, m: F.when(a.isNull() | (m["score"] > a["score"]), m).otherwise(a))
