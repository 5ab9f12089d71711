"""Trigram language model in an Elias-Fano trie of memory-mapped levels.

Level 1 holds the training words in order of their hashes, as one Elias-Fano sequence with their counts as
another (rising sums). Level 2 holds bigrams and level 3 trigrams, those seen least times or more: contexts, rising
pointers from each context to its successors, and the successors, each an Elias-Fano sequence; a query finds
its context, then searches the successor among that context's alone. An entry keeps the discounted share of
its context, floor-quantised on a log scale in one byte; the weight that a context leaves to the lower order
is one minus the sum of those very shares, so that every context's probabilities add up to one. The lowest
order is the add-half unigram estimate.

Counts travel to their shard once, folded in each task and packed. A shard holds whole contexts, found by hash; only
the contexts that hold more than a part of a shard are split over several by the hash of the successor, and their weights, some for
each shard at most, are kept with the model. One task builds each shard and writes it to the shared folder, where scoring tasks map it.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, scratch_dir
from .eliasfano import EliasFano
from .text import U, mix, word_hashes

END = int(mix(np.array([1], U))[0])  # the end token among word hashes
SHARD = 1 << 21  # tokens for each shard
PART = SHARD // 16  # tokens of a context from which it is split
TEXTS = 2000  # read at once,
CHARACTERS = 1 << 23  # or as many as first come to so many
DISCOUNT = 0.75
LEAST = 2
_LOWEST = -7.0
_CODE = 10 ** (_LOWEST * (1 - np.arange(256) / 255))  # share of code c, 1e-7 to 1
_B2, _B3 = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)  # of shard hashes


def _local(path: str) -> str:
    scheme, _, rest = path.partition("://")
    if not rest:
        return path.removeprefix("file:")
    if scheme != "file":
        raise ValueError(f"the model's levels are memory-mapped, so spark.checkpoint.dir must be a mounted shared folder, not {scheme}://")
    return rest


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line that says where each array lies, then the arrays; put in place in one step."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (at, str(a.dtype), len(a))
        at += (a.nbytes + 7) // 8 * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(line)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def _load(path: str) -> dict[str, np.ndarray]:
    raw = np.asarray(np.memmap(path, np.uint8, "r"))  # plain arrays over the map
    end = int(np.flatnonzero(raw[: 1 << 16] == 10)[0]) + 1
    return {k: raw[end + at : end + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in json.loads(bytes(raw[:end])).items()}


def _named(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": a for k, a in ef.arrays.items()}


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in EliasFano.FIELDS})


@dataclass
class Split:
    """Contexts split over several shards, in rising order: in how many parts, and the weights that they leave."""

    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.ones(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.ones(0))

    @classmethod
    def of(cls, contexts, counts, limit: int) -> Split:
        order = np.argsort(np.asarray(contexts, np.int64))
        parts = -(-np.asarray(counts, np.int64)[order] // limit)
        return cls(np.asarray(contexts, np.int64)[order], parts, np.ones(len(order)))

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given are split, and where they stand here."""
        if not len(self.contexts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        own = np.flatnonzero(self.contexts[at] == context)
        return own, at[own]


@dataclass
class Model:
    """Where the levels lie, and the few numbers needed to read them. Maps are opened on first use in each process."""

    folder: str
    shards: list[int]  # of levels 1 to 3
    base: list[list[int]]  # first number of each shard's entries, and the end, of levels 1 and 2
    tokens: int
    types: int
    starts: int  # texts
    least: int = LEAST  # occurrences of the bigrams and trigrams kept
    split: dict[int, Split] = field(default_factory=lambda: {2: Split(), 3: Split()})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @property
    def limit(self) -> int:
        """Occurrences above which a context is split; so large that a million contexts reach it at most."""
        return max(PART, self.tokens >> 20)

    def part(self, level: int, shard: int) -> dict | None:
        """The arrays of a shard, None if nothing is in it."""
        maps = self.__dict__.setdefault("_maps", {})
        if (level, shard) not in maps:
            path, own = f"{self.folder}/level{level}-{shard}", None
            if os.path.exists(path):
                a = _load(path)
                own = {"a": a} | {name: _sequence(a, name) for name in ({"words", "sums"} if level == 1 else {"contexts", "pointers", "entries", "sums"}) if f"{name}.meta" in a}
            maps[level, shard] = own
        return maps[level, shard]

    def key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """One number for a context and a word, in order of contexts; word number types stands for every word unknown."""
        return context.astype(U) * U(self.types + 1) + word.astype(U)

    def unkey(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, w = np.divmod(key, U(self.types + 1))
        return c.astype(np.int64), w.astype(np.int64)

    def words(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, -1 for unknown ones; h distinct or not."""
        out, owner = np.full(len(h), -1), (h % U(max(1, self.shards[0]))).astype(np.int64)
        for s, own in _by(owner):
            at = self.part(1, s)["words"].find(h[own]) if self.part(1, s) else np.full(len(own), -1)
            out[own] = np.where(at >= 0, at + self.base[0][s], -1)
        return out

    def counts(self, level: int, number: np.ndarray) -> np.ndarray:
        """Counts of words (level 1) or bigrams (2) by number, 0 for -1."""
        out, edges = np.zeros(len(number), np.int64), np.array(self.base[level - 1])
        for s, own in _by(np.where(number >= 0, np.searchsorted(edges, number, "right") - 1, -1)):
            if s >= 0:
                sums, at = self.part(level, s)["sums"], number[own] - edges[s]
                out[own] = sums.get(at).astype(np.int64) - np.where(at > 0, sums.get(np.maximum(at - 1, 0)).astype(np.int64), 0)
        return out

    def shard_of(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        h = context.astype(U) * _B2
        own, at = self.split[level].find(context)
        h[own] += (mix(word[own].astype(U) * _B3) % self.split[level].parts[at].astype(U) + U(1)) * _B3
        return (mix(h) % U(max(1, self.shards[level - 1]))).astype(np.int64)

    def search(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (level 2) or places (3) of successors of known contexts, -1 where there is none; their shares; what the contexts leave.

        Equal contexts stand together.
        """
        out, share, left = np.full(len(word), -1), np.zeros(len(word)), np.ones(len(word))
        for s, own in _by(self.shard_of(level, context, word)):
            part = self.part(level, s)
            if part is None:
                continue
            asked = context[own]
            head = np.concatenate([[True], asked[1:] != asked[:-1]])  # one look-up for each run of a context
            c = part["contexts"].find(asked[head])
            start, end = (x.astype(np.int64) for x in part["pointers"].pair(np.maximum(c, 0)))
            rest = 1 - _CODE[part["a"]["codes"][np.minimum(start, len(part["a"]["codes"]) - 1)]]
            many, run = part["a"]["many"], np.cumsum(head) - 1
            if len(many):
                at = np.minimum(np.searchsorted(many, c.astype(many.dtype)), len(many) - 1)
                rest = np.where(many[at] == c, part["a"]["rest"][at], rest)
            known = c[run] >= 0
            own, run = own[known], run[known]
            if not len(own):
                continue
            left[own] = rest[run]
            at = part["entries"].find(c[run].astype(U) * U(self.types + 1) + word[own].astype(U), start[run], end[run])
            own, at = own[at >= 0], at[at >= 0]
            out[own] = at + (self.base[1][s] if level == 2 else 0)
            share[own] = _CODE[part["a"]["codes"][at]]
        own, at = self.split[level].find(context)
        left[own] = self.split[level].weights[at]
        return out, share, left


def _by(owner: np.ndarray):
    """Each owner and its places in rising order."""
    if not len(owner):
        return
    order = np.argsort(owner.astype(np.int16) if abs(owner).max() < 1 << 15 else owner, kind="stable")
    own = owner[order]
    edge = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(own[a]), order[a:b]


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and offsets."""
    h, off = word_hashes(texts, ascii_case=True)
    n = np.diff(off)
    out_off = off + np.arange(len(off))
    out = np.full(out_off[-1], END, U)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, out_off


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_inverse=True)


class _Tally:
    """Counts of keys, folded whenever many have come together."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray):
        own, n = np.unique(keys, return_counts=True)
        self.held.append((own, n))
        self.size += len(own)
        if self.size > 1 << 21:
            yield self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, U), np.zeros(0, np.int64))
        own, back = _runs(keys)
        self.held, self.size = [], 0
        return own, np.bincount(back, weights=n, minlength=len(own)).astype(np.int64)


def _count_words(batches):
    tally = _Tally()
    frame = lambda k, n: pd.DataFrame({"h": k.view(np.int64), "n": n})
    for pdf in batches:
        for part in tally.add(_tokens(pdf["text"].tolist())[0]):
            yield frame(*part)
    yield frame(*tally.fold())


@dataclass
class _Read:
    """Texts as word numbers: now, the word before (the start counts as number types), and facts of distinct words by place."""

    now: np.ndarray
    before: np.ndarray
    off: np.ndarray
    back: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, model: Model, texts: list[str | None], counted: bool = True) -> _Read:
        """counted: also the counts of words, else only whether they are known."""
        h, off = _tokens(texts)
        own, back = _runs(h)
        known = model.words(own)
        counts = model.counts(1, known) if counted else (known >= 0).astype(np.int64)
        number = np.where(counts >= model.least, known, -1)  # rarer words are in no kept bigram
        now = number[back]
        before = np.concatenate([[0], now[:-1]]) if len(now) else now
        before[off[:-1]] = model.types
        return cls(now, before, off, back, counts)

    def search(self, model: Model, level: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """model.search() of every token, each pair of context and word once; unknown contexts (-1) have no successors."""
        number, share, left = np.full(len(context), -1), np.zeros(len(context)), np.ones(len(context))
        ok = np.flatnonzero(context >= 0)
        key, back = _runs(model.key(context[ok], np.where(self.now[ok] >= 0, self.now[ok], model.types)))
        number[ok], share[ok], left[ok] = (x[back] for x in model.search(level, *model.unkey(key)))
        return number, share, left

    def contexts(self, number: np.ndarray) -> np.ndarray:
        """The number of the bigram before each token of the same text, -1 for none."""
        context = np.concatenate([[-1], number[:-1]]) if len(number) else number
        context[self.off[:-1]] = -1
        return context


def _pack(c: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Counts in order of (c, w), byte by byte of their numbers, compressed."""
    import zstandard

    head, body = [len(c)], []
    for x in (np.diff(c, prepend=0), w, n):
        width = max(1, (int(x.max()).bit_length() + 7) // 8)
        head.append(width)
        body.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return struct.pack("<QBBB", *head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    size, *widths = struct.unpack_from("<QBBB", blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[11:]), np.uint8)
    out, at = [], 0
    for width in widths:
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(x.view("<u8")[:, 0].astype(np.int64))
        at += size * width
    out[0] = np.cumsum(out[0])
    return out


def _packed(model: Model, level: int, keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row (shard, blob) for each shard that the counts of sorted keys belong to."""
    c, w = model.unkey(keys)
    rows = [(s, _pack(c[own], w[own], n[own])) for s, own in _by(model.shard_of(level, c, w))]
    return pd.DataFrame(rows, columns=["shard", "blob"])


def _gathered(batches):
    """Lists of texts, from column text of frames or as they are: about TEXTS, or CHARACTERS."""
    held: list[str | None] = []
    size = 0
    for batch in batches:
        for t in batch["text"] if isinstance(batch, pd.DataFrame) else batch:
            held.append(t if isinstance(t, str) else None)
            size += len(held[-1] or "")
            if len(held) >= TEXTS or size >= CHARACTERS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_level(level: int, batches, shared):
    model, tally = shared.value, _Tally()
    for texts in _gathered(batches):
        r = _Read.of(model, texts, model.least > 1)
        context = r.before
        if level == 3:
            number = r.search(model, 2, r.before)[0]
            context = np.where(number >= 0, r.contexts(number), -1)  # a kept trigram holds kept bigrams
        ok = (context >= 0) & (r.now >= 0)
        for part in tally.add(model.key(context[ok], r.now[ok])):
            yield _packed(model, level, *part)
    yield _packed(model, level, *tally.fold())


def _write_words(key, pdf, folder):
    pdf = pdf.sort_values("h", key=lambda s: s.to_numpy().view(U))
    h = pdf["h"].to_numpy().view(U)
    n = pdf["n"].to_numpy()
    _save(f"{folder}/level1-{int(key[0])}", _named("words", EliasFano.build(h, 1 << 64)) | _named("sums", EliasFano.build(np.cumsum(n), int(n.sum()) + 1)))
    return pd.DataFrame({"shard": [int(key[0])], "size": [len(h)], "total": [int(n.sum())]})


def _write_level(level, shard, blobs, shared):
    """Writes one shard from packed counts. Rows (shard, kind, a, n, x): 0 its size, 1 an entry that as a context is split, 2 a split context's sum of shares."""
    model = shared.value
    c, w, n = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    order = np.lexsort((w, c))
    c, w, n = c[order], w[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
    c, w, n = c[head], w[head], np.add.reduceat(n, head)
    kept = n >= model.least
    c, w, n = c[kept], w[kept], n[kept]
    if not len(c):
        return pd.DataFrame({"shard": [shard], "kind": 0, "a": 0, "n": 0, "x": 0.0})
    contexts, first = np.unique(c, return_index=True)
    size = np.diff(np.append(first, len(c)))
    local = np.repeat(np.arange(len(contexts)), size)
    total = np.where(contexts == model.types, model.starts, model.counts(1, np.where(contexts < model.types, contexts, -1))) if level == 2 else model.counts(2, contexts)
    share = (n - DISCOUNT) / np.maximum(total[local], n)
    code = np.clip(np.floor((1 - np.log10(share) / _LOWEST) * 255 + 1e-9), 0, 255).astype(np.uint8)
    code = np.where(_CODE[code] > share * (1 + 1e-12), np.maximum(code, 1) - 1, code).astype(np.uint8)
    used = np.bincount(local, weights=_CODE[code])
    many = np.flatnonzero(size > 1)
    arrays = _named("contexts", EliasFano.build(contexts, int(contexts[-1]) + 1)) | _named("pointers", EliasFano.build(np.append(first, len(c)), len(c) + 1))
    arrays |= _named("entries", EliasFano.build(local.astype(U) * U(model.types + 1) + w.astype(U), len(contexts) * (model.types + 1)))
    arrays |= {"codes": code, "many": many.astype(np.uint32), "rest": np.maximum(1 - used[many], 0).astype(np.float32)}
    if level == 2:
        arrays |= _named("sums", EliasFano.build(np.cumsum(n), int(n.sum()) + 1))
    _save(f"{model.folder}/level{level}-{shard}", arrays)
    large = np.flatnonzero(n > model.limit) if level == 2 else np.zeros(0, np.int64)
    own = model.split[level].find(contexts)[0]
    return pd.DataFrame({
        "shard": shard, "kind": np.repeat([0, 1, 2], [1, len(large), len(own)]), "a": np.concatenate([[len(c)], large, contexts[own]]),
        "n": np.concatenate([[0], n[large], np.zeros(len(own), np.int64)]), "x": np.concatenate([np.zeros(1 + len(large)), used[own]]),
    })


def _level(texts: DataFrame, level: int, model: Model) -> None:
    """Builds level 2 or 3, and sets what the model knows of it: sizes of its shards, weights of split contexts, contexts to split above."""
    spark = texts.sparkSession
    model.shards[level - 1] = max(1, -(-model.tokens // SHARD))
    shared = spark.sparkContext.broadcast(model)
    packed = texts.mapInPandas(lambda it: _count_level(level, it, shared), "shard long, blob binary")
    built = packed.groupBy("shard").applyInPandas(lambda k, p: _write_level(level, int(k[0]), p["blob"], shared), "shard long, kind int, a long, n long, x double")  # about SHARD tokens a group
    got = built.toPandas()  # a row for each shard and for contexts of over model.limit tokens, a million at most
    sizes = got[got["kind"] == 0].set_index("shard")["a"].to_dict()
    split = model.split[level]
    used = got[got["kind"] == 2].groupby("a")["x"].sum()
    at = np.searchsorted(split.contexts, used.index.to_numpy(np.int64))
    split.weights[at] = np.maximum(0.0, 1 - used.to_numpy())
    if level == 2:
        model.base[1] = [0, *np.cumsum([sizes.get(s, 0) for s in range(model.shards[1])]).tolist()]
        large = got[got["kind"] == 1]
        model.split[3] = Split.of(np.array(model.base[1])[large["shard"].to_numpy(np.int64)] + large["a"].to_numpy(np.int64), large["n"].to_numpy(np.int64), model.limit)


def train(docs: DataFrame, text: str = "text", least: int = LEAST) -> Model:
    """Counts words, bigrams and trigrams of all texts (null as empty) and writes the trie's levels.

    Words are maximal runs without white space, A-Z in lower case, and every text ends in one end token. All
    words are kept; bigrams and trigrams from least occurrences on, all of them at 1. Words are told
    apart by 64-bit hashes. Without rows the model has no tokens.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = f"{_local(scratch_dir(spark))}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col(text).alias("text"))
    words = texts.mapInPandas(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).persist()
    types, tokens, starts = words.agg(F.count("*"), F.sum("n"), F.max(F.when(F.col("h") == int(np.array([END], U).view(np.int64)[0]), F.col("n")))).first()
    shards = max(1, -(-types // SHARD))
    model = Model(folder, [shards, 1, 1], [[0] * (shards + 1), [0, 0]], int(tokens or 0), int(types), int(starts or 0), least)

    @F.pandas_udf("int")
    def placed(h: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy().view(U) % U(shards)).astype(np.int32))

    done = words.withColumn("shard", placed("h")).groupBy("shard").applyInPandas(lambda k, p: _write_words(k, p, folder), "shard int, size long, total long").collect()
    frequent = words.where(F.col("n") > model.limit).toPandas()  # a million at most
    words.unpersist()
    sizes = {x["shard"]: x["size"] for x in done}
    if not types:
        model.shards = [0, 0, 0]
        return model
    model.base[0] = [0, *np.cumsum([sizes.get(s, 0) for s in range(shards)]).tolist()]
    contexts, counts = model.words(frequent["h"].to_numpy(np.int64).view(U)), frequent["n"].to_numpy(np.int64)
    if model.starts > model.limit:
        contexts, counts = np.append(contexts, model.types), np.append(counts, model.starts)
    model.split[2] = Split.of(contexts, counts, model.limit)
    model.__dict__.pop("_maps", None)
    for level in (2, 3):
        _level(texts, level, model)
    return model


def evaluate(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """n_tokens, n_known, base_score and score (log10 probabilities) of each text."""
    if not model.types:
        n = np.diff(_tokens(texts)[1])
        base = n * (np.log10(0.5) - np.log10(0.5))
        return pd.DataFrame({"n_tokens": n, "n_known": 0, "base_score": base, "score": base})
    r = _Read.of(model, texts)
    c = r.counts[r.back]
    p1 = ((r.counts + 0.5) / (model.tokens + 0.5 * (model.types + 1)))[r.back]
    number, share, left = r.search(model, 2, r.before)
    p2 = share + left * p1
    _, share, left = r.search(model, 3, r.contexts(number))
    p3 = share + left * p2
    off = r.off
    add = lambda v: np.add.reduceat(v, off[:-1])  # noqa: E731  every text has its end token
    return pd.DataFrame({"n_tokens": np.diff(off), "n_known": add((c > 0).astype(np.int64)), "base_score": add(np.log10(p1)), "score": add(np.log10(np.maximum(p3, 1e-300)))})


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score, replacing columns of these names.

    Null texts count as empty: one end token. Without training tokens both scores are 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<n_tokens:long,n_known:long,base_score:double,score:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _gathered(batches):
            yield evaluate(shared.value, texts)

    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    own = fresh(docs, "_lm")
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(*kept, scored(F.col(text)).alias(own))
    return out.select(*kept, f"{own}.n_tokens", f"{own}.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), f"{own}.base_score", f"{own}.score")
