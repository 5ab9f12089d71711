"""SentencePiece encoding to the N best segmentations, and decoding.

No piece crosses from text into a space or over a line feed, so the piece lattice of a text is a chain of
small lattices, one for each unit (spaces and what follows them up to the next space or line feed). The arcs of all
new units of a batch are found together, one letter of every piece at a time, and forward Viterbi scores are
computed place by place for all of them at once. They are exact heuristics for an A*
search from a unit's end backwards, which yields its segmentations in falling order of score. The margin of a
unit, the loss of its first deviation from the best path, follows from the forward scores alone; only the
units of smallest margin can differ in a text's N best segmentations, so A* runs on those.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, prepare
from .text import Slots, U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_P = U(0x9E3779B97F4A7C15)
LONG = 40
KNOWN = 1 << 18  # units in a worker's store before a batch, about 60 MB
SEARCHED = 1 << 13  # units whose n best segmentations are kept
BYTE_LOSS = 10.0
GRID = 1 << 20


class _Numbers(dict):
    """Numbers of units in order of first sight."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run of n, one run after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def units_of(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """All units of texts in order, as numbers of the distinct ones, these in order of first sight, and how many units come before each text and the end."""
    try:
        raw = [(" " + t).encode() if t else b"" for t in texts]
    except UnicodeEncodeError:  # lone surrogates, which no text of a table holds
        cuts = [_UNIT.findall(" " + t) if t else [] for t in texts]
        seen = _Numbers()
        codes = np.array([seen[u] for u in chain.from_iterable(cuts)], np.int64)
        return codes, list(seen), np.append(0, np.cumsum([len(c) for c in cuts]))
    joined, end = b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(joined, np.uint8)
    space, feed = data == 32, data == 10
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = feed[1:] | feed[:-1] | (space[1:] & ~space[:-1])
    first[end] = True
    at = np.flatnonzero(first)
    coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.append(0, np.searchsorted(at, end))


class Lattice:
    """Pieces with scores. A model whose scores are only merge ranks gets log probabilities by Zipf's law on rank."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes, self.piece = [0] * 256, {}
        text, score = {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                t = p.replace("▁", " ")
                if t.strip(" ").find(" ") < 0 and not (t[-1:] == " " and t.strip(" ")) and "\n" not in t[:-1] and t not in text:
                    text[t], score[i], self.piece[i] = i, sp.get_score(i), t
        ranks = sorted(-s for s in score.values())
        if ranks and all(float(r).is_integer() for r in ranks) and ranks[-1] >= len(ranks) - 1:
            total = math.log(sum(1 / (r + 2) for r in ranks))
            score = {i: -math.log(-s + 2) - total for i, s in score.items()}
        score = {i: round(s * GRID) / GRID for i, s in score.items()}  # sums of these are exact, whatever their order
        self.scores = score
        self.ids = text
        self.byte_score = min(score.values(), default=0.0) - BYTE_LOSS
        self.longest = max(map(len, text), default=1)
        start = {t[:n]: -1 for t in text for n in range(1, len(t))} | text  # beginnings of pieces, -1 where they are none
        keys = sorted((self._hash(t), i) for t, i in start.items())
        self.keys = np.array([k for k, _ in keys], U)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("pieces with one hash")
        self.key_ids = np.array([i for _, i in keys], np.int64)
        self.key_scores = np.array([score.get(i, -math.inf) for _, i in keys])
        self.slots = Slots(self.keys)
        self.decoded = {i: t.encode() for i, t in self.piece.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        known = [self.decoded.get(i, b"") for i in range(max(self.decoded, default=-1) + 1)]
        self.spelled = pa.array(known + [b[1:] if b[:1] == b" " else b for b in known], pa.large_binary())  # then as they begin a text
        self.is_known = np.array([len(b) > 0 for b in known], bool)
        self.nbest_of: dict[str, list] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the store of best segmentations."""
        self.place, self.used = _Numbers(), np.zeros(0, np.int64)
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.unit_score, self.unit_margin = np.zeros(0), np.zeros(0)

    @staticmethod
    def _hash(t: str) -> int:
        h = np.zeros(1, U)
        for c in t:
            h = h * _P + U(ord(c) + 1)
        return int(mix(h)[0])

    def arcs(self, unit: str, end: int):
        """Pieces that end there, longest first: (start, id or None for bytes, score)."""
        ids, scores = self.ids, self.scores
        for start in range(max(0, end - self.longest), end):
            i = ids.get(unit[start:end])
            if i is not None:
                yield start, i, scores[i]
        if unit[end - 1] not in self.ids:
            yield end - 1, None, self.byte_score * len(unit[end - 1].encode("utf-8", "surrogatepass"))

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a unit by A* from its end, with forward scores as exact heuristic.

        Of paths of one score the one further along is followed first, and a place is left by at most n paths:
        the n best through it need no more. So work grows with the unit's length, also where all paths tie.
        """
        if (known := self.nbest_of.get(unit)) and (len(known) >= n or known[-1] is None):
            return [x for x in known if x is not None][:n]
        arcs = [[], *(list(self.arcs(unit, end)) for end in range(1, len(unit) + 1))]
        best, out, count = [0.0], [], 0
        for own in arcs[1:]:
            best.append(max([best[a] + s for a, _, s in own]))
        heap = [(-best[-1], len(unit), 0, 0.0, None)]
        left = [0] * (len(unit) + 1)
        while heap and len(out) < n:
            _, at, _, after, path = heapq.heappop(heap)
            left[at] += 1
            if left[at] > n:
                continue
            if at == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((after, ids))
                continue
            for start, i, s in arcs[at]:
                count += 1
                here = [i] if i is not None else [self.bytes[b] for b in unit[start:at].encode("utf-8", "surrogatepass")]
                heapq.heappush(heap, (-(best[start] + s + after), start, count, s + after, (here, path)))
        if len(unit) <= LONG:
            if len(self.nbest_of) >= SEARCHED:
                self.nbest_of.clear()
            self.nbest_of[unit] = [*out, *([None] if len(out) < n else [])]
        return out

    def _arcs_of(self, codes: np.ndarray, rest: np.ndarray, width: np.ndarray):
        """Starts, lengths, ids (-1 for bytes) and scores of all arcs; rest: characters up to the unit's end."""
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), U), []
        for size in range(1, self.longest + 1):
            if size > 1:
                inside = rest[at] >= size
                at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _P + (codes[at + size - 1] + 1).astype(U)
            k = self.slots.find(mix(h))
            known = k >= 0
            if size == 1:
                bare = at[~known | (self.key_ids[k] < 0)]
                found.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1), self.byte_score * width[bare]))
            at, h, k = at[known], h[known], k[known]
            piece = self.key_ids[k] >= 0
            found.append((at[piece], np.full(piece.sum(), size), self.key_ids[k[piece]], self.key_scores[k[piece]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _viterbi(self, units: list[str]):
        """Flat ids, sizes, scores and margins of the best segmentations of units of LONG characters at most."""
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(codes)) - first[owner]
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        start, length, ids, gain = self._arcs_of(codes, sizes[owner] - place, width)
        depth = place[start] + length
        order = np.argsort(start, kind="stable")
        order = order[np.argsort(depth[order].astype(np.uint8), kind="stable")]
        start, length, ids, gain, depth = start[order], length[order], ids[order], gain[order], depth[order]
        low = start + owner[start]  # a unit has one node more than characters
        high, begin = low + length, first + np.arange(len(units))
        best, gap, arc = np.full(len(codes) + len(units), -np.inf), np.full(len(codes) + len(units), np.inf), np.zeros(len(codes) + len(units), np.int64)
        best[begin] = 0
        edges = np.searchsorted(depth, np.arange(1, sizes.max() + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            new, node = best[low[a:b]] + gain[a:b], high[a:b]
            head = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
            top = np.maximum.reduceat(new, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, b - a)))
            wins = np.flatnonzero(new == top[group])
            wins = wins[np.concatenate([[True], group[wins[1:]] != group[wins[:-1]]])]  # of equals the longest piece
            new[wins] = -np.inf
            node = node[head]
            best[node], gap[node], arc[node] = top, top - np.maximum.reduceat(new, head), a + wins
        node, live, margin, steps = begin + sizes, np.arange(len(units)), np.full(len(units), np.inf), []
        score = best[node]
        while len(live):
            took = arc[node]
            margin[live] = np.minimum(margin[live], gap[node])
            steps.append((live, took))
            node = node - length[took]
            more = node > begin[live]
            node, live = node[more], live[more]
        unit, took = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(start[took], kind="stable")
        unit, took = unit[order], took[order]
        n = np.where(ids[took] >= 0, 1, width[start[took]])
        flat = np.repeat(ids[took], n)
        for i, a in zip((np.cumsum(n) - n)[ids[took] < 0].tolist(), start[took][ids[took] < 0].tolist(), strict=True):
            raw = chr(codes[a]).encode("utf-8", "surrogatepass")
            flat[i : i + len(raw)] = [self.bytes[x] for x in raw]
        return flat.astype(np.int32), np.bincount(unit, weights=n, minlength=len(units)).astype(np.int64), score, margin

    def best_of(self, units: list[str]):
        """For distinct units: flat ids, sizes, scores and margins of their best segmentations."""
        short = [k for k, u in enumerate(units) if len(u) <= LONG]
        score, margin, size = np.zeros(len(units)), np.full(len(units), np.inf), np.zeros(len(units), np.int64)
        flat = np.zeros(0, np.int32)
        if short:
            flat, size[short], score[short], margin[short] = self._viterbi([units[k] for k in short])
        if len(short) == len(units):
            return flat, size, score, margin
        long = [k for k, u in enumerate(units) if len(u) > LONG]
        parts = [flat]
        for k in long:
            two = self.n_best(units[k], 2)
            score[k], size[k] = two[0][0], len(two[0][1])
            margin[k] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            parts.append(np.array(two[0][1], np.int32))
        begin = np.zeros(len(units), np.int64)
        begin[short + long] = np.cumsum(size[short + long]) - size[short + long]
        return np.concatenate(parts)[runs(begin, size)], size, score, margin

    def _age(self) -> None:
        """Leaves units in the store that came more than once since the last call; none if those are over half of KNOWN."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > KNOWN // 2:
            return self.forget()
        units, (flat, n) = list(self.place), self._ids(keep)
        self.place = _Numbers((units[k], i) for i, k in enumerate(keep.tolist()))
        self.flat, self.off = flat, np.append(0, np.cumsum(n))
        self.unit_score, self.unit_margin, self.used = self.unit_score[keep], self.unit_margin[keep], np.zeros(len(keep), np.int64)

    def _ids(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after another, and how many each has."""
        n = self.off[seq + 1] - self.off[seq]
        return self.flat[runs(self.off[seq], n)], n

    def cut(self, texts: list[str | None], n: int):
        """For each text: ids of its best segmentation, the n best scores, its units' numbers, and what each further segmentation swaps.

        A swap maps a unit's place in the text to the ids that it has there. Null or empty texts have one empty segmentation.
        """
        if len(self.place) > KNOWN:
            self._age()
        known = len(self.place)
        codes, distinct, edge = units_of(texts)
        number = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[codes]
        if len(self.place) > known:
            flat, size, score, margin = self.best_of(list(islice(self.place, known, None)))
            self.flat, self.off = np.concatenate([self.flat, flat]), np.concatenate([self.off, self.off[-1] + np.cumsum(size)])
            self.unit_score, self.unit_margin = np.concatenate([self.unit_score, score]), np.concatenate([self.unit_margin, margin])
        self.used = np.append(self.used, np.zeros(len(self.place) - known, np.int64)) + np.bincount(number, minlength=len(self.place))
        ids, size = self._ids(number)
        ends = np.append(0, np.cumsum(size))[edge]
        totals, margins = np.append(0, np.cumsum(self.unit_score[number]))[edge], self.unit_margin[number]
        for k in range(len(texts)):
            a, b = edge[k], edge[k + 1]
            total, scores, swaps = float(totals[k + 1] - totals[k]), [], []
            if n > 1 and b > a:
                scores, swaps = self._others(lambda i, a=a: distinct[codes[a + i]], margins[a:b], n)
            yield ids[ends[k] : ends[k + 1]], [total, *(total - c for c in scores)], number[a:b], swaps

    def _others(self, unit: Callable[[int], str], margin: np.ndarray, n: int):
        """Losses of the second to n-th best segmentations of a text, and their swaps; unit gives the unit at a place.

        A unit's margin is the loss of its second best, so the unit itself is searched only where that is among the n.
        """
        near = np.flatnonzero(margin <= np.partition(margin, n - 2)[n - 2]) if len(margin) >= n else np.arange(len(margin))
        near = near[np.argsort(margin[near], kind="stable")[: n - 1]]
        near = near[np.isfinite(margin[near])].tolist()
        second, searched = margin[near].tolist(), {}

        def options(i: int) -> list[tuple[float, list[int]]]:
            if i not in searched:
                searched[i] = self.n_best(unit(near[i]), n)
            return searched[i]

        loss = lambda i, k: (0.0, second[i])[k] if k < 2 else options(i)[0][0] - options(i)[k][0]
        first = (0,) * len(near)
        heap, seen, picks = [(0.0, first)], {first}, []
        while heap:
            cost, pick = heapq.heappop(heap)
            picks.append((cost, pick))
            if len(picks) == n:
                break
            for i, k in enumerate(pick):
                if k == 0 or k + 1 < len(options(i)):
                    nxt = (*pick[:i], k + 1, *pick[i + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (sum(loss(j, c) for j, c in enumerate(nxt)), nxt))
        return [c for c, _ in picks[1:]], [{near[i]: options(i)[k][1] for i, k in enumerate(pick) if k} for _, pick in picks[1:]]

    def encode(self, texts: list[str | None], n: int):
        """For each text its n best segmentations as (score, option), best first, and what expand() needs to read an option."""
        out = []
        for ids, scores, seq, swaps in self.cut(texts, n):
            out.append([(s, o) for s, o in zip(scores, [ids.tolist(), *((seq, swap) for swap in swaps)], strict=True)])
        return out, self

    def decode(self, ids) -> str:
        text = b"".join([self.decoded.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """decode() of every list, null for null: the bytes of all pieces are taken at once, lists of no whole letters are read one by one."""
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.is_known))
        known[known] = self.is_known[ids[known]]
        begin = np.append(0, np.cumsum(known))[np.append(0, np.cumsum(size))]
        ids = ids[known].astype(np.int64)
        ids[begin[:-1][begin[1:] > begin[:-1]]] += len(self.is_known)
        spelled = self.spelled.take(pa.array(ids))
        off, data = (np.frombuffer(b, t) for b, t in zip(spelled.buffers()[1:], (np.int64, np.uint8), strict=True)) if len(ids) else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
        at = off[: len(ids) + 1][begin]
        data = data[: at[-1]]
        try:
            data.tobytes().decode()
            whole = not (data[at[:-1][at[:-1] < at[1:]]] & 0xC0 == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        null = lists.is_null().to_numpy(zero_copy_only=False)
        if not whole:
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.string())
        valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
        return pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at), pa.py_buffer(data), valid, int(null.sum())).cast(pa.string())


def expand(option, lattice: Lattice) -> list[int]:
    """The ids of one segmentation that encode() gave."""
    if isinstance(option, list):
        return option
    seq, swap = option
    parts, at = [], 0
    for k in sorted(swap):
        parts += [lattice._ids(seq[at:k])[0].tolist(), swap[k]]
        at = k + 1
    return [i for part in (*parts, lattice._ids(seq[at:])[0].tolist()) for i in part]


def swapped(ids: np.ndarray, seq: np.ndarray, swaps: list[dict], lattice: Lattice) -> list[np.ndarray]:
    """The ids of a text's further segmentations, from those of its best one."""
    if not swaps:
        return []
    start, out = np.append(0, np.cumsum(lattice.off[seq + 1] - lattice.off[seq])).tolist(), []
    for swap in swaps:
        parts, at = [], 0
        for k in sorted(swap):
            parts += [ids[at : start[k]], np.array(swap[k], np.int32)]
            at = start[k + 1]
        out.append(np.concatenate([*parts, ids[at:]]))
    return out


def _shared(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(Lattice(model))  # the size of the vocabulary


def _numbers(lists: list[np.ndarray], kind) -> pa.Array:
    """Arrays of numbers as lists."""
    off = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(lists, dtype=kind) if lists else np.zeros(0, kind)))


def _lists(nested: list[list[np.ndarray]]) -> pa.Array:
    off = np.append(0, np.cumsum([len(x) for x in nested])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), _numbers([x for own in nested for x in own], np.int32))


def encode(docs: DataFrame, model: str = MODEL, nbest: int = 4, all_ids: bool = False, text: str = "text") -> DataFrame:
    """Adds ids (array<int>, the best segmentation), n_pieces, piece_score and nbest_scores (falling, up to nbest).

    With all_ids also nbest_ids, the ids of every segmentation. A text is read with one space before it;
    spaces are kept one by one and characters without a piece become bytes, so decode() gives the text back.
    Null and empty texts have no pieces, score 0 and one score. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = _shared(spark, model)

    @F.arrow_udf("struct<ids:array<int>,score:double,scores:array<double>,all:array<array<int>>>")
    def cut(texts: pa.Array) -> pa.Array:
        listed = texts.to_pylist()
        found = [x for a in range(0, len(listed), 400) for x in shared.value.cut(listed[a : a + 400], nbest)]
        ids, scores = [x[0] for x in found], [x[1] for x in found]
        every = _lists([[i, *swapped(i, seq, swaps, shared.value)] for i, _, seq, swaps in found]) if all_ids else pa.nulls(len(found), pa.list_(pa.list_(pa.int32())))
        parts = [_numbers(ids, np.int32), pa.array([x[0] for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), every]
        return pa.StructArray.from_arrays(parts, ["ids", "score", "scores", "all"])

    kept = [c for c in docs.columns if c not in ("ids", "n_pieces", "piece_score", "nbest_scores", "nbest_ids")]
    own = fresh(docs, "_cut")
    out = docs.select(*kept, cut(F.col(text)).alias(own))
    cols = [F.col(f"{own}.ids").alias("ids"), F.size(f"{own}.ids").alias("n_pieces"), F.col(f"{own}.score").alias("piece_score"), F.col(f"{own}.scores").alias("nbest_scores")]
    return out.select(*kept, *cols, *([F.col(f"{own}.all").alias("nbest_ids")] if all_ids else []))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of column ids; null for null, ids that are no piece are left out."""
    spark = rows.sparkSession
    shared = _shared(spark, model)

    @F.arrow_udf("string")
    def read(column: pa.Array) -> pa.Array:
        return shared.value.decode_all(column)

    return rows.withColumn(text, read(F.col(ids)))
