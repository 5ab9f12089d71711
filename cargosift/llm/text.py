"""Words and shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 19
STEM = U(0x5851F42D4C957F2D)  # tells the hash of a stem from that of the word
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of h over the whole word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        for key, base in (("p", _P), ("i", _PI)):
            t = np.full(max(n, _CHUNK + 4096), base, U)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["p"], _tables["i"]


def _hash_chunk(buf: np.ndarray, table: np.ndarray, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word hashes and hashes of stems (words of more than stem characters cut there; else zero) of a byte buffer."""
    inside = table[buf]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * p[: len(buf)], out=total[1:])
    whole = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U))
    cut = np.zeros(0, U)
    if stem:
        first = (buf & 0xC0) != 0x80  # bytes that begin a character
        number, place = np.cumsum(first), np.flatnonzero(first)
        cut = np.zeros(len(starts), U)
        long = np.flatnonzero(number[ends - 1] - number[starts] + 1 > stem)
        a = starts[long]
        b = place[number[a] - 1 + stem]
        cut[long] = mix(mix((total[b] - total[a]) * inv[a] + (b - a).astype(U)) ^ STEM)
    return starts, whole, cut


class Slots:
    """Places of distinct hashes in an array, by a few tables of their bits."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys))
        while len(left):  # a key whose slot is taken lies in a later table, by other bits
            slot = self._slot(keys[left], len(self.tables))
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, h: np.ndarray, n: int) -> np.ndarray:
        return (h >> U(self.BITS * n % 44) & U((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for those that are no key."""
        if not self.tables:
            return np.full(len(h), -1)
        at = self.tables[0][self._slot(h, 0)]
        wrong = self.keys[at] != h
        ask = np.flatnonzero(wrong & (at >= 0))
        at[wrong] = -1
        for n, table in enumerate(self.tables[1:], 1):
            if len(ask):
                k = table[self._slot(h[ask], n)]
                hit = self.keys[k] == h[ask]
                at[ask[hit]] = k[hit]
                ask = ask[~hit & (k >= 0)]
        return at


def word_hashes(texts: list[str | None], punctuation: bool = True, ascii_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and len(texts) + 1 offsets into them. Nulls have no words.

    punctuation: words run from white space to white space; else over letters, digits, _ and all of
    non-ASCII. ascii_case: only A-Z go to lower case. Long texts are hashed in pieces cut at word ends.
    """
    return word_and_stem_hashes(texts, 0, punctuation, ascii_case)[::2]


def word_and_stem_hashes(texts: list[str | None], stem: int, punctuation: bool = True, ascii_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() with the hash of each word's first stem characters between, zero where it has no more (none at all if stem is 0)."""
    table = _SPACE if punctuation else _ALNUM
    enc = [b"" if t is None else (t.encode("utf-8", "surrogatepass").lower() if ascii_case else t.lower().encode("utf-8", "surrogatepass")) for t in texts]
    found: list[np.ndarray] = []
    cuts: list[np.ndarray] = []
    counts = np.zeros(len(enc), np.int64)
    i = 0
    while i < len(enc):
        j, size = i, 0
        while j < len(enc) and (j == i or size + len(enc[j]) < _CHUNK):
            size += len(enc[j]) + 1
            j += 1
        if j == i + 1 and size > _CHUNK:
            raw, at = np.frombuffer(enc[i], np.uint8), 0
            while at < len(raw):
                end = min(len(raw), at + _CHUNK)
                if end < len(raw):
                    while end > at and table[raw[end - 1]]:
                        end -= 1
                    if end == at:  # one word longer than a chunk
                        end = min(len(raw), at + _CHUNK)
                        while end < len(raw) and table[raw[end]]:
                            end += 1
                _, h, cut = _hash_chunk(raw[at:end], table, stem)
                found.append(h)
                cuts.append(cut)
                counts[i] += len(h)
                at = end
        else:
            starts, h, cut = _hash_chunk(np.frombuffer(b" ".join(enc[i:j]) + b" ", np.uint8), table, stem)
            begin = np.cumsum([0, *(len(e) + 1 for e in enc[i:j])])
            found.append(h)
            cuts.append(cut)
            counts[i:j] = np.diff(np.searchsorted(starts, begin))
        i = j
    whole, cut = (np.concatenate(x) if x else np.zeros(0, U) for x in (found, cuts))
    return whole, cut, np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words inside each text; a text of fewer words has one run, the whole of it."""
    n = np.diff(offsets)
    full = np.maximum(n - size + 1, 0)
    out_n = np.where(n == 0, 0, np.maximum(full, 1))
    out_off = np.concatenate([[0], np.cumsum(out_n)])
    starts = np.repeat(offsets[:-1] - out_off[:-1], out_n) + np.arange(out_off[-1])
    length = np.repeat(np.minimum(n, size), out_n)
    h = length.astype(U)
    padded = np.concatenate([words, np.zeros(size, U)])
    for k in range(size):
        h = np.where(k < length, mix(h * U(0xD6E8FEB86659FD93) + padded[starts + k]), h)
    return h, out_off


def distinct_per_text(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def constants(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def sequence_keys(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order; zero for a text without words."""
    n = np.diff(offsets)
    out = np.zeros(len(n), U)
    some = np.flatnonzero(n)
    if len(some):
        at = np.arange(len(words)) - np.repeat(offsets[:-1], n)
        out[some] = mix(np.add.reduceat(mix(words + constants(int(n.max()))[at]), offsets[:-1][some]) + n[some].astype(U))
    return out


def minima(h: np.ndarray, offsets: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One hash for each text and band, of the least of rows permutations; no text is empty."""
    mul, add = constants(n_bands * rows) | U(1), constants(2 * n_bands * rows)[n_bands * rows :]
    out = np.zeros((len(offsets) - 1, n_bands), U)
    for b in range(n_bands):
        total = np.full(len(out), b + 1, U)
        for r in range(b * rows, (b + 1) * rows):
            total = mix(total * U(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix(h * mul[r] + add[r]), offsets[:-1]))
        out[:, b] = total
    return out
