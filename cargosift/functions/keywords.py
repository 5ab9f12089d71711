"""Long keyword lists: all keywords at once by an automaton that each Python worker builds once, in time linear in the text."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHAINED = 64  # keywords up to which expressions test them one by one, without a Python worker

_built: dict[tuple, ahocorasick.Automaton] = {}  # of this Python worker


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds words by their first place in the list."""
    key = (len(words), hash(words))
    if key not in _built:
        if len(_built) > 8:
            _built.clear()
        found = ahocorasick.Automaton()
        for n, w in reversed(list(enumerate(words))):
            found.add_word(w, n)
        found.make_automaton()
        _built[key] = found
    return _built[key]


def first_of_groups(low: Column, groups: list[dict], kind: str) -> Column:
    """Array of hits (kind), in the order of groups, of each group's first hard keyword that a lower-case text contains."""
    owners: dict[str, list[tuple[int, int]]] = {}
    for g, group in enumerate(groups):
        for n, k in enumerate(k.lower() for k in group["hard_keywords"] if k):
            owners.setdefault(k, []).append((g, n))
    words = tuple(owners)
    of = [owners[w] for w in words]
    heads = [(g["group_id"], g["name"], g["risk_level"]) for g in groups]

    @F.pandas_udf(f"array<{kind}>")
    def hits(texts: pd.Series) -> pd.Series:
        machine, out = _automaton(words), []
        for t in texts:
            best: dict[int, tuple[int, int]] = {}
            for i in {i for _, i in machine.iter(t)} if t else ():
                for g, n in of[i]:
                    best[g] = min(best.get(g, (n, i)), (n, i))
            out.append([dict(zip(("group_id", "group_name", "risk_level"), heads[g], strict=True)) | {"matched_phrase": None, "matched_keyword": words[best[g][1]], "similarity_score": None} for g in sorted(best)])
        return pd.Series(out)

    return hits(low)


_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_words(text: Column, keywords: Iterable[str]) -> Column:
    """Sorted distinct lower-case keywords that occur as whole words: from left to right the first keyword of the list that fits, matches apart."""
    words = tuple(dict.fromkeys(k.translate(_ASCII) for k in keywords if k))

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        machine, out = _automaton(words), []
        part = lambda c: c == "_" or c.isalnum()
        for t in texts:
            if t is None:
                out.append(None)
                continue
            low = t.translate(_ASCII)
            edge = lambda i: (i > 0 and part(low[i - 1])) != (i < len(low) and part(low[i]))  # noqa: E731, B023
            at = sorted((end + 1 - len(words[n]), n, end + 1) for end, n in machine.iter(low))
            own, free = set(), 0
            for start, _, end in at:
                if start >= free and edge(start) and edge(end):
                    own.add(t[start:end].lower())
                    free = end
            out.append(sorted(own))
        return pd.Series(out)

    return found(text)
