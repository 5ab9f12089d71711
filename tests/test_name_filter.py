"""A batch of names is held against a whole list at once; only names that may match are compared one by one."""

import random

import pyarrow as pa
import pytest

from cargosift.operators import matching as M

LISTED = ["blocked industries ltd", "blocked industries", "sanctioned holding corp", "sanctioned holdings", "prohibited trading company", "émile co", "ab cd ab"]


def test_names_unlike_any_are_not_compared():
    index = M.NameIndex(LISTED, 0.8)
    assert not index.likely(pa.array([f"customer {i:09d}" for i in range(5000)] + ["ltd blockade"])).any()


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_every_match_is_likely(threshold):
    rng = random.Random(5)
    words = "blocked industries ltd limited sanctioned holding corp holdings prohibited trading company co ab cd émile x".split()

    def name() -> str:
        letters = list(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))))
        for _ in range(rng.randint(0, 4) if letters else 0):
            i = rng.randrange(len(letters) + 1)
            letters[i : i + 1] = rng.choice(["", "q", "e", " "])
        return "".join(letters)

    names = [name() for _ in range(2000)]
    for listed in (LISTED, LISTED + [""], [], [f"name {i}" for i in range(300)]):
        index = M.NameIndex(listed, threshold)
        likely = index.likely(pa.array(["none", *names]).slice(1))
        assert len(likely) == len(names) and not [n for n, own in zip(names, likely, strict=True) if not own and index.best(n) is not None]
