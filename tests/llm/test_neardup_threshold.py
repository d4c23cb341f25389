"""The threshold of near duplicates is a parameter, and of a component one row stays."""

import random

import pytest

from pulsegrid.llm import neardup
from pulsegrid.llm.neardup import deduplicate, least_estimate, near_duplicates
from tests.llm.test_neardup import plain_set


def brute(docs, similar):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both and 100 * both >= similar * (len(x) + len(y) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def graded(seed):
    """Texts with copies of which 1 to 7 words in 150 are new: similarities from 0.6 to 0.95."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(150)]
        texts.append(base)
        for n in range(1, 8):
            copy = list(base)
            for at in r.sample(range(len(copy)), n):
                copy[at] = word()
            texts.append(copy)
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [50, 3])
def test_threshold_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    docs = graded(1)
    expected = brute(docs, 80)
    assert expected != brute(docs, 85)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if hot == 3:
        assert sorted(tuple(r) for r in near_duplicates(df, 80).collect()) == expected
    else:
        assert sorted(r.doc_id for r in deduplicate(df, 80).collect()) == [d for d, _, _, kept in expected if kept]


def test_one_row_of_a_component_whose_least_id_repeats(spark):
    """Near texts under one doc_id are one component; unlike texts under one doc_id are two, and both stay."""
    words = [f"a{i}" for i in range(100)]
    near, other = " ".join([*words[:-1], "new"]), " ".join(f"b{i}" for i in range(100))
    docs = [(1, " ".join(words)), (1, near), (1, other), (2, near), (3, other), (4, ""), (4, "")]
    found = sorted((r.doc_id, r.text) for r in deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert len(found) == 4 and {d for d, _ in found} == {1, 4}
    assert (1, other) in found and found[:2] == [x for x in found if x[0] == 1]


def test_least_estimate():
    assert 35 / 64 < least_estimate(85) < 36 / 64 and least_estimate(80) == pytest.approx(0.475)
