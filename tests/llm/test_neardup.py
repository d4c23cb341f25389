import random
import re
from collections import defaultdict

import pytest

from pulsegrid.llm import neardup
from pulsegrid.llm.components import connected_components
from pulsegrid.llm.neardup import near_duplicates, op7_near_duplicates
from tests.llm.fixtures import AWKWARD, awkward, empty, rows


def plain_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(pairs):
    pairs = [(d, t) for d, t in pairs if d is not None]
    sets = [plain_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = defaultdict(int)
    for found in where.values():
        for x in range(len(found)):
            for y in found[:x]:
                seen[y, found[x]] += 1
    for (i, j), both in seen.items():
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(pairs))


def test_whole_table(spark):
    docs = [p for p in rows(spark, "/root/testdata/sf0.01")]
    assert sorted(tuple(r) for r in op7_near_duplicates(spark, "/root/testdata/sf0.01").collect()) == brute(docs)


def test_awkward(spark):
    found = [tuple(r) for r in near_duplicates(awkward(spark)).collect()]
    assert sorted(r for r in found if r[0] is not None) == brute([(d, t) for d, t, _, _ in AWKWARD])
    assert [r[2:] for r in found if r[0] is None] == [(None, True)]
    assert near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("hot,block", [(3, 4), (8, 1000)])
def test_hot_groups(spark, monkeypatch, hot, block):
    """A star of near copies, a chain of truncations, and a passage in many unlike documents, with tiny limits."""
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(0, 6)):
            copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    texts += [base[: 150 - 4 * i] for i in range(25)]
    for i in range(40):
        own = [word() for _ in range(r.choice([5, 20, 60]))]
        texts.append(own[: len(own) // 2] + passage + own[len(own) // 2 :])
    r.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(x) for x in found.collect()) == brute(docs)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 502), (502, 500)]
    found = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {i: 0 for i in range(101)} | {500: 500, 501: 500, 502: 500}
