import random
import re

import pytest

from corpusloom.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id long, text string, n long"


def brute(docs, k=5, percent=80):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    docs = []
    for i in range(160):
        if docs and r.random() < 0.45:
            w = r.choice(docs)[1].split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            w = w[: len(w) - r.randint(0, 8)] or w
        else:
            w = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
            w = w[:20] + passage + w[20:] if r.random() < 0.5 else w
        docs.append((i, " ".join(w)))
    for i in range(160, 220):
        w = docs[3][1].split(" ") if i % 2 else passage[:]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((i, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three")]


@pytest.mark.parametrize("seed, cap", [(1, 16), (2, 4)])
def test_against_brute_force(spark, seed, cap):
    docs = corpus(seed)
    got = jaccard_components(spark, spark.createDataFrame([(*d, 7) for d in docs], SCHEMA), region_cap=cap)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_empty_nulls_and_repeats(spark):
    assert jaccard_components(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(4, text), (4, text), (None, text), (None, "a b c d e f"), (2, text + " z"), (4, "x y z a b c")]
    got = jaccard_components(spark, spark.createDataFrame([(*d, 0) for d in docs], SCHEMA))
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert (4, 56, 2) in rows and (None, 56, 2) in rows and (None, 2, None) in rows and (2, 57, 2) in rows and (4, 2, 4) in rows and len(rows) == 6


def test_nested_sets_of_different_sizes(spark):
    r, docs = random.Random(5), []
    for i in range(60):
        w = [f"p{i}w{j}" for j in range(r.randint(60, 130))]
        n = len(w) - 4
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: -(-n * (80 + i % 9) // 100) + 4]))]
    got = jaccard_components(spark, spark.createDataFrame([(*d, 0) for d in docs], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_id_of_several_texts_links_by_text_not_by_id(spark):
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join(words[:34] + ["x", "y"])
    rows = [(4, a, 0), (4, b, 0), (2, b, 0), (4, a, 0), (7, a, 0)]
    got = sorted(map(tuple, jaccard_components(spark, spark.createDataFrame(rows, SCHEMA)).collect()))
    # 30 shingles of 38 are common: below 0.8
    assert got == sorted([(4, 36, 4), (4, 32, 2), (2, 32, 2), (4, 36, 4), (7, 36, 4)])


def test_random_repeated_ids(spark):
    docs = [(i % 90, t) for i, t in corpus(5)] + corpus(5)[:5]
    got = jaccard_components(spark, spark.createDataFrame([(d, t, 0) for d, t in docs], SCHEMA), region_cap=3, rounds=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_null_ids_never_name_others(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *more: " ".join([*base, *more])
    docs = [(None, near()), (7, near("x")), (9, near("x", "y")), (None, "alone " * 3), (3, "quite different words " * 4), (12, None)]
    got = jaccard_components(spark, spark.createDataFrame([(*d, 1) for d in docs[:3] + docs[4:]], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs[:3] + docs[4:])
    got = jaccard_components(spark, spark.createDataFrame([(*d, 1) for d in docs], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)
