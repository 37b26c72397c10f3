import random
import re
from collections import defaultdict

import pytest

from corpusloom.llm.source_mixing import mix_sources

SCHEMA = "doc_id long, text string, source string"


def goals(sizes: dict, cap: float = 3.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - cap * sum(sizes[s] for s in capped)
        out = {s: cap * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 5)), r.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "zero"), (402, " \t\n", None)]
    rows += [(500 + i, "same text here", "b") for i in range(60)]
    got = {x.doc_id: x for x in mix_sources(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    again = {x.doc_id: x for x in mix_sources(spark, spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got == again and len(got) == len(rows)
    sizes = defaultdict(int)
    for d, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert got[d].size == n and got[d].taken == got[d].copies * n and 0 <= got[d].copies <= 3
        sizes[source] += n
    want = goals(sizes)
    taken = defaultdict(int)
    for d, _, source in rows:
        assert got[d].source_size == sizes[source] and got[d].target == pytest.approx(want[source])
        taken[source] += got[d].taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(0.02 * goal, 3), s
    # tilted rates: of two documents of a source, the mean copies grow or shrink with the size throughout
    assert {s: 3 * n for s, n in sizes.items() if want[s] >= 3 * n} == {s: taken[s] for s, n in sizes.items() if want[s] >= 3 * n}


def test_empty(spark):
    assert mix_sources(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert [x.taken for x in mix_sources(spark, spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [0]
