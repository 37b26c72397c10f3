import hashlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import skew, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, v int, code string"


def brute_force(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) and the digest, from every part against every entry."""
    kept = [(d, [int(np.floor(256 * x)) for x in e], label) for d, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(d, v + [0] * (parts * width - len(v)), label) for d, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min(range(len(book[p])), key=lambda e: (gap(cut(v, p), book[p][e]), e)) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            own = defaultdict(list)
            for (_, v, _), code in zip(kept, codes):
                own[code[p]].append(cut(v, p))
            for e, x in own.items():
                book[p][e] = [sum(c) // len(x) for c in zip(*x)]
    codes = nearest()
    errors = [sum(gap(cut(v, p), book[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes)]
    of_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        of_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()
    return sorted(((d, "".join(f"{c:02x}" for c in code), e, of_label[label], digest) for (d, _, label), code, e in zip(kept, codes, errors)), key=repr)


def vectors(seed: int, n: int = 400, dims: int = 32, scale: float = 1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * scale + rng.integers(0, 3, size=(n, 1)) * scale
    x[50:90] = x[50]
    rows = [(int(i), [float(y) for y in v], int(i) % 5 or None) for i, v in zip(rng.permutation(n), x)]
    return rows + [(9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")] * dims, 2), (9004, [float("-inf")] * dims, 2), (3, rows[0][1], 3), (None, rows[1][1], 77)]


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.01), (3, 1e5)])
def test_against_brute_force(spark, seed, scale, monkeypatch):
    monkeypatch.setattr(skew, "FEW_KEYS", 2)  # labels meet by broadcast of the hot ones and by shuffle
    monkeypatch.setattr(skew, "HOT_PART", 3)
    rows = vectors(seed, scale=scale)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(df, entries=20, rounds=3)
    got = got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(rows, 16, 20, 3)


def test_lengths_and_small_tables(spark):
    rows = [(1, [0.5] * 20, None), (2, [], None), (3, [1.0, -1.0], 4), (3, [1.0, -1.0], 4), (4, [0.1] * 16, 4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(rows, 16, 64, 2)
    assert vector_codes.compress(df.where("vec_id = 2")).count() == 1
    assert vector_codes.compress(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 16, 1, 1, "x"), (2, [-1e300] * 16, 1, 1, "x")], SCHEMA)
    assert [(r.code, r.error) for r in vector_codes.compress(huge, entries=1, rounds=0).collect()] == [("00" * 16, 0), ("00" * 16, (1 << 63) - 1)]


def test_heaps_pop_what_drift_has_reached_and_little_else():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, size=(3000, 1, 4))
    books = vector_codes.Codebooks(x[:40].transpose(1, 0, 2).astype(object), True)
    codes, slacks = books.scan(x[:, 0], 0)
    popped = []
    for _ in range(6):
        members = {(0, e): (int((codes == e).sum()), [int(s) for s in x[codes == e, 0].sum(axis=0)]) for e in np.unique(codes)}
        books = books.moved(members)
        rows = books.violated(0, codes, slacks)
        popped.append(len(rows))
        codes[rows], slacks[rows] = books.scan(x[rows, 0], 0)
        assert (codes == books.scan(x[:, 0], 0)[0]).all()
    assert popped[-1] < 0.7 * len(x)
