import re

import numpy as np

from corpusloom.llm import words


def test_spans_agree_with_the_pattern(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 16)
    texts = ["", " a\tbc\n", None, "x" * 100, "é  \x0b\x0cé \x1c\xa0z", "last one"]
    (begin, run), = words.groups(texts)
    w = words.words_of(run)
    data = b"\n".join([*run, b""])
    got = [[data[a:b] for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert begin == 0 and got == want
    flat = [x for doc in got for x in doc]
    assert len({*zip(flat, w.hashes.tolist())}) == len(set(flat)) == len(set(w.hashes.tolist()))


def test_windows():
    h = np.array([1, 2, 3, 1, 2], dtype=np.uint64)
    pairs = words.windows(h, 2)
    assert len(pairs) == 4 and pairs[0] == pairs[3] and len(set(pairs.tolist())) == 3
    assert len(words.windows(h, 6)) == 0


def test_long_runs_of_texts_take_little_memory():
    import tracemalloc

    from corpusloom.llm.jaccard_join import shingle_sets

    texts = [" ".join(f"w{i * j % 997}" for i in range(500)) for j in range(1, 3000)]
    list(shingle_sets(texts[:1], 5))
    tracemalloc.start()
    for _ in shingle_sets(texts, 5):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
