import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import packing, queries, topk_search, url_filters


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: x[:2], default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    r = random.Random(1)
    parts = ["com", "net", "a", "b", "example", "B"]
    rules = sorted({(".".join(r.choice(parts).lower() for _ in range(r.randint(1, 3))), r.choice(["/", "/en/", "/en/7", "/x"])) for _ in range(30)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http{r.choice('s:')}://".replace(":://", "://") + ".".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "/", "/en/78?q", "/x#y", "?z", "/en"]) for _ in range(400)]
    urls += [None, "", "nohost", "://", "ftp://.com/en/", "http://com./en/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert url_filters.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", " \t ", "A'S <|endoftext|> \x0b\x1c\xa0 ÉÉ ﬁ ΑΣ x", "word " * 9000, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, queries.tokenizer_path(), block_tokens=30_000).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(x)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        # full, or a power of two: no padding at all
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_words_of_the_cache_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    own, whole = packing.WordTokenizer(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    texts = ["Été, été. ÉTÉ! straße; İstanbul, ŉ. ª! ABC, abc abc. x.. it's! don't, 's, 12, a1. ,, .", "İ, ǅ, ﬁ, Ωσς, e\u0301, \u0301, ¿Qué? no: sí;", "", "!", "a"]
    for t in texts * 2:
        assert own.encode(t, 2).tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]


def test_costs_are_balanced():
    r = random.Random(1)
    lengths = [int(min(4096, 30 * r.paretovariate(1))) for _ in range(3000)]
    rows = packing.assign(lengths, 4096, 1.0, 1 / 2048)
    cost, size = {}, {}
    for _, _, n, s, _ in rows:
        cost[s] = cost.get(s, 0) + n + n * n / 2048
        size[s] = size.get(s, 0) + n
    full = [cost[s] for s in cost if size[s] == 4096]
    in_order = [sum(n + n * n / 2048 for n in lengths[i : i + 20]) for i in range(0, 3000, 20)]
    assert np.std(full) / np.mean(full) < 0.5 * np.std(in_order) / np.mean(in_order)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)) + rng.integers(0, 3, size=(700, 1)) * 2
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 6), (5150, [float("inf")] + [0.0] * 5), (5200, []), (5250, [1.0, 2.0]), (5251, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.top_k(df, block=150, query_block=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = np.floor(256 * x).astype(np.int64)
    for i in range(0, 700, 50):
        scores = q @ q[i]
        best = sorted((int(-s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert sorted(got.pop(i)) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)], i
    assert got == {5250: [(1, 5251, 256 * 768 + 512 * 256)]}
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_tells_rows_apart(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [9.0, 0.5]), (0, [1.0, 1.0]), (None, [2.0, 0.0]), (None, None), (2, [2.0, 0.0]), (2, [2.0, 0.0])]
    got = topk_search.top_k(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, query int"), k=4).collect()
    want = []
    for i in (0, 3):
        dots = [(-sum(int(256 * a) * int(256 * b) for a, b in zip(v, rows[i][1])), d is None, d or 0, d) for j, (d, v) in enumerate(rows) if v is not None and j != i]
        want += [(0, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(dots, key=lambda x: x[:3])[:4])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_query_keeps_every_page(spark):
    got = queries.op7_url_filter_sweep(spark, "/root/testdata/sf0.01")
    assert got.count() == 250 and got.where(F.col("verdict") == "block").count() > 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    urls = ("http://a.net/de/1", "http://net/de/x", "http://example.net/de/8", "http://x.example.net/de/7", "http://com/en/1", "http://a.example.com/en/7", "http://b.org/es/", "http://b.org/en/")
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.rule, x.verdict) for x in queries.op7_url_filter_sweep(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow"),
    ]
