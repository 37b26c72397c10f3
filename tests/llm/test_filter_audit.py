import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from corpusloom.llm import filter_audit, skew

SCHEMA = "doc_id long, text string, lang string, fails int, good int, part string"


def failures(rows):
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d,
        }


def brute_force(rows, labels):
    marks = defaultdict(lambda: [0, 0])
    for d, quality, toxic in labels:
        marks[d][0] |= quality == 1
        marks[d][1] |= toxic == 1
    fails = list(failures(rows))
    parts = {lang or "" for _, _, lang, *_ in rows}
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        counts = defaultdict(Counter)
        for (d, _, lang, *_), fail in zip(rows, fails):
            gone = False
            for i, f in enumerate(order, 1):
                c = counts[lang or "", i]
                c["redundant"] += fail[f] and gone
                c["unique"] += fail[f] and sum(fail.values()) == 1
                if fail[f] and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good"] += d is not None and marks[d][0]
                    c["toxic"] += d is not None and marks[d][1]
                c["kept"] += not gone
        for part in parts:
            for i, f in enumerate(order, 1):
                c = counts[part, i]
                out[part, "".join(order), i] = (c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"])
                shapley[part, f] += c["removed"]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW_KEYS", 2)
    monkeypatch.setattr(skew, "HOT_PART", 5)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["LOUD", "#tag", "50%", "é|", "A"]
    texts = [" ".join(r.choices(vocabulary, weights=[4] * 400 + [r.choice([0, 90])] * 5, k=r.choice([0, 5, 99, 100, 130]))) for _ in range(60)]
    texts += ["x " * 99 + "x", "\t \n", "", None, "ÄÖ " * 60, "A" * 11 + "é" * 99, "A" * 10 + "b" * 90, "long " * 30_000, "\x1c\x85 a"]
    rows = [(i, r.choice(texts), r.choice(["en", "de", "", None]), 1, 1, "x") for i in range(300)]
    rows += [(i, texts[0], "en", 1, 1, "x") for i in range(500, 700)]
    rows += [(None, texts[0], "en", 0, 0, "y"), (None, texts[1], None, 0, 0, "y"), rows[5], rows[5]]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 700, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(x) for x in filter_audit.audit_filters(docs, marks).collect()]
    assert len(got) == 3 * 600 and set(got) == brute_force(rows, labels)
    # no labels at all, then no documents
    assert set(map(tuple, filter_audit.audit_filters(docs, marks.limit(0)).collect())) == brute_force(rows, [])
    assert filter_audit.audit_filters(docs.limit(0), marks).count() == 0
