import random

from pyspark.sql import functions as F

from corpusloom.operators import graph, ordering, retrieval, structure
from corpusloom.sources import files


def walked(starts, edges, depth):
    ways = {}
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)
    out = set()
    for root in {r for r, _ in starts}:
        seen = {n: 0 for r, n in starts if r == root}
        front = set(seen)
        for d in range(1, depth + 1):
            front = {b for a in front for b in ways.get(a, ())} - set(seen)
            seen |= dict.fromkeys(front, d)
        out |= {(root, n, d) for n, d in seen.items()}
    return out


def test_traversal_against_brute_force(spark):
    r = random.Random(6)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(130)] + [(7, i) for i in range(60)] + [(5, 5)]
    starts = [(i, i) for i in range(0, 120, 9)] + [(9, 7), (200, 500)]
    e = spark.createDataFrame(edges, "src long, dst long")
    s = spark.createDataFrame(starts, "root_id long, node_id long")
    for depth in (1, 3):
        got = graph.traverse(s, e, depth, hub=5)
        assert {tuple(x) for x in got.collect()} == walked(starts, edges, depth)
    assert graph.traverse(s, e, 9, most=2).agg(F.max("depth")).first()[0] == 2
    assert graph.traverse(s.limit(0), e, 2).count() == 0 and graph.traverse(s, e.limit(0), 3).count() == len(starts)
    near = {tuple(x) for x in graph.edges_near(got, e, 3).collect()}
    inner = {(root, n) for root, n, d in walked(starts, edges, 3) if d < 3}
    assert near == {(root, a, b) for root, n in inner for a, b in edges if n in (a, b)}
    inside = {tuple(x) for x in graph.edges_inside(got, e).collect()}
    nodes = {(root, n) for root, n, _ in walked(starts, edges, 3)}
    assert inside == {(root, a, b) for root in {r for r, _ in starts} for a, b in edges if (root, a) in nodes and (root, b) in nodes}


def test_concept_graph_goes_several_steps(spark):
    edges = [("investor", "procedure", "REQUIRES_PROCEDURE", True), ("procedure", "company", "CREATES_ENTITY", True), ("company", "land", "ENABLES_RIGHT", True), ("land", "tax", "X", False), ("land", "investor", "SEEKS", True)]
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string, is_active boolean")
    roots = spark.createDataFrame([(1, "investor"), (2, "tax")], "query_id long, concept_id string")
    links = spark.createDataFrame([("company", 5, True), ("land", 6, False)], "concept_id string, document_id long, is_active boolean")
    nodes, kept, anchors = graph.concept_graph(roots, e, links, 3)
    assert {(n.query_id, n.node_id, n.depth) for n in nodes.collect()} == {(1, "investor", 0), (1, "procedure", 1), (1, "land", 1), (1, "company", 2), (2, "tax", 0)}
    assert {x.edge_type for x in kept.collect()} == {"REQUIRES_PROCEDURE", "CREATES_ENTITY", "ENABLES_RIGHT", "SEEKS"}
    assert [(a.query_id, a.concept_id, a.document_id) for a in anchors.collect()] == [(1, "company", 5)]
    one = lambda inside: {x.edge_type for x in graph.concept_graph(roots, e, links, 1, inside)[1].collect()}
    assert one(False) == {"REQUIRES_PROCEDURE", "SEEKS"} and one(True) == {"REQUIRES_PROCEDURE", "SEEKS"}


def test_positions_and_pages(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["b", "a", None, "é", "e", "E"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x string").repartition(5)
    placed = ordering.positions(df, F.asc_nulls_last("x"), F.desc("id"))
    want = {i: n for n, (i, x) in enumerate(sorted(rows, key=lambda t: (t[1] is None, (t[1] or "").encode(), -t[0])), 1)}
    assert {x.id: x.place for x in placed.collect()} == want
    assert not [line for line in placed._jdf.queryExecution().toString().split("\n") if "Window" in line]
    assert sorted(x.place for x in ordering.page(df, 9, 60, F.col("id")).collect()) == list(range(481, 501))
    assert sorted(x.place for x in ordering.page(df, 99, 60, F.col("id")).collect()) == list(range(481, 501))
    assert ordering.page(df.limit(0), 1, 10, F.col("id")).count() == 0


def test_natural_order(spark):
    titles = ["Điều 10", "điều 9", "Dieu 9", "Zebra", "état", "Etat 2", "Étage", "a1", "a01", "a2", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", ordering.natural_key(F.col("t")).alias("k"))
    got = [r.t for r in df.orderBy("k", "t").collect()]
    assert got == [None, "a01", "a1", "a2", "Dieu 9", "điều 9", "Điều 10", "Étage", "état", "Etat 2", "Zebra"]


def test_files_of_so_many_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(23)], "id long, t string").repartition(4)
    files.write_in_parts(df, "id", 10, str(tmp_path / "parts"))
    back = spark.read.json(str(tmp_path / "parts")).collect()
    assert {(r.part, r.id) for r in back} == {(i // 10, i) for i in range(23)}
    assert len(list((tmp_path / "parts").glob("part=*/*.json"))) == 3


def test_similar_vectors_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(90)] + [(90, None), (91, [0.0] * 5), (92, [1.0, 2.0]), (93, [2.0, 4.0])]
    rows += [(100 + i, rows[3][1]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for x in retrieval.top_similar(df, df.where("id % 7 = 0 or id > 89"), 4, block=30).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.id, x.score)

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(max(0.0, sum(x * y for x, y in zip(a, b)) / norm), 6) if norm else 0.0

    for i, v in rows:
        if i % 7 == 0 or i > 89:
            best = sorted((-cosine(v, w), j) for j, w in rows if j != i)[:4]
            assert got[i] == {n: (j, -s if s else 0.0) for n, (s, j) in enumerate(best, 1)}, i


def test_packing_against_a_fold(spark):
    r = random.Random(4)

    def fold(pieces, most=320, target=220):
        done, cur, words, last = [], [], 0, 0
        for n, border in pieces:
            if cur and (words + n > most or words >= target and border):
                done.append(cur)
                cur, words = cur[-1:], last
            cur = [*cur, (n, border)]
            words, last = words + n, n
        return [*done, cur]

    texts, want = [], []
    for i in range(30):
        pieces = [(r.choice([2, 30, 120, 300]), r.random() < 0.3) for _ in range(r.randint(1, 40))]
        texts.append((i, "\n".join(" ".join(["Wort"] * n) + (":" if b else "") for n, b in pieces)))
        want.append([len(c) for c in fold(pieces)])
    rows = structure.fallback_chunks(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    got = [[len(x.content.split("\n")) for x in rows if x.doc_id == i] for i in range(30)]
    assert got == want


def test_concept_graph_meets_one_edge_of_a_type_and_deals_anchors(spark, monkeypatch):
    r = random.Random(5)
    roots = spark.createDataFrame([(i, i % 3) for i in range(60)], "query_id long, concept_id long")
    raw = [(r.randrange(4), r.randrange(4), r.choice("XY"), r.random() < 0.8, i) for i in range(400)]
    e = spark.createDataFrame(raw, "src long, dst long, edge_type string, is_active boolean, edge_id long")
    links = spark.createDataFrame([(i % 4, i, i % 2 == 0) for i in range(200)], "concept_id long, document_id long, is_active boolean")
    best = {}
    for a, b, kind, ok, i in raw:
        if ok:
            best.setdefault((a, b, kind), i)
    monkeypatch.setattr(graph, "ANCHORS_A_TASK", 50, raising=False)
    nodes, kept, anchors = graph.concept_graph(roots, e, links, 1)
    assert not {"edge_id"} - set(kept.columns) and "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    near = {(q, *key, i) for q in range(60) for key, i in best.items() if q % 3 in key[:2]}
    assert sorted(tuple(x) for x in kept.select("query_id", "src", "dst", "edge_type", "edge_id").collect()) == sorted(near)
    met = {(q, c) for q, a, b, _, _ in near for c in (a, b)} | {(q, q % 3) for q in range(60)}
    want = sorted((q, c, d) for q, c in met for d in range(0, 200, 2) if d % 4 == c)
    assert sorted(tuple(x) for x in anchors.select("query_id", "concept_id", "document_id").collect()) == want
