from corpusloom.operators import structure


def provisions(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return structure.parse_provisions(df).orderBy("seq").collect()


def test_hierarchy(spark):
    text = "Chương I\nNHỮNG QUY ĐỊNH CHUNG\nĐiều 5. Phạm vi điều chỉnh\n1. Khoản một\na) Điểm a\nb) Điểm b\n2. Khoản hai"
    rows = provisions(spark, text)
    assert [r.provision_level for r in rows] == ["article", "clause", "point", "point", "clause"]
    assert rows[3].sort_key == "005.001.002"
    assert rows[3].parent_seq == 2
    assert rows[0].chapter == "Chương I NHỮNG QUY ĐỊNH CHUNG"


def test_parents_and_labels(spark):
    rows = provisions(spark, "Điều 12\n1. Nội dung\na) Điểm a")
    assert [r.parent_seq for r in rows] == [None, 1, 2]
    assert rows[2].citation_label == "Điều 12 Khoản 1 Điểm a"


def test_inline_content(spark):
    rows = provisions(spark, "Điều 7. Căn cứ khoản 1 Điều 2 của Nghị định này.")
    assert len(rows) == 1 and "Căn cứ khoản 1 Điều 2" in rows[0].content


def test_damaged_prefixes(spark):
    rows = provisions(spark, "Chuong I\nNHUNG QUY DINH CHUNG\nieu 1. Pham vi dieu chinh\n1. Noi dung khoan mot\niem a Quyen cua ca nhan")
    assert rows[0].heading == "Điều 1. Pham vi dieu chinh"
    assert [r.citation_label for r in rows] == ["Điều 1", "Điều 1 Khoản 1", "Điều 1 Khoản 1 Điểm a"]


def test_roman_and_outline(spark):
    rows = provisions(spark, "I. Mot\n1. Hai\n1.1. Ba\n1.2. Bon\nII. Nam\n2. Sau")
    assert [r.provision_level for r in rows] == ["article", "clause", "clause", "clause", "article", "clause"]
    assert [r.clause_number for r in rows][1:3] == ["1", "1.1"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "Lời mở đầu\nĐiều 1. Tên\nLời dẫn\n1. Một\na) A\n2. Hai"), (2, "one two. three"), (3, ""), (4, None)], "doc_id long, text string")
    rows = structure.build_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert [r.section_title for r in rows if r.doc_id == 1] == ["Lời mở đầu", "Điều 1. Tên", "Điều 1 | Khoản 1 | Điểm a", "Điều 1 | Khoản 2"]
    assert [r.content for r in rows if r.doc_id == 1][2] == "Điều 1. Tên\n1. Một\na) A"
    assert [(r.doc_id, r.strategy) for r in rows if r.doc_id > 1] == [(2, "fallback")]


def test_fallback_packs_and_overlaps(spark):
    lines = [" ".join(["w"] * 150) + f" {i}" for i in range(5)] + [" ".join(["x"] * 700)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    chunks = [r.content.split("\n") for r in structure.fallback_chunks(docs).orderBy("chunk_index").collect()]
    assert all(a[-1] == b[0] for a, b in zip(chunks, chunks[1:]))
    seen = [x for c in chunks for x in c]
    assert [x for i, x in enumerate(seen) if i == 0 or x != seen[i - 1]][:5] == lines[:5]


def test_diagnostics(spark):
    docs = spark.createDataFrame([(1, "Điều 1. A\n1. B\na) C"), (2, "plain")], "doc_id long, text string")
    rows = {r.doc_id: r for r in structure.structure_diagnostics(docs, structure.parse_provisions(docs)).collect()}
    assert (rows[1].score, rows[1].label, rows[1].status) == (75.0, "medium", "parsed")
    assert rows[2].status == "failed"
