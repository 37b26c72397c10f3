import io
from xml.sax.saxutils import escape
from zipfile import ZipFile

from corpusloom.plans.rollup_queries import docx_bytes
from corpusloom.sources import office


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook with shared, inline and plain cells; None leaves a cell out."""
    strings: list[str] = []
    out = io.BytesIO()
    with ZipFile(out, "w") as z:
        links, names = [], []
        for n, (name, rows) in enumerate(sheets.items(), 1):
            names.append(f'<sheet name="{escape(name)}" sheetId="{n}" xmlns:r="urn:r" r:id="rId{n}"/>')
            links.append(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>')
            body = ""
            for i, row in enumerate(rows, 1):
                cells = ""
                for j, value in enumerate(row):
                    at = f"{chr(65 + j)}{i}"
                    if isinstance(value, int):
                        cells += f'<c r="{at}"><v>{value}</v></c>'
                    elif value is not None and i % 2:
                        strings.append(value)
                        cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
                    elif value is not None:
                        cells += f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
                body += f'<row r="{i}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="urn:s"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="urn:s"><sheets>{"".join(names)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="urn:p">{"".join(links)}</Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="urn:s">' + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")
    return out.getvalue()


def test_paragraphs(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx_bytes(["ieu 5. Một  & <hai>", " ", "Ba"]))
    (tmp_path / "b.docx").write_bytes(docx_bytes(["x"])[:-30])
    name = 'xmlns:w="u"'
    mixed = io.BytesIO()
    with ZipFile(mixed, "w") as z:
        z.writestr("word/document.xml", f"<w:document {name}><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "c.DOCX").write_bytes(mixed.getvalue())
    (tmp_path / "d.docx").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes("Một\r\n\r\nhai".encode())
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    rows = [(r.path[-6], r.pos, r.text) for r in office.docx_paragraphs(files.where("lower(path) like '%.docx'")).collect() if r.error is None]
    assert sorted(rows) == [("a", 0, "Điều 5. Một & <hai>"), ("a", 2, "Ba"), ("c", 0, "a bc")]
    got = {r.path.rpartition("/")[2]: (r.status, r.segments) for r in office.import_files(files).collect()}
    assert got["a.docx"] == ("imported", ["Điều 5. Một & <hai>", "Ba"]) and got["e.txt"] == ("imported", ["Một", "hai"])
    assert all(got[f] == ("failed", []) for f in ("b.docx", "d.docx", "f.txt", "g.pdf")) and got["c.DOCX"][0] == "imported"


def test_workbook(spark):
    head = ["STT", "Category", "Prompt", None, "Expected Output", "Legal Basic"]
    sheets = {
        "Questions_DD": [["Bảng theo dõi"], [None], head, [1, "Temporal", " Câu 1 ", "x", "Đáp 1", "Điều 1; Điều 2"], [2, None, "không đáp"], [3, "Hierarchy / Conflict", "Câu 2", None, "Đáp 2"], [4, "Compliance", "Câu 3", None, "Đ" * 900]],
        "Other": [head, [1, "a", "b", None, "c"]], "Questions_HN": [["no header"], ["x", "y"]],
    }
    files = spark.createDataFrame([("w.xlsx", workbook(sheets)), ("bad.xlsx", b"PK\x03\x04zz")], "path string, content binary")
    rows = office.workbook_rows(files)
    assert [(r.path, r.error is not None) for r in rows.where("sheet is null").collect()] == [("bad.xlsx", True)]
    assert [r.cells for r in rows.where("sheet = 'Questions_DD' and row = 4").collect()] == [["1", "Temporal", " Câu 1 ", "x", "Đáp 1", "Điều 1; Điều 2"]]
    cases = office.benchmark_cases(rows, {"Questions_DD": "dat-dai", "Questions_HN": "hon-nhan-va-gia-dinh"}).orderBy("case_id").collect()
    assert [(c.case_id, c.query, c.expected_intent, c.expected_complexity, c.must_escalate) for c in cases] == [
        ("LAND-XLSX-001", "Câu 1", "legal_qa", "high", False), ("LAND-XLSX-002", "Câu 2", "conflict_check", "high", False), ("LAND-XLSX-003", "Câu 3", "legal_qa", "high", True),
    ]
    assert cases[0].legal_basis_text == "Điều 1; Điều 2" and len(cases[2].expected_answer_excerpt) == 700
    assert office.benchmark_cases(rows, {"Questions_DD": "hon-nhan-va-gia-dinh"}, most=1).collect()[0].case_id == "FAMILY-XLSX-001"
