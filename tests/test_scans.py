import difflib
import random

import pytest

from corpusloom.operators import scans
from corpusloom.operators.editing import LEXICON


def repaired(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in scans.repair_scans(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("cutoff, lexicon", [(scans.REPAIR_RATIO, tuple(sorted(LEXICON))), (scans.SUGGEST_RATIO, scans.SPELLINGS)])
def test_closest_against_brute_force(spark, cutoff, lexicon):
    r = random.Random(2)
    words = {"", "a", "x" * 50}
    for _ in range(600):
        w = list(r.choice(lexicon))
        for _ in range(r.randint(0, 3)):
            w.insert(r.randint(0, len(w)), r.choice("aeinhgt"))
            if r.random() < 0.6:
                del w[r.randrange(len(w))]
        words.add("".join(w))
    got = {(x.word, x.match, round(x.ratio, 9)) for x in scans.closest(spark.createDataFrame([(w,) for w in words] * 2, "word string"), lexicon, cutoff).collect()}
    want = set()
    for w in words:
        for m in difflib.get_close_matches(w, lexicon, n=1, cutoff=cutoff):
            want.add((w, m, round(difflib.SequenceMatcher(a=m, b=w).ratio(), 9)))
    assert got == want and len(want) > 100


def test_structure(spark):
    text = "DIEU 1 Pham vi dieu chinh Khoan 1 Noi dung khoan mot Diem a Noi dung diem a Diem b Noi dung diem b DIEU 2 Dieu khoan thi hanh"
    lines = repaired(spark, text)[0].split("\n")
    assert lines[0] == "Điều 1. Phạm vi điều chỉnh" and lines[-1] == "Điều 2. Điều khoản thi hành"
    assert {"1. Noi dung khoan mot", "a) Noi dung diem a", "b) Noi dung diem b"} <= set(lines)


def test_confused_letters(spark):
    lines = repaired(spark, "D1EU 1 PHAM V1 D1EU CH1NH KH0AN 1 N01 DUNG D1EM a N01 DUNG D1EM a")[0].split("\n")
    assert lines[0] == "Điều 1. Phạm vi điều chỉnh" and {"1. NOI DUNG", "a) NOI DUNG DIEM a"} <= set(lines)


def test_headings_and_wrapped_lines(spark):
    long = "To chuc, ca nhan nuoc ngoai duoc xet cap phep trong truong hop dac biet khi co du dieu kien"
    lines = repaired(spark, f"CHUONG II QUY DINH CHUNG DIEU 1 Pham vi dieu chinh {long}")[0].split("\n")
    assert lines == ["Chương II QUY ĐỊNH CHUNG", "Điều 1. Phạm vi điều chỉnh", long]


def test_phrases(spark):
    out = repaired(spark, "CHINH PHU CONG HOA XA HOI CHU NGHIA VIET NAM Doc lap Tu do Hanh phuc NGHI DINH SUA DOI BO SUNG MOT SO DIEU CUA NGHI DINH SO 103/2024/ND-CP QUY DINH VE TIEN SU DUNG DAT TIEN THUE DAT CAN CU LUAT DAT DAI SO 31/2024/QH15")[0]
    for phrase in ("CHÍNH PHỦ", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Độc lập - Tự do - Hạnh phúc", "NGHỊ ĐỊNH", "Căn cứ Luật Đất đai số 31/2024/QH15"):
        assert phrase in out
    assert "quy dinh ve tien su dung dat tien thue dat" in scans._folded(out)


def test_leftmost_longest(spark):
    table = dict(scans.PHRASES)
    r = random.Random(5)
    pool = sorted({w for p in table for w in p.split()}) + ["khac", "nam"]
    texts = [" ".join(r.choices(pool, k=25)) for _ in range(40)] + [" ".join(r.choices(list(table), k=6)) for _ in range(40)] + ["", "?!", "sua   doi, (bo sung)"]

    def brute(text):
        words, out, i = [w for w in text.replace(",", " ").replace("(", " ").replace(")", " ").split() if w.isalnum()], [], 0
        while i < len(words):
            n = next((n for n in range(9, 0, -1) if " ".join(words[i : i + n]) in table and i + n <= len(words)), 0)
            out.append(table[" ".join(words[i : i + n])] if n else words[i])
            i += n or 1
        return " ".join(out) or text

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [x.y for x in df.select(scans.restored(df.t).alias("y")).collect()]
    assert got == [brute(t) for t in texts]


def test_lines_that_go_on(spark):
    rows = [(["Phần", "Một hai ba bốn năm sáu"],), (["Điều 3", "Quyền Và Nghĩa Vụ", "Của Ai"],), (["Ngắn thôi", "5 người", "Xong."],), (["Dòng này dài hơn năm từ nhiều", "Tiếp theo sau đó"],), ([],)]
    df = spark.createDataFrame(rows, "lines array<string>")
    joints = df.selectExpr("lines").select(scans._joints(scans.F.transform("lines", scans._line_flags)).alias("j")).collect()
    assert [r.j for r in joints] == [["", " "], ["", ". ", "\n"], ["", "\n", "\n"], ["", "\n"], []]


def test_preview(spark):
    df = spark.createDataFrame([(1, "D1EU 1 PHAM V1 D1EU CH1NH KH0AN 1 N01 DUNG"), (2, None), (3, "nothing to see here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in scans.preview_corrections(df).collect()}
    assert rows[1].corrected.split("\n")[0] == "Điều 1. Phạm vi điều chỉnh" and rows[1].review_required and rows[1].changed_tokens >= 2
    assert {s.reason for s in rows[1].suggestions} & {"ocr_confusable_character", "legal_heading_accent"}
    assert rows[1].corrected.split("\n")[1] == "1. NỘI DỤNG"
    assert not rows[2].review_required and rows[2].corrected == "" and rows[2].suggestions == []


def test_empty(spark):
    assert repaired(spark, None, "", "  \n ") == ["", "", ""]
    assert scans.preview_corrections(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    from corpusloom.functions.text import tokens
    from corpusloom.plans.scan_queries import lexicon_matches

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.w for r in docs.select(scans.F.explode(tokens(docs.text, [])).alias("w")).distinct().collect()}
    got = {(r.word, r.match, r.ratio) for r in lexicon_matches(spark, sf).collect()}
    want = {(w, m, round(difflib.SequenceMatcher(a=m, b=w).ratio(), 6)) for w in words for m in difflib.get_close_matches(w, sorted(LEXICON), n=1, cutoff=scans.REPAIR_RATIO)}
    assert got == want
