import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_fold_agrees_with_unicode(spark):
    text = "Tranh chấp Quyền SỬ DỤNG đất   Điều\tÉté ǍŘ ñ"
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    assert one(spark, text, T.fold) == " ".join(plain.split())


def test_codes(spark):
    assert one(spark, " 12 / 2024 / qh15 ", T.document_code) == "12/2024/QH15"
    assert one(spark, "so 05 / 2024 / VBHN - VPQH", T.document_code) == "05/2024/VBHN-VPQH"
    # letters that do not decompose are dropped, not folded
    assert one(spark, "291/2025/NĐ-CP", T.document_code) == "291/2025/N-CP"
    assert one(spark, "Đất đai", T.ascii_slug) == "at-ai"
    assert one(spark, "291_2025_ND-CP_679921.docx", T.file_code).startswith("291/2025/ND-CP")


def test_tokens_and_excerpt(spark):
    assert one(spark, "Của người lao động, ĐƯỢC 42 an", T.tokens) == ["lao", "dong"]
    assert one(spark, "a" * 400, T.excerpt) == "a" * 320 + "..."
    assert one(spark, None, T.tokens) is None


def test_whole_words_do_not_overlap(spark):
    row = spark.createDataFrame([("the the the, the",)], "x string")
    marked = T.marked(F.col("x"))
    got = row.select(T.whole_word_count(marked, F.lit("the the")).alias("two"), T.whole_word_count(marked, F.lit("the")).alias("one"), T.whole_word_count(marked, F.lit("th")).alias("part")).first()
    assert (got.two, got.one, got.part) == (1, 4, 0)


def test_sort_fragments(spark):
    assert [one(spark, x, T.digits_padded) for x in ("5", "12a", "1234", "IV", None)] == ["005", "012", "1234", "0IV", "000"]
