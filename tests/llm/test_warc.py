import base64
import hashlib

from corpusloom.llm.warc import read_archive, write_archive, write_files

SCHEMA = "page_id long, url string, html string, chunk string"
ROWS = [(5, "http://a/é x", "hello"), (3, None, "hello"), (1, "u", None), (2, "u", ""), (9, "u\r\n", "é" * 50), (4, "u", "hello"), (7, "u", "xyz\r\n\r\nWARC/1.1")]


def expected(rows, least):
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", p), p)
    out = set()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and p > first[h or ""]
        out.add((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return out


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "extra") for r in ROWS], SCHEMA)
    for least, chunk in ((0, 7), (4, 1 << 16)):
        archive = write_archive(pages, least, chunk)
        got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archive(archive).collect()}
        assert got == expected(ROWS, least)
    write_files(archive, str(tmp_path), 2)
    raw = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("*.warc")))
    assert raw.count(b"WARC-Type: ") == len(ROWS) and b"hello" in raw


def test_chunks_are_bounded(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 10_000, "")], SCHEMA)
    rows = write_archive(pages, 0, 64).where("chunk > 0").collect()
    assert max(len(r.data) for r in rows) == 64 and sum(len(r.data) for r in rows) == 10_000 + 4


def test_empty_and_repeated(spark):
    assert read_archive(write_archive(spark.createDataFrame([], SCHEMA))).count() == 0
    twice = spark.createDataFrame([(1, "u", "a", "")] * 2 + [(2, "u", "a", "")], SCHEMA)
    assert sorted(r.record_type for r in read_archive(write_archive(twice)).collect()) == ["response", "response", "revisit"]
