import hashlib

import pytest
from stagelens.llm import warc as W

SCHEMA = "page_id long, url string, html string, first string, digest string"


def test_table(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://b", big, "", ""), (3, "http://a b", big, "", ""), (9, None, big, "", ""), (1, "u", "tiny", "", ""), (2, "u", "tiny", "", ""), (7, "u", None, None, None), (3, "http://a b", big, "", ""), (None, "n", big, "", ""), (8, "v", "é" * 60, "", "")]
    got = W.read(W.write(spark.createDataFrame(rows, SCHEMA))).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("5", "revisit", 3), ("3", "response", None), ("9", "revisit", 3), ("1", "response", None), ("2", "response", None), ("7", "response", None), ("3", "response", None), ("None", "revisit", 3), ("8", "response", None)])
    by = {r.page_id: r for r in got}
    assert by[9].payload_digest == hashlib.sha256(big.encode()).hexdigest() and by[9].payload_bytes == len(big) and bytes(by[9].payload) == b""
    assert by[8].payload_bytes == 120 and by[7].payload_bytes == 0 and bytes(by[3].payload) == big.encode()


def test_empty_table(spark):
    assert W.read(W.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_dictionary_is_in_the_leading_frame():
    pages = [f"<html><body><p>page {i} of the same site with the same frame</p></body></html>".encode() * 3 for i in range(300)]
    dictionary = W.train_dictionary(pages)
    w = W.Writer(dictionary)
    for i, p in enumerate(pages):
        w.add(W.record("response", i, "u", p, hashlib.sha256(p).hexdigest(), len(p), None))
    data = w.close()
    assert dictionary and data[:4] == W.DICTIONARY_MAGIC and data[8 : 8 + len(dictionary)] == dictionary
    assert [b for _, b in W.read_archive(data)] == pages
    with pytest.raises(ValueError, match="damaged|cut off"):
        list(W.read_archive(data[:-3]))


@pytest.mark.parametrize(("old", "new", "message"), [(b"Content-Length: 3", b"Content-Length: 4", "length"), (b"WARC-Date", b"WARC-Dote", "missing"), (b"abc", b"abd", "digest"), (b"WARC/1.1", b"WARC/9.9", "no WARC"), (b"WARC-Date: ", b"WARC-Type: ", "repeated")])
def test_damaged_records(old, new, message):
    w = W.Writer(b"")
    good = W.record("response", 1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None)
    w.add(good.replace(old, new))
    with pytest.raises(ValueError, match=message):
        list(W.read_archive(w.close()))
