import base64
import glob
import gzip
import hashlib

import pytest

from causeway.llm import warc


def test_round_trip(spark, tmp_path):
    big = "<p>" + "é😀\r\n\r\nWARC/1.1 " * 5000
    pages = [(5, "http://a/ x", "same"), (2, "http://b", "same"), (9, None, None), (3, "http://c", ""), (7, "http://d", big), (8, "http://e", "same")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    firsts = {}
    for page, _, html in sorted(pages, key=lambda p: p[0]):
        firsts.setdefault(html or "", page)
    for page, _, html in pages:
        raw = (html or "").encode()
        r = got[page]
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = firsts[html or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page else ("revisit", first))
    assert got[5]["url"] == "http://a/%20x"

    path = str(tmp_path / "w")
    warc.write(df, path)
    records = [x for f in glob.glob(path + "/*/*.gz") for x in warc.parse(iter([gzip.open(f).read()]))]
    assert len(records) == 3 * len(pages)
    bodies = [b for h, b in records if h["warc-type"] == "response"]
    assert big.encode() in [b[b.index(b"\r\n\r\n") + 4 :] for b in bodies]
    nested = warc.transactions(warc.read(spark, path, keep_blocks=True)).collect()
    assert len(nested) == len(pages) and all(r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["capture"] for r in nested)


def test_least_bytes_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (1, "u", "abc"), (2, "u", "abc"), (None, "u", "abc")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "revisit", 1)]
    assert {r["record_type"] for r in warc.round_trip(df, least_bytes=4).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_one_id_with_several_payloads(spark):
    pages = [(None, "u", "a"), (None, "u", "bb"), (None, None, "bb"), (None, "", None), (4, "u", "ccc"), (4, "u", "dddd"), (4, "v", "dddd"), (4, "v", "dddd"), (6, "w", "dddd")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = [(p, u, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len(h or "")) for p, u, h in pages]
    assert sorted(((r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"]) for r in got), key=str) == sorted(want, key=str)
    assert [(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"] == [(6, 4)]


def test_archives_of_other_writers(spark, tmp_path, monkeypatch):
    """One member a record, members of several records, no compression; parts smaller than a record."""
    record = lambda k, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-capture:{k}:a:b:response>\r\nContent-Length: {len(body) + 4}\r\n\r\n".encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    bodies = [b"", b"x" * 10, b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 50]
    raw = [record(k, b) for k, b in enumerate(bodies)]
    want = sorted((len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for b in bodies)
    for part in (1 << 20, 7):
        monkeypatch.setattr(warc, "PART", part)
        for data in (b"".join(map(gzip.compress, raw)), gzip.compress(raw[0] + raw[1]) + gzip.compress(raw[2] + raw[3]), b"".join(raw)):
            assert [b[4:] for _, b in warc.parse(warc.inflated(data))] == bodies
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    got = warc.transactions(warc.read(spark, str(tmp_path))).select("response.payload_bytes", "response.payload_digest").collect()
    assert sorted(tuple(r) for r in got) == want
    for cut in (b"".join(map(gzip.compress, raw))[:-20], gzip.compress(raw[3][:-40])):
        with pytest.raises(EOFError):
            list(warc.parse(warc.inflated(cut)))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((100, 9), (1000, 6), (1 << 62, 3)))
    pages = [(k, "u", "x" * n + str(k)) for k, n in enumerate([5] * 7 + [500] * 4 + [5000] * 2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    warc.write(df, str(tmp_path / "w"))
    sizes = sorted(len(gzip.open(f).read()) for f in glob.glob(str(tmp_path / "w/*/*.gz")))
    assert len(sizes) == 3 + 2 + 2 and max(sizes) < 5000 + 1500
    assert warc.round_trip(df).count() == len(pages)
