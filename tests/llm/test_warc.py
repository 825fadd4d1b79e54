"""The archive: kinds of records, exact round trips, broken bytes."""

import gzip
import hashlib
from glob import glob

import pytest

from oddledger.llm import warc
from tests.oracle import compare, connection
from oddledger.llm.sql import SQL

BIG, OTHER = "<p>" + "é" * 600, "x" * 1000
PAGES = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (9, None, BIG),
    (3, "http://a/3", OTHER),
    (4, "http://a/4", "y" * 999),
    (5, "http://a/5", "y" * 999),
    (6, "http://a/6\r\nX: 1", None),
    (7, "", ""),
    (8, "http://a/8", "line\r\n\r\nWARC/1.1\r\n" + OTHER),
]


def test_kinds_and_digests(spark, pages):
    archive = warc.write(pages(PAGES))
    got = {r["page_id"]: r for r in warc.index(archive, spark).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        again = i in (1, 2)
        assert got[i]["record_type"] == ("revisit" if again else "response")
        assert got[i]["refers_to"] == (9 if again else None)
    # each payload is stored once
    assert archive.read_payloads(spark).count() == len({html or "" for _, _, html in PAGES})


def test_records_come_back_exactly(spark, pages):
    archive = warc.write(pages(PAGES))
    want = {i: (html or "").encode() for i, _, html in PAGES}
    for r in warc.records(archive, spark).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert rest[size:] == b"\r\n\r\n" and rest[:size] == (b"" if r["record_type"] == "revisit" else want[r["page_id"]])
        assert bytes(r["payload"]) == want[r["page_id"]]
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(want[r["page_id"]]).hexdigest().encode()


def test_export(spark, pages, tmp_path):
    archive = warc.write(pages(PAGES))
    folder = str(tmp_path / "warc")
    warc.export(archive, spark, folder)
    data = b"".join(gzip.open(f).read() for f in glob(f"{folder}/*.gz"))
    assert data.count(b"WARC-Record-ID") == len(PAGES) and BIG.encode() in data


def test_missing_ids_repeated_rows_and_empty(spark, pages):
    rows = [(None, "u", BIG), (None, "u", BIG), (2, "u", BIG), (2, "u", BIG), (None, "v", OTHER), (None, None, None)]
    got = warc.index(warc.write(pages(rows)), spark).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] > 1100)
    assert kinds == [("2", "response", None)] * 2 + [("None", "revisit", 2)] * 2
    assert {r["record_type"] for r in got if r["payload_bytes"] <= 1100} == {"response"}
    assert warc.index(warc.write(pages([])), spark).count() == 0


def test_changed_bytes_are_found(spark, pages):
    archive = warc.write(pages(PAGES[:3]))
    stored = archive.read_payloads(spark).collect()[0]
    broken = warc.Archive(archive.records, archive.payloads + "-broken")
    spark.createDataFrame(
        [(stored["address"], bytearray(b"other"))], "address binary, payload binary"
    ).write.parquet(broken.payloads)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.index(broken, spark).collect()


def test_sql_on_copies(spark, pages, tmp_path):
    import duckdb

    path = str(tmp_path / "pages.parquet")
    pages(PAGES).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    ok, message = compare(
        spark, con, "op10", lambda s, f: warc.index(warc.write(s.read.parquet(path)), s), SQL["op10_archive"], ""
    )
    assert ok, message
    assert connection is not None
