"""WARC archives: round trips of whole payloads through chunk rows, hot groups, oversized records, edge rows."""

import gzip
from base64 import b32encode
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch
from crossmarket.llm.warc import archived_pages, chunk_table, read_archives, roles, write_archives

SCHEMA = "page_id bigint, url string, html string, record bigint, chunk int, data string, last boolean, key string"
BIG = "".join(chr(97 + i * i % 26) + "é\r\n"[i % 4:] for i in range(60_000))
PAGES = ([(i, f"http://a.b/{i}?x=1 2\n", f"<p>page {i % 40} €</p>") for i in range(100, 200)]
         + [(i, None, "the same everywhere") for i in range(300, 5, -1)]
         + [(1, "http://big", BIG), (2, "http://big", BIG), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n"),
            (None, "u", "no id"), (None, "u", "no id"), (900, "u", "no id"), (901, "u", "twice"), (901, "u", "twice")])


def digest(html):
    return b32encode(sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 7, 7, "x", True, "x") for p in PAGES], SCHEMA)


def expected(least=0):
    first = {}
    for i, _, html in PAGES:
        html = html or ""
        if len(html.encode()) >= least and i is not None:
            first[html] = min(first.get(html, i), i)
    out, taken = [], set()
    for i, _, html in PAGES:
        html = html or ""
        revisits = html in first and (i != first[html] or html in taken)
        if html in first and i == first[html]:
            taken.add(html)
        out.append((i, len(html.encode()), digest(html), "revisit" if revisits else "response",
                    first[html] if revisits else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,chunk_bytes", [(0, 8192), (0, 7), (15, 1000)])
def test_pages_against_brute_force(pages, least, chunk_bytes):
    got = archived_pages(pages, least_bytes=least, chunk_bytes=chunk_bytes, archive_bytes=50_000)
    assert got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(least)


def test_payloads_and_files_round_trip(spark, pages, tmp_path):
    scratch = Scratch(spark, "warc-test")
    chunks = scratch.cut(chunk_table(pages, chunk_bytes=1000))
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == 1000
    archives = scratch.cut(write_archives(chunks, scratch.cut(roles(chunks)), f"file://{tmp_path}", archive_bytes=50_000))
    assert archives.count() > 2 and archives.agg(F.sum("records")).first()[0] == len(PAGES)
    back = read_archives(archives, chunk_bytes=999)
    parts = back.where("record_type = 'response'").groupBy("record_uri", "page_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("c"))
    texts = {r.page_id: b"".join(c.data for c in r.c).decode() for r in parts.collect()}
    assert texts["1"] == BIG and texts["5"] == "WARC/1.1\r\n\r\n" and texts["3"] == "" and texts["6"] == "the same everywhere"
    uris = {r.record_uri for r in back.select("record_uri").distinct().collect()}
    assert len(uris) == len(PAGES)
    lines = [x for p in tmp_path.glob("*.warc.gz") for x in gzip.open(p).read().split(b"\r\n")]
    assert sum(x == b"WARC-Type: response" for x in lines) == len({h or "" for _, _, h in PAGES})


def test_a_cut_archive_is_an_error(spark, pages, tmp_path):
    scratch = Scratch(spark, "warc-test")
    chunks = scratch.cut(chunk_table(pages))
    archives = scratch.cut(write_archives(chunks, scratch.cut(roles(chunks)), f"file://{tmp_path}", archive_bytes=1 << 30))
    path = next(tmp_path.glob("*.warc.gz"))
    path.write_bytes(path.read_bytes()[:-200])
    with pytest.raises(Exception, match="EOFError"):
        read_archives(archives).collect()


def test_empty_and_text_ids(spark, pages):
    assert archived_pages(pages.limit(0)).count() == 0
    named = spark.createDataFrame([("b\r\nX: y", "same"), ("a%20", "same"), ("", "other")], "name string, body string")
    got = {r.page_id: r.refers_to for r in archived_pages(named, "name", None, "body").collect()}
    assert got == {"b\r\nX: y": "a%20", "a%20": None, "": None}
