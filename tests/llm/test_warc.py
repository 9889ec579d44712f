"""Derivatives against hand-made pages, and files against what was written."""

import gzip
import hashlib

from mediaseries.llm.warc import derive, read_warc, responses_of, write_warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, type string"
PAGE = """<!DOCTYPE html><html><head><TITLE>A &amp; B</TITLE><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- <p>no</p> --><h1>Head</h1><p>One <b>two</b>&nbsp;&lt;x&gt; &amp;lt;<br>three <a class=k href="/l?a=1&amp;b=2">link</a><a href="/two words">x</a></body></html>"""


def rows(spark, *pages):
    responses = responses_of(spark.createDataFrame(list(pages), SCHEMA))
    return derive(responses, keep=("page_id",)), responses


def test_records(spark):
    records, responses = rows(spark, (1, "http://a", PAGE, "clash"))
    meta, text = sorted(records.collect(), key=lambda r: r["type"] == "conversion")
    source = responses.first()
    assert text["content"] == "Head\nOne two <x> &lt;\nthree linkx"
    digest = "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
    assert meta["content"].split("\r\n") == [
        "software: corpus derivatives", f"source-payload-digest: {digest}", "source-header: HTTP/1.1 200 OK",
        "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(PAGE)}", "title: A & B",
        "outlink: /l?a=1&b=2 L a/@href", "outlink: /two%20words L a/@href", "",
    ]
    for r in (meta, text):
        assert r["refers_to"] == source["record_id"] and r["target_uri"] == "http://a" and r["source_digest"] == digest
        assert r["content_length"] == len(r["content"].encode())
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["content"].encode()).hexdigest()
    assert len({meta["record_id"], text["record_id"], source["record_id"]}) == 3


def test_links_in_any_quotes_and_none_that_are_hidden(spark):
    page = """<a href='/single "x"'>1</a><A class="k" HREF = /bare>2</A><a data-href="/no" href="it's">3</a><a
    href="/new
line">4</a><!-- <a href="/comment">no</a> --><script>s = '<a href="/script">';</script><abbr href="/abbr">no</abbr><a name="x">no</a><a href=''>5</a>"""
    records, _ = rows(spark, (1, "u", page, "x"))
    meta = next(r["content"] for r in records.collect() if r["type"] == "metadata")
    links = [line.removeprefix("outlink: ").removesuffix(" L a/@href") for line in meta.split("\r\n") if line.startswith("outlink: ")]
    assert links == ['/single%20"x"', "/bare", "it's", "/new%20line", ""]


def test_references_are_decoded_once(spark):
    page = "<title>&Eacute;t&eacute; &#8217;&#x2019;</title><p>&#8217; &#x1F600; &eacute;&hellip; &amp;eacute; &amp;#65; &#38;lt; &unknown; &#0; &#xD800; &#99999999; &AMP; a&nbsp;b &notin; & &; &#; &#160;c</p>"
    records, _ = rows(spark, (1, "u", page, "x"))
    got = {r["type"]: r["content"] for r in records.collect()}
    assert got["conversion"] == "’ \U0001F600 é… &eacute; &#65; &lt; &unknown; \ufffd \ufffd \ufffd & a b ∉ & &; &#; c"
    assert "title: Été ’’" in got["metadata"].split("\r\n")


def test_files_as_they_are(spark, tmp_path):
    record = lambda head, content: b"WARC/1.0\r\n" + head + b"\r\n\r\n" + content + b"\r\n\r\n"
    tight = record(b"WARC-Type:response\r\nwarc-target-uri:http://x:80/\r\nContent-Length:3", b"one")
    folded = record(b"WARC-Type: metadata\r\nWARC-Target-URI: http://y\r\n  /folded\r\nno colon here\r\nContent-Length: 10", b"WARC/1.0\r\n")
    missing = record(b"WARC-Type: resource", b"no length")
    wrong = record(b"WARC-Type: resource\r\nContent-Length: many", b"no length")
    last = record(b"WARC-Type: conversion\r\nContent-Length: 5", b"three")
    whole = tight + missing + folded + wrong + last
    packed = b"".join(gzip.compress(r) for r in (tight, missing, folded, wrong, last))
    want = [("conversion", None, "three"), ("metadata", "http://y /folded", "WARC/1.0\r\n"), ("response", "http://x:80/", "one")]
    files = {
        "plain": (whole, want),
        "members": (packed, want),
        "one": (gzip.compress(whole), want),
        "cut-content": (whole[:-7], want[1:]),
        "cut-head": (whole + b"WARC/1.0\r\nWARC-Type: resp", want),
        "cut-gzip": (packed[:-20], want[1:]),
        "empty": (b"", []),
        "other": (b"no records here\n" * 50, []),
    }
    for name, (data, found) in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
        got = read_warc(spark, str(tmp_path / f"{name}.warc")).select("type", "target_uri", "content").collect()
        assert sorted(map(tuple, got)) == found, name


def test_odd_pages(spark):
    long = "<p>" + "é word " * 200_000
    records, _ = rows(spark, (1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "v", "<p", "x"), (4, "w", long, None))
    got = records.collect()
    assert len(got) == 10
    texts = {(r["page_id"], r["content"]) for r in got if r["type"] == "conversion"}
    assert texts == {(1, ""), (2, ""), (None, "<p"), (4, ("é word " * 200_000).strip())}
    assert rows(spark)[0].count() == 0


def test_files_round_trip(spark, tmp_path):
    records, responses = rows(spark, (1, "http://a", PAGE, "x"), (2, None, "tail\r\n\r\nWARC/1.1 inside", "x"))
    write_warc(records, str(tmp_path / "wat"))
    names = ["type", "record_id", "date", "target_uri", "refers_to", "block_digest", "content_type", "content"]
    assert {tuple(r) for r in read_warc(spark, str(tmp_path / "wat")).select(*names).collect()} == {tuple(r) for r in records.select(*names).collect()}
    write_warc(responses.withColumn("type", F.lit("response")), str(tmp_path / "warc"))
    again = read_warc(spark, str(tmp_path / "warc")).where("type = 'response'").withColumnRenamed("content", "block")
    keep = ["type", "refers_to", "block_digest", "source_digest", "content"]
    assert {tuple(r) for r in derive(again).select(*keep).collect()} == {tuple(r) for r in records.select(*keep).collect()}
