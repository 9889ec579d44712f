"""Derivatives of WARC response records: linked metadata and plain-text conversion records.

Records are rows until they are written. Everything between reading and writing files is DataFrame expressions on one
row, so nothing is shuffled.
"""

from __future__ import annotations

import gzip
import io
import json
import zlib
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "corpus derivatives"
#: Bytes of content that are handed on together.
BATCH_BYTES = 16_000_000
# Patterns that Java and RE2 read alike.
_END = r"(?:[ \t\n\f\r/][^>]*)?>"
HIDDEN = rf"(?is)<(?:!--.*?-->|script{_END}.*?</script[ \t\n\f\r]*>|style{_END}.*?</style[ \t\n\f\r]*>|title{_END}.*?</title[ \t\n\f\r]*>)"
BLOCKS = rf"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|pre|article|section|nav|aside|header|footer|main|form|body|html|head|blockquote){_END}"
TAGS = r"<[a-zA-Z/!][^>]*>"
TITLE = rf"(?is)<title{_END}(.*?)</title"
_S = r"[ \t\n\f\r]"
LINKS = rf"""(?i)<a(?:{_S}|{_S}[^>]*?[ \t\n\f\r"'])href{_S}*={_S}*("[^"]*"|'[^']*'|[^ \t\n\f\r"'>]+)"""
QUOTES = r"""^["']|["']$"""
#: Character references: decimal, hexadecimal, named.
REFERENCES = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});"
#: The names that HTML knows, and what they stand for; a no-break space counts as a blank.
NAMED = {f"&{name}": " " if letters == "\xa0" else letters for name, letters in html5.items() if name.endswith(";")}


def record_uuid(*parts: Column) -> Column:
    """A ``urn:uuid`` made from the parts, so that a derivative made again has the same identifier."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts])
    digest = F.sha2(text, 256)
    pieces = [F.substring(digest, 1, 8), F.substring(digest, 9, 4)]
    pieces += [F.concat(F.lit("8"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_of(pages: DataFrame, key: str = "page_id", date: str = DATE) -> DataFrame:
    """Response records of pages(``key``, url, html): a page as the answer of a server. NULL html is an empty page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2)
    )
    block = F.concat(head, html)
    return pages.select(
        F.col(f"`{key}`"),
        record_uuid(F.lit("response"), F.col(f"`{key}`"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        block.alias("block"),
        digest(html).alias("payload_digest"),
    )


def _character(reference: Column) -> Column:
    """What a reference stands for. Numbers that are no character are U+FFFD, unknown names stay as they are."""
    number = F.when(
        reference.rlike("^&#[xX]"), F.conv(F.regexp_extract(reference, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long")
    ).otherwise(F.regexp_extract(reference, "#([0-9]+)", 1).try_cast("long"))
    sound = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    letter = F.when(number == 0xA0, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # a constant, folded when the plan is made
    named = F.coalesce(F.try_element_at(names, reference), reference)
    return F.when(F.startswith(reference, F.lit("&#")), F.when(sound, letter).otherwise("\ufffd")).otherwise(named)


def decoded(text: Column) -> Column:
    """The text with its character references decoded, in one pass, so that none is decoded twice."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^&]+|{REFERENCES}|&"), F.lit(0))
    letters = F.transform(pieces, lambda piece: F.when(F.startswith(piece, F.lit("&")), F.when(piece == "&", "&").otherwise(_character(piece))).otherwise(piece))
    return F.when(F.contains(text, F.lit("&")), F.array_join(letters, "")).otherwise(text)


def visible(html: Column) -> Column:
    """A page without its comments, scripts, styles and title."""
    return F.regexp_replace(html, HIDDEN, "")


def _lines(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, "")
    text = F.regexp_replace(decoded(text), r"[ \t\f\r]{2,}|[\t\f\r]", " ")
    return F.trim(F.regexp_replace(text, r"[ \n]*\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """The text of a page: one line per block, without markup, scripts and comments, character references decoded."""
    return _lines(visible(html))


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A metadata and a conversion record for each row of responses(record_id, target_uri, date, block, payload_digest).

    ``block`` is a whole HTTP response. Columns: ``keep``, type, record_id, refers_to, target_uri, date, content_type,
    source_headers (lines of the response's head, its status first), source_digest, block_digest, content_length
    (bytes), content. The metadata's content is ``warc-fields``: source digest, status, source headers, title and one
    outlink per link, in order, whatever its quotes, but none from comments and scripts. A source digest that the record lacks is made from its payload. NULL or empty blocks give records
    without headers, links and text; a NULL identifier stays NULL; equal rows give equal records; no rows, none.
    """
    block = F.coalesce(F.col("block"), F.lit(""))
    split = F.locate(CRLF * 2, block)
    parsed = responses.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "payload_digest",
        F.when(split > 0, F.substring(block, F.lit(1), split - 1)).otherwise(F.lit("")).alias("head"),
        F.when(split > 0, F.substring(block, split + 4, F.length(block))).otherwise(block).alias("payload"),
    )
    parsed = parsed.withColumn("visible", visible(F.col("payload")))  # text and links are both taken from it
    lines = F.filter(F.split("head", CRLF), lambda line: line != "")
    payload = F.col("payload")
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract(payload, TITLE, 1)), r"[ \t\n\f\r]+", " "))
    links = F.transform(
        F.regexp_extract_all("visible", F.lit(LINKS), F.lit(1)),
        lambda link: F.concat(
            F.lit("outlink: "), decoded(F.regexp_replace(F.regexp_replace(link, QUOTES, ""), r"[ \t\n\f\r]+", "%20")), F.lit(" L a/@href")
        ),
    )
    whole = parsed.select(
        *[F.col(f"`{c}`") for c in keep], "refers_to", "target_uri", "date",
        lines.alias("source_headers"),
        F.coalesce("payload_digest", digest(payload)).alias("source_digest"),
        title.alias("title"),
        links.alias("links"),
        _lines(F.col("visible")).alias("text"),
    )
    fields = F.concat(
        F.array(
            F.concat(F.lit("software: "), F.lit(SOFTWARE)),
            F.concat(F.lit("source-payload-digest: "), F.col("source_digest")),
        ),
        F.transform("source_headers", lambda line: F.concat(F.lit("source-header: "), line)),
        F.when(F.col("title") != "", F.array(F.concat(F.lit("title: "), F.col("title")))).otherwise(F.array().cast("array<string>")),
        F.col("links"),
    )
    record = lambda kind, media, content: F.struct(
        F.lit(kind).alias("type"), record_uuid(F.lit(kind), F.col("refers_to")).alias("record_id"), F.lit(media).alias("content_type"), content.alias("content")
    )
    both = F.array(
        record("metadata", "application/warc-fields", F.concat(F.array_join(fields, CRLF), F.lit(CRLF))),
        record("conversion", "text/plain; charset=utf-8", F.col("text")),
    )
    out = whole.select(*[F.col(f"`{c}`") for c in keep], "refers_to", "target_uri", "date", "source_headers", "source_digest", F.explode(both).alias("r"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        "r.type",
        F.when(F.col("refers_to").isNotNull(), F.col("r.record_id")).alias("record_id"),
        "refers_to", "target_uri", "date", "r.content_type", "source_headers", "source_digest",
        digest(F.col("r.content")).alias("block_digest"),
        F.octet_length("r.content").cast("long").alias("content_length"),
        "r.content",
    )


def serialized(records: DataFrame) -> Column:
    """A record as it stands in a file, without the two line ends behind it. Fields that are NULL are left out."""
    names = {
        "WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri",
        "WARC-Refers-To": "refers_to", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest",
        "Content-Type": "content_type",
    }
    lines = [F.concat(F.lit(f"{name}: "), F.col(column)) for name, column in names.items() if column in records.columns]
    body = F.coalesce(F.col("content" if "content" in records.columns else "block"), F.lit(""))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), body)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (of ``derive``, or responses with a ``type``) as gzipped WARC files, one per partition."""
    records.select(serialized(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _records(data: bytes):
    """Header fields (names in lower case) and content of each record of a file, plain or of gzip members, read bit by bit."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            name = None
            while (line := stream.readline()) and line.strip():
                text = line.decode(errors="replace").rstrip("\r\n")
                if text[0] in " \t" and name:  # a folded line goes on with the one before
                    head[name] += " " + text.strip()
                elif ":" in text:
                    name, value = (part.strip() for part in text.split(":", 1))
                    name = name.lower()
                    head[name] = value
            size = head.get("content-length", "")
            if not size.isascii() or not size.isdigit():
                continue
            content = stream.read(int(size))
            if len(content) == int(size):
                yield head, content
    except (EOFError, gzip.BadGzipFile, zlib.error):
        return


def _parse(batches):
    names = ["type", "record_id", "date", "target_uri", "refers_to", "block_digest", "payload_digest", "content_type", "content"]
    fields = ["warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-refers-to", "warc-block-digest", "warc-payload-digest", "content-type"]

    def batch_of(rows):
        return pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for head, content in _records(data.as_py()):
                rows.append([*[head.get(f) for f in fields], content.decode(errors="replace")])
                size += len(content)
                if len(rows) == 1000 or size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files: type, record_id, date, target_uri, refers_to, digests, content_type, content.

    A file is one task's work. Spark's binary reader hands it over as it lies there, 2 GB at most; it is decompressed and read bit by bit. Header
    names count in any case, with or without a blank behind the colon, and may be folded. A record without a sound
    Content-Length is left out, and reading goes on at the next one; so is one that the file's end cuts off. An empty file has no records.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = "type string, record_id string, date string, target_uri string, refers_to string, block_digest string, payload_digest string, content_type string, content string"
    return files.mapInArrow(_parse, kinds)
