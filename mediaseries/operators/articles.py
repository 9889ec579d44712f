"""Title and body text of crawled pages, by built-in expressions over whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Blocks that hold no article text.
_DROPPED = r"(?is)<!--.*?-->|<(script|style|nav|aside|footer|header|noscript)\b.*?</\1\s*>"
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_PARAGRAPH_BREAK = r"(?i)</?(?:p|div|article|section|h[1-6]|li|ul|ol|table|tr|br|blockquote|body|html)\b[^>]*>"
_TAG = r"(?s)<[^>]*>"

# The character references that are decoded, the ampersand last.
_REFERENCES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)


def _tidy(c: Column) -> Column:
    for name, char in _REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def page_title(html: Column | str) -> Column:
    html = F.col(html) if isinstance(html, str) else html
    return _tidy(F.regexp_replace(F.regexp_extract(html, _TITLE, 1), _TAG, ""))


def page_text(html: Column | str) -> Column:
    """Paragraphs of the body, a blank line between them."""
    html = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(F.regexp_replace(html, _TITLE, ""), _DROPPED, "")
    bare = F.replace(bare, F.lit("\x1e"), F.lit(""))  # the mark that paragraphs are split at
    parts = F.split(F.regexp_replace(bare, _PARAGRAPH_BREAK, "\x1e"), "\x1e")
    tidy = F.transform(parts, lambda p: _tidy(F.regexp_replace(p, _TAG, "")))
    return F.array_join(F.filter(tidy, lambda p: p != ""), "\n\n")


# Marks around the text of links, and between blocks.
_LINK, _END, _BLOCK = "\x1c", "\x1d", "\x1e"
#: Shares of linked words above which a block, or the one before it, counts as navigation.
LINKED, LINKED_BEFORE = 1 / 3, 5 / 9


def page_blocks(html: Column | str) -> Column:
    """Blocks of text of a page in order, as structs of text, words and the number of linked words."""
    html = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(F.regexp_replace(html, _TITLE, ""), _DROPPED, "")
    bare = F.translate(bare, _LINK + _END + _BLOCK, "")
    marked = F.regexp_replace(F.regexp_replace(bare, r"(?i)<a\b[^>]*>", _LINK), r"(?i)</a\s*>", _END)
    parts = F.split(F.regexp_replace(marked, _PARAGRAPH_BREAK, _BLOCK), _BLOCK)

    def words(text: Column) -> Column:
        return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))

    def block(part: Column) -> Column:
        plain = F.regexp_replace(part, _TAG, "")
        text = _tidy(F.translate(plain, _LINK + _END, ""))
        linked = _tidy(F.array_join(F.regexp_extract_all(plain, F.lit(f"{_LINK}([^{_END}]*)"), F.lit(1)), " "))
        return F.struct(text.alias("text"), words(text).alias("words"), words(linked).alias("linked"))

    return F.filter(F.transform(parts, block), lambda b: b["words"] > 0)


def body_blocks(blocks: Column) -> Column:
    """The blocks that are running text, by their words and links and those of their neighbours (Kohlschütter et al. 2010, by number of words).

    A block with few links stays if it is long, stands before a long one, or stands behind a block that has more than a few words;
    behind a block of links it has to be longer itself.
    """

    def share(b: Column) -> Column:
        return F.coalesce(b["linked"] / b["words"], F.lit(0.0))

    def count(b: Column) -> Column:
        return F.coalesce(b["words"], F.lit(0))

    def stays(b: Column, k: Column) -> Column:
        before, after = F.get(blocks, k - 1), F.get(blocks, k + 1)
        calm = (count(b) > 16) | (count(after) > 15) | (count(before) > 4)
        behind_links = (count(b) > 40) | (count(after) > 17)
        return (share(b) <= LINKED) & F.when(share(before) <= LINKED_BEFORE, calm).otherwise(behind_links)

    return F.filter(blocks, stays)


def extract_bodies(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their title and the text of their body in place of their HTML: navigation, advertisements and footers are left out.

    Parts that their tags name as such go first, then blocks go by text and link density. A page without running text
    has an empty text, one without HTML a NULL.
    """
    body = F.array_join(F.transform(body_blocks(F.col("_blocks")), lambda b: b["text"]), "\n\n")
    return pages.withColumn("title", page_title(html)).withColumn("_blocks", page_blocks(html)).withColumn("text", body).drop(html, "_blocks")


def extract_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``title`` and ``text`` in place of their HTML."""
    return pages.withColumn("title", page_title(html)).withColumn("text", page_text(html)).drop(html)
