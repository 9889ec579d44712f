"""Text expressions. All stay in the JVM and work on whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that str.split() and str.strip() treat as blanks in Python.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Clean-up steps for posts that carry HTML, applied in this order.
HTML_STEPS = (
    (r"(?d)<a[^>]*>.+?</a>", "Link."),
    ("&gt;", ""),
    ("&#x27;", "'"),
    ("&quot;", '"'),
    ("&#x2F;", " "),
    ("<p>", " "),
    ("</i>", ""),
    ("&#62;", ""),
    ("<i>", " "),
    ("\n", ""),
)

# The same blanks as a Java class: the Unicode property plus the four information separators.
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f]+"

# A sentence ends at . ! or ?, perhaps inside a closing quote or bracket, before a blank.
_SENTENCE_END = r"""([.!?]["')\]]?)[ \t\r\n\f]+"""
_MARK = "\uffff"  # a noncharacter; where a text holds it all the same, it is dropped first


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_quotes(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit('"'), F.lit(""))


def parse_text(c: Column | str) -> Column:
    """Trimmed of every kind of blank, then freed of double quotes."""
    return strip_quotes(F.btrim(_col(c), F.lit(BLANKS)))


def none_to_null(c: Column | str) -> Column:
    """The text ``None`` stands for a missing value in older tables."""
    return F.nullif(_col(c), F.lit("None"))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(_NOT_BLANK))


def clean_html(c: Column | str) -> Column:
    c = _col(c)
    for pattern, replacement in HTML_STEPS:
        if pattern.startswith("(?"):
            c = F.regexp_replace(c, pattern, replacement)
        else:
            c = F.replace(c, F.lit(pattern), F.lit(replacement))
    return c


def split_sentences(c: Column | str) -> Column:
    """Array of non-empty sentences in text order."""
    marked = F.regexp_replace(F.replace(_col(c), F.lit(_MARK), F.lit("")), _SENTENCE_END, f"$1{_MARK}")
    parts = F.transform(F.split(marked, _MARK), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(parts, lambda s: s != "")


def letters_only_words(c: Column | str) -> Column:
    """Array of lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\p{L}+"), F.lit(0))


def nonzero_long(c: Column | str) -> Column:
    """Counter as a long; zero and anything that is no integer become NULL."""
    return F.nullif(_col(c).try_cast("long"), F.lit(0).cast("long"))


def long_or_null(c: Column | str) -> Column:
    """Identifier as a long, NULL where it is not one."""
    return _col(c).try_cast("long")
