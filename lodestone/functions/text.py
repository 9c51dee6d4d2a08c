"""String functions with the semantics of Python's, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() takes off: Unicode white space and the four separators that Java's class lacks.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Only the ends are looked at, however long the text."""
    return F.trim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


def or_else(first: Column, second: Column) -> Column:
    """Python's `first or second` for strings: an empty one falls through."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def cut_at_blank(c: Column, most: int) -> Column:
    """The first `most` characters, back to the last blank if there is one."""
    cut = F.substring(c, 1, most)
    return F.when(F.char_length(c) <= most, c).otherwise(F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1"))


def session_title(message: Column, most: int = 60) -> Column:
    """A session's title from its first message."""
    clean = strip(message)
    return F.when(F.char_length(clean) > most, F.concat(cut_at_blank(clean, most), F.lit("…"))).otherwise(clean)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; two empty arrays are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def request_id(c: Column, most: int = 64) -> Column:
    """A client's request id without anything but letters, digits, `-`, `_` and `.`."""
    return F.nullif(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", ""), 1, most), F.lit(""))


def markdown_html(c: Column) -> Column:
    """Escaped text with bold, code, links and bare addresses as HTML, in this order."""
    out = c
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    for pattern, html in (
        (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"`([^`]+)`", "<code>$1</code>"),
        (r"\[([^\]]+)\]\((https?://[^\s)]+)\)", '<a href="$2">$1</a>'), (r'(^|[\s(])(https?://[^\s<)"]+)', '$1<a href="$2">$2</a>'),
    ):
        out = F.regexp_replace(out, pattern, html)
    return F.replace(out, F.lit("\n"), F.lit("<br>"))
