"""HTML field extraction as native Spark expressions (P6, P7, P8, P3 hrefs).

No HTML parser runs: each extractor is a fixed chain of regex / split /
higher-order-function expressions, so extraction is one narrow, codegen'd
stage that scales with the page table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BLOCK_TAGS, TEXT_TAGS
from .text import unescape_html

MARK = "\u0001"
COMMENT_PATTERN = r"(?s)<!--.*?-->"
SCRIPT_PATTERN = r"(?is)<script(?:[ \t\r\n\f][^>]*)?>.*?</script[ \t\r\n\f]*>"
STYLE_PATTERN = r"(?is)<style(?:[ \t\r\n\f][^>]*)?>.*?</style[ \t\r\n\f]*>"
HEAD_PATTERN = r"(?is)<head(?:[ \t\r\n\f][^>]*)?>.*?</head[ \t\r\n\f]*>"
BLOCK_PATTERN = r"(?i)<(/?(?:" + "|".join(BLOCK_TAGS) + r"))([ \t\r\n\f/>])"
TEXT_SEGMENT_PATTERN = r"(?i)^<(?:" + "|".join(TEXT_TAGS) + r")[ \t\r\n\f/>]"
TAG_PATTERN = r"<[^>]*>"
TITLE_OPEN_PATTERN = r"(?i)<title[ \t\r\n\f/>]"
TITLE_PATTERN = r"(?is)<title(?:[ \t\r\n\f][^>]*)?>(.*?)</title[ \t\r\n\f]*>"
HREF_TAG_PATTERN = r'(?i)<a[ \t\r\n\f][^>]*href="([^"]*)"[^>]*>'
IMG_ALT_PATTERN = r'(?i)<img[ \t\r\n\f][^>]*alt="([^"]*)"[^>]*>'
HREF_PATTERN = r'(?i)<a[ \t\r\n\f][^>]*href="([^"]*)"'


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _re(col: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(repl))


def strip_invisible(html) -> Column:
    """Remove comments, then ``<script>`` and ``<style>`` elements (in that order,
    so a ``"</p>"`` inside a script never reaches the tag logic)."""
    h = _re(_c(html), COMMENT_PATTERN)
    h = _re(h, SCRIPT_PATTERN)
    return _re(h, STYLE_PATTERN)


def extract_plaintext(html, cleaned: bool = False) -> Column:
    """Text of ``title``, ``h1``..``h6`` and ``p`` elements, newline-joined.

    A marker goes before every block tag (open or close); segments that start
    with a wanted opening tag are kept, which closes an unclosed ``<p>`` at the
    next block tag.  Inner tags become line breaks, entities are decoded and
    blank runs around line breaks collapse to one newline.
    """
    clean = _c(html) if cleaned else strip_invisible(html)
    marked = _re(clean, BLOCK_PATTERN, MARK + "<$1$2")
    segs = F.split(marked, MARK)
    keep = F.filter(segs, lambda s: s.rlike(TEXT_SEGMENT_PATTERN))
    texts = F.transform(keep, lambda s: F.regexp_replace(s, F.lit(TAG_PATTERN), F.lit("\n")))
    text = unescape_html(F.array_join(texts, "\n"))
    text = _re(text, r"[ \t\r\n\f]*\n[ \t\r\n\f]*", "\n")
    return _re(text, r"^\n+|\n+$", "")


def extract_fulltext(html, cleaned: bool = False) -> Column:
    """Visible body text plus link targets and image alt text.

    Head, scripts, styles and comments are dropped; each ``<a href=X>`` adds X
    to the text (a markdown rendering keeps link targets inline); other tags
    become spaces; entities decoded; whitespace collapsed.
    """
    clean = _re(_c(html) if cleaned else strip_invisible(html), HEAD_PATTERN)
    clean = _re(clean, HREF_TAG_PATTERN, " $1 ")
    clean = _re(clean, IMG_ALT_PATTERN, " $1 ")
    text = unescape_html(_re(clean, TAG_PATTERN, " "))
    return F.trim(_re(text, r"[ \t\r\n\f]+", " "))


def extract_title(html, url, cleaned: bool = False) -> Column:
    """The ``<title>`` string.

    No title tag -> the URL; a title tag that is empty or holds markup -> NULL
    (such a page then has no similarity rows, see J2).
    """
    clean = _c(html) if cleaned else strip_invisible(html)
    raw = F.regexp_extract(clean, TITLE_PATTERN, 1)
    return (
        F.when(~clean.rlike(TITLE_OPEN_PATTERN), _c(url))
        .when((raw == "") | (F.instr(raw, "<") > 0), F.lit(None).cast("string"))
        .otherwise(unescape_html(raw))
    )


def extract_hrefs(html) -> Column:
    """P3 (first part): ``href`` values of anchors, in document order."""
    return F.regexp_extract_all(strip_invisible(html), F.lit(HREF_PATTERN), 1)
