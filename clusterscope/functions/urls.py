"""URL scalar functions (P2, P5, P9, P10, domain keys)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NETLOC_PATTERN = r"^[^:/?#]+://([^/?#]*)"
# registered domain: the last two dot-separated labels of the host
DOMAIN_PATTERN = r"([^.]+\.[^.]+)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def netloc(url) -> Column:
    """Network location of a URL exactly as written (keeps port and userinfo)."""
    return F.regexp_extract(_c(url), NETLOC_PATTERN, 1)


def host(url) -> Column:
    """Lower-cased host: the netloc without userinfo and port."""
    n = netloc(url)
    n = F.regexp_replace(n, F.lit(r"^[^@]*@"), F.lit(""))
    return F.lower(F.regexp_replace(n, F.lit(r":[0-9]*$"), F.lit("")))


def registered_domain(url) -> Column:
    """Site key of a page: the last two labels of its host (``a.b.example.com`` ->
    ``example.com``).  A crawl of that domain accepts every such host (P2)."""
    return F.regexp_extract(host(url), DOMAIN_PATTERN, 1)


def in_domain(url, domain) -> Column:
    """The domain is a *substring* of the URL's netloc (not a suffix match)."""
    return F.instr(netloc(url), _c(domain) if not isinstance(domain, str) else F.lit(domain)) > 0


def strip_domain(url, domain, fixed: bool = False) -> Column:
    """The URL from one character past the first occurrence of the domain.

    Skips a single character, not the domain (``https://toolshed.org/x`` ->
    ``oolshed.org/x``); domain absent -> whole URL; empty result -> one space.
    ``fixed=True`` cuts the whole domain instead.
    """
    u = _c(url)
    d = _c(domain)
    pos = F.instr(u, d)
    start = F.when(pos > 0, pos + (F.length(d) if fixed else F.lit(1))).otherwise(F.lit(1))
    out = F.substr(u, start)
    return F.when(out == "", F.lit(" ")).otherwise(out)


def url_hash(url) -> Column:
    """P10: 32-hex MD5 of the URL."""
    return F.md5(_c(url))


def page_key(url) -> Column:
    """P5 (first part): percent-quote every byte of the URL except ``A-Za-z0-9_.-~``.

    Java's form encoder writes space as ``+``, ``~`` as ``%7E`` and leaves
    ``*`` alone; the three replacements give the RFC 3986 form.
    """
    e = F.url_encode(_c(url))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))
