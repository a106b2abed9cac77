"""String scalar functions as Spark Column expressions (JVM-side, codegen'd).

Regexes are built with the Python API (raw strings in ``F.lit``), never inside
``F.expr`` strings, where backslashes would be eaten by the SQL parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HTML_ENTITIES, LABEL_APPROX_CHARS, LABEL_CLEAN_PATTERN

# word characters: letters, digits (all scripts) and underscore
WORD_CLASS = r"\p{L}\p{N}_"
# similarity tokens: lower-cased runs of two or more word characters
SIM_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# search tokens: lower-cased runs of letters/digits, single characters kept
SEARCH_TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# keyphrase tokens: word runs or runs of other non-space characters
RAKE_TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sim_tokens(col) -> Column:
    """Similarity tokenizer (P12): ``array<string>`` of lower-cased words of >= 2 chars."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(SIM_TOKEN_PATTERN), 0)


def search_tokens(col) -> Column:
    """Index / query analyzer (P13): lower-cased letter-or-digit runs."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(SEARCH_TOKEN_PATTERN), 0)


def rake_tokens(col) -> Column:
    """Keyphrase tokenizer (R3): lower-cased word runs and punctuation runs."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(RAKE_TOKEN_PATTERN), 0)


def unescape_html(col) -> Column:
    """Decode the fixed entity set; ``&amp;`` last so ``&amp;lt;`` stays ``&lt;``."""
    out = _c(col)
    for ent, ch in HTML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def normalise_whitespace_controls(col) -> Column:
    """Q8: each of tab, newline, CR, form feed, vertical tab becomes a space."""
    return F.translate(_c(col), "\t\n\r\f\x0b", "     ")


def clean_label(col) -> Column:
    """Drop leading / trailing commas and non-alphanumeric runs before commas."""
    return F.regexp_replace(_c(col), F.lit(LABEL_CLEAN_PATTERN), F.lit(""))


def clip_label(col, approx_chars: int = LABEL_APPROX_CHARS) -> Column:
    """A label longer than ``approx_chars`` is cut at its first comma at or
    after that offset (0-based); without such a comma it is kept whole."""
    c = _c(col)
    pos = F.locate(",", c, approx_chars + 1)
    return F.when((F.length(c) > approx_chars) & (pos > 0), F.substring(c, F.lit(1), pos - 1)).otherwise(c)


def normalise_domain(col) -> Column:
    """Strip trailing slashes from a domain key or base URL."""
    return F.regexp_replace(_c(col), F.lit(r"/+$"), F.lit(""))
