"""Cluster labels by RAKE keyphrases (R1-R10), as DataFrame jobs.

Per cluster: the members' texts (first ``max_chars`` characters each, in hit
order) are tokenised into word runs and punctuation runs; maximal runs of
tokens that are neither stopwords nor single punctuation characters are the
candidate phrases (distinct per cluster).  Word score = degree / frequency
over the distinct phrases; phrase score = sum of its word scores; the top 20
phrases (score desc, phrase desc) joined by ", " form the label.  Words that
appear in the labels of at least ``max(2, clusters / 2)`` clusters of a query
are blanked, then the label is cleaned (R7) and clipped (R8).

The member texts are newline-joined in hit order before tokenising, so a
phrase may run on from one member's text into the next, exactly as when
the joined text is labelled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENGLISH_STOPWORDS, PUNCTUATION, RAKE_MAX_CHARS, RAKE_MAX_PHRASES
from ..functions.text import clean_label, clip_label
from ..session import cut

WORD_TOKEN_PATTERN = r"^[\p{L}\p{N}_]+$"


def domain_stopwords(domain: Column) -> Column:
    """R2: words of the domain without its last label: split on dots, on
    non-alphanumerics, and once more with digit runs replaced by a control
    character (so digits drop out); the union of the three."""
    minus_tld = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    parts = F.replace(minus_tld, F.lit("."), F.lit(" "))
    words = F.regexp_replace(parts, F.lit(r"[^a-zA-Z0-9]+"), F.lit(" "))
    words2 = F.regexp_replace(words, F.lit(r"([0-9]+)"), F.lit(" \u0001 "))

    def ws_split(c):
        return F.filter(F.split(c, r"[ \t\n\r\f\u000b]+"), lambda x: x != "")

    return F.array_distinct(F.concat(ws_split(parts), ws_split(words), ws_split(words2)))


W = r"\p{L}\p{N}_"                 # word characters
P = r"^\p{L}\p{N}_\s\p{Z}"          # (negated) punctuation-run characters


def _trie_alternation(words) -> str:
    """A regex alternation of ``words`` factored by common prefixes, so the
    matcher tests one branch per first character instead of every word."""
    tree: dict = {}
    for w in sorted(set(words)):
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node) -> str:
        alts = []
        end = "" in node
        for ch in sorted(k for k in node if k):
            alts.append(re.escape(ch) + emit(node[ch]))
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 and not end else "(?:" + "|".join(alts) + ")"
        return body + ("?" if end else "")

    return emit(tree)


# ignored word tokens: the stopwords that are single word runs, plus "_"
# (a punctuation character that tokenises as a word run)
_WORD_STOP = [w for w in ENGLISH_STOPWORDS if re.fullmatch(r"\w+", w)] + [c for c in PUNCTUATION if re.fullmatch(r"\w", c)]
_PUNCT_STOP = [c for c in PUNCTUATION if not re.fullmatch(r"\w", c)]
IGNORED_PATTERN = (
    f"(?<![{W}])(?:{_trie_alternation(_WORD_STOP)})(?![{W}])"
    f"|(?<![{P}])[{re.escape(''.join(_PUNCT_STOP))}](?![{P}])"
)
MARK = "\u0002"


def cluster_texts(hits: DataFrame, cluster_ids: DataFrame, fields: DataFrame,
                  max_chars: int = RAKE_MAX_CHARS) -> DataFrame:
    """``(query_id, cluster_id, domain, text)`` — the first ``max_chars``
    characters of each member's text, newline-joined in hit order.  A cluster
    holds at most k members, so a text is at most k x ``max_chars``.

    Grouped on ``(query_id, cluster_id)`` only: every later RAKE step is keyed
    by a superset of it and runs inside this one hash partitioning."""
    mem = (hits.select("query_id", "domain", "rank", "page_id")
           .join(cluster_ids, ["query_id", "rank"])
           .join(fields.select("domain", "page_id", "plaintext"), ["domain", "page_id"]))
    mem = mem.select("query_id", "cluster_id", "domain", "rank",
                     F.substring(F.coalesce("plaintext", F.lit("")), 1, max_chars).alias("txt"))
    g = mem.groupBy("query_id", "cluster_id").agg(
        F.max("domain").alias("domain"),
        F.array_sort(F.collect_list(F.struct("rank", "txt"))).alias("parts"))
    return g.select("query_id", "cluster_id", "domain",
                    F.array_join(F.transform("parts", lambda x: x["txt"]), "\n").alias("text"))


def _domain_pattern(dw: Column) -> Column:
    """Per-row pattern matching the domain stopwords as whole tokens (word-run
    words and punctuation-run words; mixed words can never equal a token)."""
    quote = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))
    words = F.filter(dw, lambda x: x.rlike(f"^[{W}]+$"))
    puncts = F.filter(dw, lambda x: x.rlike(f"^[{P}]+$"))
    wpat = F.concat(F.lit(f"(?<![{W}])(?:"), F.array_join(F.transform(words, quote), "|"), F.lit(f")(?![{W}])"))
    ppat = F.concat(F.lit(f"(?<![{P}])(?:"), F.array_join(F.transform(puncts, quote), "|"), F.lit(f")(?![{P}])"))
    return (F.when((F.size(words) > 0) & (F.size(puncts) > 0), F.concat(wpat, F.lit("|"), ppat))
            .when(F.size(words) > 0, wpat).when(F.size(puncts) > 0, ppat))


def cluster_phrases(hits: DataFrame, cluster_ids: DataFrame, fields: DataFrame,
                    max_chars: int = RAKE_MAX_CHARS) -> DataFrame:
    """Distinct candidate phrases ``(query_id, cluster_id, phrase)``.

    Regex passes over the lower-cased text, no per-token lambdas: put a space
    at every word/punctuation run boundary (they are separate tokens), replace
    every ignored token by a marker (lookarounds make the match a whole
    token), collapse blank runs to one space and split at the markers: each
    piece, trimmed, is a phrase with its tokens joined by single spaces."""
    t = cluster_texts(hits, cluster_ids, fields, max_chars)
    x = F.lower(F.col("text"))
    x = F.regexp_replace(x, F.lit(f"(?<=[{W}])(?=[{P}])|(?<=[{P}])(?=[{W}])"), F.lit(" "))
    x = F.regexp_replace(x, F.lit(IGNORED_PATTERN), F.lit(f" {MARK} "))
    dpat = _domain_pattern(domain_stopwords(F.col("domain")))
    x = F.when(dpat.isNull(), x).otherwise(F.regexp_replace(x, F.coalesce(dpat, F.lit("$^")), F.lit(f" {MARK} ")))
    x = F.regexp_replace(x, F.lit(r"[\s\p{Z}]+"), F.lit(" "))
    pieces = F.transform(F.split(x, f" ?{MARK} ?"), lambda p: F.trim(p))
    phrases = F.array_distinct(F.array_remove(pieces, ""))
    return t.select("query_id", "cluster_id", F.explode(phrases).alias("phrase"))


def phrase_scores(phrases: DataFrame) -> DataFrame:
    """``(query_id, cluster_id, phrase, score)``, degree / frequency metric.

    Word statistics come from a window on ``(query_id, cluster_id, w)``, not a
    join, so the partitioning of the phrases on ``(query_id, cluster_id)``
    serves every step."""
    occ = phrases.select("query_id", "cluster_id", "phrase", F.split("phrase", " ").alias("ws"))
    occ = occ.select("query_id", "cluster_id", "phrase", F.size("ws").alias("len"), F.explode("ws").alias("w"))
    w = Window.partitionBy("query_id", "cluster_id", "w")
    occ = occ.select("query_id", "cluster_id", "phrase",
                     (F.sum("len").over(w) / F.count(F.lit(1)).over(w)).alias("ws_score"))
    return occ.groupBy("query_id", "cluster_id", "phrase").agg(F.sum("ws_score").alias("score"))


def top_phrases(scores: DataFrame, n: int = RAKE_MAX_PHRASES) -> DataFrame:
    """Best ``n`` phrases per cluster (score rounded to 9 places so float
    summation order cannot reorder ties; then phrase descending)."""
    w = Window.partitionBy("query_id", "cluster_id").orderBy(
        F.round("score", 9).desc(), F.col("phrase").desc())
    return scores.withColumn("prank", F.row_number().over(w)).where(F.col("prank") <= n)


def rake_summaries(hits: DataFrame, cluster_ids: DataFrame, fields: DataFrame,
                   max_chars: int = RAKE_MAX_CHARS, n_phrases: int = RAKE_MAX_PHRASES) -> DataFrame:
    """``(query_id, cluster_id, summary)``."""
    top = top_phrases(phrase_scores(cluster_phrases(hits, cluster_ids, fields, max_chars)), n_phrases)
    # at most n_phrases rows per cluster, read twice below: materialise once
    top = cut(top.select("query_id", "cluster_id", "prank", F.split("phrase", " ").alias("ws")))
    # Words of the kept phrases, counted once per cluster, per query
    n_clusters = cluster_ids.groupBy("query_id").agg(F.countDistinct("cluster_id").alias("nc"))
    cw = (top.select("query_id", "cluster_id", F.explode("ws").alias("w")).distinct()
          .groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("cnt"))
          .join(n_clusters, "query_id")
          .where(F.col("cnt") >= F.greatest(F.lit(2.0), F.col("nc") / 2.0))
          .where(F.col("w").rlike(WORD_TOKEN_PATTERN))
          .groupBy("query_id").agg(F.collect_set("w").alias("common")))
    t = top.join(cw, "query_id", "left").withColumn(
        "common", F.coalesce("common", F.array().cast("array<string>")))
    # a common word token is blanked where it stands (its spaces remain)
    t = t.withColumn("kept", F.array_join(F.transform(
        "ws", lambda x: F.when(F.array_contains(F.col("common"), x), F.lit("")).otherwise(x)), " "))
    lab = t.groupBy("query_id", "cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("prank", "kept"))).alias("ps"))
    label = F.array_join(F.transform("ps", lambda x: x["kept"]), ", ")
    return lab.select("query_id", "cluster_id", clip_label(clean_label(label)).alias("summary"))
