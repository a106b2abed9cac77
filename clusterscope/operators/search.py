"""Retrieval (Q1-Q10): boosted multi-field BM25 (dismax), top-k, hits, highlights.

A search is a batch: any number of queries at once.  A query whose
``domain`` is NULL is asked on every site; its result key becomes
``<query_id>@<domain>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FIELD_BOOSTS, SEARCH_FIELDS, TOP_K
from ..functions.text import normalise_whitespace_controls, search_tokens
from ..session import cut, of_keys
from .index import bm25_tf, term_stats

# runs of letters/digits or of anything else: splitting a passage this way and
# joining the runs back restores it exactly
RUN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
# a sentence: text up to and including its closing punctuation, or to a line end
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"


# a clause: optional +/- operator, then a quoted phrase or a run of non-blanks
CLAUSE_PATTERN = r'[+-]?"[^"]*"|[+-]?[^\s"]+'


def _clauses(queries: DataFrame) -> DataFrame:
    """``(query_id, q_domain, op, body, toks)``: the query string's clauses, operators split off."""
    c = queries.select("query_id", F.col("domain").alias("q_domain"),
                       F.explode(F.regexp_extract_all("query", F.lit(CLAUSE_PATTERN), 0)).alias("clause"))
    op = (F.when((F.length("clause") > 1) & F.col("clause").startswith("+"), F.lit("+"))
          .when((F.length("clause") > 1) & F.col("clause").startswith("-"), F.lit("-"))
          .otherwise(F.lit("")))
    c = c.select("query_id", "q_domain", op.alias("op"),
                 F.when(op != "", F.substring("clause", 2, 1 << 30)).otherwise(F.col("clause")).alias("body"))
    return c.withColumn("toks", search_tokens(F.col("body")))


def _phrase_term():
    """A phrase clause's own term: its tokens in quotes (no token holds a quote)."""
    return F.concat(F.lit('"'), F.array_join("toks", " "), F.lit('"'))


def _is_phrase():
    return F.col("body").startswith('"') & (F.size("toks") > 1)


def query_terms(queries: DataFrame, phrases: bool = False) -> DataFrame:
    """Q4: ``(query_id, q_domain, term, qtf, req, proh, n_req)``.

    The query string is split into clauses; ``+clause`` terms are required,
    ``-clause`` terms prohibited, other terms optional.  A quoted phrase of
    several tokens is one term of its own with ``phrases`` (see
    ``phrase_impacts``), and stands for its tokens without.  ``qtf`` counts
    scored occurrences (a repeated term counts once per occurrence, as
    repeated clauses do)."""
    toks = F.when(_is_phrase(), F.array(_phrase_term())).otherwise(F.col("toks")) if phrases else F.col("toks")
    t = _clauses(queries).select("query_id", "q_domain", "op", F.explode(toks).alias("term"))
    g = t.groupBy("query_id", "q_domain", "term").agg(
        F.count(F.when(F.col("op") != "-", 1)).alias("qtf"),
        F.max(F.col("op") == "+").alias("req"),
        F.max(F.col("op") == "-").alias("proh"))
    nreq = g.groupBy("query_id").agg(F.count(F.when(F.col("req"), 1)).alias("n_req"))
    return g.join(nreq, "query_id")


def _runs_of(column: str, n):
    """How many values of a sorted array occur ``n`` times."""
    acc0 = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("hits"))
    ended = lambda acc: acc["hits"] + F.when(acc["run"] == n, 1).otherwise(0).cast("long")

    def merge(acc, x):
        return F.when(x == acc["prev"], F.struct(acc["prev"].alias("prev"), (acc["run"] + 1).alias("run"), acc["hits"].alias("hits"))) \
            .otherwise(F.struct(x.alias("prev"), F.lit(1).cast("long").alias("run"), ended(acc).alias("hits")))
    return F.aggregate(column, acc0, merge, ended)


def phrase_impacts(queries: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Q4: impacts ``(domain, term, page_id, s_<field>...)`` of the queries' quoted phrases.

    A phrase occurs where all its tokens stand at consecutive positions of a
    field: every occurrence of a token votes for the position at which the
    phrase would start (one equi-join on the token; a posting's votes are one row, which meets those of
    the phrase's other tokens on its page), and starts with all votes count.  Its score is BM25 with that
    count as tf and the sum of its tokens' idfs.
    """
    ph = _clauses(queries).where(_is_phrase()).select(_phrase_term().alias("term"), "toks").distinct()
    part = ph.select("term", F.size("toks").alias("n"), F.posexplode("toks").alias("i", "tok"))
    post = postings.withColumnRenamed("term", "tok")
    place = ("term", "n", "domain", "field", "page_id", "dl")
    votes = part.join(post, "tok").select(*place, F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
    starts = votes.groupBy(*place).agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))
    tf = starts.select("term", "domain", "field", "page_id", "dl", _runs_of("starts", F.col("n")).alias("tf")).where("tf > 0")
    df = term_stats(postings).withColumnRenamed("term", "tok")
    idf = (part.join(df, "tok").join(stats, ["domain", "field"]).groupBy("term", "domain", "field")
           .agg(F.sum(F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf")))
    s = (tf.join(idf, ["term", "domain", "field"]).join(stats, ["domain", "field"])
         .withColumn("s", F.col("idf") * bm25_tf(F.col("tf"), F.col("dl"), F.col("avgdl"))))
    return s.groupBy("domain", "term", "page_id").agg(*[
        F.coalesce(F.max(F.when(F.col("field") == f, F.col("s"))), F.lit(0.0)).alias(f"s_{f}") for f in SEARCH_FIELDS])


def dismax_score(boosts: dict | None = None, tie: float = 0.0):
    """Q1/Q2: per term, the max over fields of boost x field score (+ tie x rest)."""
    boosts = boosts or FIELD_BOOSTS
    parts = [F.lit(float(b)) * F.col(f"s_{f}") for f, b in boosts.items()]
    best = F.greatest(*parts)
    if tie:
        best = best + F.lit(tie) * (sum(parts[1:], parts[0]) - best)
    return best


def match_scores(queries: DataFrame, impacts: DataFrame, boosts: dict | None = None,
                 phrases: DataFrame | None = None) -> DataFrame:
    """Q1: ``(query_id, domain, page_id, score)`` for every page matching any term.

    With ``phrases`` (``phrase_impacts`` of the same queries) quoted phrases match
    by adjacency, otherwise by their tokens.

    Queries bound to a site meet the impacts on ``(domain, term)``, the others
    on ``term`` (AQE splits a hot term's partition); one aggregation follows,
    combined map-side, on ``(query_id, domain, page_id)``.
    """
    qt = query_terms(queries, phrases is not None)
    if phrases is not None:
        impacts = impacts.unionByName(phrases, allowMissingColumns=True).na.fill(0.0)
    bound = qt.where("q_domain is not null").withColumn("domain", F.col("q_domain")).join(impacts, ["domain", "term"])
    m = qt.where("q_domain is null").join(impacts, "term").unionByName(bound)
    m = m.select(
        F.when(F.col("q_domain").isNull(), F.concat(F.col("query_id"), F.lit("@"), F.col("domain")))
        .otherwise(F.col("query_id")).alias("query_id"),
        F.col("query_id").alias("base_id"), "domain", "page_id", "req", "proh", "n_req", "qtf",
        (F.col("qtf") * dismax_score(boosts)).alias("s"))
    return combined_scores(m)


PAGE_KEY = ("query_id", "base_id", "domain", "page_id")


def page_sums(m: DataFrame) -> DataFrame:
    """The rows of matched terms added up by query and page: ``s`` and what the clauses' conditions need."""
    return m.groupBy(*PAGE_KEY).agg(
        F.sum("s").alias("s"), F.count(F.when(F.col("req"), 1)).alias("req"), F.max("proh").alias("proh"),
        F.max("n_req").alias("n_req"), F.max(F.col("qtf") > 0).alias("pos"))


def matched_pages(sums: DataFrame) -> DataFrame:
    """Scores of pages from their sums (several rows a page); clauses' conditions applied."""
    g = sums.groupBy(*PAGE_KEY).agg(F.sum("s").alias("score"), F.sum("req").alias("_req"), F.max("proh").alias("_proh"),
                                    F.max("n_req").alias("_nreq"), F.max("pos").alias("_pos"))
    # required terms all present, no prohibited term, at least one scored term
    return g.where((F.col("_req") == F.col("_nreq")) & ~F.col("_proh") & F.col("_pos")).select(*PAGE_KEY, "score")


def combined_scores(m: DataFrame) -> DataFrame:
    """Scores of pages from the rows of their matched terms; clauses' conditions applied."""
    g = page_sums(m)
    return g.where((F.col("req") == F.col("n_req")) & ~F.col("proh") & F.col("pos")).select(*PAGE_KEY, F.col("s").alias("score"))


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Q5: best ``k`` pages per query, ties by page_id; ``rank`` = 1..k.

    ``row_number() <= k`` is planned as a WindowGroupLimit, so each map task
    keeps only its own top k per query before the shuffle.
    """
    # ranked on the score rounded to 9 places: exactly tied pages (copies) must
    # not be reordered by float summation order
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("page_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


HIT_COLUMNS = ["query_id", "base_id", "domain", "rank", "page_id", "url", "title", "score"]


def search(queries: DataFrame, impacts: DataFrame, fields: DataFrame, k: int = TOP_K,
           boosts: dict | None = None, with_highlight: bool = False,
           passages: DataFrame | None = None, phrases: DataFrame | None = None,
           blocks: DataFrame | None = None) -> DataFrame:
    """Q1-Q6 (+Q7/Q8): ``hits(query_id, base_id, domain, rank, page_id, url, title,
    score[, highlight, highlight_str])``; ``base_id`` is the query's own id.

    The hits (k per query) meet the page table in one join on
    ``(domain, page_id)``; highlights need the query terms, joined back on the
    original query id.  Scores come from ``page_search`` (every posting of the query
    terms, block by block).  With ``blocks`` (``build_blocks``, which has the boosts
    in it) only posting blocks that can reach the k-th score are read.
    """
    if blocks is not None:
        from .block_index import block_scores

        scores = block_scores(queries, blocks, impacts, boosts, k)
    else:
        from .page_search import best_pages

        if phrases is not None:
            impacts = impacts.unionByName(phrases, allowMissingColumns=True).na.fill(0.0)
        scores = best_pages(query_terms(queries, phrases is not None), impacts, fields, dismax_score(boosts), k)
    top = top_k(scores, k)
    pages = fields.select("domain", "page_id", "url", "title").where(F.col("url").isNotNull())
    hits = top.join(pages, ["domain", "page_id"])
    if not with_highlight:
        return hits.select(*HIT_COLUMNS)
    # the highlight plan reads the hits three times: materialise them once
    # (k rows per query) instead of re-running the search per read
    hits = cut(hits.select(*HIT_COLUMNS))
    if passages is None:
        # no prepared passages: build them for the hit pages only
        passages = page_passages(fields.join(hits.select("domain", "page_id").distinct(),
                                             ["domain", "page_id"], "left_semi"))
    qterms = queries.select(F.col("query_id").alias("base_id"),
                            F.array_distinct(search_tokens(F.col("query"))).alias("_terms"))
    return _add_highlight_rows(hits, qterms, passages).select(*HIT_COLUMNS, "highlight", "highlight_str")


def _mark(passage, terms):
    runs = F.regexp_extract_all(passage, F.lit(RUN_PATTERN), 0)
    marked = F.transform(runs, lambda r: F.when(F.array_contains(terms, F.lower(r)),
                                                F.concat(F.lit("<mark>"), r, F.lit("</mark>"))).otherwise(r))
    return F.array_join(marked, "")


def _best_passage(text, terms):
    """(matched distinct terms, passage) of the best sentence; first wins ties."""
    sents = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_PATTERN), 0)
    scored = F.transform(sents, lambda s, i: F.struct(
        F.size(F.array_intersect(search_tokens(s), terms)).alias("n"), (-i).alias("neg_pos"),
        s.alias("s")))
    best = F.array_max(scored)
    return F.coalesce(best["n"], F.lit(0)), best["s"]


def _add_highlight(h: DataFrame) -> DataFrame:
    """Q7/Q8: the best sentence of the plaintext (most distinct query terms,
    earliest first) with matched words in ``<mark>``; no match -> the same over
    the full text; none there either -> empty.  All array work inside the row."""
    n1, p1 = _best_passage(F.col("plaintext"), F.col("_terms"))
    n2, p2 = _best_passage(F.col("fulltext"), F.col("_terms"))
    hl = (F.when(n1 > 0, _mark(p1, F.col("_terms")))
          .when(n2 > 0, _mark(p2, F.col("_terms")))
          .otherwise(F.lit("")))
    out = h.withColumn("highlight", hl)
    return out.withColumn("highlight_str", normalise_whitespace_controls(F.col("highlight")))


def page_passages(fields: DataFrame) -> DataFrame:
    """Highlight passages, query independent (built with the index):
    ``(domain, page_id, src, i, s, toks)`` — every sentence of the plaintext
    (src 1) and of the full text (src 2) with its distinct search tokens."""
    srcs = F.explode(F.array(F.struct(F.lit(1).alias("src"), F.coalesce("plaintext", F.lit("")).alias("t")),
                             F.struct(F.lit(2).alias("src"), F.coalesce("fulltext", F.lit("")).alias("t"))))
    x = fields.select("domain", "page_id", srcs.alias("x"))
    x = x.select("domain", "page_id", F.col("x.src").alias("src"),
                 F.posexplode(F.regexp_extract_all(F.col("x.t"), F.lit(SENTENCE_PATTERN), 0)).alias("i", "s"))
    return x.select("domain", "page_id", "src", "i", "s", F.array_distinct(search_tokens(F.col("s"))).alias("toks"))


def _add_highlight_rows(hits: DataFrame, qterms: DataFrame, passages: DataFrame) -> DataFrame:
    """Q7/Q8 with sentences as rows: every sentence of the plaintext (source 1)
    and of the full text (source 2) is scored with built-in array functions;
    the best per hit is ``min(struct(source, -matches, position))`` over the
    matching ones, combined map-side; the winner is marked inside its row."""
    h = hits.join(qterms, "base_id")
    x = h.select("query_id", "rank", "domain", "page_id", "_terms").join(of_keys(passages, hits, "domain", "page_id"), ["domain", "page_id"])
    x = x.select("query_id", "rank", "src", "i", "s",
                 F.size(F.array_intersect(F.col("toks"), F.col("_terms"))).alias("n")).where("n > 0")
    best = x.groupBy("query_id", "rank").agg(F.min(F.struct(F.col("src"), (-F.col("n")).alias("nn"), "i", "s"))
                                             .alias("b"))
    out = h.join(best, ["query_id", "rank"], "left")
    hl = F.when(F.col("b").isNull(), F.lit("")).otherwise(_mark(F.col("b.s"), F.col("_terms")))
    out = out.withColumn("highlight", hl)
    return out.withColumn("highlight_str", normalise_whitespace_controls(F.col("highlight")))


def flat_results(hits: DataFrame) -> DataFrame:
    """Q9: the ungrouped list, by descending score (stable on rank)."""
    return hits.orderBy("query_id", F.desc("score"), "rank")
