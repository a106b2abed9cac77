"""Independent DuckDB SQL for the registered jobs (the correctness oracle).

Written from the operator definitions, not from the Spark plans: the pair
similarity is the literal per-pair TF-IDF (full outer join of the two term
vectors, idf from the pair's own document frequencies) rather than the
closed form; DBSCAN is a recursive reachability CTE; RAKE is scored from its
phrase/word counts.  Views ``pages`` and ``benchmark`` / ``conversations``
are the driver's tables.
"""

from __future__ import annotations

from ..config import (BLOCK_TAGS, ENGLISH_STOPWORDS, FIELD_BOOSTS, HTML_ENTITIES, PUNCTUATION,
                      SEARCH_FIELDS, SIM_FIELDS, SIM_WEIGHTS, TEXT_TAGS)


LINKAGE_METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")
AFFINITY_ROUNDS = 4


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _unescape(x: str) -> str:
    for ent, ch in HTML_ENTITIES:
        x = f"replace({x}, {_q(ent)}, {_q(ch)})"
    return x


SCRIPT = r"(?is)<script(?:[ \t\r\n\f][^>]*)?>.*?</script[ \t\r\n\f]*>"
STYLE = r"(?is)<style(?:[ \t\r\n\f][^>]*)?>.*?</style[ \t\r\n\f]*>"
HEAD = r"(?is)<head(?:[ \t\r\n\f][^>]*)?>.*?</head[ \t\r\n\f]*>"
BLOCK = r"(?i)<(/?(?:" + "|".join(BLOCK_TAGS) + r"))([ \t\r\n\f/>])"
TEXTSEG = r"(?i)^<(?:" + "|".join(TEXT_TAGS) + r")[ \t\r\n\f/>]"
TITLE = r"(?is)<title(?:[ \t\r\n\f][^>]*)?>(.*?)</title[ \t\r\n\f]*>"
SIM_TOK = r"[\p{L}\p{N}_]{2,}"
SEARCH_TOK = r"[\p{L}\p{N}]+"
RAKE_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+"


def fields_cte() -> str:
    """CTE ``fields``: page fields (P2, P6-P11) straight from ``pages``."""
    clean = (f"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
             f"{_q(SCRIPT)}, '', 'g'), {_q(STYLE)}, '', 'g')")
    seg = (f"list_transform(list_filter(string_split(regexp_replace(clean, {_q(BLOCK)}, "
           f"chr(1) || '<\\1\\2', 'g'), chr(1)), lambda s: regexp_matches(s, {_q(TEXTSEG)})), "
           f"lambda s: regexp_replace(s, '<[^>]*>', chr(10), 'g'))")
    pt = _unescape(f"array_to_string({seg}, chr(10))")
    pt = f"regexp_replace({pt}, '[ \\t\\r\\n\\f]*\\n[ \\t\\r\\n\\f]*', chr(10), 'g')"
    pt = f"regexp_replace({pt}, '^\\n+|\\n+$', '', 'g')"
    ft = f"regexp_replace(clean, {_q(HEAD)}, '', 'g')"
    ft = f"regexp_replace({ft}, '(?i)<a[ \\t\\r\\n\\f][^>]*href=\"([^\"]*)\"[^>]*>', ' \\1 ', 'g')"
    ft = f"regexp_replace({ft}, '(?i)<img[ \\t\\r\\n\\f][^>]*alt=\"([^\"]*)\"[^>]*>', ' \\1 ', 'g')"
    ft = _unescape(f"regexp_replace({ft}, '<[^>]*>', ' ', 'g')")
    ft = f"trim(regexp_replace({ft}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
    traw = f"regexp_extract(clean, {_q(TITLE)}, 1)"
    return f"""
pg0 AS (
  SELECT page_id, url, html, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS netloc FROM pages),
pg1 AS (
  SELECT *, regexp_extract(lower(regexp_replace(regexp_replace(netloc, '^[^@]*@', ''), ':[0-9]*$', '')),
                           '([^.]+\\.[^.]+)$', 1) AS domain FROM pg0),
pg2 AS (
  SELECT domain, page_id, url, {clean} AS clean FROM pg1 WHERE strpos(netloc, domain) > 0),
pg3 AS (
  SELECT domain, page_id, url, md5(url) AS url_hash,
    CASE WHEN strpos(url, domain) > 0 THEN substr(url, strpos(url, domain) + 1) ELSE url END AS ut,
    CASE WHEN NOT regexp_matches(clean, '(?i)<title[ \\t\\r\\n\\f/>]') THEN url
         WHEN {traw} = '' OR strpos({traw}, '<') > 0 THEN NULL
         ELSE {_unescape(traw)} END AS title,
    {pt} AS plaintext,
    {ft} AS fulltext,
    row_number() OVER (PARTITION BY domain, url ORDER BY page_id) AS rn
  FROM pg2),
fields AS (
  SELECT domain, page_id, url, url_hash, CASE WHEN ut = '' THEN ' ' ELSE ut END AS url_text,
         title, plaintext, fulltext
  FROM pg3 WHERE rn = 1)"""


def index_ctes() -> str:
    """CTEs ``toks`` (search tokens with positions), ``fstats``, ``impacts``."""
    unions = " UNION ALL ".join(
        f"SELECT domain, page_id, '{f}' AS field, regexp_extract_all(lower(coalesce({f}, '')), "
        f"{_q(SEARCH_TOK)}, 0) AS t FROM fields" for f in SEARCH_FIELDS)
    bm = []
    for f in SEARCH_FIELDS:
        bm.append(f"""coalesce(max(CASE WHEN p.field = '{f}' THEN
            ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.2) /
            (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl)) END), 0.0) AS s_{f}""")
    return f"""
ftok AS ({unions}),
toks AS (
  SELECT domain, page_id, field, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos FROM ftok),
post AS (
  SELECT domain, field, term, page_id, count(*) AS tf, max(dl) AS dl FROM toks
  GROUP BY domain, field, term, page_id),
fstats AS (
  SELECT domain, field, count(*) AS n_docs, avg(len(t)) AS avgdl FROM ftok WHERE len(t) > 0
  GROUP BY domain, field),
dfs AS (SELECT domain, field, term, count(*) AS df FROM post GROUP BY domain, field, term),
impacts AS (
  SELECT p.domain, p.term, p.page_id, {", ".join(bm)}
  FROM post p JOIN dfs d USING (domain, field, term) JOIN fstats s USING (domain, field)
  GROUP BY p.domain, p.term, p.page_id)"""


def hits_ctes(query_source: str = "bench") -> str:
    """CTEs ``qs`` (queries), ``hits`` (top 10 per query and site)."""
    if query_source == "bench":
        qs = "SELECT 'b' || CAST(item_id AS VARCHAR) AS base_id, text AS query FROM benchmark"
    else:
        qs = ("SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS base_id, "
              "text AS query FROM conversations WHERE role = 'user'")
    best = ", ".join(f"{float(FIELD_BOOSTS[f])} * i.s_{f}" for f in SEARCH_FIELDS)
    return f"""
qs AS ({qs}),
qt AS (
  SELECT base_id, term, count(*) AS qtf FROM (
    SELECT base_id, unnest(regexp_extract_all(lower(query), {_q(SEARCH_TOK)}, 0)) AS term FROM qs)
  GROUP BY base_id, term),
sc AS (
  SELECT qt.base_id || '@' || i.domain AS query_id, qt.base_id, i.domain, i.page_id,
         sum(qt.qtf * greatest({best})) AS score
  FROM qt JOIN impacts i USING (term)
  GROUP BY 1, 2, 3, 4),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM sc),
hits AS (
  SELECT r.query_id, r.base_id, r.domain, CAST(r.rank AS INTEGER) AS rank, r.page_id, f.url, f.title, r.score
  FROM ranked r JOIN fields f USING (domain, page_id) WHERE r.rank <= 10)"""


def sim_ctes() -> str:
    """CTEs ``sims`` (the four per-pair TF-IDF cosines of hit pairs) and
    ``dist`` (weighted distance of every hit pair, 1.0 when absent)."""
    src = {"url": "url_text", "title": "title", "fulltext": "fulltext", "plaintext": "plaintext"}
    vec_union = " UNION ALL ".join(
        f"SELECT domain, page_id, '{f}' AS field, unnest(regexp_extract_all(lower({src[f]}), "
        f"{_q(SIM_TOK)}, 0)) AS term FROM fields WHERE {src[f]} IS NOT NULL" for f in SIM_FIELDS)
    cnt = " + ".join(f"(CASE WHEN {src[f]} IS NOT NULL AND len(regexp_extract_all(lower({src[f]}), "
                     f"{_q(SIM_TOK)}, 0)) > 0 THEN 0 ELSE 0 END)" for f in SIM_FIELDS)
    del cnt
    ntok = ", ".join(f"len(regexp_extract_all(lower(coalesce({src[f]}, '')), {_q(SIM_TOK)}, 0)) AS k_{f}"
                     for f in SIM_FIELDS)
    valid = " AND ".join(f"(a.k_{f} > 0 OR b.k_{f} > 0)" for f in SIM_FIELDS)
    pivot = ", ".join(f"coalesce(max(CASE WHEN field = '{f}' THEN sim END), 0.0) AS {f}_sim_score"
                      for f in SIM_FIELDS)
    wsum = " + ".join(f"{SIM_WEIGHTS[f]} * s.{f}_sim_score" for f in SIM_FIELDS)
    return f"""
vec AS (
  SELECT domain, page_id, field, term, count(*) AS tf FROM ({vec_union}) GROUP BY ALL),
pinfo AS (
  SELECT domain, page_id, title IS NOT NULL AS title_ok, {ntok} FROM fields),
hp AS (
  SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, a.url AS url_a, b.url AS url_b,
         a.domain, a.page_id AS pa, b.page_id AS pb
  FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.rank < b.rank
  JOIN pinfo x ON x.domain = a.domain AND x.page_id = a.page_id
  JOIN pinfo y ON y.domain = b.domain AND y.page_id = b.page_id
  WHERE x.title_ok AND y.title_ok AND {valid.replace('a.k_', 'x.k_').replace('b.k_', 'y.k_')}),
va AS (SELECT hp.query_id, hp.rank_a, hp.rank_b, v.field, v.term, v.tf
       FROM hp JOIN vec v ON v.domain = hp.domain AND v.page_id = hp.pa),
vb AS (SELECT hp.query_id, hp.rank_a, hp.rank_b, v.field, v.term, v.tf
       FROM hp JOIN vec v ON v.domain = hp.domain AND v.page_id = hp.pb),
pv AS (
  SELECT coalesce(va.query_id, vb.query_id) AS query_id, coalesce(va.rank_a, vb.rank_a) AS rank_a,
         coalesce(va.rank_b, vb.rank_b) AS rank_b, coalesce(va.field, vb.field) AS field,
         coalesce(va.tf, 0) AS tf1, coalesce(vb.tf, 0) AS tf2
  FROM va FULL OUTER JOIN vb
    ON va.query_id = vb.query_id AND va.rank_a = vb.rank_a AND va.rank_b = vb.rank_b
   AND va.field = vb.field AND va.term = vb.term),
pw AS (
  SELECT *, ln(3.0 / (1 + (CASE WHEN tf1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN tf2 > 0 THEN 1 ELSE 0 END))) + 1
         AS idf FROM pv),
fs AS (
  SELECT query_id, rank_a, rank_b, field,
         CASE WHEN sum((tf1 * idf) * (tf1 * idf)) = 0 OR sum((tf2 * idf) * (tf2 * idf)) = 0 THEN 0.0
              ELSE sum((tf1 * idf) * (tf2 * idf)) /
                   (sqrt(sum((tf1 * idf) * (tf1 * idf))) * sqrt(sum((tf2 * idf) * (tf2 * idf)))) END AS sim
  FROM pw GROUP BY ALL),
sims AS (
  SELECT hp.query_id, hp.rank_a, hp.rank_b, hp.url_a, hp.url_b, {pivot}
  FROM hp LEFT JOIN fs USING (query_id, rank_a, rank_b)
  GROUP BY hp.query_id, hp.rank_a, hp.rank_b, hp.url_a, hp.url_b),
dist AS (
  SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b,
         coalesce(least(1.0, greatest(0.0, 1.0 - ({wsum}))), 1.0) AS d
  FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.rank < b.rank
  LEFT JOIN sims s ON s.query_id = a.query_id AND s.rank_a = a.rank AND s.rank_b = b.rank)"""


def dbscan_ctes(eps: float = 0.4) -> str:
    """CTE ``cids``: DBSCAN (min_samples 2) as reachability over d <= eps, with
    noise relabelled -1, -2, ... in hit order."""
    return f"""
edges AS (
  SELECT query_id, rank_a AS a, rank_b AS b FROM dist WHERE d <= {eps}
  UNION ALL SELECT query_id, rank_b AS a, rank_a AS b FROM dist WHERE d <= {eps}),
reach(query_id, src, dst) AS (
  SELECT query_id, rank, rank FROM hits
  UNION
  SELECT r.query_id, r.src, e.b FROM reach r JOIN edges e ON r.query_id = e.query_id AND r.dst = e.a),
comp AS (SELECT query_id, src AS rank, min(dst) AS root, count(*) AS csize FROM reach GROUP BY 1, 2),
lab AS (
  SELECT query_id, rank, csize > 1 AS clustered, dense_rank() OVER (PARTITION BY query_id, csize > 1 ORDER BY root) - 1 AS c,
         row_number() OVER (PARTITION BY query_id, csize > 1 ORDER BY rank) AS nr
  FROM comp),
cids AS (
  SELECT query_id, rank, CAST(CASE WHEN clustered THEN c ELSE -nr END AS VARCHAR) AS cluster_id FROM lab)"""


def _lance_williams(method: str) -> str:
    """Distance of a cluster z to the merge of s and t, from ``dsv``, ``dtv``, ``dst`` and sizes."""
    s, t, st = "dsv", "dtv", "dst"
    return {
        "single": f"least({s}, {t})", "complete": f"greatest({s}, {t})", "weighted": f"({s} + {t}) / 2",
        "average": f"(ns * {s} + nt * {t}) / (ns + nt)",
        "centroid": f"sqrt(greatest((ns * {s} * {s} + nt * {t} * {t}) / (ns + nt) - ns * nt * {st} * {st} / ((ns + nt) * (ns + nt)), 0))",
        "median": f"sqrt(greatest({s} * {s} / 2 + {t} * {t} / 2 - {st} * {st} / 4, 0))",
        "ward": f"sqrt(greatest(((nv + ns) * {s} * {s} + (nv + nt) * {t} * {t} - nv * {st} * {st}) / (nv + ns + nt), 0))",
    }[method]


def linkage_ctes(method: str, t: float = 0.4, depth: int = 5) -> str:
    """CTE ``cids``: agglomerative merges one per recursion step over lists of pairs and
    sizes, then the inconsistency cut; labels number the clusters in walk order."""
    lw = _lance_williams(method)
    for name, value in (("dsv", "u.dsv"), ("dtv", "u.dtv"), ("dst", "dst"), ("nv", "u.nv")):
        lw = lw.replace(name, value)
    far = "list_filter(pairs, lambda p: p.a = least({e}, z.id) AND p.b = greatest({e}, z.id))[1].d"
    return f"""
lkin AS (
  SELECT h.query_id, h.n, coalesce(p.pairs, []) AS pairs FROM (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) h
  LEFT JOIN (SELECT query_id, list({{'a': CAST(rank_a - 1 AS BIGINT), 'b': CAST(rank_b - 1 AS BIGINT), 'd': CAST(d AS DOUBLE)}}) AS pairs FROM dist GROUP BY query_id) p
  USING (query_id)),
lk AS (
  SELECT query_id, n, CAST(0 AS BIGINT) AS step, pairs, list_transform(range(n), lambda i: {{'id': i, 'n': CAST(1 AS BIGINT)}}) AS sizes,
         CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS h FROM lkin
  UNION ALL
  SELECT query_id, n, step + 1,
         list_concat(list_filter(pairs, lambda p: p.a <> s AND p.a <> t AND p.b <> s AND p.b <> t),
                     list_transform(ups, lambda u: {{'a': u.id, 'b': n + step, 'd': CAST({lw} AS DOUBLE)}})),
         list_concat(list_filter(sizes, lambda z: z.id <> s AND z.id <> t), [{{'id': n + step, 'n': ns + nt}}]), s, t, dst
  FROM (
    SELECT query_id, n, step, pairs, sizes, best.a AS s, best.b AS t, best.raw AS dst,
           list_filter(sizes, lambda z: z.id = best.a)[1].n AS ns, list_filter(sizes, lambda z: z.id = best.b)[1].n AS nt,
           list_transform(list_filter(sizes, lambda z: z.id <> best.a AND z.id <> best.b),
             lambda z: {{'id': z.id, 'nv': z.n, 'dsv': {far.format(e='best.a')}, 'dtv': {far.format(e='best.b')}}}) AS ups
    FROM (SELECT *, list_min(list_transform(pairs, lambda p: {{'k': round(p.d, 9), 'a': p.a, 'b': p.b, 'raw': p.d}})) AS best
          FROM lk WHERE step < n - 1))),
mg AS (SELECT query_id, n + step - 1 AS node, l, r, h FROM lk WHERE step > 0),
dn AS (
  SELECT query_id, node AS top, node, 1 AS lvl FROM mg
  UNION ALL
  SELECT d.query_id, d.top, c.node, d.lvl + 1 FROM dn d JOIN mg p ON p.query_id = d.query_id AND p.node = d.node
  JOIN mg c ON c.query_id = p.query_id AND c.node IN (p.l, p.r) WHERE d.lvl < {depth}),
cf AS (
  SELECT m.query_id, m.node, CASE WHEN coalesce(max(s.sd), 0) > 1e-9 THEN (m.h - max(s.mean)) / max(s.sd) ELSE 0 END AS coef
  FROM mg m JOIN (SELECT d.query_id, d.top, avg(x.h) AS mean, stddev_samp(x.h) AS sd FROM dn d
                  JOIN mg x ON x.query_id = d.query_id AND x.node = d.node GROUP BY d.query_id, d.top) s
  ON s.query_id = m.query_id AND s.top = m.node GROUP BY m.query_id, m.node, m.h),
al AS (
  SELECT query_id, node AS top, l AS child, '0' AS side, l AS at FROM mg UNION ALL SELECT query_id, node, r, '1', r FROM mg
  UNION ALL
  SELECT a.query_id, a.top, a.child, a.side, u.x FROM al a
  JOIN (SELECT query_id, node, unnest([l, r]) AS x FROM mg) u ON u.query_id = a.query_id AND u.node = a.at),
ok AS (
  SELECT c.query_id, c.node FROM cf c LEFT JOIN al a ON a.query_id = c.query_id AND a.top = c.node
  LEFT JOIN cf w ON w.query_id = a.query_id AND w.node = a.at
  GROUP BY c.query_id, c.node, c.coef HAVING round(greatest(c.coef, max(coalesce(w.coef, 0))), 9) <= {t}),
lf AS (
  SELECT h.query_id, h.rank, coalesce(string_agg(a.side, '' ORDER BY a.top DESC), '') AS path,
         coalesce(max(a.top) FILTER (o.node IS NOT NULL), -h.rank) AS owner
  FROM hits h LEFT JOIN al a ON a.query_id = h.query_id AND a.at = h.rank - 1
  LEFT JOIN ok o ON o.query_id = a.query_id AND o.node = a.top GROUP BY h.query_id, h.rank),
cids AS (
  SELECT query_id, rank, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS VARCHAR) AS cluster_id
  FROM (SELECT *, min(path) OVER (PARTITION BY query_id, owner) AS first FROM lf))"""


def affinity_ctes(rounds: int) -> str:
    """CTE ``aff{rounds}``: messages after so many damped rounds, every maximum and sum by a
    self-join over the other candidates or points."""
    out = ["""
whole AS (
  SELECT query_id, rank_a AS i, rank_b AS k, 1.0 - d AS s FROM dist UNION ALL SELECT query_id, rank_b, rank_a, 1.0 - d FROM dist
  UNION ALL SELECT query_id, rank, rank, 1.0 FROM hits),
aff0 AS (
  SELECT w.query_id, w.i, w.k, CASE WHEN w.i = w.k THEN p.pref ELSE w.s END - 1e-9 * w.k AS s, 0.0 AS r, 0.0 AS a
  FROM whole w JOIN (SELECT query_id, median(s) AS pref FROM whole GROUP BY query_id) p USING (query_id))"""]
    for j in range(1, rounds + 1):
        out.append(f"""
resp{j} AS (
  SELECT m.query_id, m.i, m.k, any_value(m.s) AS s, any_value(m.a) AS a,
         CASE WHEN max(o.a + o.s) IS NULL THEN any_value(m.r) ELSE 0.5 * any_value(m.r) + 0.5 * (any_value(m.s) - max(o.a + o.s)) END AS r
  FROM aff{j - 1} m LEFT JOIN aff{j - 1} o ON o.query_id = m.query_id AND o.i = m.i AND o.k <> m.k GROUP BY m.query_id, m.i, m.k),
aff{j} AS (
  SELECT m.query_id, m.i, m.k, any_value(m.s) AS s, any_value(m.r) AS r,
         0.5 * any_value(m.a) + 0.5 * CASE WHEN m.i = m.k THEN sum(CASE WHEN o.i <> m.k THEN greatest(o.r, 0) ELSE 0 END)
           ELSE least(0, max(CASE WHEN o.i = m.k THEN o.r END) + sum(CASE WHEN o.i <> m.k AND o.i <> m.i THEN greatest(o.r, 0) ELSE 0 END)) END AS a
  FROM resp{j} m JOIN resp{j} o ON o.query_id = m.query_id AND o.k = m.k GROUP BY m.query_id, m.i, m.k)""")
    return ",".join(out)


def cluster_agg_ctes() -> str:
    return """
clus AS (
  SELECT h.query_id, h.domain, c.cluster_id, count(*) AS size, min(h.rank) AS first_rank,
         string_agg(CAST(h.rank AS VARCHAR), ',' ORDER BY h.rank) AS members,
         max(h.score) AS score_max, median(h.score) AS score_median, sum(h.score) AS score_sum
  FROM hits h JOIN cids c USING (query_id, rank)
  GROUP BY h.query_id, h.domain, c.cluster_id)"""


def rake_ctes() -> str:
    """CTE ``summ``: RAKE labels of the clusters in ``cids``."""
    stop = ", ".join(_q(w) for w in list(ENGLISH_STOPWORDS) + list(PUNCTUATION))
    dw = ("list_distinct(list_concat(list_concat("
          "list_filter(regexp_split_to_array(parts, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''), "
          "list_filter(regexp_split_to_array(words, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')), "
          "list_filter(regexp_split_to_array(words2, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')))")
    return f"""
ctext AS (
  SELECT h.query_id, c.cluster_id, h.domain,
         string_agg(substr(coalesce(f.plaintext, ''), 1, 10000), chr(10) ORDER BY h.rank) AS text
  FROM hits h JOIN cids c USING (query_id, rank) JOIN fields f ON f.domain = h.domain AND f.page_id = h.page_id
  GROUP BY h.query_id, c.cluster_id, h.domain),
dom0 AS (SELECT DISTINCT domain, replace(regexp_extract(domain, '^(.*)\\.[^.]*$', 1), '.', ' ') AS parts FROM ctext),
dom1 AS (SELECT domain, parts, regexp_replace(parts, '[^a-zA-Z0-9]+', ' ', 'g') AS words FROM dom0),
dom2 AS (SELECT domain, parts, words, regexp_replace(words, '([0-9]+)', ' ' || chr(1) || ' ', 'g') AS words2 FROM dom1),
dws AS (SELECT domain, {dw} AS dw FROM dom2),
cphr AS (
  SELECT t.query_id, t.cluster_id,
    list_distinct(list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(
      regexp_extract_all(lower(t.text), {_q(RAKE_TOK)}, 0),
      lambda k: CASE WHEN k IN ({stop}) OR list_contains(d.dw, k) THEN '' ELSE k END), ' '), ' {{2,}}'),
      lambda p: trim(p)), lambda p: p <> '')) AS phrases
  FROM ctext t JOIN dws d USING (domain)),
phr AS (SELECT query_id, cluster_id, unnest(phrases) AS phrase FROM cphr),
pwords AS (
  SELECT query_id, cluster_id, phrase, len(string_split(phrase, ' ')) AS plen,
         unnest(string_split(phrase, ' ')) AS w FROM phr),
wst AS (SELECT query_id, cluster_id, w, count(*) AS freq, sum(plen) AS degree FROM pwords GROUP BY ALL),
psc AS (
  SELECT p.query_id, p.cluster_id, p.phrase, sum(CAST(s.degree AS DOUBLE) / s.freq) AS score
  FROM pwords p JOIN wst s USING (query_id, cluster_id, w) GROUP BY ALL),
ptop AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY round(score, 9) DESC, phrase DESC) AS prank
    FROM psc) WHERE prank <= 20),
ncl AS (SELECT query_id, count(DISTINCT cluster_id) AS nc FROM cids GROUP BY query_id),
cw AS (
  SELECT w.query_id, list(w.w) AS common FROM (
    SELECT query_id, w, count(*) AS cnt FROM (
      SELECT DISTINCT query_id, cluster_id, unnest(string_split(phrase, ' ')) AS w FROM ptop)
    GROUP BY query_id, w) w JOIN ncl USING (query_id)
  WHERE w.cnt >= greatest(2.0, ncl.nc / 2.0) AND regexp_full_match(w.w, '[\\p{{L}}\\p{{N}}_]+')
  GROUP BY w.query_id),
kept AS (
  SELECT p.query_id, p.cluster_id, p.prank,
         array_to_string(list_transform(string_split(p.phrase, ' '),
           lambda x: CASE WHEN list_contains(coalesce(cw.common, []), x) THEN '' ELSE x END), ' ') AS k
  FROM ptop p LEFT JOIN cw USING (query_id)),
lab0 AS (
  SELECT query_id, cluster_id,
         regexp_replace(string_agg(k, ', ' ORDER BY prank), '(^,+)|(,+$)|([^0-9A-Za-z]+,+)', '', 'g') AS s
  FROM kept GROUP BY query_id, cluster_id),
summ AS (
  SELECT query_id, cluster_id,
         CASE WHEN length(s) > 50 AND strpos(substr(s, 51), ',') > 0
              THEN substr(s, 1, 50 + strpos(substr(s, 51), ',') - 1) ELSE s END AS summary
  FROM lab0)"""


def _canon(h: str, base: str) -> str:
    """SQL of the link canonicalisation (resolve, drop fragment, sort query)."""
    hh = f"trim(regexp_replace({h}, '#.*$', ''))"
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    bpath = f"regexp_replace(regexp_replace({base}, '[?#].*$', ''), '/[^/]*$', '/')"
    bdir = (f"CASE WHEN regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/.*)?$', 1) = '' "
            f"THEN {origin} || '/' ELSE {bpath} END")
    ab = (f"CASE WHEN regexp_matches({hh}, '^([A-Za-z][A-Za-z0-9+.-]*):') THEN {hh} "
          f"WHEN starts_with({hh}, '//') THEN {scheme} || ':' || {hh} "
          f"WHEN starts_with({hh}, '/') THEN {origin} || {hh} "
          f"WHEN starts_with({hh}, '?') THEN regexp_replace({base}, '[?#].*$', '') || {hh} "
          f"WHEN {hh} = '' THEN regexp_replace({base}, '#.*$', '') "
          f"ELSE {bdir} || {hh} END")
    path = f"regexp_extract({ab}, '^([^?]*)', 1)"
    sq = (f"array_to_string(list_sort(list_filter(string_split(regexp_extract({ab}, '\\?(.*)$', 1), '&'), "
          f"lambda x: x <> '')), '&')")
    return f"(CASE WHEN {sq} = '' THEN {path} ELSE {path} || '?' || {sq} END)"


def links_ctes() -> str:
    clean = (f"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
             f"{_q(SCRIPT)}, '', 'g'), {_q(STYLE)}, '', 'g')")
    return f"""
lp0 AS (
  SELECT page_id, url, regexp_extract(lower(regexp_replace(regexp_replace(
           regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')),
           '([^.]+\\.[^.]+)$', 1) AS domain, {clean} AS clean FROM pages),
lp1 AS (
  SELECT domain, page_id, url, unnest(regexp_extract_all(clean, '(?i)<a[ \\t\\r\\n\\f][^>]*href="([^"]*)"', 1)) AS href
  FROM lp0),
lp2 AS (
  SELECT domain, page_id AS src_page_id, {_canon('url', 'url')} AS src, {_canon('href', 'url')} AS dst FROM lp1),
links AS (
  SELECT DISTINCT domain, src_page_id, src, dst FROM lp2
  WHERE regexp_matches(lower(dst), '^https?://')
    AND strpos(regexp_extract(dst, '^[^:/?#]+://([^/?#]*)', 1), domain) > 0)"""


def corpus_ctes(eps: float = 0.1) -> str:
    """CTE ``cdb``: corpus DBSCAN (min_samples 2) from ALL page pairs of a site
    (literal per-pair TF-IDF), components by recursive reachability."""
    src = {"url": "url_text", "title": "title", "fulltext": "fulltext", "plaintext": "plaintext"}
    vec_union = " UNION ALL ".join(
        f"SELECT domain, page_id, '{f}' AS field, unnest(regexp_extract_all(lower({src[f]}), "
        f"{_q(SIM_TOK)}, 0)) AS term FROM fields WHERE {src[f]} IS NOT NULL" for f in SIM_FIELDS)
    ntok = ", ".join(f"len(regexp_extract_all(lower(coalesce({src[f]}, '')), {_q(SIM_TOK)}, 0)) AS k_{f}"
                     for f in SIM_FIELDS)
    valid = " AND ".join(f"(x.k_{f} > 0 OR y.k_{f} > 0)" for f in SIM_FIELDS)
    wsum = " + ".join(f"{SIM_WEIGHTS[f]} * coalesce(max(CASE WHEN field = '{f}' THEN sim END), 0.0)"
                      for f in SIM_FIELDS)
    return f"""
cvec AS (
  SELECT domain, page_id, field, term, count(*) AS tf FROM ({vec_union}) GROUP BY ALL),
cinfo AS (SELECT domain, page_id, title IS NOT NULL AS title_ok, {ntok} FROM fields),
cp AS (
  SELECT x.domain, x.page_id AS a, y.page_id AS b FROM cinfo x JOIN cinfo y
    ON x.domain = y.domain AND x.page_id < y.page_id
  WHERE x.title_ok AND y.title_ok AND {valid}),
cva AS (SELECT cp.domain, cp.a, cp.b, v.field, v.term, v.tf FROM cp JOIN cvec v ON v.domain = cp.domain AND v.page_id = cp.a),
cvb AS (SELECT cp.domain, cp.a, cp.b, v.field, v.term, v.tf FROM cp JOIN cvec v ON v.domain = cp.domain AND v.page_id = cp.b),
cpv AS (
  SELECT coalesce(cva.domain, cvb.domain) AS domain, coalesce(cva.a, cvb.a) AS a, coalesce(cva.b, cvb.b) AS b,
         coalesce(cva.field, cvb.field) AS field, coalesce(cva.tf, 0) AS tf1, coalesce(cvb.tf, 0) AS tf2
  FROM cva FULL OUTER JOIN cvb ON cva.domain = cvb.domain AND cva.a = cvb.a AND cva.b = cvb.b
   AND cva.field = cvb.field AND cva.term = cvb.term),
cpw AS (SELECT *, ln(3.0 / (1 + (CASE WHEN tf1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN tf2 > 0 THEN 1 ELSE 0 END))) + 1 AS idf FROM cpv),
cfs AS (
  SELECT domain, a, b, field,
         CASE WHEN sum((tf1 * idf) * (tf1 * idf)) = 0 OR sum((tf2 * idf) * (tf2 * idf)) = 0 THEN 0.0
              ELSE sum((tf1 * idf) * (tf2 * idf)) /
                   (sqrt(sum((tf1 * idf) * (tf1 * idf))) * sqrt(sum((tf2 * idf) * (tf2 * idf)))) END AS sim
  FROM cpw GROUP BY ALL),
cd AS (SELECT domain, a, b, least(1.0, greatest(0.0, 1.0 - ({wsum}))) AS d FROM cfs GROUP BY domain, a, b),
ce AS (SELECT domain, a, b FROM cd WHERE d <= {eps} UNION ALL SELECT domain, b, a FROM cd WHERE d <= {eps}),
creach(domain, src, dst) AS (
  SELECT DISTINCT domain, a, a FROM ce
  UNION
  SELECT r.domain, r.src, e.b FROM creach r JOIN ce e ON e.domain = r.domain AND e.a = r.dst),
cdb AS (
  SELECT f.domain, f.page_id, coalesce(c.root, -1) AS cluster
  FROM fields f LEFT JOIN (SELECT domain, src AS page_id, min(dst) AS root FROM creach GROUP BY 1, 2) c
    ON c.domain = f.domain AND c.page_id = f.page_id)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def oracle_sql() -> dict[str, str]:
    F = fields_cte()
    I = index_ctes()
    H = hits_ctes("bench")
    S = sim_ctes()
    D = dbscan_ctes()
    C = cluster_agg_ctes()
    K = rake_ctes()
    out = {}
    L = links_ctes()
    out["page_links"] = _with(L) + """
SELECT domain, src_page_id, src, dst FROM links"""
    out["reachable_pages"] = _with(L) + f"""
,
pu AS (SELECT DISTINCT domain, {_canon('url', 'url')} AS u FROM lp0),
st AS (SELECT domain, {_canon('url', 'url')} AS start FROM (
         SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS r FROM lp0) WHERE r = 1),
e AS (SELECT DISTINCT domain, src, dst FROM links),
reach(domain, url, depth) AS (
  SELECT domain, start, 0 FROM st
  UNION
  SELECT r.domain, e.dst, r.depth + 1 FROM reach r JOIN e ON e.domain = r.domain AND e.src = r.url
  WHERE r.depth < 64),
best AS (SELECT domain, url, min(depth) AS depth FROM reach GROUP BY ALL)
SELECT b.domain, b.url, CAST(b.depth AS INTEGER) AS depth, pu.u IS NOT NULL AS is_page,
       (pu.u IS NOT NULL AND (b.depth > 0 OR EXISTS (SELECT 1 FROM e WHERE e.domain = b.domain AND e.dst = b.url)))
       AS saved
FROM best b LEFT JOIN pu ON pu.domain = b.domain AND pu.u = b.url"""
    keyq = """
pk0 AS (
  SELECT domain, page_id, url, url_encode(url) AS q FROM pg1),
pk AS (
  SELECT domain, page_id, url,
         CASE WHEN length(q) > 210 THEN substr(q, 1, 200) || substr(CAST(row_number() OVER (
              PARTITION BY domain, length(q) > 210 ORDER BY page_id) - 1 AS VARCHAR), 1, 10) ELSE q END AS page_key
  FROM pk0)"""
    out["page_keys"] = _with(F, keyq) + """
SELECT domain, page_id, url, page_key FROM pk"""
    out["urlmap"] = _with(F, keyq) + """
SELECT domain, url, page_key AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY domain, page_id) AS r FROM pk) WHERE r = 1"""
    out["urlmap_recrawl"] = _with(F, keyq) + """
SELECT domain, url, 'v2/' || page_key AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY domain DESC, page_id DESC) AS r FROM pk) WHERE r = 1"""
    store = """
store AS (
  SELECT least(md5(url_a), md5(url_b)) AS url1_hash, greatest(md5(url_a), md5(url_b)) AS url2_hash,
         max(CASE WHEN md5(url_a) <= md5(url_b) THEN url_a ELSE url_b END) AS url1,
         max(CASE WHEN md5(url_a) <= md5(url_b) THEN url_b ELSE url_a END) AS url2,
         """ + ", ".join(f"max({f}_sim_score) AS {f}_sim_score" for f in SIM_FIELDS) + """
  FROM sims GROUP BY 1, 2)"""
    out["similarity_store"] = _with(F, I, H, S, store) + """
SELECT url1_hash, url2_hash, url1, url2, """ + ", ".join(
        f"round({f}_sim_score, 6) AS {f}_sim_score" for f in SIM_FIELDS) + " FROM store"
    out["similarity_upsert"] = _with(F, I, H, S) + """
,
lead AS (SELECT DISTINCT least(url_a, url_b) AS u, greatest(url_a, url_b) AS v FROM sims WHERE rank_a = 1)
SELECT query_id, rank_a, rank_b, """ + ", ".join(
        f"round(CASE WHEN lead.u IS NULL THEN {f}_sim_score ELSE -{f}_sim_score END, 6) + 0.0 AS {f}_sim_score" for f in SIM_FIELDS) + """
FROM sims LEFT JOIN lead ON lead.u = least(url_a, url_b) AND lead.v = greatest(url_a, url_b)"""
    out["similarity_scan"] = _with(F, I, H, S) + """
SELECT query_id, rank_a, rank_b, round(d, 6) AS d FROM dist"""
    out["corpus_dbscan"] = _with(F, corpus_ctes(0.1)) + """
SELECT domain, page_id, CAST(cluster AS BIGINT) AS cluster FROM cdb"""
    out["page_fields"] = _with(F) + """
SELECT domain, page_id, url, url_hash, url_text, title, plaintext, fulltext FROM fields"""
    out["incremental_prepare"] = out["page_fields"]
    out["postings"] = _with(F, I) + """
SELECT domain, field, term, page_id, count(*) AS tf, CAST(max(dl) AS INTEGER) AS dl,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM toks GROUP BY domain, field, term, page_id"""
    out["field_stats"] = _with(F, I) + """
SELECT domain, field, n_docs, round(avgdl, 6) AS avgdl FROM fstats"""
    out["bm25_impacts"] = _with(F, I) + """
SELECT domain, term, page_id, round(s_title, 6) AS s_title, round(s_plaintext, 6) AS s_plaintext,
       round(s_fulltext, 6) AS s_fulltext FROM impacts"""
    out["search_hits"] = _with(F, I, H) + """
SELECT query_id, domain, rank, page_id, url, title, round(score, 6) AS score FROM hits"""
    out["search_top_k"] = out["search_hits"]
    out["term_vectors"] = _with(F) + f"""
,
tv AS (SELECT domain, page_id, term, count(*) AS tf FROM (
    SELECT domain, page_id, unnest(regexp_extract_all(lower(coalesce(fulltext, '')), {_q(SEARCH_TOK)}, 0)) AS term FROM fields) GROUP BY ALL)
SELECT domain, page_id, term, CAST(tf AS DOUBLE) AS tf, round(CAST(tf AS DOUBLE) / count(*) OVER (PARTITION BY domain, term), 6) AS tf_idf FROM tv"""
    clause = ", ".join(f"{float(FIELD_BOOSTS[f])} * i.s_{f}" for f in SEARCH_FIELDS)
    out["search_clauses"] = _with(F, I) + f"""
,
qw AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS base_id, regexp_extract_all(lower(text), {_q(SEARCH_TOK)}, 0) AS w FROM benchmark),
qc AS (SELECT base_id, w[1] AS must, w[-1] AS never, unnest(list_concat([w[1]], w)) AS term FROM qw),
qn AS (SELECT base_id, any_value(must) AS must, any_value(never) AS never, term, count(*) AS qtf FROM qc GROUP BY base_id, term),
sc AS (
  SELECT q.base_id, i.domain, i.page_id, sum(q.qtf * greatest({clause})) AS score, bool_or(q.term = q.must) AS has, bool_or(q.term = q.never) AS bad
  FROM qn q JOIN impacts i USING (term) GROUP BY q.base_id, i.domain, i.page_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY base_id, domain ORDER BY round(score, 9) DESC, page_id) AS rank FROM sc WHERE has AND NOT bad)
SELECT r.base_id || '@' || r.domain AS query_id, r.domain, CAST(r.rank AS INTEGER) AS rank, r.page_id, f.url, round(r.score, 6) AS score
FROM ranked r JOIN fields f USING (domain, page_id) WHERE r.rank <= 10"""
    best = ", ".join(f"{float(FIELD_BOOSTS[f])} * coalesce(max(CASE WHEN field = '{f}' THEN s END), 0.0)" for f in SEARCH_FIELDS)
    best1 = ", ".join(f"{float(FIELD_BOOSTS[f])} * i.s_{f}" for f in SEARCH_FIELDS)
    out["search_phrases"] = _with(F, I) + f"""
,
qs AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS base_id, regexp_extract_all(lower(text), {_q(SEARCH_TOK)}, 0) AS w FROM benchmark),
pairs AS (SELECT base_id, w[1] AS t1, w[2] AS t2 FROM qs WHERE len(w) > 1),
one AS (SELECT base_id, term, count(*) AS qtf FROM (
    SELECT base_id, unnest(w) AS term FROM qs UNION ALL SELECT base_id, w[1] FROM qs WHERE len(w) = 1) GROUP BY base_id, term),
adj AS (
  SELECT p.base_id, a.domain, a.field, a.page_id, a.dl, count(*) AS tf, any_value(p.t1) AS t1, any_value(p.t2) AS t2
  FROM pairs p JOIN toks a ON a.term = p.t1
  JOIN toks b ON b.term = p.t2 AND b.domain = a.domain AND b.field = a.field AND b.page_id = a.page_id AND b.pos = a.pos + 1
  GROUP BY p.base_id, a.domain, a.field, a.page_id, a.dl),
ps AS (
  SELECT j.base_id, j.domain, j.page_id, j.field,
         (ln(1 + (s.n_docs - d1.df + 0.5) / (d1.df + 0.5)) + ln(1 + (s.n_docs - d2.df + 0.5) / (d2.df + 0.5)))
         * (j.tf * 2.2) / (j.tf + 1.2 * (0.25 + 0.75 * j.dl / s.avgdl)) AS s
  FROM adj j JOIN fstats s USING (domain, field)
  JOIN dfs d1 ON d1.domain = j.domain AND d1.field = j.field AND d1.term = j.t1
  JOIN dfs d2 ON d2.domain = j.domain AND d2.field = j.field AND d2.term = j.t2),
sc AS (
  SELECT base_id, domain, page_id, sum(s) AS score FROM (
    SELECT o.base_id, i.domain, i.page_id, o.qtf * greatest({best1}) AS s FROM one o JOIN impacts i USING (term)
    UNION ALL
    SELECT base_id, domain, page_id, greatest({best}) AS s FROM ps GROUP BY base_id, domain, page_id)
  GROUP BY base_id, domain, page_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY base_id, domain ORDER BY round(score, 9) DESC, page_id) AS rank FROM sc)
SELECT r.base_id || '@' || r.domain AS query_id, r.domain, CAST(r.rank AS INTEGER) AS rank, r.page_id, f.url, round(r.score, 6) AS score
FROM ranked r JOIN fields f USING (domain, page_id) WHERE r.rank <= 10"""
    sent = r"[^.!?\n]+[.!?]*"
    run = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
    out["search_highlights"] = _with(F, I, H) + f"""
,
qterm AS (SELECT base_id, list_distinct(regexp_extract_all(lower(query), {_q(SEARCH_TOK)}, 0)) AS terms FROM qs),
hl0 AS (
  SELECT h.query_id, h.rank, q.terms, f.plaintext, f.fulltext
  FROM hits h JOIN qterm q USING (base_id) JOIN fields f ON f.domain = h.domain AND f.page_id = h.page_id),
ps AS (
  SELECT query_id, rank, terms, 1 AS src, unnest(regexp_extract_all(coalesce(plaintext, ''), {_q(sent)}, 0)) AS s,
         unnest(range(len(regexp_extract_all(coalesce(plaintext, ''), {_q(sent)}, 0)))) AS i FROM hl0
  UNION ALL
  SELECT query_id, rank, terms, 2 AS src, unnest(regexp_extract_all(coalesce(fulltext, ''), {_q(sent)}, 0)) AS s,
         unnest(range(len(regexp_extract_all(coalesce(fulltext, ''), {_q(sent)}, 0)))) AS i FROM hl0),
psn AS (SELECT *, len(list_intersect(regexp_extract_all(lower(s), {_q(SEARCH_TOK)}, 0), terms)) AS n FROM ps),
bsel AS (
  SELECT query_id, rank, s, terms FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY src, n DESC, i) AS r FROM psn WHERE n > 0)
  WHERE r = 1),
hl AS (
  SELECT h.query_id, h.rank, h.page_id,
         coalesce(array_to_string(list_transform(regexp_extract_all(b.s, {_q(run)}, 0),
           lambda r: CASE WHEN list_contains(b.terms, lower(r)) THEN '<mark>' || r || '</mark>' ELSE r END), ''), '')
         AS highlight
  FROM hits h LEFT JOIN bsel b USING (query_id, rank))
SELECT query_id, rank, page_id, highlight,
       translate(highlight, chr(9) || chr(10) || chr(13) || chr(12) || chr(11), '     ') AS highlight_str FROM hl"""
    out["flat_search"] = _with(F, I, hits_ctes("conv")) + """
SELECT query_id, domain, rank, page_id, url, round(score, 6) AS score FROM hits"""
    out["hit_similarity"] = _with(F, I, H, S) + """
SELECT query_id, rank_a, rank_b, url_a, url_b, """ + ", ".join(
        f"round({f}_sim_score, 6) AS {f}_sim_score" for f in SIM_FIELDS) + " FROM sims"
    out["hit_distances"] = _with(F, I, H, S) + """
SELECT query_id, rank_a, rank_b, round(d, 6) AS d FROM dist"""
    out["dbscan_labels"] = _with(F, I, H, S, D) + """
SELECT query_id, rank, cluster_id FROM cids"""
    ranked = """
SELECT query_id, domain,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({m}, 9) DESC, first_rank) AS INTEGER)
         AS cluster_rank,
       cluster_id, size, first_rank, members, round(score_max, 6) AS score_max,
       round(score_median, 6) AS score_median, round(score_sum, 6) AS score_sum{extra}
FROM clus{join}"""
    out["grouped_search"] = _with(F, I, H, S, D, C, K) + ranked.format(
        m="score_max", extra=", coalesce(summ.summary, '') AS summary",
        join=" LEFT JOIN summ USING (query_id, cluster_id)")
    out["rank_median_score"] = _with(F, I, H, S, D, C) + ranked.format(m="score_median", extra="", join="")
    out["rank_sum_score"] = _with(F, I, H, S, D, C) + ranked.format(m="score_sum", extra="", join="")
    for method in LINKAGE_METHODS:
        out[f"cluster_linkage_{method}"] = _with(F, I, H, S, linkage_ctes(method), C) + ranked.format(m="score_max", extra="", join="")
    out["affinity_messages"] = _with(F, I, H, S, affinity_ctes(AFFINITY_ROUNDS)) + f"""
SELECT query_id, i AS rank, k AS candidate, round(r, 6) AS responsibility, round(a, 6) AS availability FROM aff{AFFINITY_ROUNDS}"""
    out["rake_labels"] = _with(F, I, H, S, D, K) + """
SELECT query_id, cluster_id, summary FROM summ"""
    return out
