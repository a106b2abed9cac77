"""The subpackage's queries for the driver: ``opN_<name>`` with production parameters
over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterscope.llm.texts import table


#: Vocabulary file of the output operator; a parameter of it.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_template_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.chat import format_conversations, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                                                              F.lit(role).alias("role"), F.lit(said).alias("text"))
                                                     for i, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return read_back(format_conversations(rows.unionByName(extra)))


def op7_seekable_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.token_files import token_output

    return token_output(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.wrappers import extract_text

    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.mixing import mixed, volume_targets

    docs = table(spark, sf_dir, "documents")
    placed = mixed(docs.select("doc_id", "source", "text"), volume_targets(docs))
    return placed.select("doc_id", "source", "mix_block", "mix_place", "mix_slot")


OP9_SQL = r"""
WITH RECURSIVE rows AS (SELECT doc_id, source, coalesce(doc_id % 1024, 0) AS chunk, CAST(coalesce(length(text), 0) AS BIGINT) AS size, text FROM documents),
placed AS (SELECT doc_id, source, row_number() OVER o - 1 AS mix_place, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS mix_block
    FROM rows WINDOW o AS (PARTITION BY source ORDER BY chunk, doc_id, text)),
weights AS (SELECT source, row_number() OVER (ORDER BY source) AS i, CAST(floor(sqrt(CAST(sum(size) AS DOUBLE))) AS BIGINT) AS w FROM rows GROUP BY source),
whole AS (SELECT count(*) AS s, sum(w) AS total, greatest(1000, 2 * count(*)) AS q FROM weights),
parts AS (SELECT i, source, s, q, (w * (q - s)) // total AS share, (w * (q - s)) % total AS rest FROM weights, whole),
shares AS (SELECT i, source, q, 1 + share + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= q - s - sum(share) OVER () THEN 1 ELSE 0 END AS a FROM parts),
listed AS (SELECT max(q) AS q, list(a ORDER BY i) AS a FROM shares),
edf AS (
    SELECT -1 AS t, CAST(NULL AS BIGINT) AS pick, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS had FROM listed
    UNION ALL
    SELECT t, pick, list_transform(had, lambda h, i: CASE WHEN i = pick THEN h + 1 ELSE h END) FROM (
        SELECT e.t + 1 AS t, e.had, CAST(list_min(list_filter(list_transform(e.had, lambda h, i: CASE WHEN h < l.a[i] AND (h * l.q) // l.a[i] <= e.t + 1
                 THEN ((h + 1) * l.q + l.a[i] - 1) // l.a[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS BIGINT) AS pick
        FROM edf e, listed l WHERE e.t + 1 < l.q)),
slots AS (SELECT t, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t >= 0)
SELECT p.doc_id, p.source, CAST(p.mix_block AS BIGINT) AS mix_block, p.mix_place, CAST((p.mix_block // s.a) * s.q + slots.t AS BIGINT) AS mix_slot
FROM placed p JOIN shares s USING (source) JOIN slots ON slots.i = s.i AND slots.nth = p.mix_block % s.a
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("digest")


OP12_SQL = r"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
crc AS (SELECT conv_id, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * CAST(3988292384 AS BIGINT)) END), CAST(4294967295 AS BIGINT)) % 4 AS h FROM sizes),
heads AS (SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 20 AS base, least(c.h, coalesce(b.n, 0)) AS got FROM crc c LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % 20),
turns AS (SELECT h.conv_id, o.i, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.base AND o.i < h.h
    UNION ALL SELECT h.conv_id, o.i - h.h + h.got, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.i >= h.h),
whole AS (SELECT conv_id, coalesce(list({'r': role, 't': text} ORDER BY i) FILTER (i IS NOT NULL), []) AS s FROM heads LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ended FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM whole)),
placed AS (SELECT *, min(conv_id) OVER (PARTITION BY d, p) AS node FROM prefixes),
nodes AS (SELECT node, d, count(*) AS n_convs, len(regexp_extract_all(coalesce(any_value(p[-1].t), ''), '[^\x20\x09-\x0D]+')) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM placed GROUP BY node, d),
ups AS (SELECT n.*, a.node AS parent FROM nodes n LEFT JOIN placed a ON a.conv_id = n.node AND a.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM ups WHERE d > 0 GROUP BY ALL),
sums AS (SELECT a.node, a.d, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
    FROM nodes n JOIN placed a ON a.conv_id = n.node AND a.d <= n.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d GROUP BY a.node, a.d)
SELECT u.node AS conv_id, CAST(u.d AS BIGINT) AS depth, u.parent AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, CAST(CASE WHEN u.ends = '' THEN 0 ELSE len(string_split(u.ends, ',')) END AS BIGINT) AS n_ends, sha256(u.ends) AS ends_sha256
FROM ups u JOIN sums s ON s.node = u.node AND s.d = u.d LEFT JOIN kids k ON k.node = u.node AND k.d = u.d
"""


def op13_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clusterscope.llm.sigtree import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


def _component_sql(width: int, columns: str) -> str:
    """DuckDB SQL of the components of shingle sets of ``width`` words that overlap by 85 percent of their union."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^ 	-
]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id{columns}
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""


OP2_SQL = _component_sql(5, ", d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept")
OP13_SQL = _component_sql(4, "")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_cotraining, op2_bbit_minhash, op3_norm_sorted_topk, op4_winnowing, op5_counterfactual, op6_template_compiler,
        op7_seekable_zstd, op8_wrappers, op9_pfair_mix, op10_suffix_dedup, op11_jacobi_davidson, op12_prefix_trie, op13_signature_tree)}


def oracle_sql() -> dict[str, str]:
    return {"op2_bbit_minhash": OP2_SQL, "op4_winnowing": OP4_SQL, "op9_pfair_mix": OP9_SQL, "op12_prefix_trie": OP12_SQL,
            "op13_signature_tree": OP13_SQL}
