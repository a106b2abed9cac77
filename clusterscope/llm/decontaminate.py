"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``SPAN`` words holds ``SPAN - GRAM + 1`` word grams; the smallest gram
hash of each such window is a fingerprint, so a document and a benchmark
item that share ``SPAN`` words share a fingerprint at the same place of
the span.  Fingerprints are joined on their hash; a match fixes the item's offset
in the document (its diagonal), along which the words themselves are then
compared.  Items shorter than a span are matched by their whole length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterscope.llm.texts import with_text_key
from clusterscope.session import cut

SPAN = 10
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ONE_BYTE_WORD = r"[a-z0-9\uFFFD]+"        # the same in texts of one-byte characters, or of bytes that are none, and faster
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE_BITS = 30              # of a packed fingerprint; the rest is the gram's hash


def words(text: Column) -> Column:
    """Words of the text, with A-Z (and no other letters) in lower case; none if it is null."""
    one_byte = F.octet_length(text) == F.char_length(text)
    found = F.when(one_byte, F.regexp_extract_all(F.lower(text), F.lit(ONE_BYTE_WORD), F.lit(0))).otherwise(
        F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def fingerprints(rows: DataFrame, gram: int, span: int) -> DataFrame:
    """``rows`` with their ``words`` array replaced by one row per fingerprint: print, place.

    The packed number of a gram is its hash above its place, so the least number
    of a window is its least hash, leftmost."""
    grams = F.transform(
        F.slice("hashes", 1, F.greatest(F.size("hashes") - (gram - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get("hashes", i + t) for t in range(1, gram))).bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i))
    width = span - gram + 1
    least = F.array_distinct(F.transform(
        F.slice("grams", 1, F.greatest(F.size("grams") - (width - 1), F.lit(0))),
        lambda x, i: F.least(x, *(F.get("grams", i + t) for t in range(1, width))))) if width > 1 else F.col("grams")
    keep = [c for c in rows.columns if c != "words"]
    return (rows.where(F.size("words") >= span)
            .select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
            .select(*keep, grams.alias("grams")).select(*keep, F.explode(least).alias("packed"))
            .select(*keep, F.shiftrightunsigned("packed", PLACE_BITS).alias("print"),
                    F.col("packed").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place")))


def _windows_on(diagonal: Column, item: Column, doc: Column, span: Column) -> Column:
    """Places in the document of the item's windows that stand there on this diagonal."""
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal) - span
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, lambda j: F.slice(item, j + 1, span) == F.slice(doc, diagonal + j + 1, span)),
                       lambda j: diagonal + j)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Words of each document that stand in an occurrence of a benchmark window.

    A window is ``span`` consecutive words of an item, or a shorter item as a
    whole.  One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_words, n_hit, n_items, item_ids (as strings, sorted), hits (places of
    the hit words) and contaminated.  A null or wordless text or item has no
    words and hits nothing; item rows with one item_id are one item, and
    those without an item_id count as one item named by the empty string.  Options: span and
    gram (words).
    """
    return _checked(docs, benchmark, **options).drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with its columns, that hold no benchmark window."""
    return _checked(docs, benchmark, **options).where(~F.col("contaminated")).select("row.*")


def _checked(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    texts = with_text_key(docs)
    items = cut(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                                 words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0).distinct())
    # At most span different lengths, whatever the benchmark's size.
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(span)).alias("n")).distinct().collect()]
    worded = texts.select("doc_id", "text_key", words(F.col("text")).alias("words"))
    met = []
    for n in sorted(lengths):
        k = gram if n == span else n
        of_length = items.where((F.size("words") >= span) if n == span else (F.size("words") == n))
        prints = cut(fingerprints(of_length.select("item_id", F.col("words").alias("item_words"), "words"), k, n)
                     .withColumnRenamed("place", "item_place"))
        met.append(fingerprints(worded, k, n).join(prints, "print").select(
            "doc_id", "text_key", "item_id", "item_words", (F.col("place") - F.col("item_place")).alias("diagonal")))
    if not met:
        met = [worded.where("false").select("doc_id", "text_key", F.lit("").alias("item_id"), F.col("words").alias("item_words"),
                                            F.lit(0).alias("diagonal"))]
    per_item = reduce(DataFrame.unionByName, met).groupBy("doc_id", "text_key", "item_id", "item_words").agg(
        F.collect_set("diagonal").alias("diagonals"))
    per_text = cut(per_item.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("item_id", "item_words", "diagonals")).alias("candidates")))

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    t, c = rows.alias("t"), per_text.alias("c")
    # The candidates grow with the corpus: joined by shuffle at every size, never by broadcast.
    joined = t.hint("merge").join(c, F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.text_key") == F.col("c.text_key")), "left")
    joined = joined.select("t.row", "t.doc_id", words(F.col("t.row.text").cast("string")).alias("words"), "c.candidates")

    def occurrences(x):
        n = F.least(F.size(x.item_words), F.lit(span))
        starts = F.flatten(F.transform(x.diagonals, lambda d: _windows_on(d, x.item_words, F.col("words"), n)))
        return F.struct(x.item_id.alias("item_id"), F.flatten(F.transform(starts, lambda s: F.sequence(s, s + n - 1))).alias("places"))
    checked = joined.select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                            F.filter(F.transform(F.coalesce("candidates", F.array().cast("array<struct<item_id:string,item_words:array<string>,diagonals:array<int>>>")),
                                                 occurrences), lambda o: F.size(o.places) > 0).alias("found"))
    found = checked.select("row", "doc_id", "n_words", F.array_sort(F.array_distinct(F.col("found.item_id"))).alias("item_ids"),
                           F.array_distinct(F.flatten("found.places")).alias("hits"))
    return found.select("row", "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        "item_ids", "hits", (F.size("hits") > 0).alias("contaminated"))
