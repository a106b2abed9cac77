"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source's rows are put in an order of its own and cut into blocks of
``block_size``.  Targets are rounded to whole slots of a cycle: source s gets a_s of Q
slots.  Its j-th block of a cycle (from 0) is released at slot floor(j * Q / a_s) and due
by slot ceil((j + 1) * Q / a_s); every slot goes to the released block that is due
first.  The weights sum to one, so no block is late, and at every slot t a
source has had between t * a_s / Q - 1 and t * a_s / Q + 1 blocks.  A cycle ends with
exactly a_s blocks of each, so one cycle's table, whose size depends on the
number of sources alone, gives every block's slot: block b of source s takes
slot (b div a_s) * Q + table[s, b mod a_s].  The bound is against the rounded shares a_s / Q: what
rounding adds to or takes from a target weight comes again in every cycle.

A source that has run out leaves its slots empty: at slot t it has had
min(N_s, t * a_s / Q) blocks, and the others go on in their proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterscope.session import cut

CYCLE = 1000
CHUNKS = 1024
BLOCK_CHARS = 1 << 16


def _key(source: Column) -> Column:
    """The source as a string that tells null from all names."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def cycle_table(targets: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Slots of one cycle: (key, slots, cycle, nth, slot) for targets (key, weight).

    Weights are whole numbers in any unit.  Every source gets one slot and a share of
    the others by largest remainder, ties to the smaller key; the cycle is at least
    two slots per source long.  Null, zero and negative weights get the one slot.
    """
    one = targets.groupBy("key").agg(F.greatest(F.lit(0), F.coalesce(F.max("weight"), F.lit(0))).cast("decimal(38,0)").alias("w"))
    # A row per source: these windows and the single row below are as long as the list of sources.
    everything = Window.partitionBy()
    counted = one.select("key", "w", F.count("*").over(everything).alias("s"), F.sum("w").over(everything).alias("total"))
    counted = counted.withColumn("q", F.greatest(F.lit(cycle), 2 * F.col("s")).cast("long"))
    spare = counted.select("key", "q", "s", (F.col("q") - F.col("s")).alias("free"),
                           F.expr("if(total > 0, (w * (q - s)) div total, 0)").cast("long").alias("share"),
                           F.expr("if(total > 0, (w * (q - s)) % total, 0)").alias("rest"))
    by_rest = F.row_number().over(Window.orderBy(F.desc("rest"), "key"))
    slots = (spare.withColumn("left", F.col("free") - F.sum("share").over(everything)).withColumn("r", by_rest)
             .select("key", "q", (1 + F.col("share") + F.expr("left div s") + F.when(F.col("r") <= F.expr("left % s"), 1).otherwise(0)).alias("a")))
    listed = slots.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("key", "a"))).alias("sources"))
    table = listed.select("q", "sources", F.expr("""
        aggregate(sequence(0L, q - 1),
                  named_struct('had', transform(sources, x -> 0L), 'out', cast(array() as array<struct<source:int,nth:bigint>>)),
                  (st, t) -> element_at(transform(
                      array(array_min(transform(
                          filter(sequence(0, size(sources) - 1),
                                 i -> st.had[i] < sources[i].a and (st.had[i] * q) div sources[i].a <= t),
                          i -> struct(((st.had[i] + 1) * q + sources[i].a - 1) div sources[i].a as due, i as i))).i),
                      p -> named_struct('had', transform(st.had, (h, i) -> if(i = p, h + 1, h)),
                                        'out', concat(st.out, array(named_struct('source', p, 'nth', st.had[p]))))), 1),
                  st -> st.out)""").alias("out"))
    return table.select("q", "sources", F.posexplode("out").alias("slot", "o")).select(
        F.expr("sources[o.source].key").alias("key"), F.expr("sources[o.source].a").alias("slots"), F.col("q").alias("cycle"),
        F.col("o.nth").alias("nth"), F.col("slot").cast("long").alias("slot"))


def volume_targets(docs: DataFrame) -> DataFrame:
    """Targets (source, weight) by the square root of each source's characters: large
    sources lead, small ones come more often than their volume alone would have it."""
    size = F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return docs.groupBy("source").agg(F.floor(F.sqrt(size.cast("double"))).cast("long").alias("weight"))


def mixed(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` with their place in the mixture: columns mix_slot (long), mix_block
    (block of the source, from 0) and mix_place (row of the source, from 0) are added, or replaced.

    Sorting by (mix_slot, mix_place) gives the mixture.  ``docs`` has doc_id, source and text;
    ``targets`` has source and weight; sources without a target get the smallest share.
    ``size`` (default: characters of the text) is a row's volume, null or negative as 0; a block
    holds the rows that start in its stretch of the source's volume, so a row that is
    larger than a block leaves the blocks it covers empty.  A null source is a source of its
    own.  A source's rows come by doc_id modulo ``chunks`` (null as 0), then doc_id, then text;
    equal rows in either order.  Nothing is dropped or repeated.  Options: size, block_size,
    cycle (slots of a cycle) and chunks.
    """
    names = ["mix_slot", "mix_block", "mix_place"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in names]
    return _placed(docs, targets, **options).select(*kept, *names)


def _placed(docs: DataFrame, targets: DataFrame, size: Column | None = None, block_size: int = BLOCK_CHARS, cycle: int = CYCLE,
            chunks: int = CHUNKS) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), _key(F.col("source")).alias("key"),
                       F.greatest(F.lit(0), F.coalesce((F.char_length("text") if size is None else size).cast("long"), F.lit(0))).alias("size"),
                       F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(chunks)), F.lit(0)).alias("chunk"))
    # Places within a source, however large: places within its chunks, and the chunks' volumes before.
    volumes = rows.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("v"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(volumes.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                                 F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v0")))
    order = Window.partitionBy("key", "chunk").orderBy("row.doc_id", "row.text")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.select("*", (F.row_number().over(order) - 1).alias("nth_row"),
                           F.coalesce(F.sum("size").over(running), F.lit(0)).alias("volume"))
    placed = (numbered.join(offsets, ["key", "chunk"])
              .select("row", "key", (F.col("n0") + F.col("nth_row")).alias("mix_place"),
                      F.expr(f"(v0 + volume) div {int(block_size)}").alias("mix_block")))
    given = targets.select(_key(F.col("source")).alias("key"), F.col("weight").cast("long").alias("weight"))
    known = offsets.select("key").distinct().join(given.groupBy("key").agg(F.max("weight").alias("weight")), "key", "left")
    table = cut(cycle_table(known, cycle))
    shares = table.select("key", "slots").distinct()
    blocks = placed.join(shares, "key").withColumn("nth", F.expr("mix_block % slots"))
    return blocks.join(table.select("key", "nth", "cycle", "slot"), ["key", "nth"]).select(
        "row", "mix_place", "mix_block", (F.expr("mix_block div slots") * F.col("cycle") + F.col("slot")).alias("mix_slot"))


def in_mixture_order(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with its columns only, laid out in the order of the mixture."""
    order = ["mix_slot", "mix_place"]
    rows = _placed(docs, targets, **options)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
