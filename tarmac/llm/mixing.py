"""Mixing sources to target weights at exact word budgets.

Every document gets a hash-random key; the rows are range-partitioned by
(source, key), so a hot source spreads over many partitions. Prefix sums of
the sizes are built in two levels: sums of each (partition, source) first,
then the running sum inside a partition on top of its offset. The cut falls
on the exact word of a source's budget; budgets beyond a source's size repeat
it in whole epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import WORD_RE, join_small, packed, shuffle_partitions, stage, text_of, unpacked

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size).

    Weights repeat over the sources by code point, null last. The total size
    is shared by weight; a share above ``most`` times the source's size is cut
    there and the excess reshared. Sorted by cap over weight, the capped
    sources are a prefix, so the level follows from two running sums. There
    is one row per source here, never one per document.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy("ratio", "place")
    everything = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = sources.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    r = r.withColumn("weight", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    r = r.withColumn("before", F.sum("cap").over(order) - F.col("cap"))
    r = r.withColumn("weights_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    r = r.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("weights_left"))
    r = r.withColumn("capped", F.col("ratio") <= F.col("level"))
    share = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything) * F.col("weight")
    r = r.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    return r.select("source", "source_size", "target", F.round("target").cast("long").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, source, text): doc_id, source,
    size, source_size, target, taken, text_key.

    Sizes are numbers of words; null or empty texts have size 0 and take
    nothing. A null source is a source of its own, the last. Rows repeated in
    full are told apart by nothing and share their key; the order among them
    does not change the rows of the result. ``taken`` counts the words the mix
    takes of the row: whole epochs, plus the part before the source's cut in
    the last one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = stage(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD_RE)).cast("long").alias("size"),
                             key.alias("key"), F.md5(text_of()).alias("text_key")), "mix-sizes")
    order = [F.asc_nulls_last("source"), "key", "doc_id", "text_key"]
    dealt = slim.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    rows = stage(dealt, "mix-dealt")
    parts = rows.groupBy("part", "source").agg(F.sum("size").alias("part_size"))
    sums = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    by_part = Window.partitionBy("source").orderBy("part")
    offsets = parts.withColumn("offset", F.sum("part_size").over(by_part) - F.col("part_size")).alias("o")
    plan = offsets.join(sums.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    plan = stage(plan.select("part", F.col("o.source").alias("plan_source"), "offset", "source_size", "target", "budget"), "mix-plan")
    inside = Window.partitionBy("part", "source").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("ahead", F.sum("size").over(inside) - F.col("size")).withColumnRenamed("part", "row_part")
    both = join_small(running, plan, (F.col("row_part") == F.col("part")) & F.col("source").eqNullSafe(F.col("plan_source")), "inner")
    epochs = F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0 END")
    rest = F.col("budget") - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("ahead")))
    return both.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).alias("taken"), "text_key")


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, its last
    copy cut after the words that the budget still takes. ``n_chars`` follows
    the text. Rows of size 0 are taken as they are, once, if their source
    takes anything: they cost no words. Rows repeated with id, source and
    text take together what each of them takes; where they differ in other
    columns, the copies have the least one's."""
    plan = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_key").alias("_key"), F.col("size").alias("_size"), "taken", "target")
    # Rows repeated with id, source and text take together what each of them takes: whole copies, and the rest in a last one.
    plan = plan.groupBy("_id", "_source", "_key").agg(F.max("_size").alias("_size"), F.sum("taken").alias("_taken"), (F.max("target") > 0).alias("_any"), F.count("*").alias("_rows"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_key") == F.md5(text_of()))
    each = packed(docs, "doc_id", "source", "text").join(plan, same)
    own = ["_id", "_source", "_key", "_size", "_taken", "_any", "_rows"]
    repeated = each.where("_rows > 1").groupBy(*own).agg(F.min("_row").alias("_row")).withColumn("text", F.col("_row")["text"])
    each = each.where("_rows = 1").select(*own, "_row", "text").unionByName(repeated)
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("_taken") / F.col("_size"))).otherwise(F.col("_any").cast("long") * F.col("_rows")).cast("int")
    each = each.withColumn("_copies", copies).where("_copies > 0")
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    each = each.withColumn("_words", F.col("_taken") - F.col("_size") * (F.col("_copy") - 1))
    # The first k words with the white space between them; (k - 1) pairs of word and space, iterated possessively.
    head = F.expr(r"regexp_extract(text, concat('^[\\x20\\x09-\\x0D]*+(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+){0,', cast(_words as string), '}+'), 0)")
    text = F.when((F.col("_size") > 0) & (F.col("_words") < F.col("_size")), head).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unpacked(each, docs, **changed)
