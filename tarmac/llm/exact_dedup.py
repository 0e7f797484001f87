"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so (the end of a sentence or line
once a chunk has ``MIN_CHUNK`` characters, at ``MAX_CHUNK`` at the latest).
A chunk's identifier is its 64-bit hash, verified against all chunk contents:
where two different chunks share a hash, an ordinal tells them apart. Two
texts are equal when their ordered identifier lists are. Only the chunks'
distinct contents are moved once, for the verification; documents are
compared, grouped and joined by their recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import lower_ascii, stage, text_of

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text as an array of chunks that concatenate to it (empty text: no chunk)."""
    cut = rf"(?s).{{{least},{most}}}?(?<=[.!?\n])(?=\s)|(?s).{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def colliding_chunks(texts: DataFrame, hash_of=chunk_id) -> DataFrame:
    """(hash, chunk, ordinal) of every chunk content that shares its hash with
    another content. Each distinct chunk is shuffled once, copies are combined
    before the shuffle; after it only hashes are counted. Empty unless hashes
    collide."""
    parts = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = parts.select(hash_of(F.col("chunk")).alias("hash"), "chunk").distinct()
    twice = stage(distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "chunk-hashes")
    if twice.isEmpty():
        return texts.sparkSession.createDataFrame([], "hash bigint, ordinal int, chunk string")
    contents = distinct.join(twice, "hash").groupBy("hash").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    return contents.select("hash", F.posexplode("all").alias("ordinal", "chunk"))


def with_recipes(docs: DataFrame, hash_of=chunk_id) -> DataFrame:
    """(doc_id, uid, text_sha256, recipe, ordinals) per row of ``docs``; staged."""
    texts = docs.select("doc_id", lower_ascii(text_of()).alias("norm"))
    sha = F.sha2(F.col("norm"), 256).alias("text_sha256")
    recipe = F.transform(chunks(F.col("norm")), hash_of).alias("recipe")
    rows = stage(texts.select("doc_id", F.monotonically_increasing_id().alias("uid"), sha, recipe), "recipes")
    collisions = stage(colliding_chunks(texts, hash_of), "chunk-collisions")
    if collisions.isEmpty():
        return rows.withColumn("ordinals", F.array().cast("array<string>"))
    # Each place of a colliding chunk, named by place and ordinal, as part of the recipe.
    places = texts.select(sha, F.posexplode(chunks(F.col("norm"))).alias("place", "chunk")).withColumn("hash", hash_of(F.col("chunk")))
    named = places.join(collisions, ["hash", "chunk"]).select("text_sha256", F.format_string("%010d:%d", "place", "ordinal").alias("at"))
    ordinals = named.distinct().groupBy("text_sha256").agg(F.array_sort(F.collect_list("at")).alias("ordinals"))
    return rows.join(ordinals, "text_sha256", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<string>")))


def exact_dedup(docs: DataFrame, hash_of=chunk_id) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text; other columns are ignored).

    Null text counts as empty; all empty texts are one group. Of a group the
    row with the largest doc_id stays (null doc_id counts as the smallest);
    of rows repeated with that doc_id exactly one stays. Columns: doc_id,
    keep_id, group_size, kept, text_sha256, n_chunks. An empty table gives
    an empty result.
    """
    rows = with_recipes(docs, hash_of)
    groups = rows.groupBy("recipe", "ordinals").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("keep"))
    return rows.join(groups, ["recipe", "ordinals"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))
