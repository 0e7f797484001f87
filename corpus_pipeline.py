"""A corpus pipeline over ``documents``: filter, deduplicate, decontaminate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between the
stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import WORD_RE, packed, read, stage, text_of, unpacked
from tarmac.llm.decontaminate import clean_documents
from tarmac.llm.mixing import mix, mixed_documents
from tarmac.llm.ngram_join import first_of_each
from tarmac.llm.queries import tokenizer_file
from tarmac.llm.token_output import token_output
from tarmac.llm.toxicity import harmless_documents

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return harmless_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays
    (null ids last; of one id's texts the one with the smallest MD5; of rows
    repeated with id and text, one). Texts that share an id or have none are
    documents of their own. Documents without words all stay, but for rows
    repeated with their id."""
    first = stage(first_of_each(docs, WORDS, NUM, DEN).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_first")), "kept-texts")
    nameless = F.col("doc_id").isNull() & ~text_of().rlike(WORD_RE)  # nothing says that two of these are one document
    keyed = packed(docs.where(~nameless), "doc_id", "text").withColumn("_key", F.md5(text_of()))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_first")), "left_semi")
    return unpacked(kept.dropDuplicates(["doc_id", "_key"]), docs).union(docs.where(nameless))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark text go."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight: documents repeated, left out or cut at their source's budget."""
    return mixed_documents(docs, mix(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-plane token files of the mix, digested per document copy as read back."""
    return token_output(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_files),
]

#: The classifier, the spaced seeds and the tokenizer are outside SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
