"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import oracle
from tarmac.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.line_dedup import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.pii import pii_report

    return pii_report(read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.html_extract import extract

    return extract(read(spark, sf_dir, "pages")).drop("template_tokens")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.lm_score import cross_entropy_difference

    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).drop("source", "text_key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.token_output import token_output

    return token_output(read(spark, sf_dir, "documents"), tokenizer_file()).drop("shard")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.ngram_join import similar_sets

    return similar_sets(read(spark, sf_dir, "documents")).drop("class_size")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.url_filter import judge_urls

    return judge_urls(read(spark, sf_dir, "pages")).drop("listed")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.conversation_repair import damaged, repair_report

    conversations = read(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.llm.periodic_runs import periodic_runs, planted

    return periodic_runs(read(spark, sf_dir, "documents"), planted)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """Every operator's query by name, and the pipeline."""
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
