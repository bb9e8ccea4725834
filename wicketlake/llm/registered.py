"""Queries of this subpackage for ``__spark_entry__``: each applies one
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wicketlake.llm import audit, chat, decontaminate, fingerprints, jaccard, linededup, packing, pii, resample, tokens, toxicity, urls, warc
from wicketlake.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return urls.judge_urls(pages, urls.labelled_urls(pages, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, wide=True).select("doc_id", "text", "cut.n_lines", "cut.n_dropped")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(spark, f"{sf_dir.rstrip('/')}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_pii, op2_chat, op3_urls, op4_toxicity, op5_linededup, op6_packing, op7_decontaminate, op8_fingerprints,
            op9_jaccard, op10_tokens, op11_resample, op12_audit, op13_warc,
            pipeline)
_ORACLES = {"op2_chat": chat.ORACLE, "op3_urls": urls.ORACLE, "op7_decontaminate": decontaminate.ORACLE,
            "op9_jaccard": jaccard.ORACLE, "op11_resample": resample.ORACLE, "op12_audit": audit.ORACLE,
            "op13_warc": warc.ORACLE}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_queries() -> dict[str, str]:
    return dict(_ORACLES)
