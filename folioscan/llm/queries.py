"""The registered queries of this subpackage: thin calls of its operators over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, neardup, packing, quality, tokenbin, toxicity, urlfilter, winnow
from .common import read


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_table(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_table(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_table(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_table(read(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_urlfilter, op3_packing, op4_neardup, op5_langid, op6_tokenbin, op7_quality, op8_bpe, op9_winnow, op10_ann)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express: none; models, signatures and tokenizers take part in all."""
    return {}
