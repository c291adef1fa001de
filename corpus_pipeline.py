"""From raw documents to packed training sequences, in stages that each call one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, whichever they are, so extra columns pass
through. Labels come from the ``labels`` table beside the documents; null and
empty texts, repeated rows and empty tables are treated as the operators'
docstrings say (a null text counts as empty, rows without an id are kept by
the near-duplicate stage).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import neardup, packing, quality, toxicity
from folioscan.llm.common import read, tune, unused, written

#: Near copies: five-word shingles with a Jaccard measure of so many hundredths or more (op4_neardup has its own, 85).
NEAR = 80


def _keep(docs: DataFrame, score, accept) -> DataFrame:
    """Rows whose score of the text is accepted; only texts go to Python, other columns stay where they are."""
    name = unused(docs, "score")
    return docs.withColumn(name, score("text")).filter(accept(F.col(name))).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _keep(docs, toxicity.scorer(docs, model), lambda s: s < toxicity.THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _keep(docs, quality.scorer(docs, model), lambda s: s >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the rows with the group's least id the one with the least text.

    Rows without an id all stay.
    """
    found = written(neardup.classes(docs, percent=NEAR), "classes")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("node")).distinct()
    rest = neardup.without(docs, gone)
    again = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return rest.select(*docs.columns)
    one = rest.join(again, "doc_id", "left_semi").groupBy("doc_id")  # partial minima, so an id of very many rows is no hot key
    one = one.agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Learnt models, signatures and a tokenizer decide; SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
