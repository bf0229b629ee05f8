"""From raw documents to token ids, in stages that are each written and read again.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: of each group linked by five-word shingles (Jaccard >= 0.75) one document stays.
3. private: spans of personal data are masked in the text; n_chars follows.
4. mixture: sources are cut to the target weights, at most MIX_SHARE of the tokens, none repeated.
5. encode: whole texts become byte-level BPE ids.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.llm import bpe, jaccard, mixing, pii, toxicity
from chronolane.llm.registry import vocabulary
from chronolane.llm.shared import documents, table, written

#: Share of the tokens that the mixture may take.
MIX_SHARE = 0.9


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(spark, docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.selected(docs, MIX_SHARE)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, vocabulary(), ("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("private", mask_private),
    ("mixture", mix_sources),
    ("encode", encode_ids),
]

#: Toxicity, masking and BPE cannot be put into SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
