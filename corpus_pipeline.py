"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Defined results, for all stages: a null text is an empty one; texts of any length are taken whole; rows
without an id, and rows that share one, are told apart by their texts; extra columns of the documents stay
until the last stage, whatever their names; an empty table gives an empty result. What a stage makes of
null and empty texts, ties and repeated rows is said with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe, decontaminate, secrets, simhash_dedup, toxicity
from skarn.llm.common import crc_mod, discard, materialise
from skarn.llm.queries import PATTERN, VOCABULARY, table

#: SQL can express none of the models and hashes here; tests hold run() against brute force.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the training labels, scores below 0.5; one of 0.5 goes.

    Repeated rows and equal texts get equal verdicts; empty texts are judged as texts without words.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; rows without an id come last.

    Of rows of one id the one of the smallest text hash stays, of repeated rows one. Empty texts are one group.
    """
    return simhash_dedup.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found (similarity 0.8 or more over shingles of five words).

    Empty texts and empty passages match nothing; repeated rows get equal verdicts.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials in their texts replaced by marks; null texts stay null.

    Of credentials that overlap the one that begins last is replaced. Repeated rows count as one text.
    """
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of what they decode to; one row a document, null and empty texts without ids."""
    out = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("byte-level bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, done = materialise(docs, f"stage{k}"), kept
            if done is not None:  # the stage before the one just written
                discard(done)
            kept = docs
    return docs
