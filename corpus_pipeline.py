"""From raw documents to token ids: five stages, each written and read again.

STAGES lists (name, function); a function takes the session, the documents that its predecessor
kept, and the folder of the tables, and returns a DataFrame. All but the last return the
columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.llm import bpe, decontaminate, quality, secrets, similar
from churnspark.llm.queries import WORD_BPE
from churnspark.llm.tables import quoted, set_aside, table
from churnspark.session import stage

REDACTED = "[secret]"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; the labels are those of the folder."""
    docs, columns = set_aside(docs, "quality_score")
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_score") >= quality.REJECT_BELOW).select(*columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates: five-word Jaccard of 0.8."""
    return similar.keep_one(docs).select(*quoted(docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs, columns = set_aside(docs, "leaks")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text where it changed."""
    docs, columns = set_aside(docs, "blob", "findings")
    clean = secrets.redact(secrets.scan(docs), mark=REDACTED)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.size("findings") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", changed)
    return clean.select(*columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number."""
    coded = bpe.encode(docs, WORD_BPE)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: The classifier and SimHash cannot be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
