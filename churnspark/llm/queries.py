"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.llm import align, bpe, decontaminate, html, langid, pii, piece, quality, runs, secrets, sharding, simhash, vectors
from churnspark.llm.tables import held_out, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and each item it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.score", F.col("leak.question").alias("question_overlap"),
        F.col("leak.answer").alias("answer_overlap"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.REJECT_BELOW).cast("int").alias("predicted"),
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the history meets the base rules first; the scan by all rules then touches only the pairs that are left
    ledger = secrets.new_ledger(spark)
    secrets.record(docs, ledger, secrets.BASE)
    found = secrets.scan(docs, ledger)
    base = secrets.of_kinds(F.col("findings"), secrets.BASE)
    return found.select(
        "doc_id",
        *[F.size(secrets.of_kinds(F.col("findings"), (r,))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("findings")).alias("spans"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: The public vocabulary file; any word-end BPE file of that format may take its place.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, WORD_BPE, decoded="decoded")
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shuffle_into_shards(narrow)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


#: The query's key; a user of the operator brings one of their own and keeps it secret.
PII_KEY = b"key of the registered query"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = pii.pseudonymise(docs, PII_KEY)
    listed = F.transform("pii", lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"]))
    return clean.select(
        "doc_id", F.col("clean_text").alias("text"), F.size("pii").cast("long").alias("n_found"), F.concat_ws(",", listed).alias("spans"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(runs.with_planted_runs(docs))
    best = runs.longest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.try_divide(1000 * best["length"] - (1000 * best["length"]) % best["period"], best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: Public files of merge-type pieces and of byte-level merges; any others of their formats may take their places.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece.encode(docs, PIECES, decoded="decoded")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.link_counts(docs, BYTE_BPE, PIECES, hashed=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


#: name: (query, SQL or None)
QUERIES = {
    "op1_simhash_near_dedup": (op1_simhash_near_dedup, None),
    "op2_html_extraction": (op2_html_extraction, None),
    "op3_benchmark_decontamination": (op3_benchmark_decontamination, None),
    "op4_quality_classifier": (op4_quality_classifier, None),
    "op5_secret_scans": (op5_secret_scans, secrets.oracle()),
    "op6_language_id": (op6_language_id, None),
    "op7_bpe": (op7_bpe, None),
    "op8_sharding": (op8_sharding, None),
    "op9_embedding_near_dedup": (op9_embedding_near_dedup, None),
    "op10_pii": (op10_pii, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_sentencepiece": (op12_sentencepiece, None),
    "op13_cross_tokenizer_alignment": (op13_cross_tokenizer_alignment, None),
}
