"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import byte_cnn, decontamination, hard_negatives, near_dup, packing, period_runs, pii, quality_rules, scratch, secret_scan, token_planes, toxicity, url_filter, warc
from fathom.llm.tables import table

#: The session's setting with the key of the surrogates, and the key of test data, which anyone can read here.
PII_KEY, TEST_KEY = "spark.fathom.pii.key", "fathom surrogate key"


def pii_key(spark: SparkSession) -> bytes:
    """The key that the session sets; without one the key of test data, with a warning."""
    key = spark.conf.get(PII_KEY, "") or ""
    if not key:
        warnings.warn(f"{PII_KEY} is not set: surrogates get the public key of test data and can be undone by anyone", stacklevel=2)
    return (key or TEST_KEY).encode()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"), scratch.new_path(spark, "ledger"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_planes(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_warc_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_report(table(spark, sf_dir, "documents"), pii_key(spark))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op9_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repeated_kgram_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_report(table(spark, sf_dir, "documents"))


def op12_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_ledger,
        op2_toxicity_nnpu,
        op3_token_planes,
        op4_warc_sequential,
        op5_redirect_filter,
        op6_minhash_containment,
        op7_pii_surrogates,
        op8_hyperminhash,
        op9_karmarkar_karp,
        op10_decision_list,
        op11_repeated_kgram_runs,
        op12_byte_cnn,
        op13_dual_tree_negatives,
    )
}

#: The others rest on learned models, keys, files of ids, or statistics that SQL cannot express.
ORACLES: dict[str, str] = {
    "op1_secret_ledger": secret_scan.report_sql(),
    "op4_warc_sequential": warc.ROUND_TRIP_SQL,
    "op5_redirect_filter": url_filter.judge_sql(),
    "op6_minhash_containment": decontamination.CONTAMINATIONS_SQL,
    "op8_hyperminhash": near_dup.COMPONENTS_SQL,
    "op11_repeated_kgram_runs": period_runs.report_sql(),
    "op13_dual_tree_negatives": hard_negatives.MINED_SQL,
}
