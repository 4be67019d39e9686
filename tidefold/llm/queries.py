"""The registered queries of this subpackage: opN_<name>, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, hnsw, licenses, lmscore, mixing, neardup, packing, quality, urlmodel, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, model)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judge(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good and not toxic; background: all documents."""
    documents = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lmscore.score_documents(documents, good)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_warc": op3_warc,
        "op4_url_filters": op4_url_filters,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_token_counts": op6_token_counts,
        "op7_license_scan": op7_license_scan,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_packing": op9_packing,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.ORACLE_SQL,
        "op4_url_filters": urlmodel.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
    }
