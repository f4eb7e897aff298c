"""The operators applied to the given tables, under the names of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.llm import (
    licenses,
    lsh_forest,
    mixing,
    mtree,
    rule_ensemble,
    sharding,
    suffix_dedup,
    tiling,
    toxicity,
    trie_codes,
    url_templates,
    warc,
    whitening,
)
from stmtflow.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "toxic_clauses",
        "clause_sum",
    )


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive_history(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks")).withColumn("n_tiles", F.size("tiles")).drop("tiles")


@query
def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    shares = F.array(*[F.lit(e) for e in fit.explained]).cast("array<double>")
    return rows.select("vec_id", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = trie_codes.encode(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    summed = trie_codes.with_label_error(coded)
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
