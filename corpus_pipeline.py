"""A corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents, with
their types; further columns of the input pass through. `run` writes each stage's result and reads it again for the next
one, so a stage works on all that its predecessor kept, and a lost executor costs no earlier stage.

Null texts count as empty in every stage; empty documents are clean, are no duplicates and are kept until the mix,
where their size of 0 words neither adds to a target nor hinders copies. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.llm import lsh_forest, mixing, suffix_dedup, tiling, toxicity
from stmtflow.llm.common import Scratch, by_ids, table
from stmtflow.plans.materialize import materialize
from stmtflow.plans.ordered import with_ordinal

#: Documents with this score or more are rejected.
TOXIC = 0.5
#: Near-duplicates share 80 % of their runs of five words.
WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject. The grammar learns from the labels of the given documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < TOXIC).select(*docs.columns)


def _free(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    while name in columns:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Of rows with one id and one text, one stays. Different texts of one id are documents of their own: they are numbered by
    (id, text) for the comparison, and each stays or goes by its own group. Rows without id stay.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count()
    if not ids.filter("count > 1").limit(1).count():
        found = lsh_forest.near_duplicates(docs, width=WIDTH, percent=PERCENT)
        gone = materialize(found.filter(~F.col("kept")).select("doc_id"), "near-duplicates")
        return by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    own, body = _free("_own", docs.columns), _free("_body", docs.columns)
    hashed = docs.withColumn(body, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    single = hashed.filter("doc_id is not null").dropDuplicates(["doc_id", body])
    numbered = with_ordinal(single, ["doc_id", body], own)
    found = lsh_forest.near_duplicates(numbered.select(F.col(own).alias("doc_id"), "text"), width=WIDTH, percent=PERCENT)
    gone = materialize(found.filter(~F.col("kept")).select(F.col("doc_id").alias(own)), "near-duplicates")
    left = by_ids(numbered, gone, own, "left_anti").select(*docs.columns)
    return left.unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier; n_chars follows. Documents left without text go."""
    cut = suffix_dedup.deduplicate(docs, keep=docs.columns, with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.filter((F.col("n_removed") == 0) | (F.trim("kept_text") != "")).withColumn("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, with its copy number and its source's figures."""
    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
]

#: The grammar's fit and the suffix arrays are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        kept = scratch(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
