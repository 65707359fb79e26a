"""From raw documents to packed training sequences, one operator a stage.

Each stage keeps all columns of its documents but the last, whatever their names. A table without rows passes through all of them. Rows
that repeat count each for itself but where a stage says so; none drops or cuts a text for its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, langid, minhash, packing, pii
from strandlake.llm.store import delete, scratch, table_path, written
from strandlake.llm.tokens import tokenizer_path

#: A document is rejected as of no known language if it has no letter or this is more than its prediction's score: a near tie in both steps.
LEAST_SCORE = 0.26


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those with a null or empty text, or without a letter, go. A null id or language plays no part but in the fit."""
    return langid.known_languages(docs, langid.fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id. A row is known by its id and text, so rows that repeat an id with other
    texts are documents of their own; rows without an id get a large one from their text for this.
    """
    kind = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    own = F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64("text"), 2)
    key = [F.coalesce(F.col("doc_id").cast(kind), own.cast(kind)).alias("id"), F.xxhash64("text").alias("text_hash")]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *key, "text")
    near, none = minhash.near_duplicates(rows, id_col="id", by_row=True), F.col("group").isNull()
    groups = near.groupBy("group", F.when(none, F.col("id")).alias("id"), F.when(none, F.col("text_hash")).alias("text_hash"))
    kept = groups.agg(F.min(F.struct(near["id"], near["text_hash"])).alias("row")).select("row.*")
    same = Window.partitionBy("id", "text_hash").orderBy("id")
    return rows.drop("text").join(kept, ["id", "text_hash"], "left_semi").withColumn("copy", F.row_number().over(same)).where("copy = 1").select("doc.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. A null or empty text has none and stays, as do repeated rows and null ids."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; a null text stays null. ``n_chars`` is counted anew where there is one."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids; a null or empty text is its end mark alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("private", private), ("packed", packed)]

#: Language models, weights of the field and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, path = docs, table_path(spark, f"stage-{name}")
        with scratch(spark):  # what a stage writes for itself goes with it, and what it read when it is done
            docs = written(stage(spark, before, sf_dir), name, path)
        delete(before)
    return STAGES[-1][1](spark, docs, sf_dir)
