"""Documents to token ids: toxic ones go, boilerplate lines go, one of each group of near copies stays, leaks go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm import line_dedup, ngram_join, sentencepiece_codec, tiling
from sparkmeter.llm import toxicity as tx
from sparkmeter.llm.shared import save
from sparkmeter.session import prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the string-kernel machine, trained on the labelled rows outside the held-out fold, doesn't find toxic."""
    model = tx.fit(docs.where(~tx.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tx.clean_rows(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without lines that are boilerplate of its source; n_chars follows the text."""
    rows = line_dedup.drop_boilerplate(docs).drop("_lines", "_dropped")
    return rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of five-word shingles at 0.8 form: the one with the smallest doc_id.

    Rows without words are in no group and stay. Null ids come last; of equal ids the first row stays.
    """
    plain = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()
    rows = docs.withColumn("_row", F.col("doc_id")) if plain else save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = ngram_join.link_classes(rows.select(F.col("_row").alias("doc_id"), "text"), 5, 80, 100)
    members = save(rows.select("_row", "doc_id").join(classes.where("n_shingles > 0").withColumnRenamed("doc_id", "_row"), "_row"), "members")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    extra = members.join(best, "component_id").where("_row <> m._row").select("_row")
    return rows.join(save(extra, "extra"), "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is covered by half."""
    return tiling.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text and the text that they give back."""
    import public_tokenizers

    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_deduplication),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: Toxicity is learned and encoding searches a vocabulary; SQL says neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name.replace(" ", "_"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
