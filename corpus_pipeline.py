"""The corpus pipeline: quality, near duplicates, repeated passages, mixing and packing.

``run`` applies STAGES to the documents. Each stage writes its result as Parquet and deletes what else it wrote, whoever
calls it, and the result is read again for the next one. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm import mixing, near_duplicates, packing, quality, suffix_dedup
from veritrail.storage import delete, new_path, stage_tables, write

#: Stands for a null id in keys.
_NO_ID = 2**63 - 1
#: The last stages choose documents by hash and by least squares, which SQL doesn't express.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling samples."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the least id, then the least hash of its text."""
    own = {"__text_hash": F.xxhash64("text"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__null": F.col("doc_id").isNull()}
    found = near_duplicates.near_duplicates(docs).where("component is not null")
    keys = found.select("component", F.coalesce("doc_id", F.lit(_NO_ID)).alias("__id"), F.col("doc_id").isNull().alias("__null"), F.col("text_hash").alias("__text_hash"))
    best = keys.groupBy("component").agg(F.min(F.struct("__null", "__id", "__text_hash")).alias("best"))
    kept = docs.withColumns(own).join(best.select("best.*", F.lit(True).alias("__first")), list(own), "left")
    # Repeated rows of the least id share its keys; one of them stays. Texts without words are in no group.
    again = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1)))
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.withColumn("__again", again).where(empty | (F.col("__first") & (F.col("__again") == 1))).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that occur earlier; documents of which nothing is left go."""
    cut = suffix_dedup.dedup(docs).where("text is null or text <> '' or size(removed_spans) = 0")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def written(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with its result written, and without the tables that it leaves on the way."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        path = new_path(docs.sparkSession, "pipeline")
        with stage_tables(docs.sparkSession):
            made = stage(spark, docs, sf_dir)
            write(made, path)
        return docs.sparkSession.read.schema(made.schema).parquet(path)

    return run


STAGES = [
    ("quality_classifier", written(keep_quality)),
    ("ngram_jaccard_join", written(drop_near_duplicates)),
    ("suffix_array_dedup", written(cut_repeats)),
    ("mixing_sources", written(mix_sources)),
    ("packing", written(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result goes when that of the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k:
            for path in {file.rsplit("/", 1)[0] for file in before.inputFiles()}:
                delete(spark, path)
    return docs
