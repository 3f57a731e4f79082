"""From raw documents to packed training sequences: five stages, each a table on its own.

``STAGES`` names the stages in order; each function takes (spark, docs, sf_dir) and returns a frame that is
written as Parquet and read again as the next stage's documents. All but the last return the columns of
documents. ``run`` applies them to the documents of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variscope.llm.exact_dedup import deduplicate
from variscope.llm.mixing import mixed_documents
from variscope.llm.near_dedup import near_duplicates
from variscope.llm.packing import pack, tokenize
from variscope.llm.quality import judge
from variscope.llm.scratch import stored
from variscope.llm.urls import LOWER, UPPER

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; null and short texts go."""
    return judge(docs).filter("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id, and one row of it if it is repeated."""
    verdicts = deduplicate(docs)
    kept = verdicts.filter("kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_kept_text"))
    mark = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)
    stay = docs.withColumn("_mark", mark).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_mark") == F.col("_kept_text")), "left_semi")
    if not verdicts.filter("NOT kept AND doc_id <=> keep_id").isEmpty():  # rows that are repeated whole
        stay = stay.dropDuplicates(["doc_id", "_mark"])
    return stay.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the least doc_id.

    Rows that share a doc_id are one document and stay if one of them does.
    """
    kept = near_duplicates(docs, width=5, percent=80).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated, left out or cut off as the mixture takes them."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    import public_tokenizers

    pieces = tokenize(docs, public_tokenizers.path(VOCABULARY))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(digests, "pieces"), ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer, so the rows of ``run`` are tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
