"""The registered queries of this package: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variscope.llm.oracles import OP3, OP4, OP6, OP11, OP12, OP13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_quality_rules", OP3)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules")
    )


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from variscope.llm.packing import pack, tokenize
    from variscope.llm.scratch import stored

    pieces = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(digests, "pieces"), ["doc_id", "piece", "ids_crc32"])


@query("op4_exact_dedup", OP4)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.exact_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


@query("op5_source_mixing")
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.mixing import mix, sized

    segments = mix(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    taken = segments.groupBy("sid", "place", "id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long").alias("taken"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


RULES_SQL = """SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, verdict)"""


@query("op6_url_filters", OP6)
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.urls import judge_urls

    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), spark.sql(RULES_SQL))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.sharding import shards

    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return shards(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.extraction import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.licences import scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text")).drop("text")


@query("op10_chat_formatting")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.chat import conversations

    return conversations(table(spark, sf_dir, "conversations"))


@query("op11_benchmark_decontamination", OP11)
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op12_phrase_collocations", OP12)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.collocations import best, collocations

    found = best(collocations(table(spark, sf_dir, "documents").select("lang", "text")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op13_importance_resampling", OP13)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from variscope.llm.resampling import resample

    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
