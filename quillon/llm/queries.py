"""The registered queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, lines, mixing, pii, quality, secrets, simhash, suffix, tiff, warc
from quillon.llm import spans as S
from quillon.llm.common import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark)
    archives = warc.write_archives(table(spark, sf_dir, "pages"), f"{where}/warc", where)
    index = materialize(warc.build_index(archives), f"{where}/index")
    read = materialize(warc.read_records(index).drop("payload"), f"{where}/read")
    return warc.resolve(read).select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shared_dir(spark))
    return out.select("doc_id", "text_score", "meta_score", "score", "keep")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), shared_dir(spark))
    base = [r.kind for r in secrets.BASE]
    tags = {r.kind: S.tagged(F.col(r.kind), r.kind, k) for k, r in enumerate(secrets.RULES)}
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(S.written(F.concat(*[tags[k] for k in base]), True), 256).alias("base_sha256"),
        S.written(F.concat(*tags.values()), True).alias("spans"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), power=0.5, seed=42)


def _with_context(k: pii.Kind) -> Column:
    return F.size(F.filter(k.name, lambda s: s["score"] > k.prior))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    names = [k.name for k in pii.KINDS]
    base = names[:4]
    tags = {k: S.tagged(F.col(k), k, i) for i, k in enumerate(names)}
    near = [_with_context(k) for k in pii.KINDS]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(S.written(F.concat(*[tags[k] for k in base]), False), 256).alias("base_sha256"),
        S.written(F.concat(*tags.values()), False).alias("spans"),
        sum(near[1:], near[0]).cast("long").alias("n_with_context"),
    )


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(tiff.encode_bytes(table(spark, sf_dir, "documents"), "text", "doc_id"), f"{shared_dir(spark)}/media")
    facts = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    size = F.octet_length("pixels")
    return tiff.decode_pages(facts, "media").select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", size - 63, F.lit(64))).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%dx%dx%d %s mean=%.6f deviation=%.6f", "width", "height", "samples", "dtype", "mean", "deviation").alias("feature"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate_lines(table(spark, sf_dir, "documents"), shared_dir(spark), candidates="runs")
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shared_dir(spark), size=3, threshold=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents"), shared_dir(spark))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark), window=10)
    n_hit = F.size("hits").cast("long")
    return hits.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scans": op3_secret_scans,
    "op4_mixing": op4_mixing,
    "op5_personal_data": op5_personal_data,
    "op6_tiff": op6_tiff,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_suffix_array": op9_suffix_array,
    "op10_decontamination": op10_decontamination,
}
