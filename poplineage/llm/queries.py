"""Each operator over its whole table, as its query returns it."""

from __future__ import annotations

import os
import pathlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fim, html, linecrf, lm, mixing, quality, simhash, substrings, tokenfile, topk, urls

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0


#: Parameter: bytes of rows that a Python worker is sent at once, in place of Spark's default.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies; a cluster may get it by ``--py-files`` instead.

    Batches for the workers are made smaller, unless the session sets their size itself.
    """
    if spark.conf.get(_BATCH, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    root, held = str(pathlib.Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [held.get("PYTHONPATH"), root]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.quality_rules(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", f"{quality.RESULT}.*")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def digest(text):
    return F.sha2(text, 256)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas."""
    return F.translate(F.col(ids).cast("string"), "[] ", "")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BPE_FILE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(ids_text()).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages").select("page_id", "url", "html"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = tokenfile.scratch_folder(spark)
    manifest = tokenfile.write_tokens(table(spark, folder, "documents"), BPE_FILE, END_ID, place)
    read = tokenfile.read_tokens(manifest, place)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, table(spark, folder, "documents"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "words", "score")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    held = F.col(substrings.RESULT)
    return cut.select("doc_id", held["n_words"].alias("n_words"), held["n_removed"].alias("n_removed"), digest(held["kept"]).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = mixing.plan_for(table(spark, folder, "documents"))
    taken = mixing.with_copies(rows, plan)
    return taken.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"), BPE_FILE)


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), every=20, k=20)


def op11_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = linecrf.classify(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    score = F.col(linecrf.RESULT)["score"]
    return scored.select(
        "doc_id",
        linecrf.held_out().alias("held_out"),
        score.alias("score"),
        (score >= linecrf.GOOD_SCORE).cast("int").alias("predicted"),
        F.col(linecrf.RESULT)["lines"].alias("lines"),
    )


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    held = F.col(fim.RESULT)
    return made.select(
        "doc_id",
        held["n"].alias("n"),
        held["form"].alias("form"),
        held["prefix_units"].alias("prefix_chars"),
        held["middle_units"].alias("middle_chars"),
        digest(held["output"]).alias("output_sha256"),
        digest(fim.restored(held["output"], held["form"])).alias("restored_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_html_text": op5_html_text,
    "op6_token_files": op6_token_files,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_lm_scores": op9_lm_scores,
    "op10_top_k": op10_top_k,
    "op11_line_quality": op11_line_quality,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}
