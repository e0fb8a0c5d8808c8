"""The registered queries of the operators and, where SQL can say them, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.llm import (
    backoff_scores,
    checking,
    decontaminate,
    fill_in_middle,
    license_scan,
    line_dedup,
    mixing,
    near_copies,
    pseudonyms,
    quality_gam,
    quality_rules,
    token_alignment,
    toxic_crf,
    word_bpe,
)
from pricelark.llm.text import documents
from pricelark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    if fn.__name__ in checking.SQL:
        ORACLES[fn.__name__] = checking.SQL[fn.__name__]
    return fn


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.verdicts(documents(spark, sf_dir))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good",
    )


@query
def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mixed(documents(spark, sf_dir), texts=False)
    return d.select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that leaks into it."""
    found = decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("text_digest")


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan.scanned(documents(spark, sf_dir))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("detections").cast("long").alias("n_detections"),
    )


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(documents(spark, sf_dir)).drop("text_digest", "first")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counts(documents(spark, sf_dir))


@query
def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxic_crf.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


@query
def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonyms.masked(documents(spark, sf_dir))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", F.size("found").cast("long").alias("n_found"), *map(number, pseudonyms.KINDS), "text")


@query
def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores.scores(documents(spark, sf_dir))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(text: Column | str) -> Column:
    """Lower-case hex of the UTF-8 bytes' hash."""
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle.restored(fill_in_middle.transformed(documents(spark, sf_dir)))
    return d.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha256("output").alias("output_sha256"), sha256("restored.text").alias("restored_sha256"),
    )


@query
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    d = word_bpe.decoded(word_bpe.encoded(documents(spark, sf_dir), path), path)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return d.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(said).alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
    )


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.scored(
        documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    )
