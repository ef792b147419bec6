"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, chat_format, decontaminate, divergence, html_extract, line_dedup, periodic_runs, quality, simhash, suffix_dedup,
    topk_search, toxicity, url_filter,
)
from .common import let, words

#: A conversation that speaks in marks, told apart by its number.
MARKED = (-7, r"\### Assistant: </turn> ok")


def table(spark: SparkSession, data: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_html_extraction(spark: SparkSession, data: str) -> DataFrame:
    return html_extract.extract(table(spark, data, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op2_simhash(spark: SparkSession, data: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, data, "documents"), size=4, budget=4).select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op3_chat_format(spark: SparkSession, data: str) -> DataFrame:
    conv, text = MARKED
    marked = spark.range(2).select(
        F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    turns = table(spark, data, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    back = chat_format.parse(chat_format.format_chats(chat_format.turn_events(turns)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(said).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha256(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_url_filter(spark: SparkSession, data: str) -> DataFrame:
    return url_filter.filter_urls(spark, table(spark, data, "pages"))


def op5_quality_rules(spark: SparkSession, data: str) -> DataFrame:
    return quality.judge(table(spark, data, "documents"), table(spark, data, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_suffix_dedup(spark: SparkSession, data: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, data, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", sha256(F.col("kept")).alias("kept_sha256")
    )


def op7_line_dedup(spark: SparkSession, data: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, data, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", sha256(F.col("line_text")).alias("kept_sha256")
    )


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op8_toxicity(spark: SparkSession, data: str) -> DataFrame:
    docs = table(spark, data, "documents")
    model = toxicity.learn(docs, table(spark, data, "labels").where(~held_out()))
    return toxicity.score_texts(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_bpe(spark: SparkSession, data: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_texts(table(spark, data, "documents").select("doc_id", "text"), path)
    return bpe.decode_ids(coded, path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        sha256(F.col("ids")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op10_decontamination(spark: SparkSession, data: str) -> DataFrame:
    found = decontaminate.Index(table(spark, data, "documents"), table(spark, data, "benchmark")).report()
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )


def op11_source_divergence(spark: SparkSession, data: str) -> DataFrame:
    found = divergence.Divergence.of(table(spark, data, "documents"), least=30)
    parts = {"pair": divergence.ranked(found.pairs(), "other"), "term": divergence.ranked(found.terms(), "term", top=50)}
    both = [rows.withColumn("part", F.lit(name)) for name, rows in parts.items()]
    return both[0].unionByName(both[1]).select("lang", "source", "part", "item", "value", "rank")


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text; for a tenth of the documents, its words from one of them on repeated with a period."""
    number = F.crc32(doc_id.cast("string").cast("binary"))
    part = F.floor(number / 10)

    def repeat(own: Column) -> Column:
        n = F.size(own).cast("long")
        start = part % n
        period = 1 + F.floor((n - start) / (3 + part % 8))
        again = F.transform(own, lambda word, i: F.when(i < start, word).otherwise(
            F.element_at(own, (start + (i - start) % period + 1).cast("int"))
        ))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    return F.when(number % 10 == 0, let(words(text), repeat)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, data: str) -> DataFrame:
    docs = table(spark, data, "documents").select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    most = F.reduce(
        "runs", F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")
    )), "")
    return found.withColumn("most", most).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"most.{c}") for c in ("start", "length", "period")],
        F.floor(1000 * F.col("most.length") / F.col("most.period")).cast("long").alias("exponent_milli"),
        sha256(listed).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_topk_search(spark: SparkSession, data: str) -> DataFrame:
    vectors = table(spark, data, "embeddings")
    found = topk_search.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_html_extraction, op2_simhash, op3_chat_format, op4_url_filter, op5_quality_rules, op6_suffix_dedup, op7_line_dedup,
        op8_toxicity, op9_bpe, op10_decontamination, op11_source_divergence, op12_periodic_runs,
        op13_topk_search,
    )
}
