"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creelstat.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from creelstat.llm.common import stored

TOXIC = 0.5


def _with_digest(docs: DataFrame) -> DataFrame:
    """The rows in ``row`` beside the id and the hash of the text that name them."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("digest")
    )


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learnt from all labels, stays under 0.5; NULL and empty texts stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model, name="__score").where(F.col("__score") < TOXIC).drop("__score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds, and with n_chars counted anew. NULL texts get empty."""
    found = line_dedup.dedup_lines(docs)
    text = {"text": F.col("line_text"), "n_chars": F.length("line_text").cast("long")}
    return found.select(*[
        text[c].alias(c) if c in text else F.col("row").getField(c).alias(c) for c in docs.columns
    ])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents alike at 0.8 or more: the smallest doc_id's."""
    heads = stored(simhash.similar_documents(docs).where("stays").select("doc_id", "digest").distinct())
    kept = _with_digest(docs).alias("d").join(heads.alias("h"), _same("d", "h"), "left_semi")
    return kept.dropDuplicates(["doc_id", "digest"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    report = decontaminate.Index(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).report()
    hit = stored(report.where("contaminated").select("doc_id", "digest").distinct())
    return _with_digest(docs).alias("d").join(hit.alias("h"), _same("d", "h"), "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded): token ids of every text and the text read back from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), path).drop("text")
    return bpe.decode_ids(coded, path).withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: SQL expresses neither the lexicon nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, every stage's rows written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
