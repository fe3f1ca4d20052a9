"""A corpus from documents: five stages, each written as Parquet and read again.

Every stage works on all rows the one before it kept. Stages one to four return the columns of documents (extra columns travel along in
one struct, so their names can't clash); the last returns the index of the token files it has written and read back.

1. toxicity: rows whose score reaches 0.5 go.
2. near_dedup: of each group of near copies (five-word shingles, similarity of 0.8 or more) one row stays, the one with the smallest doc_id (of rows equal in id and text, one).
3. decontaminate: passages of the benchmark are cut out of the texts; a text of which nothing else was left goes.
4. mix: sources by target weights; a row is there as often as its words are taken, with the words taken that often.
5. tokens: doc_id, start, n_tokens, ids_crc32 of each row.

Null texts are clean and have no words; they go in stage 4, which takes words. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.llm import common
from pitbars.llm.decontaminate import decontaminate
from pitbars.llm.mixing import mix_sources, mixed_texts
from pitbars.llm.near_copies import similar_documents
from pitbars.llm.token_store import stored
from pitbars.llm.toxicity import score_toxicity

BASE = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = "other_columns"


def _packed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    extra = [c for c in docs.columns if c not in BASE]
    if not extra:
        return docs.select(*BASE), BASE
    return docs.select(*BASE, F.struct(*(F.col(f"`{c}`") for c in extra)).alias(EXTRA)), [*BASE, EXTRA]


def _unpacked(out: DataFrame, like: DataFrame) -> DataFrame:
    return out.select(*(F.col(c) if c in BASE else F.col(f"{EXTRA}.`{c}`") for c in like.columns))


def _counted(out: DataFrame, before: str) -> DataFrame:
    """n_chars follows a text that has changed."""
    return out.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType))).drop(before)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _packed(docs)
    return _unpacked(score_toxicity(rows, common.table(spark, sf_dir, "labels"), keep=tuple(columns)).where("score < 0.5"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _packed(docs)
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    found = similar_documents(keyed, keep=("doc_id", "text_key"))
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("x")).select("x.id", "x.key")
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return _unpacked(kept.select(*columns), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _packed(docs)
    cut = decontaminate(rows, common.table(spark, sf_dir, "benchmark"), keep=tuple(columns), cut=True)
    left = cut.where(~F.col("contaminated") | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]")).withColumnsRenamed({"text": "before", "clean_text": "text"})
    return _unpacked(_counted(left, "before"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = _packed(docs)
    out = mixed_texts(mix_sources(rows, keep=tuple(columns)), columns)
    return _unpacked(out.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stored(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontamination), ("mix", mix), ("tokens", tokens)]

#: Hashes, models and tokenizers are beyond SQL; tests hold the operators against brute force and the stages against what each promises.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
