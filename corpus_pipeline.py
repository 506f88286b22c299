"""The corpus pipeline: quality, near-duplicates, benchmark leaks, encoding; each stage reads its predecessor's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import encode_decode
from weftline.llm.decontaminate import without_leaks
from weftline.llm.neardup import near_duplicates
from weftline.llm.quality import keep_good, train
from weftline.llm.queries import tokenizer
from weftline.plans.shared import Stash
from weftline.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    A null or empty text is scored as an empty one, null metadata as a value of its own; repeated rows are judged alike;
    an empty table gives none.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The row with the smallest id stays, a row without id only where its group has none with one; of equal ids or none the
    smallest digest of the text decides, and of rows with equal id and text one stays, the smallest by its other columns.
    Texts without words are in no group; an empty table gives none.
    """
    key = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text").cast("binary"), 256)
    near = near_duplicates(docs.select("doc_id", "text", key.alias("key")), n=5, percent=80, carry=("key",))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key"))
    kept = near.where("group IS NOT NULL").groupBy("group").agg(best.alias("x")).select("x.key")
    kept = kept.union(near.where("group IS NULL").select("key"))
    # Rows and decisions meet in one aggregate, which combines repeated rows before the only shuffle of texts.
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(False).alias("stays"))
    rows = rows.union(kept.select("key", F.lit(None).cast(rows.schema["row"].dataType), F.lit(True)))
    return rows.groupBy("key").agg(F.min("row").alias("row"), F.max("stays").alias("stays")).where("stays").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none, repeated rows are judged alike."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the round trip's digests; a null or empty text has no ids."""
    out = encode_decode(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    Nulls, empty texts and repeated rows are treated as the stages say; an empty table gives an empty result.
    """
    stash, docs = Stash(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
