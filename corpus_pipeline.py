"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it as the next stage's
docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.decontaminate import decontaminate
from weft.llm.language import identify, train
from weft.llm.mixing import mix_sources
from weft.llm.nearjoin import drop_near_duplicates
from weft.llm.queries import held_out, table, tokenizer_path
from weft.llm.tokenstore import store_tokens
from weft.shared import fresh_path


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """(weft_key, weft_row, ...): 128 bits of identifier and text, equal for repeated rows alone, the whole
    row, and the columns asked for; so no column of docs can clash with one of a stage."""
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(7), "doc_id").alias("b"))
    return docs.select(key.alias("weft_key"), _whole(docs).alias("weft_row"), *columns)


def _whole(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"weft_row.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; lang becomes the prediction."""
    model = train(docs.where(~held_out()), sample_key=F.col("doc_id"))
    kept = identify(docs.select(_whole(docs).alias("weft_row")), model, id_col="weft_row", text_in_id=True).where(~F.col("rejected"))
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"weft_row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate(_packed(docs, "text"), table(spark, sf_dir, "benchmark"), id_col="weft_key")
    hit = found.where("n_hit > 0").select(F.col("weft_key").alias("hit"))
    rows = _packed(docs)
    return _unpacked(rows.join(hit, F.col("weft_key") == F.col("hit"), "left_anti"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(_packed(docs, "text", "source"), id_col="weft_key").groupBy("weft_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    wanted = mixed.where("copies > 0").withColumnRenamed("weft_key", "m_key")
    joined = _packed(docs).join(wanted, F.col("weft_key") == F.col("m_key"))
    # Repeated rows share a key and, between them, their copies: the first ones take one more.  The
    # window needs the join's own partitioning and order, so it moves nothing.
    place = F.row_number().over(Window.partitionBy("weft_key").orderBy("weft_key"))
    share = F.floor(F.col("copies") / F.col("rows")) + (place <= F.pmod(F.col("copies"), F.col("rows"))).cast("long")
    shared = joined.withColumn("share", share).where("share > 0")
    return _unpacked(shared.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share")))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards, read back: a row per document of the mix."""
    return store_tokens(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

#: Language models, MinHash and random rounding have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
