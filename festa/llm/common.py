"""Shared helpers: reading tables, text defaults, reliable checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from festa.shared import shared_folder

#: The six white space characters that the text contracts name.
WHITE_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and the pipeline's stages."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that each later use reads only the columns that it needs."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``cut``, in as many partitions as its size asks for: what follows a wide shuffle may be small."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def learn_row() -> Column:
    """Rows that a model may learn from: crc32 of the id's text, modulo 3, is not 1 (a null id is never learnt from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key(doc_id: Column, text_digest: Column) -> Column:
    """One key for a row's id (null differs from all) and the digest of its text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_digest).cast("binary"), 256))


def rows_of_keys(docs: DataFrame, own: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key ``own`` is among those of ``kept`` (one column), once each; texts move once, by key."""
    keyed, keys = docs.withColumn("__key", own), kept.toDF("__key")
    return keyed.join(keys, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
