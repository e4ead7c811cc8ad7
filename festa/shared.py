"""The folder that the driver and all executors share, and what is kept there between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, or a temporary one if all of Spark is one local process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="festa-checkpoint-")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_festa-checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: cut lineage, of which each later use reads its columns alone."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, amount: Column, *by: Column) -> DataFrame:
    """``rows``, stored, with ``before``, the sum of ``amount`` (null: 0) over all rows that come earlier in the order of ``by``.

    One sort by range; sums of partitions first, so no task holds all rows. ``by`` must be a total order for equal reruns.
    """
    placed = rows.withColumn("__amount", F.coalesce(amount.cast("double"), F.lit(0.0))).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(placed.withColumn("__place", F.monotonically_increasing_id())).withColumn("__part", F.shiftrightunsigned("__place", 33))
    sizes = placed.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    earlier = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("__part", F.coalesce(earlier, F.lit(0.0)).alias("__start"))
    within = F.sum("__amount").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    told = placed.withColumn("__within", F.coalesce(within, F.lit(0.0))).join(F.broadcast(starts), "__part")
    return told.withColumn("before", F.col("__start") + F.col("__within")).drop("__amount", "__place", "__part", "__start", "__within")
