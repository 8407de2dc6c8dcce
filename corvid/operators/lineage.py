"""Cutting lineage, folders for intermediate tables, and places in an order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a session of one machine without either gets its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corvid-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """rows with their place (from 1) in the order of their `by` group.

    Rows are dealt to ranges of group and order, places counted within a range and summed up over a group's ranges, so
    that a large group is ranked by many tasks.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(ranges, *by, *order).withColumn("__range", F.spark_partition_id()))
    per = dealt.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__of"), before.alias("__before"))
    same = F.col("__range") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    nth = F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order))
    return dealt.withColumn("__nth", nth).join(per, same).select(*rows.columns, (F.col("__nth") + F.col("__before")).alias(name))
