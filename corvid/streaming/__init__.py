"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvid.sources import upserted


def log_stream(spark: SparkSession, path: str, files: str = "*.parquet") -> DataFrame:
    """The query log as a stream; ts as a timestamp, which watermarks need."""
    schema = spark.read.option("pathGlobFilter", files).parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def log_windows(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, mean_value of a batch or stream of the log."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    out = rows.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def log_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(log: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark on a stream."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if log.isStreaming else log.dropDuplicates([key])


def run_available(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands what is there to batch, once each; a restart with the checkpoint goes on where it was."""
    query = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def resumable(questions: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> None:
    """Evaluates a stream of questions into a folder, each key once, whichever file or batch it comes in again.

    A batch writes a folder of its own number, so a repeated batch replaces itself.
    """
    spark = questions.sparkSession

    def one(df: DataFrame, n: int) -> None:
        new = df.dropDuplicates([key])
        before = [f"{out}/batch={i}" for i in range(n) if there(spark, f"{out}/batch={i}/_SUCCESS")]
        if before:
            new = new.join(spark.read.parquet(*before).select(key).distinct(), key, "left_anti")
        evaluate(new).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_available(questions, one, checkpoint)


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upserting(changes: DataFrame, key: str, at: str, checkpoint: str, order: str | None = None) -> None:
    """Keeps a table by key: each batch writes the next version, and the newest version is the table; the one before stays, older ones go.

    Of a key's rows in a batch the last in `order` wins; without it, the greatest row, column by column.
    """
    spark = changes.sparkSession

    def one(df: DataFrame, n: int) -> None:
        rest = [c for c in df.columns if c != key]
        last = F.max_by(F.struct(*rest), F.struct(order, *rest) if order else F.struct(*rest))
        new = df.groupBy(key).agg(last.alias("__row")).select(key, "__row.*").select(*df.columns)
        old = spark.read.parquet(f"{at}/version={n - 1}") if n else new.limit(0)
        upserted(old, new, key).write.mode("overwrite").parquet(f"{at}/version={n}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/version={n - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    run_available(changes, one, checkpoint)


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream over what is there into a table in memory, for tests and small reports."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
