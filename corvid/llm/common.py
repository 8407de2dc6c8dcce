"""Helpers the operators share: tables, lineage cuts, held-out folds, connected components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space and the characters 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"

#: A table of at most this many narrow rows may be broadcast; larger ones go through a shuffle.
BROADCAST_ROWS = 200_000

#: Edges that a task of components() takes at least.
PART_EDGES = 50_000

#: Rows in an Arrow batch of texts.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session of one machine (local[n], as in tests) gets a folder of its own; a cluster is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvid-checkpoint-"))
        set_ = sc._jsc.sc().getCheckpointDir()
    return set_.get()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing needs any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Has the JVM collect its garbage, upon which Spark deletes shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sieve(df: DataFrame, name: str, rows: int, bits_a_row: int, most: int) -> tuple[Column, int]:
    """A bitmap of the rows' hashes (long) in a column as an array literal of numbers of 64 bits, and its bits: a power of two, `most` at most."""
    bits = min(max(1 << 12, 1 << (bits_a_row * rows).bit_length()), most)
    slot = F.col(name).bitwiseAND(F.lit(bits - 1).cast("long"))
    words = df.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    found = {r["i"]: r["b"] for r in words.collect()}  # at most `most` / 64 rows
    listed = ",".join(str(found.get(i, 0)) for i in range(bits // 64))
    return F.expr(f"cast(split('{listed}', ',') as array<bigint>)"), bits  # one constant to the plan


def bitmap(df: DataFrame, name: str, rows: int, bits_a_row: int, most: int) -> tuple[Column, int]:
    """sieve() as a subquery of one row, for large ones: neither the driver nor the text of a plan holds the numbers."""
    bits = min(max(1 << 12, 1 << (bits_a_row * rows).bit_length()), most)
    slot = F.col(name).bitwiseAND(F.lit(bits - 1).cast("long"))
    words = df.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    zeros = df.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b"))
    dense = words.unionByName(zeros).groupBy("i").agg(F.expr("bit_or(b)").alias("b"))
    one = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda w: w["b"]).alias("words"))  # `most` / 64 numbers
    return cut(one).scalar(), bits


def passes(hash_: Column, words: Column, bits: int) -> Column:
    """Whether a hash may be among those of the sieve: true for all that are."""
    bit = hash_.bitwiseAND(F.lit(bits - 1).cast("long"))
    return F.bit_get(F.get(words, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores at its end until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> None:
    """From now on Python workers of df's session get at most BATCH_ROWS texts at once: texts are long, memory is not."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def in_fold(doc_id: Column, by: int, fold: int) -> Column:
    """True where the remainder is the fold; a null doc_id is in no fold."""
    return F.coalesce(remainder(doc_id, by) == fold, F.lit(False))


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) fixed by seed and cols."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its measured number of rows is within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once: a plain column would be copied into each lambda and evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def columns_of(df: DataFrame) -> list[Column]:
    """Its columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): (node, root), root the least node reachable.

    Alternates the large-star and small-star steps: the edges of a component turn into a star
    around its least node in a number of rounds logarithmic in its size. Each round is written to
    the shared folder, in as many parts as its rows call for, so that small graphs make few files.
    Nodes without an edge don't appear. Empty edges give an empty result.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n, before = now.count(), None
    while n:
        fit = lambda df, k=n // PART_EDGES + 1: df.coalesce(k)
        both = fit(now).unionByName(fit(now).select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fit(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = fit(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = fit(large.groupBy("u").agg(F.min("v").alias("m")))
        small = fit(large.join(least, "u")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = cut(fit(small))
        n, digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (n, digest) == before:
            break
        before = n, digest
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
