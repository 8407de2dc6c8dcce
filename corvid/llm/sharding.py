"""Sharding by size-tiered compaction, in DataFrame functions throughout.

A Lake is a folder of immutable Parquet shards and versioned manifests.

* append() writes rows as small shards, a few for each task, without a shuffle.
* compact() puts shards into tiers by the logarithm of their size, packs runs of RUN_LEAST or more
  shards of one tier up to the target size, and writes each run as one file. Shards that no run
  takes, and those of the target size or more, stay as they are.
* A manifest is written aside and renamed to its version, in one step that fails if the version
  exists; readers see the old or the new one, whole. Shards that no kept manifest names are waste,
  also those that failed attempts leave; vacuum() deletes them.

Sizes come from file metadata, so planning reads no column. The plan has a row for each shard.

Defined results: nulls in any column, empty texts and repeated rows are stored as they are. Columns
of any name go along, but for those that differ in case only, which Spark can't tell apart. Appending
no rows commits a version without new shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, cut, fresh, maybe_broadcast, shared_dir

TARGET_BYTES = 128 << 20
TIER_BASE = 4
RUN_LEAST = 2
#: Shards whose sizes one task sums up.
SLICE_SHARDS = 10_000
MANIFEST = "shard string, file string, rows long, bytes long, tier int, version long"


class Lake:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _list(self, name: str) -> list[str]:
        fs = self._path(name).getFileSystem(self.conf)
        return sorted(x.getPath().getName() for x in fs.listStatus(self._path(name))) if fs.exists(self._path(name)) else []

    def versions(self) -> list[int]:
        return [int(x[1:]) for x in self._list("manifests") if x.startswith("v")]

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the latest by default."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version or known[-1]:012d}")

    def _commit(self, shards: DataFrame, version: int) -> None:
        aside = f"manifests/.{uuid.uuid4()}"
        shards.coalesce(1).write.parquet(f"{self.root}/{aside}")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("manifests").toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._path(aside), self._path(f"manifests/v{version:012d}"), none)

    def _files(self, folder: str) -> DataFrame:
        """file (relative to the root), rows, bytes of the Parquet files of a folder of data."""
        raw = self.spark.read.parquet(f"{self.root}/data/{folder}")
        at = F.regexp_extract("_metadata.file_path", f"/data/({folder}/.*)$", 1)
        return raw.select(at.alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))

    def _shards(self, folder: str, version: int) -> DataFrame:
        name = F.regexp_replace("file", "/part-(\\d+)-.*-(c\\d+)[.].*$", "/part-$1-$2")
        tier = F.floor(F.log(float(TIER_BASE), F.greatest(F.col("bytes") / 1024, F.lit(1.0)))).cast("int")
        return self._files(folder).select(name.alias("shard"), "file", "rows", "bytes", tier.alias("tier"), F.lit(version).cast("long").alias("version"))

    def append(self, rows: DataFrame, rows_per_file: int = 0) -> int:
        """Writes rows as new shards and commits a version with them."""
        version = max(self.versions(), default=0) + 1
        folder = f"arrived-{version:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        self._commit(self.manifest().unionByName(self._shards(folder, version)), version)
        return version

    def plan(self) -> DataFrame:
        """The latest manifest with run: its number from 0, null for shards that stay.

        Sizes are summed up in slices of SLICE_SHARDS shards by a hash of the file, and then slice by slice, so no task
        sorts a whole tier.
        """
        small = self.manifest().where(F.col("bytes") < self.target)
        slices = max(1, small.count() // SLICE_SHARDS)
        small = small.withColumn("slice", F.pmod(F.xxhash64("file"), F.lit(slices)))
        per = small.groupBy("tier", "slice").agg(F.sum("bytes").alias("all"))
        up_to = lambda w: F.coalesce(F.sum(F.col("all")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        per = per.select("tier", "slice", up_to(W.partitionBy("tier").orderBy("slice")).alias("before"))
        within = F.coalesce(F.sum("bytes").over(W.partitionBy("tier", "slice").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        small = small.withColumn("within", within).join(per, ["tier", "slice"])
        small = cut(small.select("file", "tier", F.floor((F.col("before") + F.col("within")) / self.target).alias("nth")))
        runs = small.groupBy("tier", "nth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RUN_LEAST)
        # Numbered in the order of tier and place: a tier's runs begin after those of the tiers before.
        tiers = runs.groupBy("tier").agg(F.max("nth").alias("most"))
        first = F.coalesce(F.sum(F.col("most") + 1).over(W.orderBy("tier").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        runs = runs.join(tiers.select("tier", first.alias("first")), "tier").select("tier", "nth", (F.col("first") + F.col("nth")).cast("int").alias("run"))
        return self.manifest().join(small.join(runs, ["tier", "nth"]).select("file", "run"), "file", "left")

    def compact(self) -> int:
        """Merges the planned runs, each by one task into one file, and commits a version with what results; the version stays if there are none."""
        version = max(self.versions(), default=0)
        plan = cut(self.plan())
        most = plan.agg(F.max("run")).first()[0]
        if most is None:
            return version
        version += 1
        folder = f"merged-{version:012d}-{uuid.uuid4().hex[:8]}"
        rows, run = self._rows(plan.where("run is not null").select("file", F.struct("run").alias("side")))
        rows.repartitionById(most + 1, F.col(run)["run"]).drop(run).write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        self._commit(plan.where("run is null").drop("run").unionByName(self._shards(folder, version)), version)
        return version

    def _rows(self, shards: DataFrame) -> tuple[DataFrame, str]:
        """The rows of the shards (file, side), read from these files alone, with a column that holds side; and that column's name."""
        files = sorted(r["file"] for r in shards.select("file").collect())  # paths, as Spark lists them to scan a table
        raw = self.spark.read.option("mergeSchema", len({f.partition("/")[0] for f in files}) > 1).parquet(*[f"{self.root}/data/{f}" for f in files])
        key, side = fresh(raw, "__shard_file"), fresh(raw, "__shard_side")
        at = F.regexp_extract("_metadata.file_path", "/data/([^/]+/[^/]+)$", 1)
        rows = raw.select(*columns_of(raw), at.alias(key))
        known = shards.select(F.col("file").alias(key), F.col("side").alias(side))
        return rows.join(maybe_broadcast(known, len(files)), key).drop(key), side

    def read(self) -> DataFrame:
        """The rows of the latest version."""
        rows, side = self.stored()
        return rows.drop(side)

    def stored(self) -> tuple[DataFrame, str]:
        """The rows of the latest version, with a struct of shard, rows, bytes, tier and version of their shard; and its name."""
        return self._rows(cut(self.manifest().select("file", F.struct("shard", "rows", "bytes", "tier", "version").alias("side"))))

    def vacuum(self) -> None:
        """Deletes the folders of data, and the manifests, that the latest version doesn't need."""
        used = {r["folder"] for r in self.manifest().select(F.substring_index("file", "/", 1).alias("folder")).distinct().collect()}
        gone = [f"data/{x}" for x in self._list("data") if x not in used] + [f"manifests/v{v:012d}" for v in self.versions()[:-1]]
        for name in gone:
            self._path(name).getFileSystem(self.conf).delete(self._path(name), True)


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, rows_per_file: int = 0) -> DataFrame:
    """Appends docs to a new lake in the shared folder, compacts it, and returns doc_id, shard, tier, shard_rows, shard_bytes, version of every row stored."""
    lake = Lake(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}", target_bytes)
    lake.append(docs, rows_per_file)
    lake.compact()
    lake.vacuum()
    if lake.manifest().isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, shard string, tier int, shard_rows long, shard_bytes long, version long")
    rows, side = lake.stored()
    of = F.col(side)
    name = F.regexp_replace(of["shard"], "^(\\w+)-0*(\\d+)-[0-9a-f]+", "$1-$2")
    return rows.select("doc_id", name.alias("shard"), of["tier"].alias("tier"), of["rows"].alias("shard_rows"), of["bytes"].alias("shard_bytes"), of["version"].alias("version"))
