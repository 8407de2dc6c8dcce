"""Scans and sinks. Files that hold one record a line are read and written by Spark's own formats."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, name, length of the files with a suffix; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def paged(spark: SparkSession, path: str, extract: Callable[[bytes], Sequence[str]], suffix: str = ".pdf") -> DataFrame:
    """source, page (from 1), text of binary documents; extract gives a document's pages. Empty pages are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, content in zip(pdf["source"], pdf["content"], strict=True):
                texts = extract(bytes(content))
                yield pd.DataFrame({"source": source, "page": range(1, len(texts) + 1), "text": list(texts)})

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")
    return named.mapInPandas(pages, "source string, page int, text string").where(F.trim("text") != "")


def whole_documents(pages: DataFrame, by: Sequence[str], order: str, text: str = "text", sep: str = "") -> DataFrame:
    """by, text: the pages of each document joined in order. A document's pages are its own size."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "drop") -> DataFrame:
    """Records of JSON lines. Bad lines: `drop`ped, `fail` the read, or kept as CORRUPT in an `audit`."""
    if mode == "audit":
        return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(schema).option("mode", {"drop": "DROPMALFORMED", "fail": "FAILFAST"}[mode]).json(path)


def bad_lines(spark: SparkSession, path: str, required: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """file, line (from 1), reason of the lines of JSON that don't parse, lack a required field or have another label. Files are small: one is split by one task."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", "\n")).alias("at", "raw")).where(F.trim("raw") != "")
    got = F.from_json("raw", "map<string, string>")
    rows = rows.withColumn("got", F.when(F.try_parse_json("raw").isNotNull(), got))
    lacks = F.array_join(F.filter(F.array(*map(F.lit, required)), lambda k: F.trim(F.coalesce(F.get(F.filter(F.map_entries("got"), lambda x: x["key"] == k), F.lit(0))["value"], F.lit(""))) == ""), ", ")
    known = F.coalesce(F.element_at("got", label).isin(*labels), F.lit(False))
    reason = F.when(F.col("got").isNull(), "not JSON").when(lacks != "", F.concat(F.lit("lacks "), lacks)).when(~known, "unknown label")
    return rows.select("file", (F.col("at") + 1).alias("line"), reason.alias("reason")).where("reason is not null")


def jsonl_checked(spark: SparkSession, path: str, schema: str, required: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """The records, or an error that names the first bad line."""
    first = bad_lines(spark, path, required, label, labels).orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first['file']}, line {first['line']}: {first['reason']}")
    return jsonl(spark, path, schema, "fail")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and, if any, a byte order mark; all strings without a schema."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path, schema=schema)
    return df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array or object."""
    return spark.read.option("multiLine", True).json(path, schema=schema)


def metrics(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """file and the fields of all JSON documents that a glob finds; unreadable ones are left out."""
    raw = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(path, wholetext=True)
    raw = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value").where(F.try_parse_json("value").isNotNull())
    return raw.select("file", F.from_json("value", fields).alias("m")).select("file", "m.*")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value of a file that is one JSON object; value: the type of its values."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string, {value}>")))


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first non-empty of the named columns that df has, as text."""
    there = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def recursive(spark: SparkSession, path: str, exclude: str = "") -> DataFrame:
    """question, file of all .jsonl and .csv files below a folder but those whose path has `exclude`."""
    out = spark.createDataFrame([], "question string, file string")
    for suffix, read in ((".jsonl", lambda r: r.json(path)), (".csv", lambda r: r.option("header", True).option("multiLine", True).csv(path))):
        names = listing(spark, path, suffix)
        if exclude:
            names = names.where(~F.contains("path", F.lit(exclude)))
        if names.isEmpty():
            continue
        df = read(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}"))
        rows = df.select(first_of(df, ["question", "text", "input", "Question"]).alias("question"), F.col("_metadata.file_path").alias("file"))
        if exclude:
            rows = rows.where(~F.contains("file", F.lit(exclude)))
        out = out.unionByName(rows.where("question is not null"))
    return out


def or_else(spark: SparkSession, path: str, read: Callable[[str], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """read(path) if the path exists, else the fallback."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else fallback()


def images(spark: SparkSession, path: str, suffix: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """path, category (the folder), content of an image tree; the content is read only if selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("category"), "length", "content")


def manifest(files: DataFrame) -> DataFrame:
    """category, paths in order."""
    return files.groupBy("category").agg(F.array_sort(F.collect_list("path")).alias("paths"))


# Sinks -----------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_new(df: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def write_lines(df: DataFrame, path: str, line: Column, mode: str = "overwrite") -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def replace(df: DataFrame, path: str, backup: bool = False) -> str | None:
    """Writes df beside path and renames it into its place; the old folder is kept under the returned name with backup."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    fs = at(path).getFileSystem(conf)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(at(aside), at(path)):
        raise OSError(f"{aside} can't be moved")
    if had and not backup:
        fs.delete(at(old), True)
    return old if had and backup else None


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows by key; where both have one, new's values win column by column unless null."""
    a, b = old.alias("a"), new.alias("b")
    cols = [c for c in old.columns if c != key]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in cols])


def chat_markdown(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, value: each conversation as Markdown."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), F.coalesce("text", F.lit("")))
    return whole_documents(messages.withColumn("line", line), [by], "turn", "line", "\n\n").withColumnRenamed("text", "value")
