"""Sources, sinks and streams."""

import json

import pytest
from corvid import sources as s
from corvid import streaming
from corvid.operators import chat, models
from pyspark.sql import functions as F


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "one", "page": 1}\n\n{broken\n{"q": "two", "page": 2}\n')
    path, schema = str(tmp_path / "a.jsonl"), "q string, page int"
    assert {r.q for r in s.jsonl(spark, path, schema).collect()} == {"one", "two"}
    assert [r._corrupt_record for r in s.jsonl(spark, path, schema, "audit").cache().collect() if r._corrupt_record] == ["{broken"]
    with pytest.raises(Exception, match="(?i)malformed"):
        s.jsonl(spark, path, schema, "fail").collect()


def test_csv_with_bom_and_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿question,answer\n"one","first\nsecond"\n"t""wo",x\n', encoding="utf-8")
    got = s.csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.question for r in got] == ["one", 't"wo'] and got[0].answer == "first\nsecond"
    s.write_csv(spark.createDataFrame([("a\nb", '"c"')], "x string, y string"), str(tmp_path / "out"))
    assert tuple(s.csv(spark, str(tmp_path / "out")).first()) == ("a\nb", '"c"')


def test_json_documents_and_scans(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"x": ["p", "q"], "y": []}))
    assert {r.key: r.value for r in s.json_map(spark, str(tmp_path / "m.json"), "array<string>").collect()} == {"x": ["p", "q"], "y": []}
    (tmp_path / "in" / "skip").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "one"}\n')
    (tmp_path / "in" / "b.csv").write_text("Question,z\ntwo,1\n")
    (tmp_path / "in" / "skip" / "c.csv").write_text("question\nthree\n")
    got = s.recursive(spark, str(tmp_path / "in"), "/skip/").collect()
    assert sorted(r.question for r in got) == ["one", "two"] and all("file" in r.file for r in got)
    assert s.or_else(spark, str(tmp_path / "none"), spark.read.text, lambda: spark.range(1)).count() == 1


def test_pages_and_images(spark, tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"one\x0c\x0ctwo")
    got = s.paged(spark, str(tmp_path), lambda b: b.decode().split("\x0c")).collect()
    assert [(r.source, r.page, r.text) for r in got] == [("d.pdf", 1, "one"), ("d.pdf", 3, "two")]
    assert s.listing(spark, str(tmp_path), ".pdf").first().name == "d.pdf"
    for name in ("cat/1.png", "cat/2.jpg", "dog/1.png"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"x")
    assert {r.category: len(r.paths) for r in s.manifest(s.images(spark, str(tmp_path / "img"))).collect()} == {"cat": 2, "dog": 1}


def test_sinks(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    s.write_new(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        s.write_new(df, path)
    old = s.replace(spark.range(5), path, backup=True)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(old).count() == 3
    assert s.replace(spark.range(1), path) is None and spark.read.parquet(path).count() == 1
    s.write_lines(df, str(tmp_path / "l"), F.concat(F.lit("n"), F.col("id")))
    assert spark.read.text(str(tmp_path / "l")).count() == 3
    a = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "k string, p int, q int")
    b = spark.createDataFrame([("y", 9, None), ("z", 5, 6)], "k string, p int, q int")
    assert sorted(map(tuple, s.upserted(a, b, "k").collect())) == [("x", 1, 2), ("y", 9, 4), ("z", 5, 6)]


def test_chat(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(6)], "conv_id int, turn int, role string, text string")
    assert chat.last_turns(m).first().history == "User: t2\nAssistant: t3\nUser: t4\nAssistant: t5\n"
    assert [(r.turn, r.question) for r in chat.asked_before(m).orderBy("turn").collect()] == [(1, "t0"), (3, "t2"), (5, "t4")]


def test_streamed_windows_equal_the_batch(spark, sf, tmp_path):
    log = streaming.log_stream(spark, sf, "events.parquet")
    streaming.to_memory(streaming.log_windows(log), "log_windows_test").stop()
    batch = streaming.log_windows(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    key = ["window_start", "event_type", "n"]
    assert sorted(map(tuple, spark.table("log_windows_test").select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_resumed_evaluation_does_each_question_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long").parquet(src)
        streaming.resumable(stream, lambda df: df.withColumn("answer", F.col("id") * 2), out, ck, "id")
    got = spark.read.parquet(out).collect()
    assert sorted(r.id for r in got) == list(range(20)) and all(r.answer == 2 * r.id for r in got)


def test_streamed_upserts(spark, tmp_path):
    src, at, ck = (str(tmp_path / x) for x in ("src", "at", "ck"))
    for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(src)
        streaming.upserting(spark.readStream.schema("k string, v int").parquet(src), "k", at, ck)
    assert sorted(map(tuple, spark.read.parquet(f"{at}/version=1").select("k", "v").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_outside_models_fail_softly(spark):
    def load():
        def run(texts):
            if any(t == "bad" for t in texts):
                raise ValueError
            return [t.upper() for t in texts]

        return run

    rows = spark.createDataFrame([("x",)], "t string")
    assert rows.select(models.model_column(load, F.col("t"), "string").alias("o")).first().o == "X"
    assert spark.createDataFrame([("bad",)], "t string").select(models.model_column(load, F.col("t"), "string").alias("o")).first().o is None
