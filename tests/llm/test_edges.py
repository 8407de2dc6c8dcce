"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns of clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from corvid.llm import context_tree, decontamination, language_id, mixing, quotations, ranking, rules, sharding, simhash, wrappers
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, h long, fp string, held_out boolean, n_words int, key string, w string, block long, `a.b` int, rep long, band int, copies int, run string"
EXTRA = (0.5, 1, 2, "x", True, 3, "k", "w", 7, 8, 9, 10, 11, "r")
WORDS = "the quick brown fox jumps over a lazy dog and runs away from this big bad house".split()
CLASH = "__mix_words int, __mix_plan int, __simhash_keep int, __language_id int, __shard_side int, __shard_file int, row int, text_hash int, range int, own int"


def text(n: int, step: int = 1) -> str:
    return " ".join(WORDS[(i * step * i + i) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, text(60), "en", "a", 1, *EXTRA),
        (1, text(60), "en", "a", 1, *EXTRA),
        (2, text(60), "en", "b", 1, *EXTRA),
        (3, None, None, None, None, *[None] * 14),
        (4, "", "en", "a", 0, *EXTRA),
        (5, " \n\t ", "de", "b", 0, *EXTRA),
        (6, "12345 !!! ###", "de", "", 1, *EXTRA),
        (7, text(60_000, 3), "en", "a", 1, *EXTRA),
        (8, "die und der das ist nicht ein haus für den mann mit dem hund " * 9, "de", "b", 1, *EXTRA),
        (9, "x", "de", "c", 1, *EXTRA),
        (None, text(70, 5), "en", "a", 1, *EXTRA),
        (None, None, None, "c", None, *EXTRA),
        (10, "A" * 200_000, "en", "c", 1, *EXTRA),
        (11, "a\x00b   é " + text(30), "en", "c", 1, *EXTRA),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 1), (8, 0, None), (None, 1, 0), (9, None, 0), (9, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, text(12, 7)), (2, None), (3, ""), (None, text(9)), (4, "two words")], "item_id long, text string")


def runs(bench, labels):
    return {
        "op1": lambda d: rules.judge(d, labels),
        "op2": mixing.mix,
        "op5": lambda d: ranking.rank(d, labels),
        "op6": lambda d: decontamination.flag(d, bench),
        "op7": lambda d: sharding.shard(d),
        "op8": lambda d: context_tree.score(d, block_bytes=100_000),
        "op9": simhash.near_duplicates,
        "op10": language_id.identify,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_every_row_gets_a_result(name, docs, bench, labels):
    out = runs(bench, labels)[name](docs).collect()
    given = [r.doc_id for r in docs.collect()]
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in out), key=key) == sorted(given, key=key)
    by = {}
    for r in out:
        if r.doc_id is not None and name != "op7":
            assert by.setdefault(r.doc_id, r) == r  # repeated rows, equal results


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_table(name, docs, bench, labels):
    assert runs(bench, labels)[name](docs.limit(0)).collect() == []


def test_rows_without_an_id_are_contaminated_too(spark):
    item = "A train leaves at noon and the passengers wave to those who stay behind on the platform"
    rows = [(None, f"before {item} after"), (None, "nothing of it here at all"), (1, "a text of its own"), (1, item), (1, item), (2, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = [(r.doc_id, r.contaminated) for r in decontamination.flag(given, items).collect()]
    assert sorted(got, key=str) == sorted([(None, True), (None, False), (1, False), (1, True), (1, True), (2, False)], key=str)
    assert sorted((r.text or "" for r in decontamination.clean(given, items).collect())) == ["", "a text of its own", "nothing of it here at all"]


def test_empty_side_tables(docs, bench, labels):
    assert not any(r.contaminated for r in decontamination.flag(docs, bench.limit(0)).collect())
    assert all(r.score == 0.5 and r.predicted == 1 for r in ranking.rank(docs, labels.limit(0)).collect())
    assert rules.judge(docs, labels.limit(0)).count() == docs.count()


def test_stages(spark, docs, bench, tmp_path):
    sf_dir = str(tmp_path)
    bench.write.parquet(f"{sf_dir}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf_dir)
            if name != "sharding":
                assert out.columns == docs.columns, name
            now = out
        assert now.count() >= 0


def test_stages_keep_columns_that_clash(spark, docs, bench, tmp_path):
    sf_dir = str(tmp_path)
    bench.write.parquet(f"{sf_dir}/benchmark.parquet")
    names = [c.split()[0] for c in CLASH.split(", ")]
    now = docs.where("doc_id in (1, 7, 8)").select("doc_id", "text", "lang", "source", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == now.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(names)), name
    assert sharding.shard(now).count() == now.count()


def test_language_stage_rejects_only_the_unclear(spark, docs):
    kept = {r.doc_id for r in language_id.keep_identified(docs).collect()}
    assert {1, 2, 7, 8} <= kept and not kept & {3, 4, 5, 6}


def test_dedup_stage_keeps_one_of_each(docs):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert kept.count(1) == 1 and 2 not in kept  # 1 and 2 have one text
    assert kept.count(3) == 1 and not {4, 5} & set(kept)  # no words: one fingerprint


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(1, None, None, "t", "h"), (2, "nonsense", "", "t", "h"), (3, "http://A.b/c", "just text", "t", "h"), (None, "http://a.b", "<p>x", None, None), (3, "http://A.b/c", "just text", "t", "h"), (4, "http://l.o", "<article>" + "<p>word &amp; more</p>" * 50_000, "t", "h")]
    got = wrappers.main_text(spark.createDataFrame(rows, schema)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == "" and texts[2] == "" and texts[4] == "\n".join(["word & more"] * 50_000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.main_text(spark.createDataFrame([], schema)).collect() == []


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, position int, level int, h long"
    rows = [(1, 0, "user", "Hello there", 1, 2, 3), (1, 1, None, None, None, None, None), (1, 1, None, None, None, None, None), (None, 2, "user", "> Hello there", 1, 1, 1), (2, None, "user", "x", 1, 1, 1), (3, 0, "user", "> " + "long " * 50_000, 1, 1, 1)]
    got = quotations.conversations(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(r.position is None for r in got if r.conv_id is None)
    assert sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2]
    assert quotations.conversations(spark.createDataFrame([], schema)).collect() == []
