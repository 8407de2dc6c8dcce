"""Each operator against a brute-force version, planted cases or held-out accuracy."""

import json
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from corvid.llm import context_tree, decontamination, language_id, mixing, quotations, ranking, rules, sharding, simhash, wrappers
from corvid.llm.common import components, table
from corvid.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


# 1 ---------------------------------------------------------------------------------------------


def brute_counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    at = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(at)


@pytest.mark.parametrize("text", ["", "a", "a a a a", "a b c a b c", "x\n\nx\nx \n", "é é # | <b>", "a b a b a b a", "one\x0btwo\x0cthree\r\nfour" * 3])
def test_counts_by_hand(text):
    assert rules.counts(text)[:5] == brute_counts(text)


def test_counts(rows):
    for r in rows:
        assert rules.counts(r.text)[:5] == brute_counts(r.text)


def test_forest_keeps_the_good(spark, sf, docs):
    out = {r.doc_id: r for r in QUERIES["op1_isolation_forest"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    for r in out.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    able = [i for i in labels if not out[i].base_failed]
    good, bad = [i for i in able if labels[i]], [i for i in able if not labels[i]]
    assert sum(out[i].kept for i in good) >= 0.97 * len(good) and sum(out[i].kept for i in bad) <= 0.2 * len(bad)


def test_forest_paths_isolate():
    x = np.zeros((500, 3))
    x[0] = 9
    x[1:, 0] = np.arange(499) % 7
    paths = rules.Forest(x, trees=50).path(x)
    assert paths[0] < paths[1:].min()


def brute_path(forest, tree, x):
    """The path length of a row in one tree, by recursion."""

    def down(node):
        if forest.column[tree, node] < 0:
            return forest.length[tree, node]
        return down(2 * node + (1 if x[forest.column[tree, node]] <= forest.value[tree, node] else 2))

    return down(0)


def test_verdicts_equal_brute_force(spark, sf, docs, rows):
    """Statistics, forest, calibration and verdict, each worked out again in plain Python."""
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    stats = {r.doc_id: dict(zip(rules.COUNTS, rules.counts(r.text), strict=True)) for r in rows}
    grade = lambda s: [math.floor(a / max(b, 1) / g) for a, b, g in ((s["n_symbols"], s["word_chars"], 0.02), (s["n_upper"], s["word_chars"], 0.1), (s["n_digits"], s["word_chars"], 0.1), (s["n_marks"], s["n_words"], 0.05), (s["n_same"], s["n_words"], 0.05))]
    failed = {i: s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"] for i, s in stats.items()}
    able = [i for i in stats if not failed[i]]  # fewer than the forest's sample, so all of them are in it
    assert len(able) < rules.TREES * rules.SUBSAMPLE
    x = np.array(sorted((grade(stats[i]) for i in able), key=lambda g: g[::-1]), float)
    forest = rules.Forest(x)
    path = {i: sum(brute_path(forest, t, grade(stats[i])) for t in range(rules.TREES)) / rules.TREES for i in able}
    step = (forest.depth + rules.average_path(rules.SUBSAMPLE)) / rules.BINS
    bins = {i: math.floor(p / step + 1e-12) for i, p in path.items()}
    good, bad = ([bins[i] for i in able if labels.get(i) == q] for q in (1, 0))
    allowed = [t for t in range(rules.BINS + 1) if sum(b < t for b in good) <= (1 - rules.KEEP_GOOD) * len(good)]
    merit = lambda t: sum(b < t for b in bad) / len(bad) + sum(b >= t for b in good) / len(good)
    best = max(map(merit, allowed))
    out = {r.doc_id: r for r in QUERIES["op1_isolation_forest"](spark, sf).collect()}
    assert all(abs(out[i].path_length - path[i]) <= 1.01 * step for i in able) and not any(out[i].kept for i in stats if failed[i])
    kept = [out[i].path_length for i in able if out[i].kept]
    assert merit(round(min(kept) / step)) == pytest.approx(best) and all(out[i].path_length < min(kept) for i in able if not out[i].kept)


# 2 ---------------------------------------------------------------------------------------------


def brute_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(totals.values()), set()
    while True:
        left = total - sum(3 * totals[s] for s in capped)
        level = left / max(sum(weight[s] for s in names if s not in capped), 1e-9)
        over = {s for s in names if s not in capped and level * weight[s] > 3 * totals[s]}
        if not over:
            return {s: 3 * totals[s] if s in capped else level * weight[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 500}, {"a": 1, None: 1}, {"x": 5}, {"": 0, "b": 7, "c": 9, "d": 1000, "é": 3}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_exact_where_it_can_be(seed):
    rnd = random.Random(seed)
    lengths = sorted(rnd.sample(range(1, 60), 4))
    counts = [rnd.randint(1, 5) for _ in lengths]
    total = sum(a * n for a, n in zip(lengths, counts, strict=True))
    target = rnd.uniform(0, 3 * total)
    every, more = mixing.fit(lengths, counts, target)
    assert all(0 <= x < n and 0 <= k + (x > 0) <= 3 for k, x, n in zip(every, more, counts, strict=True))
    got = sum(a * (k * n + x) for a, k, x, n in zip(lengths, every, more, counts, strict=True))
    # So small a target is filled as nearly as any copies above a proportional start can.
    share = round(target) // 2
    start = [share * n // total for n in counts]
    sums = {sum(a * x for a, x in zip(lengths, start, strict=True))}
    for a, n, x in zip(lengths, counts, start, strict=True):
        sums = {s + a * k for s in sums for k in range(3 * n - x + 1)}
    assert got == max(s for s in sums if s <= round(target))


@pytest.mark.parametrize("n", [3, 300, 30_000])
def test_fit_takes_documents_evenly(n):
    """Of lengths that all differ, documents get the copies of the source's share, not three of the longest."""
    lengths, counts = list(range(100, 100 + n)), [1] * n
    total = sum(lengths)
    for share in (0.4, 1.0, 1.7, 3.0):
        every, more = mixing.fit(lengths, counts, share * total)
        got = sum(a * (k + x) for a, k, x in zip(lengths, every, more, strict=True))
        assert abs(got - share * total) <= (60 if n == 3 else 1)
        if n > 3:
            assert sum(k + x > math.floor(share) + 1 for k, x in zip(every, more, strict=True)) <= 2


def test_mix(spark, sf, rows):
    out = QUERIES["op2_source_mix"](spark, sf).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, QUERIES["op2_source_mix"](spark, sf).collect()))
    of = {r.doc_id: r.source for r in rows}
    size = {r.doc_id: len(WORD.findall(r.text)) for r in rows}
    totals = Counter()
    for i, s in of.items():
        totals[s] += size[i]
    want, taken = brute_targets(totals), Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == totals[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert r.taken in {k * r.size for k in range(4)}
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)


def test_a_hot_length_is_ranked_in_slices(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 4000, "x").otherwise("y").alias("source"))
    out = mixing.mix(many).groupBy("doc_id").agg(F.max("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("s"))
    by = {r.s: (r.n, r.target) for r in out.groupBy("s").agg(F.sum("t").alias("n"), F.max("target").alias("target")).collect()}
    assert all(abs(n - t) <= 3 for n, t in by.values())


# 3 ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T{0}</title><style>p {{ color: red }}</style><script>if (a < b) document.write("<p>no</p>");</script></head><body>
<header><h1>Site</h1><nav><ul>{1}</ul></nav></header><div class="cookie-notice"><p>We use cookies.</p></div><aside class="sidebar"><p>Popular {0}</p></aside>
<main><article><h1>Title {0} &amp; more</h1><p>First <b>bold</b> and <a href="x">link</a>&nbsp;text {0}.<p>Second&#33; line<br>break {0}{2}<form><input name=q><p>Search</p></form><div class="ad">Buy {0}</div><div class="share">Share this</div></article>
<section id="comments"><h2>Comments</h2><p>Reader {0} says</p></section></main><footer>&copy; {0}</footer></body></html>"""


def page(i):
    links = "".join(f"<li><a href='/{k}'>L{k}</a></li>" for k in range(1 + i % 4))
    parts = "".join(f"<h2>Head {i} {k}</h2><p>Part {i} {k}</p>" for k in range(i % 3))
    return PAGE.format(i, links, parts)


def test_wrapper_extraction(spark):
    pages = spark.createDataFrame([(i, f"https://h{i % 2}.example/{i}", page(i)) for i in range(30)], "page_id long, url string, html string")
    for r in wrappers.main_text(pages).collect():
        i = r.page_id
        want = [f"Title {i} & more", f"First bold and link text {i}.", f"Second! line break {i}"]
        for k in range(i % 3):
            want += [f"Head {i} {k}", f"Part {i} {k}"]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)


def test_hosts_of_several_templates(spark):
    def html(i):
        if i % 3 == 0:
            return page(i)
        if i % 3 == 1:
            return f"<body><div id=top-menu><a href=/>Home</a></div><div class='post-content'><h1>T {i}</h1><div>Plain {i} text</div></div><div class=related>More {i}</div>"
        return f"<table><tr><td><p>Bare {i} paragraph</p></td></tr></table><ul><li><a href=/{i}>Link {i}</a></li></ul>"

    pages = spark.createDataFrame([(i, "https://one.example/x", html(i)) for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    assert all(got[i] == (f"T {i}\nPlain {i} text" if i % 3 == 1 else f"Bare {i} paragraph") for i in got if i % 3)
    assert all(got[i].startswith(f"Title {i} & more\nFirst") for i in got if i % 3 == 0)


def tree(html):
    root, texts = wrappers.parse(html)
    return wrappers.fold(wrappers.nodes_of(root, [wrappers.text_hash(t) for t in texts], {wrappers.text_hash("x")})[3])


def test_alignment_finds_optional_and_repeated_groups():
    a, b = tree("<div><p>a<p>b<hr><h2>x</h2></div>"), tree("<div><h2>x</h2><ul><li>1<li>2</ul></div>")
    (div,) = wrappers.align(a, b)
    kinds = {c[0]: (c[1], c[2]) for c in div[3]}
    assert kinds == {"p": (True, True), "h2": (False, False), "ul": (True, False)}
    assert next(c for c in div[3] if c[0] == "h2")[3][0][0] == f"#={wrappers.text_hash('x')}"  # a literal
    groups = tree("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")
    assert [g[0] for g in groups] == ["(h2 p)"] and groups[0][2]
    assert [g[0] for g in wrappers.align(groups, tree("<h2>e</h2><p>f</p>"))] == ["(h2 p)"]


@pytest.mark.parametrize("seed", range(8))
def test_alignment_of_long_sequences_matches_in_order(seed, monkeypatch):
    rnd = random.Random(seed)
    a, b = ([rnd.choice("abcdefghij") + str(rnd.randrange(5)) for _ in range(60)] for _ in range(2))
    best = wrappers.pairs(a, b)
    monkeypatch.setattr(wrappers, "CELLS", 40)
    for found in (best, wrappers.pairs(a, b)):
        assert [i for i, _ in found if i is not None] == list(range(60)) and [j for _, j in found if j is not None] == list(range(60))
        assert all(a[i] == b[j] for i, j in found if i is not None and j is not None)


PLAIN = """<html><body><div><div><p>Home</p><p>All news of the town</p></div><div>{0}</div><div><p>Written for you by the people of the town</p></div></div><div>{1}</div></body></html>"""


def plain_page(i):
    parts = "".join(f"<div><p>Paragraph {k} of the story number {i} is told here</p></div>" for k in range(1 + i % 3))
    return PLAIN.format(f"<div><p>Story {i} has a head</p></div>{parts}", " ".join(f"<p><a href=/{i}{k}>Another story called {i + k}</a></p>" for k in range(i % 4)))


def test_the_wrapper_decides_where_no_name_tells(spark):
    """Menus, claims and lists of links without a telling tag or class: only the other pages of the host tell them from the story."""
    rows = [(i, f"https://plain.example/{i}", plain_page(i)) for i in range(20)] + [(99, "https://alone.example/", plain_page(3))]
    got = {r.page_id: r.text.split("\n") for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = lambda i: [f"Story {i} has a head", *[f"Paragraph {k} of the story number {i} is told here" for k in range(1 + i % 3)]]
    assert all(got[i] == story(i) for i in range(20))
    assert got[99] == ["Home", "All news of the town", *story(3), "Written for you by the people of the town"]  # one page alone can't tell


def test_wrappers_do_not_depend_on_the_order_of_pages(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "PART_BYTES", 2000)
    monkeypatch.setattr(wrappers, "ARITY", 3)
    rows = [("h", (page if i % 3 else plain_page)(i)) for i in range(60)]
    found = set()
    for seed, parts in ((1, 1), (2, 7), (3, 3)):
        random.Random(seed).shuffle(rows)
        (one,) = wrappers.wrappers(spark.createDataFrame(rows, "host string, html string").repartition(parts)).collect()
        found.add((one.wrapper, tuple(one.literal)))
    assert len(found) == 1


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "deep", "<p " * 350_000 + "x", "<p \"" * 250_000, "<script>" * 130_000, "<!--" * 250_000, "<p><x>" * 50_000 + "<hr>" * 50_000 + "end", "<i>" * 100_000 + "</b>" * 100_000, "<td><ul>" + "<x>" * 50_000 + "<td></q></div2>" * 50_000, "".join(f"<x{i * i % 977}>a</x{i * i % 977}>" for i in range(20_000))])
def test_hostile_pages_end_within_seconds(html):
    import time

    began = time.time()
    root, texts = wrappers.parse(html)
    json_ = json.dumps(root)
    own = wrappers.nodes_of(json.loads(json_), [wrappers.text_hash(t) for t in texts], set())
    wrapper = [*own[:3], wrappers.fold(own[3]), None]
    other = wrappers.parse("<p>a</p><div>b</div>" + html[::2])
    wrapper = wrappers.merge(wrapper, [*own[:3], wrappers.fold(wrappers.nodes_of(other[0], [0] * len(other[1]), set())[3]), None])
    wrappers.extract(root, texts, set(), wrappers.judged(wrapper, [])["tree"])
    assert time.time() - began < 15


def test_texts_below_the_deepest_level_stay_in_page_order(spark):
    html = "a<x>" + "<div>b" * 200 + "c" + "</div>d" * 200 + "</x>e"
    root, texts = wrappers.parse(html)
    own = wrappers.nodes_of(root, [0] * len(texts), set())
    got = wrappers.extract(root, texts, set(), ["", [], 0]) if not own else wrappers.extract(root, texts, set(), wrappers.judged([*own[:3], wrappers.fold(own[3]), None], [])["tree"])
    (row,) = wrappers.main_text(spark.createDataFrame([(1, "http://a.b", "<article>" + html)], "page_id long, url string, html string")).collect()
    assert "".join(row.text.split()) == "a" + "b" * 200 + "c" + "d" * 200 + "e" and got is not None


def test_equal_headings_within_articles_stay(spark):
    body = lambda i: f"<h1>Dish {i}</h1><p>A long story of dish {i} and how it came</p><h2>Ingredients</h2><ul><li>salt {i}</ul><h2>Method</h2><p>Stir it for {i} minutes and serve</p>"
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<nav>Home</nav><article>{body(i)}</article>") for i in range(9)], "page_id long, url string, html string")
    for r in wrappers.main_text(pages).collect():
        i = r.page_id
        assert r.text.split("\n") == [f"Dish {i}", f"A long story of dish {i} and how it came", "Ingredients", f"salt {i}", "Method", f"Stir it for {i} minutes and serve"]


def test_pages_of_the_tables(spark, sf):
    want = {}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in QUERIES["op3_html_wrapper"](spark, sf).collect()} == want


# 4 ---------------------------------------------------------------------------------------------


QUOTED = [
    (1, 0, "user", "Where is the station?\n\nIt is late."),
    (1, 1, "assistant", "By the river."),
    (1, 2, "user", "Something else entirely."),
    (1, 3, "user", "> by the RIVER\n>> Where is the  station\nWhich river?"),
    (1, 4, "assistant", "> > By the river.\n> Which river?\n\nThe long one."),
    (2, 0, "user", "> The long one!\nQuoted from elsewhere."),
    (2, 1, "user", "> never said\nHm."),
]


def test_quotations(spark):
    rows = QUOTED
    got = {(r.conv_id, r.turn): r for r in quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 3].parent_turn, got[1, 4].parent_turn, got[2, 0].parent_conv, got[2, 0].parent_turn) == (1, 3, 1, 4)
    assert [got[1, 3].thread_turn, got[1, 4].thread_turn, got[2, 0].thread_turn] == [1, 1, 1]
    assert got[1, 3].text == "Which river?" and got[1, 4].text == "The long one." and got[2, 1].parent_turn is None
    order = sorted((r.position, k) for k, r in got.items() if r.conversation == 1)
    assert [k for _, k in order] == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0), (1, 2)]
    assert got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2 and got[2, 1].n_linked == 0


def test_quotations_equal_the_sql(spark, sf, tmp_path):
    import duckdb

    rnd, rows = random.Random(5), list(QUOTED)
    lines = ["alpha beta", "gamma.", "Delta epsilon!", "zeta", ""]
    for conv in range(3, 12):
        for turn in range(6):
            rows.append((conv, turn, "user", "\n".join("> " * rnd.choice([0, 0, 1, 2]) + rnd.choice(lines) for _ in range(5))))
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for table_ in (given, table(spark, sf, "conversations")):
        df = quotations.conversations(table_)
        con = duckdb.connect()
        con.register("conversations", table_.toPandas())
        cur = con.execute(ORACLE["op4_quotation_links"])
        names = [d[0] for d in cur.description]
        key = lambda r: tuple((x is None, x) for x in r)
        want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=key)
        got = sorted(map(tuple, df.collect()), key=key)
        assert [tuple(None if x != x else x for x in r) for r in want] == got


def test_a_message_that_all_quote_is_ranked_by_many_tasks(spark):
    """Replies of thousands of conversations to one message: their positions are those of one sort."""
    first = spark.createDataFrame([(0, 0, "user", "Who comes along tonight?")], "conv_id long, turn long, role string, text string")
    replies = spark.range(1, 3001).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("> Who comes along tonight?\nNumber "), F.col("id")).alias("text"))
    got = quotations.conversations(first.unionByName(replies))
    assert all(r.position == r.conv_id and r.conversation == 0 for r in got.collect())
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(conversation" in plan and "range" in plan


def test_long_conversations_get_all_positions(spark):
    many = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = quotations.conversations(many).select("turn", "position").collect()
    assert all(r.turn == r.position for r in got) and len(got) == 5000


# 5 ---------------------------------------------------------------------------------------------


def test_ranking_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = {r.doc_id: r for r in QUERIES["op5_bradley_terry"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [i for i in labels if out[i].held_out]
    assert sum(out[i].predicted == labels[i] for i in held) >= 0.95 * len(held)


def test_scores_equal_brute_force(spark, sf, rows):
    """The bins' weights summed document by document, and the threshold tried at every score."""
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    learned = sorted(i for i in labels if crc(i) % 5)
    stats = {r.doc_id: rules.counts(r.text) for r in rows}
    frame = lambda ids: ranking.pd.DataFrame([stats[i] for i in ids], columns=rules.COUNTS)
    model = ranking.BradleyTerry(frame(learned), np.array([labels[i] == 1 for i in learned]))
    raw = {}
    for i in stats:
        (x,), s, at = ranking.describe(frame([i])), 0.0, 0
        for value, edges in zip(x, model.edges, strict=True):
            for edge in edges:
                s, at = s + model.w[at] * (value > edge), at + 1
        raw[i] = round(s * model.scale * ranking.STEPS) / ranking.STEPS
    good, bad = ([raw[i] for i in learned if labels[i] == q] for q in (1, 0))
    merit = lambda t: sum(g >= t for g in good) / len(good) + sum(b < t for b in bad) / len(bad)
    out = {r.doc_id: r for r in QUERIES["op5_bradley_terry"](spark, sf).collect()}
    assert all(a.predicted <= b.predicted and a.score <= b.score + 1e-9 for (_, a), (_, b) in zip(*(lambda o: (o, o[1:]))(sorted((raw[i], out[i]) for i in raw)), strict=False))
    cut = min(raw[i] for i in raw if out[i].predicted)
    tried = [np.sort(good + bad)[int(q * (len(good) + len(bad)))] for q in np.arange(0.005, 1, 0.005)]
    assert merit(cut) >= max(map(merit, tried)) - 0.02
    assert all(out[i].score == pytest.approx(1 / (1 + math.exp(-(raw[i] - at_ + math.log(3 / 7)))), abs=2e-3) for at_ in [next(raw[i] - math.log(out[i].score / (1 - out[i].score)) + math.log(3 / 7) for i in raw)] for i in raw)


@pytest.mark.parametrize("seed", range(5))
def test_the_threshold_is_the_best_quantile(seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(50), rnd.random() < 0.6) for _ in range(400)]
    good, bad = [s for s, g in rows if g], [s for s, g in rows if not g]
    per = [(float(s), good.count(s), bad.count(s)) for s in {s for s, _ in rows}]
    merit = lambda t: sum(g >= t for g in good) / len(good) + sum(b < t for b in bad) / len(bad)
    tried = [sorted(s for s, _ in rows)[k * len(rows) // 200] for k in range(1, 200)]
    assert merit(ranking.quantile_cut(per)) == pytest.approx(max(map(merit, tried)))


# 6 ---------------------------------------------------------------------------------------------

ITEM = "A train leaves Berlin at 9 km per hour and after 35 minutes Anna counts 120 kg of apples while the other 9 remain on the long table near Berlin"


def test_templates(spark):
    # Anna -> Maria, Berlin -> Madrid, 9 -> 14, 35 -> 50, 120 -> 999, in a run of other words.
    other = ITEM.replace("Berlin", "Madrid").replace("Anna", "Maria").replace("9 ", "14 ").replace("35", "50").replace("120", "999")
    mixed_up = other.replace("14 remain", "77 remain").replace("near Madrid", "near Lisbon")
    filler = " ".join(random.Random(1).choices("lorem ipsum dolor sit amet elit sed do tempor".split(), k=200))
    part = " ".join(ITEM.split()[:24])
    rows = [(8, ITEM.upper()), (9, f"{filler} {ITEM.lower()}"), (12, f"{filler} {part} {filler}"), (13, ITEM.replace("apples", "pears")), (1, f"{filler}. {ITEM}. {filler}"), (2, f"{filler}\n{other}\n{filler}"), (3, f"{filler} {filler}"), (4, ITEM[::-1]), (5, " ".join(ITEM.split()[:9])), (6, None), (7, mixed_up)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, "one two"), (12, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.flag(docs, bench).collect()}
    assert sorted(i for i in got if got[i].contaminated) == [1, 2, 7, 8, 9, 12, 13]
    assert got[2].reparameterised and not got[1].reparameterised and got[1].items == [10]
    hits = {r.row.doc_id: r for r in decontamination.hits(docs, bench).collect()}
    assert hits[7].coverage < hits[2].coverage  # slots that disagree with each other don't count
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [3, 4, 5, 6]


def test_exact_copies_of_numbers_and_names_and_short_items(spark):
    items = [(1, "Calculate 12 + 7 * 3 - 4 / 2 + 9"), (2, "Alice Brown, Carol Dent, Emil Frank, Grace Hill"), (3, "Who wrote Hamlet?"), (4, "Mix 5 Grams with 7 Jars 8 Bags 9 Cans")]
    texts = {i: f"some words stand before {t} and some more come after it" for i, t in items} | {5: "the answer to 12 + 8 * 3 - 5 / 2 + 9 is known", 6: "Nothing of Karl Lund, Mona Nord, Olaf Park is here. Who wrote it?", 7: "who wrote of hamlet", 8: "among them alice brown carol dent emil frank grace hill too"}
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in decontamination.flag(docs, bench).collect()} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [], 7: [], 8: [2]}
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [5, 6, 7]


def test_planted_passages_are_found(spark, sf):
    sf = sf.replace("0.001", "0.01")
    squeeze = lambda s: " ".join(s.lower().split())
    items = [squeeze(r.text) for r in table(spark, sf, "benchmark").collect()]
    want = {r.doc_id for r in table(spark, sf, "documents").collect() if any(i in squeeze(r.text) for i in items)}
    got = {r.doc_id for r in QUERIES["op6_template_decontamination"](spark, sf).where("contaminated").collect()}
    assert want <= got and len(got - want) <= 0.01 * 1000


def brute_hits(texts, items):
    """doc -> items whose windows of five tokens, plain words or typed, are found verbatim in it to 0.8 of their tokens."""
    tokens = lambda t, names: re.sub(r"[^a-z0-9@# ]+", " ", re.sub(r"[0-9]+", "#", re.sub(r"(?<=[a-z,] )[A-Z][a-z]+(?![a-z0-9])", "@", t) if names else t).lower()).split()
    out = {}
    for d, text in texts.items():
        for i, item in items.items():
            covered = set()
            for names in (True, False):
                own, theirs = tokens(text, names), tokens(item, names)
                grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
                covered |= {k + j for k in range(len(theirs) - 4) for j in range(5) if tuple(theirs[k : k + 5]) in grams}
            if len(covered) >= 0.8 * len(tokens(item, False)):
                out.setdefault(d, set()).add(i)
    return out


def test_hits_equal_brute_force(spark):
    rnd = random.Random(8)
    words = [f"{a}{b}ing" for a in "bcdfghklmnprst" for b in "aeiou"]
    items = {i: " ".join(rnd.choices(words, k=rnd.randint(12, 30))) for i in range(12)}
    texts = {}
    for d in range(80):
        before, after = (" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(2))
        own = items[d % 12].split()
        kept = own[: rnd.randint(len(own) // 2, len(own))]
        texts[d] = f"{before} {' '.join(kept if d % 3 else own)} {after}"
    got = {}
    docs, bench = (spark.createDataFrame(list(x.items()), s) for x, s in ((texts, "doc_id long, text string"), (items, "item_id long, text string")))
    for r in decontamination.flag(docs, bench).where("contaminated").collect():
        got[r.doc_id] = set(r["items"])
    assert got == brute_hits(texts, items)


def test_every_benchmark_item_is_found(spark, sf):
    """Each item of the table, and items of little but numbers, names or units, pasted into a text."""
    own = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    odd = ["Calculate 12 + 34 * 56 - 78 / 90 + 11 = x", "Solve 3 4 5 6 7 8 9 for Anna and Bob", "7 kg 8 kg 9 kg 10 kg 11 kg", "Anna Bob Carl Dora Emil Fritz", "Who?", "2 + 2"]
    items = own + [(10_000 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame([(i, f"some words stand before it: {t} and others follow") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert all(r.doc_id in r["items"] for r in decontamination.flag(docs, bench).collect())


def test_the_sieve_drops_nothing(spark, docs, monkeypatch):
    bench = docs.limit(5).select(F.col("doc_id").alias("item_id"), "text")
    with_sieve = sorted(map(tuple, decontamination.hits(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "sieve_of", lambda *_: None)
    assert with_sieve == sorted(map(tuple, decontamination.hits(docs, bench).collect()))


# 7 ---------------------------------------------------------------------------------------------


def test_compaction(spark, docs, tmp_path):
    lake = sharding.Lake(spark, str(tmp_path), target_bytes=200_000)
    parts = docs.repartition(10, "doc_id")
    for lo in range(0, 200, 50):
        lake.append(parts.where(f"doc_id >= {lo} and doc_id < {lo + 50}"))
    before = lake.manifest().collect()
    assert lake.versions() == [1, 2, 3, 4] and sum(r.rows for r in before) == 200
    assert lake.compact() == 5
    after = lake.manifest().collect()
    assert len(after) < len(before) and sum(r.rows for r in after) == 200 and max(r.bytes for r in after) < 2 * 200_000
    assert sorted(map(tuple, lake.read().select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert len(lake.manifest(4).collect()) == len(before)  # old versions stay readable
    with pytest.raises(Exception, match="(?i)exist"):
        lake._commit(lake.manifest(), 5)  # a version is committed once
    lake.vacuum()
    assert lake.versions() == [5] and lake.read().count() == 200
    while lake.compact() != lake.versions()[-1] or lake.versions()[-1] < 6:
        if lake.versions()[-1] > 8 or lake.plan().where("run is not null").isEmpty():
            break
    assert lake.read().count() == 200


def test_several_appends_and_compactions(spark, docs, tmp_path, monkeypatch):
    """Arrivals of several times meet in tiers; every version holds exactly the rows appended so far, and no run exceeds the target by more than a shard."""
    monkeypatch.setattr(sharding, "SLICE_SHARDS", 3)
    lake, key = sharding.Lake(spark, str(tmp_path), target_bytes=60_000), lambda rows: sorted(map(tuple, rows))
    all_, parts = docs.collect(), docs.repartition(4, "doc_id")
    counts, done = [], []
    for step in range(5):
        lake.append(parts.where(f"doc_id % 5 = {step}"))
        if step != 2:
            before = {r.file: r for r in lake.manifest().collect()}
            plan = lake.plan().collect()
            lake.compact()
            runs = {}
            for r in plan:
                if r.run is not None:
                    runs.setdefault(r.run, []).append(r)
            assert all(len(v) >= sharding.RUN_LEAST and len({r.tier for r in v}) == 1 and sum(r.bytes for r in v) - max(r.bytes for r in v) < 60_000 for v in runs.values())
            after = {r.file: r for r in lake.manifest().collect()}
            assert set(before) - set(after) == {r.file for v in runs.values() for r in v} and len(set(after) - set(before)) == len(runs)
            assert sorted(r.rows for f, r in after.items() if f not in before) == sorted(sum(r.rows for r in v) for v in runs.values())
            counts.append(len(runs))
        done.append(step)
        assert key(lake.read().collect()) == key(r for r in all_ if r.doc_id % 5 in done)
    assert sum(counts) >= 4
    lake.vacuum()
    assert key(lake.read().collect()) == key(all_)


def test_every_row_has_a_shard_of_its_size(spark, docs):
    got = sharding.shard(docs.repartition(6), target_bytes=100_000)
    per = got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("shard_rows").alias("m")).collect()
    assert all(r.n == r.m for r in per) and sum(r.n for r in per) == docs.count()


# 8 ---------------------------------------------------------------------------------------------


def test_base_scores_and_counts(spark, sf, rows):
    split = {r.doc_id: re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode().lower()) + ["end"] for r in rows}
    held = {i: crc(i) % 7 == 2 for i in split}
    c = Counter(w for i, t in split.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    out = QUERIES["op8_context_tree"](spark, sf).collect()
    assert len(out) == len(rows)
    for r in out:
        t = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, held[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))


def brute_tree(texts, depth):
    """Counts, weighted log-probabilities and stopping weights of every node, by plain recursion."""
    counts = {}
    for t in texts:
        x = b"\xff" * depth + t + b"\xff"
        for p in range(depth, len(x)):
            node = 1
            for k in range(8):
                bit = (x[p] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((x[p - d : p], node), [0, 0])[bit] += 1
                node = 2 * node + bit
    children = {}
    for ctx, node in counts:
        if ctx:
            children.setdefault((ctx[1:], node), []).append((ctx, node))
    weighted, stop = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        a, b = counts[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(key[0]) == depth:
            weighted[key], stop[key] = own, 1.0
            continue
        below = sum(weighted[k] for k in children[key])
        top = max(own, below)
        weighted[key] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        stop[key] = math.exp(own - math.log(2) - weighted[key])
    return counts, stop


def brute_score(t, counts, stop, depth):
    x, out = b"\xff" * depth + t + b"\xff", 0.0
    for p in range(depth, len(x)):
        node = 1
        for k in range(8):
            bit, prob = (x[p] >> (7 - k)) & 1, None
            for d in range(depth, -1, -1):
                key = (x[p - d : p], node)
                if key in counts:
                    kt = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                    prob = kt if prob is None else stop[key] * kt + (1 - stop[key]) * prob
            out += math.log10(0.5 if prob is None else prob)
            node = 2 * node + bit
    return out


@pytest.mark.parametrize("chunk", [64, 1 << 21])
def test_context_tree_scores(spark, docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(context_tree, "CHUNK", chunk)
    monkeypatch.setattr(context_tree, "FLUSH", 500)
    some = sorted(rows, key=lambda r: r.n_chars)[:60]
    given = spark.createDataFrame([(r.doc_id, r.text) for r in some] + [(10_001, None), (10_002, "")], "doc_id long, text string")
    texts = {r.doc_id: context_tree.normal(r.text) for r in given.collect()}
    counts, stop = brute_tree([t for i, t in texts.items() if crc(i) % 7 != 2], context_tree.DEPTH)
    for r in context_tree.score(given, block_bytes=5_000).collect():
        assert r.score == pytest.approx(brute_score(texts[r.doc_id], counts, stop, context_tree.DEPTH), rel=1e-5)


def test_copies_of_buckets_answer_alike(spark, docs, monkeypatch):
    """Few buckets, each split into copies: the same scores."""
    given = docs.select("doc_id", "text").limit(60)
    want = {r.doc_id: r.score for r in context_tree.score(given).collect()}
    monkeypatch.setattr(context_tree, "MOST_BUCKETS", 3)
    monkeypatch.setattr(context_tree, "ANSWER_BYTES", 2_000)
    got = {r.doc_id: r.score for r in context_tree.score(given, block_bytes=4_000).collect()}
    assert got == pytest.approx(want, rel=1e-5)
    sizes = {("g", 0): 5_000, ("g", 1): 50, ("w", 0): 10}
    copies = context_tree.Model(None, {}, 1, 1, 2, sizes).copies(1000, 1_000)
    assert 1000 >= copies["g", 0] > copies["g", 1] >= 1 and 1 <= copies["w", 0] <= 1000


def test_operators_travel_without_the_package(spark, sf, tmp_path):
    """The queries with Python code run on executors that can't import corvid."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    code = f"""
import os, sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,4,2048]").config("spark.executor.memory", "2g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from corvid.llm.queries import QUERIES
def missing(_):
    import importlib.util
    return [importlib.util.find_spec("corvid") is None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(missing).collect() == [True]
for name, query in QUERIES.items():
    if name.split("_")[0] not in ("op1", "op3", "op5", "op8", "op9", "op10"):
        continue
    assert query(spark, {sf!r}).count() > 0, name
"""
    import os

    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"SPARK_SCALA_VERSION": "2.13"}, check=True, timeout=600)


def test_next_byte_probabilities_sum_to_one(rows):
    code, n = context_tree.distinct(np.concatenate(list(context_tree.codes([context_tree.normal(r.text) for r in rows[:20]]))), True)
    tree = context_tree.levels(code, n.astype(float), 0)
    ctx = code[::997] & ~np.uint64(255)
    total = sum(10 ** context_tree.log10_next(ctx | np.uint64(b), tree) for b in range(256))
    assert np.allclose(total, 1)


# 9 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark, sf, rows):
    out = {r.doc_id: r for r in QUERIES["op9_pivot_simhash"](spark, sf).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    assert {i: r.fingerprint for i, r in out.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r.component_id for i, r in out.items()} == brute_components(fps)


@pytest.mark.parametrize("seed", range(3))
def test_links_lose_nothing(spark, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(15)]
    fps = {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for x in base for _ in range(25)} | {0, (1 << 64) - 1, 3, 1}
    given = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = [(r.x & (1 << 64) - 1, r.y & (1 << 64) - 1) for r in simhash.links(given).collect()]
    want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def brute_groups(texts):
    """The components of texts linked by the 5-word shingles' similarity of 0.8."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    ids = sorted(texts)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    met = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in met:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_copies(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts, i = {}, 0
    for _ in range(30):
        base = rnd.choices(words, k=rnd.randint(8, 250))
        for _ in range(8):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 25))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            i += 1
            texts[i] = " ".join(t)
    got = {r.doc_id: r.group_id for r in simhash.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_groups(texts)
    assert sum(got[i] != want[i] for i in texts) == 0


def test_copies_with_repeated_lines(spark):
    rnd = random.Random(5)
    texts = {}
    for i in range(20):
        body = [f"b{i}_{k}" for k in range(300)]
        for j in range(2):
            line = [f"l{i}_{j}_{k}" for k in range(12)]
            texts[2 * i + j] = " ".join(body + line * rnd.choice([10, 60]))
    got = {r.doc_id: r.group_id for r in simhash.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(texts) == {i: i - i % 2 for i in texts}


def test_copies_among_many_texts_of_one_template(spark, monkeypatch):
    template = [f"t{i}" for i in range(140)]
    texts = {}
    for i in range(200):
        own = [f"o{i}_{k}" for k in range(60)]
        texts[i] = " ".join(template + own)
        if i % 20 == 0:  # a copy with its last words changed
            texts[1000 + i] = " ".join(template + own[:43] + [f"c{i}_{k}" for k in range(17)])
    for i in range(40):  # 18 shingles, 16 of them in both: a similarity of 0.8 exactly
        words = [f"s{i}_{k}" for k in range(22)]
        texts[2000 + i], texts[3000 + i] = " ".join(words), " ".join(words[:20] + ["x", f"y{i}"])
    none = spark.createDataFrame([], "a long, b long")  # nothing but the exact join
    monkeypatch.setattr(simhash, "stars", lambda rows: none)
    monkeypatch.setattr(simhash, "LARGE", 100)
    got = {r.doc_id: r.group_id for r in simhash.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(texts)


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(2000):
        t = list(base)
        t[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.group_id for r in simhash.copies(docs).collect()} == {0}
    rows = docs.select(simhash.sketches(F.col("text")).alias("s")).select("s.key", F.posexplode("s.bands").alias("band", "bk"))
    assert simhash.stars(rows).count() <= 2000 * simhash.BANDS


def test_templated_families_and_recall_by_similarity(spark):
    """Pairs of texts within families of one template: every pair of 0.8 is joined, and no text that is a copy of none goes."""
    rnd = random.Random(11)
    texts, pairs = {}, []
    for family in range(3):
        template = [f"t{family}_{k}" for k in range(300)]
        for i in range(150):
            body = template + [f"o{family}_{i}_{k}" for k in range(100)]
            changed, share = list(body), rnd.choice([0.01, 0.02, 0.03, 0.05])
            for at in rnd.sample(range(len(body)), int(share * len(body))):
                changed[at] = f"c{rnd.random()}"
            a, b = 10_000 * family + 2 * i, 10_000 * family + 2 * i + 1
            texts[a], texts[b] = " ".join(body), " ".join(changed)
            pairs.append((a, b))
    got = {r.doc_id: r.group_id for r in simhash.copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(texts)


@pytest.mark.parametrize("seed", range(3))
def test_odd_sketches_bound_the_difference(seed):
    rng = np.random.default_rng(seed)
    for n in (3, 50, 700, 9000):
        a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for changed in (0, 1, n // 10, n):
            b = np.concatenate([a[changed:], rng.integers(0, 1 << 62, changed, dtype=np.uint64)])
            bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(simhash.odd_sketch(a), simhash.odd_sketch(b), strict=True))
            assert bits <= 2 * changed and (changed < n or n > 5000 or bits > n // 2)


def test_pivots_discard_within_a_bucket(spark):
    """Fingerprints of one bucket that differ in the other ranges: the pivots' cells keep most of them from meeting."""
    rnd = random.Random(2)
    fps = sorted({rnd.getrandbits(26) for _ in range(600)})
    left = simhash.survivors(spark.createDataFrame([(x,) for x in fps], "fp long")).count()
    inside = sum(abs(a.bit_count() - b.bit_count()) <= 2 for i, a in enumerate(fps) for b in fps[:i])
    assert left < inside < 0.75 * len(fps) * (len(fps) - 1) / 2


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    word = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, word("a", 50)), (1, word("b", 50)), (None, word("c", 50)), (None, word("c", 50)), (None, word("a", 50)), (2, word("c", 50) + " more"), (None, word("d", 60)), (None, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept) == [(0, ""), (0, "d0"), (1, "a0"), (1, "b0"), (2, "c0")]


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 3), (9, 5), (1, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3, 1: 1, 2: 1}


# 10 --------------------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark, sf, rows):
    out = {r.doc_id: r for r in QUERIES["op10_ecoc_language"](spark, sf).collect()}
    held = [r for r in rows if out[r.doc_id].held_out]
    assert all(out[r.doc_id].held_out == (crc(r.doc_id) % 3 == 1) and 0 <= out[r.doc_id].score <= 1 for r in rows)
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_languages_equal_brute_force(spark, sf, docs, rows):
    """N-grams counted one by one, each classifier's sum and each codeword's loss worked out in plain Python."""
    model = language_id.learn(docs)
    out = {r.doc_id: r for r in QUERIES["op10_ecoc_language"](spark, sf).collect()}
    for r in rows[::10]:
        raw, x = r.text.lower().encode(), Counter()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                code = n
                for b in raw[i : i + n]:
                    code = (code * 257 + b) % (1 << 32)
                x[((code * 2654435761) % (1 << 32)) >> 20] += 1
        norm = math.sqrt(sum(x.values()))
        z = [sum(math.sqrt(c) / norm * float(model.w[f, bit]) for f, c in x.items()) + float(model.w[-1, bit]) for bit in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-float(c) * v)) for c, v in zip(word, z, strict=True)) for word in model.code]
        p = sorted(((math.exp(min(loss) - a), lang) for a, lang in zip(loss, model.langs, strict=True)), reverse=True)
        total = sum(a for a, _ in p)
        got = out[r.doc_id]
        assert got.lang_pred == p[0][1] and got.score == pytest.approx(p[0][0] / total, abs=1e-3) and got.ambiguous == ((p[0][0] - p[1][0]) / total < language_id.MARGIN)


@pytest.mark.parametrize("text,letters", [("\u00bd \u00b2", False), ("\u2167", False), ("12 !", False), (None, False), ("", False), ("\u00bd x", True), ("\u4e2d", True), ("\u00aa", True), ("_", False)])
def test_letters_are_those_of_unicode(text, letters):
    assert language_id.has_letter(text) == letters


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert len({tuple(c) for c in code.tolist()}) == n and apart >= (1 << max(n - 2, 0) if n <= 7 else code.shape[1] // 5)


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Grüße aus Köln " * 1000
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "PIECE", 1000)
    assert np.allclose(language_id.features(text), whole)


# Pipeline --------------------------------------------------------------------------------------


def test_pipeline_keeps_clean_documents(spark, sf, rows):
    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.count() >= 0.99 * len(rows)
    one = corpus_pipeline.drop_near_duplicates(spark, kept, sf)
    comp = brute_groups({r.doc_id: r.text for r in kept.collect()})
    assert {r.doc_id for r in one.collect()} == set(comp.values())
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "shard"] and 0 < out.select("doc_id").distinct().count() <= one.count()
