"""SimHash near-duplicate groups through pivot distance tables.

A text's fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its 3-word
shingles have it. Documents of one fingerprint are grouped first, so only distinct fingerprints
are compared. For these, the Hamming distances to the REFERENCES are tabulated once:

* The 64 bits are five ranges. Each range has one reference fingerprint for each of its bits (the
  range's first 1, 2, ... bits set); one more reference is zero. A range's coordinates, taken
  relative to the zero reference, change only if a bit of that range does.
* Two fingerprints that differ in at most two bits agree in all coordinates of at least three of
  the five ranges, so they share a bucket of these for at least one of the ten choices. Within a
  bucket the pivot that is the two other ranges' bits decides who meets: its distances are cut into
  cells, and fingerprints whose distances differ by more than two cells' reach are never paired.
* Of the pairs that meet, those with a coordinate difference over 2 at any of the PIVOTS are
  discarded (the triangle inequality allows no such link) as a condition of the join; the survivors
  are verified exactly.

Links join into components whose id is the least doc_id.

Two bits are a link that a change of one word in a hundred already exceeds, and a 64-bit fingerprint
can't be searched at the ten bits or more that a similarity of 0.8 needs without comparing large
parts of the corpus; on the other hand texts of one template may lie within two bits. So copies(),
which the pipeline uses, takes the links as candidates, adds others, and joins what has a Jaccard
similarity of 0.8 of the sets of 5-word shingles. Texts that share a key of minimum hashes are looked at first, cheaply
and not all of them; what that leaves apart is joined by prefixes of the sets, which miss no pair:
two sets of similarity 0.8 share one of the first shingles of both in any common order, here by
rising frequency in a sample. The sample decides what the join costs, never what it finds.

Defined results: null text or one without words: fingerprint zero, linked like any other. Fewer
than three words: one shingle of all. Repeated rows: equal results for each. A null doc_id takes
part in links; a group without any doc_id has a null component_id. Empty table: empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, columns_of, components, cut, delete, maybe_broadcast, passes, release, shared_dir, small_batches, unit_hash

RADIUS, CELL = 2, 5
#: What copies() takes: Jaccard similarity of 5-word shingles. BANDS keys of ROWS minimum hashes only join most copies
#: early; apart() finds the rest, and spreads a shingle of over LARGE texts over parts that each meet all of these.
SIMILARITY, BANDS, ROWS, LARGE = 0.8, 20, 4, 4096
#: Bits of a set's odd sketch: bit i is 1 if an odd number of its hashes falls on i.
ODD = 2048
#: Numbers of 64 bits that a sketch is folded to where it goes along with each shingle.
FOLDED = 4
#: Bits for each shingle of several groups, and bits at most (2 MB), of the bitmap that saves dealing out the others.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 24
#: Share of the texts whose shingles are counted, and the most frequent of these that prefixes put last.
SAMPLE, FREQUENT = 0.2, 100_000
_RNG = np.random.default_rng(9)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
#: First bit and width of each range.
RANGES = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


REFERENCES = [signed(((1 << (i + 1)) - 1) << at) for at, width in RANGES for i in range(width)]
#: References whose coordinates go along with each row: zero, whole ranges, and alternating bits.
PIVOTS = [0] + [signed(((1 << width) - 1) << at) for at, width in RANGES] + [0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F]


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words; of all words together if there are fewer; none without words."""
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        return np.array([h(join(words), 42)] if words else [], np.uint64)
    runs = zip(*[words[i:] for i in range(size)], strict=False)
    return np.fromiter((h(join(t), 42) for t in runs), np.uint64, len(words) - size + 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower() and split() know ASCII only


def text_key(words: list[bytes]) -> int:
    return signed(xxhash.xxh64_intdigest(b" ".join(words), 7))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint as a signed number."""
    return majority(shingle_hashes(words_of(text), size))


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t) for t in s], dtype="int64")

    return of(text)


def distance_table(fps: DataFrame) -> DataFrame:
    """fps (fp, ...) with coordinates: p0, p1, ... of the PIVOTS, r0, ... the relative coordinates of each range."""
    far = F.transform(F.array(*[F.lit(r).cast("long") for r in REFERENCES]), lambda r: F.bit_count(F.col("fp").bitwiseXOR(r)).cast("int"))
    out = fps.withColumn("zero", F.bit_count("fp").cast("int")).withColumn("far", far)
    rel = F.transform("far", lambda d: d - F.col("zero"))
    out = out.withColumn("rel", rel)
    for j, (at, width) in enumerate(RANGES):
        out = out.withColumn(f"r{j}", F.xxhash64(F.slice("rel", at + 1, width)))
    for k, p in enumerate(PIVOTS):
        out = out.withColumn(f"p{k}", F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("long"))).cast("tinyint"))
    return out.drop("zero", "far", "rel")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of distinct fingerprints (fp) at RADIUS or less; every pair once."""
    return survivors(fps).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS)


def survivors(fps: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of fps (fp) that no coordinate discards; every pair once.

    A row stands in the CELLs of its choice's own pivot that its distance, more or less RADIUS, reaches; the row that it
    is paired with in that of its distance. What the pivot tells apart never meets, however large the bucket.
    """
    tab = distance_table(fps.select("fp"))
    choices = list(combinations(range(len(RANGES)), 3))
    pivots = [f"q{t}" for t in range(len(choices))]
    for name, c in zip(pivots, choices, strict=True):
        own = sum(((1 << width) - 1) << at for j, (at, width) in enumerate(RANGES) if j not in c)
        tab = tab.withColumn(name, F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(own)).cast("long"))))
    key = lambda t, c: F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[f"r{j}" for j in c]).alias("key"), F.col(f"q{t}").alias("q"))
    near = ["fp", *[f"p{k}" for k in range(len(PIVOTS))]]
    rows = tab.select(*near, F.explode(F.array(*[key(t, c) for t, c in enumerate(choices)])).alias("k")).select(*near, "k.t", "k.key", "k.q")
    cell = lambda q: F.floor(q / CELL).cast("int")
    a = rows.select(*near, "t", "key", F.explode(F.sequence(cell(F.col("q") - RADIUS), cell(F.col("q") + RADIUS))).alias("cell")).alias("a")
    b = rows.select(*near, "t", "key", cell(F.col("q")).alias("cell")).alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.cell") == F.col("b.cell")) & (x < y)
    for k in range(len(PIVOTS)):
        on = on & (F.abs(F.col(f"a.p{k}").cast("int") - F.col(f"b.p{k}").cast("int")) <= RADIUS)
    differ = x.bitwiseXOR(y)
    same = [differ.bitwiseAND(F.lit(signed(((1 << width) - 1) << at)).cast("long")) == 0 for at, width in RANGES]
    first = F.coalesce(*[F.when(same[c[0]] & same[c[1]] & same[c[2]], F.lit(t)) for t, c in enumerate(choices)])
    return a.join(b, on & (first == F.col("a.t"))).select(x.alias("x"), y.alias("y"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id of every document."""
    small_batches(docs)
    marked = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    return marked.join(classed(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))), "fp").select("doc_id", "fp", "component_id")


def classed(fps: DataFrame) -> DataFrame:
    """fps (fp, rep) -> fp, component_id: the least rep that links reach."""
    reps = cut(fps)
    pairs = cut(links(reps))
    # Components run over fingerprints, which are never null; the least doc_id of each follows from reps.
    roots = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    return known.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of distinct hashes, in ascending order, the first n - ceil(similarity * n) + 1 by frequency; frequent are hashes in ascending order and their counts."""
    known, counts = frequent
    rank = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.argsort(rank, kind="stable")][: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]


def odd_sketch(hashes: np.ndarray) -> list[int]:
    at = (hashes >> np.uint64(20)).astype(np.int64) & (ODD - 1)
    return np.packbits(np.bincount(at, minlength=ODD) & 1).view(np.int64).tolist()


NONE = np.array([], np.uint64), np.array([], np.int64)


def sketch(text: str | None, frequent: tuple[np.ndarray, np.ndarray] = NONE, similarity: float = SIMILARITY) -> tuple[int, int, list[int], int, list[int], list[int]]:
    """The fingerprint of 3-word shingles, a hash of the words, BANDS keys of ROWS minimum hashes each, and the number, the prefix and the odd sketch of the distinct 5-word shingles."""
    words = words_of(text)
    key, hashes = text_key(words), np.unique(shingle_hashes(words, 5))  # the similarity is of sets, so a repeat counts once
    if not words:
        return 0, key, [], 0, [], [0] * (ODD // 64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * FACTORS[None, :] + SHIFTS[None, :]).min(axis=0))
    bands = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        bands = (bands ^ part) * np.uint64(0x9E3779B97F4A7C15)
        bands ^= bands >> np.uint64(29)
    return majority(shingle_hashes(words, 3)), key, bands.view(np.int64).tolist(), len(hashes), prefix(hashes, frequent, similarity).view(np.int64).tolist(), odd_sketch(hashes)


def sketches(text: Column, frequent: tuple[np.ndarray, np.ndarray] = NONE, similarity: float = SIMILARITY) -> Column:
    @F.pandas_udf("fp long, key long, bands array<long>, n int, prefix array<long>, odd array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([sketch(t, frequent, similarity) for t in s], columns=["fp", "key", "bands", "n", "prefix", "odd"])

    return of(text)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the FREQUENT most frequent 5-word shingles of a share of SAMPLE of the texts, chosen by a hash of the text."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.unique(shingle_hashes(words_of(t), 5)).view(np.int64) for t in s], dtype=object)

    some = docs.where(unit_hash(9, F.col("text")) < SAMPLE).select(F.explode(shingles(F.col("text"))).alias("s"))
    top = some.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2").orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()
    known = top["s"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], top["c"].to_numpy().astype(np.int64)[order]


def stars(rows: DataFrame) -> DataFrame:
    """rows (key, band, bk) -> distinct pairs of each text and the least one of each of its buckets."""
    centre = rows.groupBy("band", "bk").agg(F.min("key").alias("c"), F.count(F.lit(1)).alias("all")).where("all > 1")
    return rows.join(centre, ["band", "bk"]).where("key <> c").select(F.col("c").alias("a"), F.col("key").alias("b")).distinct()


def plausible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of texts (key, n, odd) that may have the similarity; it loses none that has it.

    Of two sets of n_a and n_b elements and a similarity of t, at most (1 - t) / (1 + t) * (n_a + n_b) are in one alone.
    Each of these changes one bit between the sets' odd sketches, and elements in both change none.
    """
    side = lambda k: texts.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb"))
    return both.where((differ <= most + 1e-6) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)).select("a", "b")


def apart(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (key, root, n, prefix, odd) -> every pair (a, b) of texts of different roots that may have the similarity.

    The least shingle that two such sets share is in both prefixes, and there what is left of either
    set has to hold the whole intersection; folded odd sketches, which are odd sketches of fewer bits, obey plausible()'s
    bound. All are conditions of the join. A shingle of over LARGE texts is
    spread over parts; each part meets all of its texts.
    """
    fold = [reduce(Column.bitwiseXOR, [F.get("odd", F.lit(k)) for k in range(j, ODD // 64, FOLDED)]).alias(f"o{j}") for j in range(FOLDED)]
    own = rows.select("key", "root", "n", *fold, F.posexplode("prefix").alias("i", "s"))
    mixed = cut(own.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("s", F.ceil(F.col("c") / LARGE).cast("int").alias("parts")))
    release(rows.sparkSession)
    n = mixed.count()
    some = bitmap(mixed, "s", n, SIEVE_BITS, SIEVE_MOST)  # most shingles stand in one text: they needn't be dealt out again
    met = cut(own.where(passes(F.col("s"), *some)).join(maybe_broadcast(mixed, n), "s"))
    a = met.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).alias("a")
    b = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    left = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    enough = left * (1 + similarity) >= similarity * (F.col("a.n") + F.col("b.n")) - 1e-6
    on = (F.col("a.s") == F.col("b.s")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & enough
    differ = sum((F.bit_count(F.col(f"a.o{j}").bitwiseXOR(F.col(f"b.o{j}"))) for j in range(FOLDED)), F.lit(0))
    on = on & (differ <= (1 - similarity) / (1 + similarity) * (F.col("a.n") + F.col("b.n")) + 1e-6)
    return a.join(b, on).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def handle() -> list[Column]:
    """What names a row, whatever is null in it: its doc_id and a hash of its text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def on_handle(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b on the handle."""
    b = b.withColumnRenamed("doc_id", "b_id").withColumnRenamed("text_hash", "b_hash")
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")), how).drop("b_id", "b_hash")


def may_be_among(handles: DataFrame, rows: int) -> Column:
    """Whether a row's handle may be among the `rows` handles (doc_id, text_hash): true for all that are."""
    hashes = handles.select(F.xxhash64("doc_id", "text_hash").alias("h"))
    return passes(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), *bitmap(hashes, "h", rows, SIEVE_BITS, SIEVE_MOST))


def similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts (key, doc_id, text_hash) whose sets of 5-word shingles have a Jaccard similarity of `similarity`."""
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    pairs = cut(pairs.distinct())
    release(docs.sparkSession)
    nodes = cut(texts.select("key", "doc_id", "text_hash", "n", "odd").join(maybe_broadcast(ends(pairs), 2 * pairs.count()), "key"))
    pairs = cut(plausible(pairs, nodes, similarity))
    nodes = cut(nodes.select("key", "doc_id", "text_hash").join(ends(pairs), "key"))
    n = nodes.count()
    release(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.unique(shingle_hashes(words_of(t), 5)).view(np.int64) for t in s], dtype=object)

    own = on_handle(docs.where(may_be_among(nodes, n)).select(*handle(), "text"), maybe_broadcast(nodes, n))
    path = f"{shared_dir(docs.sparkSession)}/shingles-{uuid.uuid4().hex}"
    own.select("key", shingles(F.col("text")).alias("s")).dropDuplicates(["key"]).write.option("parquet.enable.dictionary", False).parquet(path)
    sets = docs.sparkSession.read.schema("key long, s array<long>").parquet(path)
    side = lambda k: sets.select(F.col("key").alias(k), F.col("s").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    out = cut(both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"))
    delete(docs.sparkSession, path)
    return out


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, root) after the links more (a, b); these join whole groups, so only their roots are looked at again."""
    if more.isEmpty():
        return roots
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    higher = cut(components(joined).select(F.col("node").alias("root"), F.col("root").alias("top")))
    known = roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    single = higher.select(F.col("root").alias("node"), F.col("top").alias("root"))
    return cut(known.unionByName(single.join(roots.select("node"), "node", "left_anti")))


def early(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of one fingerprint and of linked fingerprints, each by their least text, and of stars()."""
    firsts = cut(texts.groupBy("fp").agg(F.min("key").alias("first")))
    alike = texts.select("key", "fp").join(firsts, "fp").select(F.col("first").alias("a"), F.col("key").alias("b")).where("a <> b")
    near = links(firsts).join(firsts.select(F.col("fp").alias("x"), F.col("first").alias("a")), "x").join(firsts.select(F.col("fp").alias("y"), F.col("first").alias("b")), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return alike.unionByName(near).unionByName(stars(texts.select("key", F.posexplode("bands").alias("band", "bk"))))


def grouped(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, root of every row: rows of one root are copies of each other.

    Candidates are the fingerprints' links and each text with the least one of its buckets; then all pairs of different
    groups whose prefixes meet. Only what has the similarity joins.
    """
    small_batches(docs)
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/sketches-{uuid.uuid4().hex}"
    docs.select(*handle(), sketches(F.col("text"), frequent_shingles(docs), similarity).alias("s")).select("doc_id", "text_hash", "s.*").write.parquet(path)
    marked = spark.read.parquet(path)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("own")
    texts = cut(marked.groupBy("key").agg(least, *[F.first(c).alias(c) for c in ("fp", "bands", "n", "prefix", "odd")]).select("key", "own.doc_id", "own.text_hash", "fp", "bands", "n", "prefix", "odd"))
    marked = cut(marked.select("doc_id", "text_hash", "key"))
    delete(spark, path)
    release(spark)
    roots = cut(components(similar(docs, texts, early(texts), similarity)))
    release(spark)
    rooted = lambda df: df.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    roots = merged(roots, similar(docs, texts, apart(rooted(texts.select("key", "n", "prefix", "odd")), similarity), similarity))
    return rooted(marked.select("doc_id", "text_hash", "key")).select("doc_id", "text_hash", "root")


def copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (the least doc_id of its copies, null if all of these are null) of every row."""
    rows = cut(grouped(docs, similarity))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("doc_id", "group_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of copies(): of the least doc_id, null last, and of the least hash of the text.

    Rows that are equal in both are one: any of them stays. A row that the sieve tells to be in no group stays without a join.
    """
    rows = cut(grouped(docs))
    release(docs.sparkSession)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("own")
    several = cut(rows.groupBy("root").agg(least, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root", "own.doc_id", "own.text_hash"))
    crowd = cut(rows.join(maybe_broadcast(several.select("root"), several.count()), "root", "left_semi").select("doc_id", "text_hash"))
    n = crowd.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    chosen = several.select("doc_id", "text_hash", F.lit(True).alias("chosen"))
    known = cut(on_handle(n, chosen, "left").select("doc_id", "text_hash", F.when(F.col("chosen"), F.col("times")).otherwise(0).alias("times")))
    maybe = may_be_among(known, known.count())
    release(docs.sparkSession)
    whole = docs.select(F.struct(*columns_of(docs)).alias("row"), *handle(), maybe.alias("maybe"))
    # A row that passes the sieve by chance is in no group, so the left join finds nothing for it; 0 times: it goes.
    out = on_handle(whole.where("maybe"), maybe_broadcast(known, known.count()), "left")
    once = out.where("times is null or times = 1").select("row")
    again = out.where("times > 1").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))  # summed before the shuffle
    return whole.where("not maybe").select("row").unionByName(once).unionByName(again.select("row")).select("row.*")
