"""Benchmark decontamination by template canonicalisation, in DataFrame functions throughout.

A text becomes tokens: numbers, units after numbers and names (a capital and small letters within
a sentence) become typed placeholders, all else is lower-cased and loses its punctuation. Windows
of WINDOW tokens are hashed, on both sides with names as placeholders and as plain words, so that
texts in capitals or small letters match too, and joined with those of the benchmark's items. Where
fewer than LITERALS tokens are words even then, the values of placeholders count, so that an exact
copy always covers its item. An item is in a document if windows found there
cover at least SIMILARITY of its tokens; an item shorter than a window is one window, looked for anywhere in a text.

Slot consistency: a found window pairs the item's slot values with the document's. In a true
re-parameterisation a value of the item always turns into the same value; windows that disagree
with the commonest pairing of their (document, item) don't count.

Before the join, windows pass a sieve: a bitmap of the benchmark's hashes of SIEVE_BITS bits for each
of its windows, of SIEVE_MOST bits (512 KB) at most. It only saves rows: what passes is joined.

Defined results: null or empty text, or a null item: no tokens, not contaminated. Rows are told apart
by doc_id and a hash of the text, so rows without a doc_id, or of one doc_id with different texts, get
results of their own, and repeated rows equal ones. Empty benchmark: nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, maybe_broadcast, passes, sieve

WINDOW, LITERALS, SIMILARITY = 5, 2, 0.8
SIEVE_BITS, SIEVE_MOST = 32, 1 << 22
#: Units of measure that become placeholders after a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl dl l s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres mph kmh hz khz mhz ghz w kw mw v a kb mb gb tb usd eur gbp dollars euros percent"
#: Between a placeholder's type and its value.
MARK = "\u0001"


def marked(text: Column, names: bool = True) -> Column:
    """Tokens of a text; placeholders are `#`, `~` or `@` (number, unit, name), MARK and the value. Without names these stay literal."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, "[\\u0000-\\u0008#~@]", " ")
    unit = f"(?<=\\p{{N}}[ \\t])(?i:{'|'.join(UNITS.split())})(?![\\p{{L}}\\p{{N}}])"
    name = f"(?<=[^.!?:\\s][ \\t])(?!{unit})\\p{{Lu}}\\p{{Ll}}+(?![\\p{{L}}\\p{{M}}\\p{{N}}_])"  # tokens are the same with and without names
    out = F.regexp_replace(out, name, f" @{MARK}$0 ") if names else out
    out = F.regexp_replace(out, "\\p{N}++(?:[.,:/]\\p{N}++)*+", f" #{MARK}$0 ")
    out = F.lower(out)
    out = F.regexp_replace(out, f"(#{MARK}[^ ]++ *+)({'|'.join(UNITS.split())})(?![\\p{{L}}\\p{{N}}])", f"$1 ~{MARK}$2 ")
    out = F.regexp_replace(out, "(?<=\\p{N})[.,:/](?=\\p{N})", "_")
    out = F.regexp_replace(out, f"[^\\p{{L}}\\p{{M}}\\p{{N}}_#~@{MARK}]++", " ")
    return F.filter(F.split(out, " "), lambda t: t != "")


def spots(text: Column, bitmap: tuple[Column, int] | None, sieve_lengths: list[int] | None) -> Column:
    """Array of struct(n, pos, hash, form, length, own): the windows of a text that pass the sieve, own their tokens.

    Forms: "typed" hashes placeholders by type; "plain" names as words; "value" all placeholders by
    value, where less than LITERALS tokens are words even so. Items (no sieve_lengths) shorter than
    WINDOW have one window; documents also have those of sieve_lengths.
    """

    def at(m: Column, length: int) -> Column:
        """The places of windows of a length; those shorter than WINDOW are an item's only one."""
        here = F.size(m) == length if sieve_lengths is None and length < WINDOW else F.size(m) >= length
        return F.when(here, F.sequence(F.lit(0), F.size(m) - length)).otherwise(F.array().cast("array<int>"))

    def all_of(m: Column, h: Column, plain: Column, value: Column, kind: Column) -> Column:
        parts = []
        for length in [WINDOW, *(range(1, WINDOW) if sieve_lengths is None else sieve_lengths)]:
            over = lambda a, i, k=length: F.xxhash64(*[F.get(a, i + j) for j in range(k)])
            held = lambda i, k=length: sum((F.get(kind, i + j) for j in range(1, k)), F.get(kind, i))
            few = lambda i, k=length: held(i) >= 16 * max(k - LITERALS + 1, 0)
            one = lambda i, hash_, form, k=length: F.struct(i.alias("pos"), hash_.alias("hash"), F.lit(form).alias("form"), F.lit(k).alias("length"))
            parts.append(F.transform(at(m, length), lambda i: one(i, over(h, i), "typed")))  # noqa: B023
            parts.append(F.transform(F.filter(at(m, length), lambda i: (held(i) % 16 > 0) & ~few(i)), lambda i: one(i, over(plain, i), "plain")))  # noqa: B023
            parts.append(F.transform(F.filter(at(m, length), lambda i: few(i)), lambda i: one(i, over(value, i), "value")))  # noqa: B023
        some = F.concat(*parts)
        some = some if bitmap is None else F.filter(some, lambda w: passes(w["hash"], *bitmap))
        return F.transform(some, lambda w: F.struct(F.size(m).alias("n"), w["pos"].alias("pos"), w["hash"].alias("hash"), w["form"].alias("form"), w["length"].alias("length"), F.slice(m, w["pos"] + 1, w["length"]).alias("own")))

    is_slot = lambda t: F.substring(t, 2, 1) == MARK
    is_name = lambda t: F.substring(t, 1, 2) == "@" + MARK
    typed = lambda m: F.transform(m, lambda t: F.xxhash64(F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t)))
    plain = lambda m: F.transform(m, lambda t: F.xxhash64(F.when(is_name(t), F.substring(t, 3, 1 << 30)).when(is_slot(t), F.substring(t, 1, 1)).otherwise(t)))
    value = lambda m: F.transform(m, lambda t: F.xxhash64(F.when(is_name(t), F.substring(t, 3, 1 << 30)).otherwise(t)))
    kind = lambda m: F.transform(m, lambda t: F.when(is_name(t), 1).when(is_slot(t), 16).otherwise(0))
    return let(marked(text), lambda m: let(F.struct(typed(m).alias("h"), plain(m).alias("p"), value(m).alias("v"), kind(m).alias("k")), lambda x: all_of(m, x["h"], x["p"], x["v"], x["k"])))


def window_rows(rows: DataFrame, key: str, text: Column, bitmap: tuple[Column, int] | None = None, sieve_lengths: list[int] | None = None) -> DataFrame:
    """key, n (tokens), pos, hash, slots (the values of the window's placeholders by their place)."""
    out = rows.select(key, F.explode(spots(text, bitmap, sieve_lengths)).alias("x")).select(key, "x.n", "x.pos", "x.hash", "x.form", "x.length", "x.own")
    slot = lambda t: F.when((F.substring(t, 2, 1) == MARK) & ((F.col("form") == "typed") | (F.substring(t, 1, 1) != "@")), F.substring(t, 3, 1 << 30))
    out = out.withColumn("slots", F.transform("own", slot))
    whole = (F.col("length") < WINDOW) & (F.col("n") == F.col("length"))
    return out.where((F.col("form") != "typed") | whole | (F.size(F.filter("slots", lambda t: t.isNull())) >= LITERALS)).select(key, "n", "pos", "hash", "slots")


def sieve_of(bench: DataFrame, rows: int) -> tuple[Column, int]:
    return sieve(bench, "hash", rows, SIEVE_BITS, SIEVE_MOST)


def named(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text, with row: its doc_id, which may be null, and a hash of its text. Structs with nulls inside are equal where their fields are."""
    return docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (doc_id and a hash of the text), item_id, n_tokens (of the item), n_found (in windows that are found), coverage, n_slots, n_changed for every item at least one window of which is found."""
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    bench = cut(window_rows(items, "item_id", F.col("text")).distinct())
    rows = bench.count()
    short = sorted(r["n"] for r in bench.where(F.col("n") < WINDOW).select("n").distinct().collect())
    size = bench.groupBy("item_id").agg(F.max("n").alias("n_tokens"))
    found = window_rows(named(docs), "row", F.col("text"), sieve_of(bench, rows), short).select("row", "hash", "slots")
    theirs = maybe_broadcast(bench.select("item_id", "pos", "hash", F.col("slots").alias("given")), rows)
    key = ["row", "item_id", "pos", "hash"]
    pairs = cut(found.join(theirs, "hash").groupBy(*key, "given", "slots").agg(F.count(F.lit(1)).alias("times")))
    pair = F.explode(F.filter(F.arrays_zip("given", "slots"), lambda z: z["given"].isNotNull())).alias("z")
    votes = pairs.select(*key, F.col("slots").alias("whole"), pair).select(*key, "whole", F.col("z.given").alias("g"), F.col("z.slots").alias("s"))
    usual = votes.groupBy("row", "item_id", "g", "s").agg(F.countDistinct("pos").alias("v")).groupBy("row", "item_id", "g").agg(F.max_by("s", F.struct("v", "s")).alias("usual"))
    # Slots hold nulls, so they are compared as text.
    as_text = lambda c: F.to_json(F.struct(F.col(c).alias("slots"))).alias("t")
    odd = votes.join(usual, ["row", "item_id", "g"]).where(F.col("s") != F.col("usual")).select(*key, as_text("whole")).distinct()
    good = pairs.withColumn("t", as_text("slots")).join(odd, [*key, "t"], "left_anti")
    changed = F.size(F.filter(F.arrays_zip("given", "slots"), lambda z: z["given"].isNotNull() & (z["given"] != z["slots"])))
    slots = F.size(F.filter("given", lambda g: g.isNotNull()))
    spans = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + WINDOW - 1))))  # at most an item's places
    out = good.groupBy("row", "item_id").agg(spans.alias("places"), F.sum(slots).alias("n_slots"), F.sum(changed).alias("n_changed"))
    out = out.join(maybe_broadcast(size, size.count()), "item_id").withColumn("n_found", F.least(F.size("places"), F.col("n_tokens")))
    return out.select("row", "item_id", "n_tokens", "n_found", (F.col("n_found") / F.col("n_tokens")).alias("coverage"), "n_slots", "n_changed")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The hits with a coverage of SIMILARITY or more."""
    return hits(docs, benchmark).where(F.col("coverage") >= SIMILARITY)


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (ascending), coverage (the greatest), reparameterised of every document."""
    found = cut(contaminated(docs, benchmark).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"), F.max(F.col("n_changed") > 0).alias("reparameterised")))
    rows = named(docs).select("doc_id", "row").join(maybe_broadcast(found, found.count()), "row", "left")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    bad = cut(contaminated(docs, benchmark).select(F.col("row.doc_id").alias("bad_id"), F.col("row.text_hash").alias("bad_hash")).distinct())
    bad = maybe_broadcast(bad, bad.count())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
