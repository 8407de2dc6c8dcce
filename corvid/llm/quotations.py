"""Chat formatting by quotation linking, in DataFrame functions throughout.

A line's quote level is its number of leading `>`. Lines of one level without a blank between them
are a passage; level 0 is the message's own. Every passage, and every line of it, is normalised
(lower case, letters and digits) and hashed. Quoted hashes are joined with own ones: the original
is the earliest message of the conversation that has it and precedes the quote, else the earliest
of all in the order of (conv_id, turn) that does. A message replies to the original of its
shallowest linked level with the most quoted characters. Replies are followed to the message that
starts their thread; a conversation is ordered by the thread's turn, then by the replies' own.

Originals are reduced to one row a hash, and one a conversation and hash, before the join, so a
common line costs a row for each time it is quoted and no more. Messages are sorted by ranges of
conversation and order; positions are counted within a range and summed up over a conversation's
ranges, so that a long conversation, or one message that everyone replies to, is ranked by many tasks.

Defined results: null or empty text: empty own text, no quotes. Rows with a null conv_id or turn are neither
linked nor linked to and have a null position. Repeated rows of one (conv_id, turn) are one message
to the links, and get positions of their own in the order of their text. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let

QUOTE = "^(?:[ \\t]*+>)++"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]++", " "))


def parsed(text: Column) -> Column:
    """Array of struct(level, body): the lines of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\\r?\\n")
    mark = lambda s: F.regexp_extract(s, QUOTE, 0)
    return F.transform(lines, lambda s: let(mark(s), lambda m: F.struct(F.regexp_count(m, F.lit(">")).alias("level"), F.when(F.length(m) > 0, F.trim(F.substring(s, F.length(m) + 1, F.length(s)))).otherwise(s).alias("body"))))


def passages(lines: Column) -> Column:
    """Array of struct(level, body): the passages of parsed lines, with a space between lines."""
    group = F.transform(lines, lambda x: F.when(F.trim(x["body"]) == "", F.lit(-1)).otherwise(x["level"]))

    def of(g: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))

        def cut_at(s: Column) -> Column:
            end = F.transform(s, lambda i, k: F.coalesce(F.get(s, k + 1), F.size(g)))
            spans = F.filter(F.arrays_zip(s.alias("a"), end.alias("b")), lambda z: F.get(g, z["a"]) >= 0)
            return F.transform(spans, lambda z: F.struct(F.get(g, z["a"]).alias("level"), F.array_join(F.transform(F.slice(lines, z["a"] + 1, z["b"] - z["a"]), lambda x: x["body"]), " ").alias("body")))

        return let(starts, cut_at)

    return let(group, of)


def own_text(lines: Column) -> Column:
    """The lines of level 0, without blank ones at the ends."""
    text = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(text, "\\A\\s++", ""), "\\s++\\z", "")


def units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, chars, h of every passage and every line, each distinct one of a message once."""
    some = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    both = let(parsed(F.col("text")), lambda lines: F.concat(lines, passages(lines)))
    out = some.select("conv_id", "turn", F.explode(both).alias("u")).select("conv_id", "turn", "u.level", normal(F.col("u.body")).alias("n"))
    return out.where("n <> ''").select("conv_id", "turn", "level", F.length("n").alias("chars"), F.xxhash64("n").alias("h")).distinct()


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv, parent_turn, n_quotes, n_linked of every message that quotes."""
    all_ = units(messages)
    quotes, own = cut(all_.where("level > 0")), all_.where("level = 0")
    own = cut(own.join(quotes.select("h").distinct(), "h", "left_semi"))
    near = own.groupBy("conv_id", "h").agg(F.min("turn").alias("near_turn"))
    far = own.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("far"))
    found = quotes.join(near, ["conv_id", "h"], "left").join(far, "h", "left")
    here = F.col("near_turn") < F.col("turn")
    there = F.col("far") < F.struct("conv_id", "turn")
    found = found.withColumn("p", F.when(here, F.struct(F.col("conv_id").alias("conv_id"), F.col("near_turn").alias("turn"))).when(there & (F.col("far.conv_id") != F.col("conv_id")), F.col("far")))
    votes = found.groupBy("conv_id", "turn", "level", "p").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    best = F.max_by("p", F.when(F.col("p").isNotNull(), F.struct(-F.col("level"), "chars", "p")))
    out = votes.groupBy("conv_id", "turn").agg(best.alias("p"), F.sum("n").alias("n_quotes"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"))
    return out.select("conv_id", "turn", F.col("p.conv_id").alias("parent_conv"), F.col("p.turn").alias("parent_turn"), "n_quotes", "n_linked")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_conv, root_turn of every linked message; each round doubles the steps to the root."""
    now = cut(links.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn")))
    while True:
        up = now.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"))
        step = cut(now.join(up, ["root_conv", "root_turn"], "left").select("conv_id", "turn", F.coalesce("up_conv", "root_conv").alias("root_conv"), F.coalesce("up_turn", "root_turn").alias("root_turn"), F.col("up_turn").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, conversation (that of the thread), thread_turn, position (from 0), parent_conv, parent_turn, n_quotes, n_linked, text (without quotes) of every message."""
    base = messages.select("conv_id", "turn", "role", "text")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    links = cut(linked(base))
    roots = threads(links)
    out = base.where(whole).join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    out = out.withColumn("conversation", F.coalesce("root_conv", "conv_id")).withColumn("thread_turn", F.coalesce("root_turn", "turn")).withColumn("text", let(parsed(F.col("text")), own_text))
    order = ["thread_turn", F.col("conv_id") != F.col("conversation"), "conv_id", "turn", "role", "text"]
    ranges = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cut(out.repartitionByRange(ranges, "conversation", *order).withColumn("range", F.spark_partition_id()))
    per = out.groupBy("conversation", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conversation").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("conversation", "range", before.alias("before"))
    nth = F.row_number().over(W.partitionBy("conversation", "range").orderBy(*order))
    out = out.withColumn("nth", nth).join(per, ["conversation", "range"]).withColumn("position", F.col("before") + F.col("nth") - 1)
    # Messages without a conv_id or turn meet in no join and no window.
    rest = base.where(~whole).withColumn("text", let(parsed(F.col("text")), own_text)).withColumn("conversation", F.col("conv_id")).withColumn("thread_turn", F.col("turn"))
    out = out.unionByName(rest, allowMissingColumns=True)
    return out.select("conv_id", "turn", "role", "conversation", "thread_turn", "position", "parent_conv", "parent_turn", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")
