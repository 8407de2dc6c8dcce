"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_tree, decontamination, language_id, mixing, quotations, ranking, rules, sharding, simhash, wrappers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(table(spark, sf_dir, "conversations"))


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op9_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_isolation_forest,
        op2_source_mix,
        op3_html_wrapper,
        op4_quotation_links,
        op5_bradley_terry,
        op6_template_decontamination,
        op7_size_tiered_shards,
        op8_context_tree,
        op9_pivot_simhash,
        op10_ecoc_language,
    )
}

#: Quotation linking in DuckDB SQL: it compares the normalised passages themselves where the operator compares hashes.
QUOTATIONS_SQL = r"""
WITH RECURSIVE line AS (
  SELECT conv_id, turn, role, text, rid, i AS no, l[i] AS l, regexp_extract(l[i], '^(?:[ \t]*>)+') AS mark
  FROM (SELECT conv_id, turn, role, text, row_number() OVER () AS rid, string_split_regex(coalesce(text, ''), '\r?\n') AS l FROM conversations), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), parsed AS (
  SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, CASE WHEN mark <> '' THEN trim(substr(l, length(mark) + 1)) ELSE l END AS body FROM line
), marked AS (
  SELECT *, CASE WHEN trim(body) = '' THEN -1 ELSE level END AS grp FROM parsed
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY no ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN grp = lag(grp) OVER (PARTITION BY rid ORDER BY no) THEN 0 ELSE 1 END AS fresh FROM marked)
), raw_units AS (
  SELECT conv_id, turn, level, body FROM parsed
  UNION ALL SELECT any_value(conv_id), any_value(turn), any_value(grp), string_agg(body, ' ' ORDER BY no) FROM runs WHERE grp >= 0 GROUP BY rid, run
), units AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM raw_units WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), own AS (SELECT * FROM units WHERE level = 0 AND n <> ''), quotes AS (SELECT * FROM units WHERE level > 0 AND n <> ''),
near AS (SELECT conv_id, n, min(turn) AS near_turn FROM own GROUP BY ALL), far AS (SELECT n, min([conv_id, turn]) AS far FROM own GROUP BY n),
found AS (
  SELECT q.conv_id, q.turn, q.level, q.n, CASE WHEN near_turn < q.turn THEN [q.conv_id, near_turn] WHEN far < [q.conv_id, q.turn] AND far[1] <> q.conv_id THEN far END AS p
  FROM quotes q LEFT JOIN near USING (conv_id, n) LEFT JOIN far ON far.n = q.n
), votes AS (SELECT conv_id, turn, level, p, sum(length(n))::BIGINT AS chars, count(*) AS k FROM found GROUP BY ALL),
links AS (
  SELECT conv_id, turn, arg_max(p, [-level, chars, p[1], p[2]]) FILTER (WHERE p IS NOT NULL) AS p, sum(k)::BIGINT AS n_quotes, coalesce(sum(k) FILTER (WHERE p IS NOT NULL), 0)::BIGINT AS n_linked FROM votes GROUP BY ALL
), up AS (
  SELECT conv_id, turn, p AS root, 1 AS depth FROM links WHERE p IS NOT NULL
  UNION ALL SELECT up.conv_id, up.turn, links.p, depth + 1 FROM up JOIN links ON links.conv_id = root[1] AND links.turn = root[2] AND links.p IS NOT NULL
), roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root FROM up GROUP BY ALL),
kept AS (
  SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role, regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE level = 0), ''), '\A\s+', ''), '\s+\z', '') AS text FROM parsed GROUP BY rid
), whole AS (
  SELECT k.*, coalesce(root[1], k.conv_id) AS conversation, coalesce(root[2], k.turn) AS thread_turn, l.p, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
  FROM kept k LEFT JOIN links l USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn)
)
SELECT conv_id, turn, role, conversation, thread_turn, CASE WHEN conversation IS NOT NULL AND thread_turn IS NOT NULL THEN row_number() OVER (PARTITION BY conversation ORDER BY thread_turn, conv_id <> conversation, conv_id, turn, role, text) - 1 END AS position,
 p[1] AS parent_conv, p[2] AS parent_turn, n_quotes, n_linked, text FROM whole
"""

ORACLE: dict[str, str] = {"op4_quotation_links": QUOTATIONS_SQL}
