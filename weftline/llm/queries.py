"""Queries of the operators for training data and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import abuse, duplicates, mixing, names, tokens
from weftline.session import table


def _map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.map_records(table(spark, sf_dir, "column_map"), table(spark, sf_dir, "map_export"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of column_map and map_export that repeat a map with a smaller id."""
    return duplicates.copies(_map_records(spark, sf_dir)).select(F.col("kind").alias("row_kind"), F.col("head").alias("first_id"), F.col("id").alias("copy_id"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct map once, with the number of its copies."""
    return duplicates.groups(_map_records(spark, sf_dir)).select(F.col("kind").alias("row_kind"), F.col("head").alias("first_id"), "n_copies")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = lambda t: table(spark, sf_dir, t).select(F.lit("customer").alias("kind"), F.col("customer_id").alias("id"), F.col("full_name").alias("name"))
    suppliers = table(spark, sf_dir, "suppliers").select(F.lit("supplier").alias("kind"), F.col("supplier_id").alias("id"), F.col("supplier_name").alias("name"))
    return names.link_names(person("crm_customers").union(person("raw_customers")).union(suppliers))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that name the same person or organisation."""
    return names.same_entity_pairs(_linked(spark, sf_dir)).select(F.col("kind").alias("name_kind"), "id_a", "id_b")


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every row that names somebody."""
    return _linked(spark, sf_dir).select(F.col("kind").alias("name_kind"), "id", F.col("entity").alias("entity_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mixing.mix(sized, table(spark, sf_dir, "mix_target"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source of mix_target reaches."""
    return _mix(spark, sf_dir)[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scored(spark, sf_dir).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, to be reviewed in order."""
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "flagged")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of such documents by source."""
    return abuse.rates(_scored(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_MAPS = f"""
WITH raw AS (
  SELECT 'map' AS row_kind, map_id AS id, source_schema AS a, source_table AS b, source_column_name AS c, target_table AS d FROM column_map
  UNION ALL
  SELECT 'export', export_id, {", ".join(
    f"CASE WHEN payload LIKE '{{%' THEN json_extract_string(payload, '$.{n}') "
    f"ELSE regexp_extract(payload, '(?:^|;)[\\s\\x{{00A0}}]*{n}[\\s\\x{{00A0}}]*=([^;]*)', 1) END"
    for n in ("SourceSchema", "SourceTable", "SourceColumnName", "TargetTable"))} FROM map_export
), keyed AS (
  SELECT row_kind, id, concat_ws('#', {_KEY.format("a")},
    array_to_string(list_sort(list_filter(list_transform(string_split(b, '|'), lambda x: {_KEY.format("x")}), lambda x: x <> '')), '|'),
    {_KEY.format("c")}, {_KEY.format("d")}) AS k
  FROM raw WHERE {_KEY.format("c")} <> ''
)"""
ORACLE: dict[str, str] = {
    "p1_found": f"""{_MAPS}, firsts AS (SELECT row_kind, id, min(id) OVER (PARTITION BY row_kind, k) AS first_id FROM keyed)
SELECT row_kind, first_id, id AS copy_id FROM firsts WHERE id <> first_id""",
    "p1_groups": f"""{_MAPS} SELECT row_kind, min(id) AS first_id, count(*) AS n_copies FROM keyed GROUP BY row_kind, k""",
}
