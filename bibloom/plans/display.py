"""Queries of values as text and of merged maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import display
from bibloom.sources.recipes import run, table

PARTS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice * 1234.5 END AS amount,
    CASE WHEN p_partkey % 8 > 0 THEN p_size / CAST(50 AS DOUBLE) END AS share,
    CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat_ws(' ', p_name, p_brand, p_type, 'é') END AS title FROM part"""


def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of a table: price, share, title cut at 30 and the words of the title as authors."""
    names = F.filter(F.split("title", " "), lambda w: w != "")
    return run(spark, sf_dir, PARTS).select(
        "id", display.grouped_number(F.col("amount")).alias("amount"), display.percent(F.col("share")).alias("share"),
        display.short_title(F.col("title"), 30).alias("title"), display.author_line(names).alias("authors"),
    )


H1_SQL = f"""WITH p AS (SELECT *, printf('%.3f', round(amount, 3)) AS shown, list_filter(string_split(title, ' '), lambda w: w <> '') AS names FROM ({PARTS}) x)
SELECT id, CASE WHEN amount IS NULL THEN '—' ELSE concat(format('{{:,}}', CAST(trunc(round(amount, 3)) AS BIGINT)), rtrim(rtrim(substr(shown, instr(shown, '.')), '0'), '.')) END AS amount,
    CASE WHEN share IS NULL THEN '—' ELSE concat(CAST(floor(share * 100 + 0.5) AS BIGINT), '%') END AS share,
    CASE WHEN title IS NULL THEN '' WHEN length(title) > 30 THEN concat(left(title, 29), '…') ELSE title END AS title,
    CASE WHEN coalesce(len(names), 0) = 0 THEN 'Unknown' WHEN len(names) <= 3 THEN array_to_string(names, ', ')
        ELSE concat(array_to_string(names[1:3], ', '), ' +', len(names) - 3) END AS authors FROM p"""

TIMES = "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'no time' WHEN event_id % 51 = 0 THEN NULL ELSE CAST(ts AS STRING) END AS raw FROM events"
AS_OF = "2024-01-30 23:26:30"


def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before a given time each event was."""
    return run(spark, sf_dir, TIMES).select("event_id", display.time_ago(F.col("raw"), F.lit(AS_OF).cast("timestamp")).alias("ago"))


H2_SQL = f"""WITH e AS (SELECT event_id, ts, CAST(floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(CAST(ts AS TIMESTAMP))) / 1000.0) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'Invalid Date' WHEN event_id % 51 = 0 THEN NULL WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago')
    WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE strftime(ts, '%-m/%-d/%Y') END AS ago FROM e"""


def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of a part from two providers, the second one's winning; a row an identifier."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    first = F.when(k % 4 > 0, F.create_map(F.lit("doi"), F.concat(F.lit("10.1/"), k), F.lit("pmid"), k.cast("string")))
    second = F.when(k % 5 > 0, F.create_map(F.lit("pmid"), F.concat(F.lit("2"), k), F.lit("openalex"), F.concat(F.lit("W"), k)))
    return p.select(k.alias("id"), F.explode(display.later_wins(first, second)).alias("name", "value"))


H3_SQL = """SELECT p_partkey AS id, 'doi' AS name, concat('10.1/', p_partkey) AS value FROM part WHERE p_partkey % 4 > 0
UNION ALL SELECT p_partkey, 'pmid', concat(CASE WHEN p_partkey % 5 > 0 THEN '2' ELSE '' END, p_partkey) FROM part WHERE p_partkey % 4 > 0 OR p_partkey % 5 > 0
UNION ALL SELECT p_partkey, 'openalex', concat('W', p_partkey) FROM part WHERE p_partkey % 5 > 0"""


def queries() -> dict:
    return {"h1_display_cells": h1, "h2_time_ago": h2, "h3_merged_ids": h3}


def oracle_sql() -> dict:
    return {"h1_display_cells": H1_SQL, "h2_time_ago": H2_SQL, "h3_merged_ids": H3_SQL}
