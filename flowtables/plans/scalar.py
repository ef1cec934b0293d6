"""Scalar function queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from flowtables.functions import expressions as E
from flowtables.plans.projection import events, millis
from flowtables.plans.registry import query
from flowtables.sources.tables import read_table


@query("""
SELECT event_id, abs(value - 50) AS f_abs, CAST(ceil(value) AS BIGINT) AS f_ceil,
       CAST(floor(value) AS BIGINT) AS f_floor,
       CAST(round(CAST(value AS DECIMAL(18, 2)), 1) AS DOUBLE) AS f_round1,
       CAST(round(CAST(value AS DECIMAL(18, 2)), 0) AS DOUBLE) AS f_round
FROM events""")
def fn_math(spark, folder):
    value = F.col("value")
    return events(spark, folder).select(
        "event_id", F.abs(value - 50).alias("f_abs"), F.ceil(value).alias("f_ceil"),
        F.floor(value).alias("f_floor"), F.round(value, 1).alias("f_round1"),
        F.round(value).alias("f_round"))


@query("SELECT event_type, count(*) AS n, count(*) AS in_range FROM events GROUP BY event_type")
def fn_random(spark, folder):
    drawn = events(spark, folder).select("event_type", F.rand().alias("r"))
    return drawn.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"))


@query("""
SELECT doc_id, source || '/' || lang AS f_concat, lower(source) AS f_lcase,
       upper(lang) AS f_ucase, CAST(length(text) AS INTEGER) AS f_len,
       substring(text, 3, 5) AS f_substring, md5(trim(text, ' ')) AS f_trim
FROM documents""")
def fn_string(spark, folder):
    text = F.col("text")
    return read_table(spark, folder, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), "lang").alias("f_concat"),
        F.lower("source").alias("f_lcase"), F.upper("lang").alias("f_ucase"),
        F.length(text).alias("f_len"), F.substring(text, 3, 5).alias("f_substring"),
        F.md5(F.trim(text)).alias("f_trim"))


@query("""
SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, 0.0) AS order_value
FROM events""")
def fn_ifnull(spark, folder):
    order_value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events(spark, folder).select(
        "event_id", F.coalesce(order_value, F.lit(0.0)).alias("order_value"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_text,
       epoch_ms(date_trunc('second', ts)) AS parsed, NULL::BIGINT AS bad
FROM events""")
def fn_datetime(spark, folder):
    pattern = "yyyy-MM-dd HH:mm:ss"
    rows = events(spark, folder).select(
        "event_id", "event_type", E.millis_to_text(millis("ts"), pattern).alias("as_text"))
    return rows.select("event_id", "as_text",
                       E.text_to_millis(F.col("as_text"), pattern).alias("parsed"),
                       E.text_to_millis(F.col("event_type"), pattern).alias("bad"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS absent,
       NULL::VARCHAR AS malformed
FROM events""")
def fn_json_field(spark, folder):
    return events(spark, folder).select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("props", "$.other").alias("absent"),
        F.get_json_object("event_type", "$.k").alias("malformed"))


@query("""
SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has_word,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS words,
       array_to_string(string_split(text, ' ')[2:4], ' ') AS second_to_fourth
FROM documents""")
def fn_array(spark, folder):
    documents = read_table(spark, folder, "documents").select(
        "doc_id", E.split_literal(F.col("text"), " ").alias("items"))
    return documents.select(
        "doc_id", F.array_contains("items", "the").alias("has_word"),
        F.size("items").alias("words"),
        F.array_join(E.slice_to(F.col("items"), 2, 4), " ").alias("second_to_fourth"))


WORDS = """
WITH words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word,
         generate_subscripts(string_split(text, ' '), 1) AS pos,
         len(string_split(text, ' ')) AS n
  FROM documents)"""


def word_lists(spark, folder):
    """The words of each document, dealt out anew: a row group of texts is read by one task."""
    texts = read_table(spark, folder, "documents").select("doc_id", "text")
    dealt = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return dealt.select("doc_id", E.split_literal(F.col("text"), " ").alias("items"))


@query(WORDS + """,
last AS (SELECT doc_id, word, max(pos) AS pos, any_value(n) AS n FROM words GROUP BY doc_id, word)
SELECT doc_id, CAST(count(*) AS INTEGER) AS entries,
       md5(string_agg(word || '=' || CASE WHEN pos <= n // 2 THEN CAST(length(word) AS VARCHAR)
                                          ELSE 'null' END, ';' ORDER BY word)) AS digest
FROM last GROUP BY doc_id""")
def as_map_arrays(spark, folder):
    documents = word_lists(spark, folder)
    half = E.whole_ratio(F.size("items"), F.lit(2)).cast("int")
    lengths = F.transform(F.slice("items", F.lit(1), half), F.length)
    mapped = documents.select("doc_id", E.map_of(F.col("items"), lengths).alias("m"))
    return mapped.select("doc_id", F.size("m").alias("entries"),
                         F.md5(E.map_text(F.col("m"))).alias("digest"))


@query(WORDS + """,
last AS (SELECT doc_id, word, max(pos) AS pos FROM words GROUP BY doc_id, word)
SELECT last.doc_id, CAST(count(*) AS INTEGER) AS entries,
       md5(string_agg(last.word || '=' || coalesce(words.word, 'null'), ';'
                      ORDER BY last.word)) AS digest
FROM last LEFT JOIN words ON words.doc_id = last.doc_id AND words.pos = last.pos + 1
GROUP BY last.doc_id""")
def next_action_map(spark, folder):
    documents = word_lists(spark, folder)
    mapped = documents.select("doc_id", E.next_item_map(F.col("items")).alias("m"))
    return mapped.select("doc_id", F.size("m").alias("entries"),
                         F.md5(E.map_text(F.col("m"))).alias("digest"))


@query("""
SELECT event_id, levenshtein(event_type, 'purchase') AS distance, value * 1.25 AS with_fee
FROM events""")
def call_user_function(spark, folder):
    def with_fee(value: pd.Series) -> pd.Series:
        return value * 1.25

    spark.udf.register("with_fee", F.pandas_udf(with_fee, "double"))
    return events(spark, folder).select(
        "event_id",
        F.call_function("levenshtein", F.col("event_type"), F.lit("purchase"))
        .cast("bigint").alias("distance"),
        F.call_function("with_fee", F.col("value")).alias("with_fee"))
