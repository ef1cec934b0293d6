"""Projection, filter, predicate and row-expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions import expressions as E
from flowtables.operators.tables import write_partitions
from flowtables.plans.registry import query
from flowtables.session import new_folder
from flowtables.sources.tables import read_table


def events(spark, folder):
    return read_table(spark, folder, "events")


def millis(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


@query("SELECT event_type AS action, * FROM events")
def project_star(spark, folder):
    return events(spark, folder).select(F.col("event_type").alias("action"), "*")


@query("""
SELECT event_id,
       CASE WHEN event_type = 'purchase' THEN value END AS total_basket,
       CASE WHEN event_type = 'purchase' THEN props END AS detail
FROM events""")
def struct_deref(spark, folder):
    purchase = F.struct(F.col("value").alias("total_basket"),
                        F.struct("props").alias("extra"))
    orders = events(spark, folder).select(
        "event_id", F.when(F.col("event_type") == "purchase", purchase).alias("order"))
    return orders.select("event_id", "order.total_basket",
                         F.col("order.extra.props").alias("detail"))


@query("""
SELECT event_id,
       CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band,
       CASE WHEN event_type = 'purchase' THEN 1.5::DOUBLE END AS weight,
       CASE WHEN event_type = 'error' THEN NULL ELSE 1 END AS counted
FROM events""")
def case_when(spark, folder):
    kind = F.col("event_type")
    return events(spark, folder).select(
        "event_id",
        F.when(F.col("value") > 50, "high").otherwise("low").alias("band"),
        F.when(kind == "purchase", F.lit(1.5)).alias("weight"),
        F.when(kind == "error", F.lit(None)).otherwise(F.lit(1)).alias("counted"))


@query("""
SELECT event_id,
       round(value * 2 + 1.5 - value / 4, 6) AS mixed,
       user_id + event_id * 2 - 1 AS whole,
       value / CASE WHEN user_id = 0 THEN NULL ELSE user_id END AS per_user
FROM events""")
def arith(spark, folder):
    value, user = F.col("value"), F.col("user_id")
    return events(spark, folder).select(
        "event_id",
        F.round(value * 2 + F.lit(1.5) - value / 4, 6).alias("mixed"),
        (user + F.col("event_id") * 2 - 1).alias("whole"),
        F.try_divide(value, user).alias("per_user"))


@query("""
SELECT event_id, CASE WHEN user_id = 0 THEN NULL ELSE event_id // user_id END AS quotient,
       (0 - event_id) // 7 AS negative
FROM events""")
def integer_division(spark, folder):
    return events(spark, folder).select(
        "event_id",
        E.whole_ratio(F.col("event_id"), F.col("user_id")).alias("quotient"),
        E.whole_ratio(0 - F.col("event_id"), F.lit(7)).alias("negative"))


@query("""
SELECT event_id, event_type || '|' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS action,
       event_type || CASE WHEN user_id > 3 THEN 'x' END AS partly
FROM events""")
def string_plus(spark, folder):
    kind = F.col("event_type")
    return events(spark, folder).select(
        "event_id", E.joined_text(kind, F.lit("|"), millis("ts")).alias("action"),
        E.joined_text(kind, F.when(F.col("user_id") > 3, "x")).alias("partly"))


@query("""
SELECT event_id, CAST(trunc(value) AS INTEGER) AS as_integer,
       CAST(trunc(value) AS BIGINT) AS as_bigint,
       CAST(user_id AS DOUBLE) AS as_double, CAST(event_id AS VARCHAR) AS as_text,
       user_id <> 0 AS as_boolean, TRY_CAST(event_type AS BIGINT) AS bad_number,
       TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS from_text
FROM events""")
def cast_types(spark, folder):
    return events(spark, folder).select(
        "event_id",
        F.col("value").try_cast("integer").alias("as_integer"),
        F.col("value").try_cast("bigint").alias("as_bigint"),
        F.col("user_id").try_cast("double").alias("as_double"),
        F.col("event_id").try_cast("string").alias("as_text"),
        F.col("user_id").try_cast("boolean").alias("as_boolean"),
        F.col("event_type").try_cast("bigint").alias("bad_number"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint").alias("from_text"))


@query("""
SELECT event_id, CASE WHEN event_type = 'purchase' THEN props
                      WHEN event_type = 'click' THEN event_type END AS looked_up,
       'second' AS second_name, NULL::VARCHAR AS absent
FROM events""")
def map_index_nested(spark, folder):
    kind = F.col("event_type")
    rows = events(spark, folder).select(
        "event_id",
        E.map_of(F.array(F.lit("purchase"), F.lit("click")),
                 F.array(F.lit("p"), F.lit("c"))).alias("short"),
        E.map_of(F.array(F.lit("p"), F.lit("c")), F.array(F.col("props"), kind)).alias("by_short"),
        kind.alias("kind"), F.array(F.lit("first"), F.lit("second")).alias("names"))
    return rows.select(
        "event_id", E.item(F.col("by_short"), E.item(F.col("short"), F.col("kind"))).alias("looked_up"),
        E.item(F.col("names"), 2).alias("second_name"),
        E.item(F.col("names"), 3).alias("absent"))


@query("""
SELECT event_id, event_type AS kind, CAST(event_id AS VARCHAR) AS number,
       NULL::VARCHAR AS beyond, string_split(props, '": ')[2] AS tail
FROM events""")
def split_index(spark, folder):
    text = E.joined_text(F.col("event_type"), F.lit("|"), F.col("event_id"))
    parts = E.split_literal(text, "|")
    return events(spark, folder).select(
        "event_id", E.item(parts, 1).alias("kind"), E.item(parts, 2).alias("number"),
        E.item(parts, 3).alias("beyond"),
        E.item(E.split_literal(F.col("props"), '": '), 2).alias("tail"))


@query("""
SELECT event_id, event_type, value FROM events
WHERE event_type != 'error' AND value > 10 AND user_id != 3""")
def where_and(spark, folder):
    return (events(spark, folder)
            .where((F.col("event_type") != "error") & (F.col("value") > 10)
                   & (F.col("user_id") != 3))
            .select("event_id", "event_type", "value"))


@query("""
SELECT event_id, user_id = 7 AS eq, user_id != 7 AS ne, value < 5 AS lt, value > 5 AS gt,
       value <= 5 AS le, value >= 5 AS ge,
       CASE WHEN event_type = 'view' THEN value END > 5 AS with_null
FROM events WHERE value >= 1 AND user_id <= 100""")
def where_compare(spark, folder):
    user, value = F.col("user_id"), F.col("value")
    return (events(spark, folder).where((value >= 1) & (user <= 100))
            .select("event_id", (user == 7).alias("eq"), (user != 7).alias("ne"),
                    (value < 5).alias("lt"), (value > 5).alias("gt"),
                    (value <= 5).alias("le"), (value >= 5).alias("ge"),
                    (F.when(F.col("event_type") == "view", value) > 5).alias("with_null")))


@query("""
SELECT event_id, value AS order_value FROM events
WHERE CASE WHEN event_type = 'purchase' THEN value END IS NOT NULL""")
def where_not_null(spark, folder):
    order_value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return (events(spark, folder).where(order_value.isNotNull())
            .select("event_id", order_value.alias("order_value")))


@query("""
SELECT event_id, event_type, props FROM events
WHERE event_type LIKE '%i_n%' AND props LIKE '{"k": 1_}'""")
def where_like(spark, folder):
    return (events(spark, folder)
            .where(F.col("event_type").like("%i_n%") & F.col("props").like('{"k": 1_}'))
            .select("event_id", "event_type", "props"))


@query("""
SELECT event_id, event_type, value FROM events
WHERE event_type = 'signup' OR event_type = 'purchase' AND value > 20""")
def where_and_or(spark, folder):
    kind = F.col("event_type")
    return (events(spark, folder)
            .where((kind == "signup") | ((kind == "purchase") & (F.col("value") > 20)))
            .select("event_id", "event_type", "value"))


@query("""
SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents)
GROUP BY lang, word""")
def explode_actions(spark, folder):
    documents = read_table(spark, folder, "documents")
    words = documents.select("doc_id", "lang",
                             F.explode(E.split_literal(F.col("text"), " ")).alias("word"))
    # One count per (word, document) first: both results follow from it.
    per_document = words.groupBy("lang", "word", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_document.groupBy("lang", "word").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("SELECT user_id AS user_key, user_id, value FROM events")
def as_value(spark, folder):
    return events(spark, folder).select(F.col("user_id").alias("user_key"), "user_id", "value")


@query("""
SELECT user_id, count(*) AS n, 1::BIGINT AS partitions, true AS in_range
FROM events GROUP BY user_id""")
def partition_by_key(spark, folder):
    sink = new_folder(spark, "by-user")
    write_partitions(events(spark, folder).select("user_id", "value"), "user_id", 16, sink)
    return spark.read.parquet(sink).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("partitions"),
        F.bool_and(F.col("partition").between(0, 15)).alias("in_range"))
