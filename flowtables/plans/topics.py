"""Topic, format and stream queries.

Stream queries read the whole table as a stream, run until the source is used up
and return what arrived in their sink.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables.functions import expressions as E
from flowtables.functions.formats import decoded, encode
from flowtables.functions.schemas import declare
from flowtables.operators import aggregates as A
from flowtables.operators import lists
from flowtables.operators import windows as W
from flowtables.operators.tables import latest_per_key
from flowtables.plans.projection import events, millis
from flowtables.plans.registry import query
from flowtables.plans.windowing import COUNTED, HOPPING, SESSIONS, counted, rounded
from flowtables.session import exists, file_system, make_folder, new_folder
from flowtables.sources.tables import read_table, stream_table
from flowtables.sources.topics import (
    OffsetTopic, declare_source, folder_records, merged, write_folder_topic,
)
from flowtables.streaming import operators as S
from flowtables.streaming.changes import (
    ReducedLog, TableLog, first_only, kept_changes, largest, matching_changes,
)
from flowtables.streaming.windows import SessionTable, WindowTable, pane_windows
from flowtables.streaming.runs import (
    EndMarker, append_changes, append_rows, current_table, read_changes,
)

NTZ = "timestamp_ntz"


def event_stream(spark, folder, **options):
    return stream_table(spark, folder, "events", ts="ts", **options)


def sink_schema(df) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def appended(spark, df, label):
    """Run an append-mode stream to its end and read its sink."""
    sink = new_folder(spark, label)
    append_rows(df, sink)
    return spark.read.schema(sink_schema(df)).parquet(sink)


def table_of(spark, df, label, keys):
    """Run an update-mode stream to its end and read the table behind its changes."""
    sink = new_folder(spark, label)
    append_changes(df, sink)
    return current_table(read_changes(spark, sink, sink_schema(df)), keys)


#: How the queries deal events into micro-batches: a tenth of the rows is one batch late.
BATCHED = """
WITH span AS (SELECT epoch_ms(min(ts)) AS begins, epoch_ms(max(ts)) AS ends FROM events),
batched AS (
  SELECT events.*, (epoch_ms(ts) - begins) // ((ends - begins) // 4 + 1)
                   + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS batch
  FROM events, span)"""


def staged_events(spark, folder, batches=4):
    """The events in folders of files, one per micro-batch, and half of their time in hours.

    Each batch spans a quarter of the table's time and is written by as many tasks as read it.
    """
    staged = new_folder(spark, "staged-events")
    rows = events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    width = (last - first) // batches + 1
    batch = F.floor((F.unix_millis("ts") - first) / width)
    late = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    rows.withColumn("_batch", batch + late).write.partitionBy("_batch").parquet(staged)
    paths = [f"{staged}/_batch={number}" for number in range(batches + 1)]
    return [path for path in paths if exists(spark, path)], sink_schema(rows), f"{2 * width // 3_600_000 + 1} HOURS"


def event_batches(spark, folder):
    """The events as a stream of several micro-batches; a grace of half their time keeps all."""
    staged, schema, grace = staged_events(spark, folder)
    topic, files = new_folder(spark, "event-batches"), spark.sparkContext.defaultParallelism
    for path in staged:
        spark.read.schema(schema).parquet(path).repartition(files).write.mode("append").parquet(topic)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(topic)
    return stream, grace


def fed_events(spark, folder):
    """The same stream again and again, each time with one more batch of files in its topic."""
    staged, schema, grace = staged_events(spark, folder)
    topic = new_folder(spark, "fed-events")
    make_folder(spark, topic)
    for number, path in enumerate(staged):
        files = file_system(spark, topic)[1]
        files.rename(file_system(spark, path)[0], file_system(spark, f"{topic}/{number}")[0])
        yield spark.readStream.schema(schema).parquet(f"{topic}/*"), grace


def plain_bounds(df):
    return df.withColumns({name: F.col(name).cast(NTZ) for name in W.BOUNDS})


PAGE_EVENTS = ("event_id bigint, user_id bigint, event_type varchar, value double, "
               "props varchar, timestamp bigint")


@query("""
SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS timestamp,
       make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts
FROM events""")
def src_stream(spark, folder):
    """A JSON topic declared as a stream with an event-time column."""
    topic = new_folder(spark, "page-events")
    write_folder_topic(events(spark, folder).withColumn("timestamp", millis("ts")).drop("ts"),
                       topic)
    stream = declare_source(folder_records(spark, topic), declare(PAGE_EVENTS, key="event_id"),
                            event_time="timestamp")
    return appended(spark, stream, "src-stream").withColumn("ts", F.col("ts").cast(NTZ))


@query("""
SELECT event_id, event_type || '|' || props AS action, value AS order_value
FROM events WHERE event_type <> 'error'""")
def stream_ctas(spark, folder):
    stream = event_stream(spark, folder).where(F.col("event_type") != "error").select(
        "event_id", E.joined_text(F.col("event_type"), F.lit("|"), F.col("props")).alias("action"),
        F.col("value").alias("order_value"))
    return appended(spark, stream, "derived-stream")


@query("""
SELECT event_id, user_id, 'sale' AS kind, value AS amount FROM events
WHERE event_type = 'purchase'
UNION ALL
SELECT event_id, user_id, 'lead', 0.0 FROM events WHERE event_type = 'signup'""")
def insert_into_union(spark, folder):
    """Two selects inserted into one stream."""
    def branch(action, kind, amount):
        return (event_stream(spark, folder).where(F.col("event_type") == action)
                .select("event_id", "user_id", F.lit(kind).alias("kind"), amount.alias("amount")))

    both = merged(branch("purchase", "sale", F.col("value")),
                  branch("signup", "lead", F.lit(0.0)))
    return appended(spark, both, "inserted")


@query("""
SELECT event_id, user_id, value AS order_value, NULL::VARCHAR AS props FROM events
WHERE event_type = 'purchase'
UNION ALL
SELECT event_id, user_id, NULL, props FROM events WHERE event_type = 'click'""")
def shared_topic_union(spark, folder):
    """Two streams of different columns that write into one topic."""
    stream = event_stream(spark, folder)
    sales = stream.where("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("value").alias("order_value"))
    clicks = event_stream(spark, folder).where("event_type = 'click'").select(
        "event_id", "user_id", "props")
    return appended(spark, merged(sales, clicks), "shared-topic")


ROUND_TRIP = """
SELECT event_id, event_type, value, props,
       CASE WHEN event_type <> 'error' THEN user_id END AS user_id {nested} FROM events"""


def nullable_user(spark, folder):
    return events(spark, folder).select(
        "event_id", "event_type", "value", "props",
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"))


@query(ROUND_TRIP.format(nested=", event_type || '|' || props AS second_item, value AS price"))
def fmt_json_roundtrip(spark, folder):
    rows = nullable_user(spark, folder).withColumns({
        "items": F.array("event_type", F.concat("event_type", F.lit("|"), "props")),
        "order": F.struct(F.col("value").alias("price"))})
    value = rows.select(encode(rows.columns).alias("value"))
    back = decoded(value, rows.schema)
    return back.select("event_id", "event_type", "value", "props", "user_id",
                       E.item(F.col("items"), 2).alias("second_item"), "order.price")


@query(ROUND_TRIP.format(nested=""))
def fmt_csv_roundtrip(spark, folder):
    rows = nullable_user(spark, folder)
    value = rows.select(encode(rows.columns, "DELIMITED", schema=rows.schema).alias("value"))
    return decoded(value, rows.schema, value_format="DELIMITED")


@query(HOPPING.format(size=20, advance=10, ratio=2, key="event_type", columns=COUNTED,
                      source="events"))
def stream_hopping_update(spark, folder):
    """Five micro-batches; the grace period covers their disorder."""
    stream, grace = event_batches(spark, folder)
    table = W.window_agg(stream, "ts", W.hopping("20 MINUTES", "10 MINUTES", grace=grace),
                         ["event_type"], counted())
    return plain_bounds(rounded(table_of(spark, table, "hopping", [*W.BOUNDS, "event_type"])))


@query("""
SELECT user_id, count(*) AS n, max(value) AS max_value FROM events
GROUP BY user_id HAVING max(value) > 50""")
def changelog_reread(spark, folder):
    """A table's change topic read back as a stream and filtered."""
    table = event_stream(spark, folder).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
    log = new_folder(spark, "table-changes")
    append_changes(table, log)
    changes = read_changes(spark, log, sink_schema(table), stream=True)
    reread = appended(spark, changes.where(F.col("max_value") > 50), "reread")
    return current_table(reread, ["user_id"])


@query(SESSIONS.format(gap="12 HOURS", source="events") + f"""
SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOURS AS window_end, user_id, {COUNTED}
FROM numbered GROUP BY user_id, number""")
def stream_session(spark, folder):
    """Closed sessions in append mode; the end marker closes the last ones."""
    stream, grace = event_batches(spark, folder)
    marker = EndMarker(spark, stream.schema, "ts", new_folder(spark, "marker"))
    table = W.window_agg(marker.attach(stream), "ts", W.session("12 HOURS", grace=grace),
                         ["user_id"], counted())
    sink = new_folder(spark, "sessions")
    append_rows(table, sink)
    marker.close()
    append_rows(table, sink)
    return plain_bounds(rounded(spark.read.schema(sink_schema(table)).parquet(sink)))


@query(f"""
WITH on_time AS (SELECT * FROM events WHERE event_type <> 'error'),
late AS (SELECT * FROM events WHERE event_type = 'error'),
kept AS (
  SELECT * FROM on_time UNION ALL
  SELECT * FROM late
  WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
        > (SELECT max(ts) FROM on_time) - INTERVAL 36 HOURS)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, {COUNTED}
FROM kept GROUP BY ALL""")
def stream_grace_late(spark, folder):
    """Error events arrive after all others: those within the grace period count."""
    topic = new_folder(spark, "late-events")
    rows = events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("event_type") == "error"
    rows.where(~late).write.parquet(topic)
    stream = spark.readStream.schema(sink_schema(rows)).parquet(topic)
    marker = EndMarker(spark, stream.schema, "ts", new_folder(spark, "marker"))
    table = W.window_agg(marker.attach(stream), "ts", W.tumbling("1 HOUR", grace="36 HOURS"),
                         [], counted())
    sink = new_folder(spark, "graced")
    append_rows(table, sink)
    rows.where(late).write.mode("append").parquet(topic)
    append_rows(table, sink)
    marker.close()
    append_rows(table, sink)
    return plain_bounds(rounded(spark.read.schema(sink_schema(table)).parquet(sink)))


@query(HOPPING.format(size=20, advance=10, ratio=2, key="event_type",
                      columns="count(DISTINCT user_id) AS users", source="events"))
def stream_count_distinct(spark, folder):
    """Exact: a stream drops repeats per window, what is left in its log is counted.

    The stream's state ends with the windows' grace; the count over the log keeps none.
    """
    stream, grace = event_batches(spark, folder)
    window = W.hopping("20 MINUTES", "10 MINUTES", grace=grace)
    seen = W.distinct_per_window(stream, "ts", window, ["event_type"], "user_id")
    log = new_folder(spark, "seen")
    append_rows(seen, log)
    return plain_bounds(spark.read.schema(sink_schema(seen)).parquet(log)
                        .groupBy(*W.BOUNDS, "event_type").agg(F.count("user_id").alias("users")))


@query(f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS window_start,
         time_bucket(INTERVAL 30 MINUTES, ts) + INTERVAL 30 MINUTES AS window_end,
         event_type, {COUNTED}
  FROM events GROUP BY ALL)
WHERE window_end > (SELECT max(ts) FROM events) - INTERVAL 48 HOURS""")
def stream_window_retention(spark, folder):
    """The table behind a windowed stream, cut to its retention when it is read."""
    stream, grace = event_batches(spark, folder)
    window = W.tumbling("30 MINUTES", retention="48 HOURS", grace=grace)
    counts = [*counted(), A.largest("_newest", F.col("ts"))]
    table = table_of(spark, W.window_agg(stream, "ts", window.kept(), ["event_type"], counts),
                     "retained", [*W.BOUNDS, "event_type"])
    kept = W.retained(table, table.agg(F.max("_newest")).scalar(), window.retention)
    return plain_bounds(rounded(kept.drop("_newest")))


@query("""
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id DESC) AS newest
FROM (SELECT user_id, event_id,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
WHERE r <= 3 GROUP BY user_id""")
def stream_topk(spark, folder):
    log = new_folder(spark, "topk")
    S.topk_changes(event_batches(spark, folder)[0], log, ["user_id"], F.col("event_id"), 3, "newest")
    changes = read_changes(spark, log, T.StructType.fromDDL("user_id bigint, newest array<bigint>"))
    return (S.topk_table(changes, ["user_id"], 3, "newest")
            .select("user_id", F.array_join("newest", ",").alias("newest")))


@query("""
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def stream_first_occurrence(spark, folder):
    stream, _ = event_batches(spark, folder)
    rows = stream.select("user_id", "event_type", "event_id", "value")
    log, keys = new_folder(spark, "first"), ["user_id", "event_type"]
    S.first_changes(rows, log, keys, "event_id")
    return S.first_table(read_changes(spark, log, sink_schema(rows)), keys, "event_id")


@query("""
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
       max(event_id) AS event_id
FROM events GROUP BY user_id""")
def stream_table_latest(spark, folder):
    """A keyed table kept from a stream: newest row per key as an upserted table."""
    rows = event_stream(spark, folder).select("user_id", "event_type", "value", "event_id")
    return table_of(spark, latest_per_key(rows, ["user_id"], F.col("event_id")), "latest",
                    ["user_id"])


@query("""
SELECT user_id, 0::BIGINT AS part,
       string_agg(event_type || '=' || props, ';' ORDER BY event_type) AS last_props
FROM (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2)
GROUP BY user_id""")
def stream_as_map(spark, folder):
    """The map kept as a table of entries, so that state never holds a whole map."""
    order = F.col("event_id")
    entries = (event_stream(spark, folder).groupBy("user_id", "event_type")
               .agg(F.max_by("props", order).alias("props"), F.max(order).alias("at")))
    table = table_of(spark, entries, "map-entries", ["user_id", "event_type"])
    maps = lists.map_parts(table, ["user_id"], F.col("event_type"), F.col("props"), F.col("at"),
                           "last_props")
    return maps.select("user_id", "part", E.map_text(F.col("last_props")).alias("last_props"))


JOINED = """
SELECT event_id, user_id, value, c_name, round(value * c_acctbal, 4) AS weighted
FROM events LEFT JOIN customer ON user_id = c_custkey"""


def config_table(spark, folder):
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_name", "c_acctbal")


def weighted(joined):
    return joined.select("event_id", "user_id", "value", "c_name",
                         F.round(F.col("value") * F.col("c_acctbal"), 4).alias("weighted"))


@query(JOINED)
def stream_static_left_join(spark, folder):
    joined = event_stream(spark, folder).join(config_table(spark, folder), "user_id", "left")
    return appended(spark, weighted(joined), "joined")


@query(JOINED)
def stream_refreshed_left_join(spark, folder):
    """The table side is read anew for every micro-batch."""
    log = new_folder(spark, "joined")
    stream = event_stream(spark, folder).select("event_id", "user_id", "value")
    S.join_refreshed(stream, lambda: config_table(spark, folder), "user_id", log)
    schema = T.StructType.fromDDL(
        "user_id bigint, event_id bigint, value double, c_name string, c_acctbal double")
    return weighted(read_changes(spark, log, schema))




@query(SESSIONS.format(gap="12 HOURS", source="events") + f"""
SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOURS AS window_end, user_id, {COUNTED}
FROM numbered GROUP BY user_id, number""")
def stream_session_updates(spark, folder):
    """Sessions while they are open: a table that every micro-batch brings up to date."""
    sessions = None
    for stream, grace in fed_events(spark, folder):
        sessions = sessions or SessionTable(
            spark, new_folder(spark, "open-sessions"), stream.schema, "ts",
            W.session("12 HOURS", grace=grace), ["user_id"], counted())
        sessions.run(stream)
    return plain_bounds(rounded(sessions.table()))


@query("""
SELECT user_id, count(*) AS n, max(value) AS max_value FROM events
GROUP BY user_id HAVING count(*) % 2 = 1""")
def stream_having_retract(spark, folder):
    """Groups come and go: those that stop matching are deleted from the table."""
    log = TableLog(spark, new_folder(spark, "having"), T.StructType.fromDDL(
        "user_id bigint, n bigint, max_value double"), ["user_id"])
    for stream, _ in fed_events(spark, folder):
        groups = stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
        matching_changes(groups, F.col("n") % 2 == 1, log)
    return log.table()


@query(BATCHED + """
SELECT user_id, event_type, event_id, value FROM batched
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch, event_id) = 1""")
def stream_first_once(spark, folder):
    """Each key's first row by arrival, emitted once, in the batch in which the key comes up."""
    log = TableLog(spark, new_folder(spark, "first-once"), T.StructType.fromDDL(
        "user_id bigint, event_type string, event_id bigint, value double"), ["user_id", "event_type"])
    for stream, _ in fed_events(spark, folder):
        first_only(stream.select("user_id", "event_type", "event_id", "value"), "event_id", log)
    return log.changes().select("user_id", "event_type", "event_id", "value")


@query(HOPPING.format(size=60, advance=5, ratio=12, key="event_type", columns=COUNTED, source="events"))
def stream_hopping_panes(spark, folder):
    """Twelve windows per row: state holds panes, and windows of closed panes."""
    stream, grace = event_batches(spark, folder)
    marker = EndMarker(spark, stream.schema, "ts", new_folder(spark, "marker"))
    table = pane_windows(marker.attach(stream), "ts", W.hopping("1 HOUR", "5 MINUTES", grace=grace),
                         ["event_type"], counted())
    sink = new_folder(spark, "panes")
    append_rows(table, sink)
    marker.close()
    append_rows(table, sink)
    return plain_bounds(rounded(spark.read.schema(sink_schema(table)).parquet(sink)))


@query(BATCHED + """,
ends AS (SELECT batch, max(ts) AS newest FROM batched GROUP BY batch),
marks AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                        - INTERVAL 1 HOUR AS watermark FROM ends),
placed AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM batched JOIN marks USING (batch))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, {COUNTED}
FROM placed WHERE watermark IS NULL OR window_start + INTERVAL 1 HOUR > watermark GROUP BY ALL""".replace(
    "{COUNTED}", COUNTED))
def stream_strict_grace(spark, folder):
    """Late events are dropped in the batch that brings them, by the last commit's watermark."""
    table = None
    for stream, _ in fed_events(spark, folder):
        table = table or WindowTable(spark, new_folder(spark, "strict"), stream.schema, "ts",
                                     W.tumbling("1 HOUR", grace="1 HOUR"), ["event_type"], counted())
        table.run(stream)
    return plain_bounds(rounded(table.table()))


@query(f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS window_start,
         time_bucket(INTERVAL 30 MINUTES, ts) + INTERVAL 30 MINUTES AS window_end,
         event_type, {COUNTED}
  FROM events GROUP BY ALL)
WHERE window_end > (SELECT max(ts) FROM events) - INTERVAL 48 HOURS""")
def stream_retention_deletes(spark, folder):
    """The same windows as a table whose old periods are dropped as time goes on."""
    table = None
    for stream, grace in fed_events(spark, folder):
        table = table or WindowTable(
            spark, new_folder(spark, "kept"), stream.schema, "ts",
            W.tumbling("30 MINUTES", retention="48 HOURS", grace=grace), ["event_type"], counted())
        table.run(stream)
    return plain_bounds(rounded(table.table()))


@query("""
SELECT user_id, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY ALL""")
def stream_table_levels(spark, folder):
    """An updating aggregate whose change log is merged in levels while it is written."""
    keys = ["user_id", "event_type"]
    log = TableLog(spark, new_folder(spark, "levels"), T.StructType.fromDDL(
        "user_id bigint, event_type string, n bigint, max_value double"), keys, fanout=2)
    for stream, _ in fed_events(spark, folder):
        groups = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
        kept_changes(groups, log)
    return log.table()


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def keyed_topic(spark, folder):
    """A topic written with message keys, read back by its keys alone."""
    topic = new_folder(spark, "keyed-topic")
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    write_folder_topic(orders, topic, keys=["o_custkey"])
    records = folder_records(spark, topic, stream=False, keyed=True)
    value = T.StructType.fromDDL("o_orderkey bigint, o_totalprice double")
    rows = decoded(records, value).withColumn("o_custkey", F.col("key").cast("bigint")).drop("key")
    return latest_per_key(rows, ["o_custkey"], F.col("o_orderkey"))


@query("""
WITH newest AS (SELECT user_id, event_id % 3 AS batch, arg_max(event_type, event_id) AS event_type
                FROM events GROUP BY ALL)
SELECT user_id, arg_max(event_type, batch) AS event_type FROM newest WHERE batch > 0 GROUP BY user_id""")
def topic_offsets(spark, folder):
    """The latest value by partition and offset, from the end of the first of three batches on."""
    topic = OffsetTopic(spark, new_folder(spark, "offset-topic"), 4)
    starts = {}
    for batch in range(3):
        rows = events(spark, folder).where(F.col("event_id") % 3 == batch)
        topic.append(latest_per_key(rows.select("user_id", "event_type", "event_id"), ["user_id"],
                                    F.col("event_id")), ["user_id"])
        starts = starts or topic.ends()
    records = decoded(topic.records(starts), T.StructType.fromDDL("user_id bigint, event_type string"))
    newest = A.latest("event_type", F.col("event_type"), F.struct("partition", "offset"))
    return records.groupBy("user_id").agg(newest.over_rows())


@query("""
SELECT event_type, value FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS r
  FROM (SELECT DISTINCT event_type, value FROM events WHERE value IS NOT NULL))
WHERE r <= 20""")
def stream_topk_levels(spark, folder):
    """The largest different values per key from a log whose runs are reduced in levels."""
    log = ReducedLog(spark, new_folder(spark, "topk-levels"), T.StructType.fromDDL(
        "event_type string, value double"), largest(["event_type"], "value", 20, distinct=True), fanout=2)
    for stream, _ in fed_events(spark, folder):
        log.run(stream.where("value IS NOT NULL").select("event_type", "value"))
    return log.table()
