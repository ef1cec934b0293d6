"""The attribution program over the ``events`` table.

Sessions are users, with twelve hours instead of twenty minutes as the gap, as
the table's users are seen every few hours. Retention is not applied, so that the
queries report on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions import expressions as E
from flowtables.operators import windows as W
from flowtables.plans import attribution as P
from flowtables.plans.projection import events, millis
from flowtables.plans.registry import query
from flowtables.plans.topics import event_batches, plain_bounds, table_of

SESSION = W.session("12 HOURS")
HEALTH = W.hopping("1 MINUTE", "30 SECONDS")
REPORTING = W.hopping("20 MINUTES", "10 MINUTES")

# Which event type stands for which action; errors carry the text 'null'.
ACTIONS = {"click": P.ENGAGED, "view": P.DISPLAYS[0], "signup": P.DISPLAYS[1], "error": "null",
           "purchase": P.PURCHASE}

PAGES = """
pages AS (
  SELECT ts, epoch_us(ts) // 1000 AS millis, event_id AS seq,
         CAST(user_id AS VARCHAR) AS session_id, CAST(user_id % 10 AS VARCHAR) AS journey_code,
         CASE WHEN user_id % 3 > 0 THEN 'region ' || (user_id % 3) END AS location,
         CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'app' END AS device,
         CASE event_type WHEN 'click' THEN 'engaged_digital_assistant'
                         WHEN 'view' THEN 'displayed_digital_assistant'
                         WHEN 'signup' THEN 'displayed_email'
                         WHEN 'error' THEN 'null' ELSE event_type END AS action,
         json_extract_string(props, '$.k') AS scenario_id,
         CASE WHEN event_type = 'purchase' AND value > 20 THEN props END AS promo_code,
         CASE WHEN event_type <> 'view' THEN props END AS cookie_id,
         CASE WHEN event_type = 'purchase' THEN value END AS order_value,
         CASE WHEN event_type = 'purchase' THEN 'EUR' END AS order_currency
  FROM events)"""


def page_events(spark, folder):
    return pages_of(events(spark, folder))


def pages_of(rows):
    """Page events from rows of ``events``, in a batch or a stream."""
    kind, user = F.col("event_type"), F.col("user_id")
    order_value = F.when(kind == "purchase", F.col("value"))
    action = kind
    for event_type, name in ACTIONS.items():
        action = F.when(kind == event_type, name).otherwise(action)
    return rows.select(
        "ts", millis("ts").alias("millis"), F.col("event_id").alias("seq"),
        user.cast("string").alias("session_id"),
        (user % 10).cast("string").alias("journey_code"),
        F.when(user % 3 > 0, F.concat(F.lit("region "), (user % 3).cast("string")))
        .alias("location"),
        F.when(user % 2 == 0, "web").otherwise("app").alias("device"),
        action.alias("action"),
        F.get_json_object("props", "$.k").alias("scenario_id"),
        F.when((kind == "purchase") & (F.col("value") > 20), F.col("props")).alias("promo_code"),
        F.when(kind != "view", F.col("props")).alias("cookie_id"),
        order_value.alias("order_value"),
        F.when(order_value.isNotNull(), "EUR").alias("order_currency"))


def config_changes(spark, folder):
    """Percentages per journey that signups change over time."""
    changes = events(spark, folder).where(F.col("event_type") == "signup")
    return changes.select((F.col("user_id") % 10).cast("string").alias("journey_code"),
                          (F.get_json_object("props", "$.k").cast("double") / 100)
                          .alias("percentage"), F.col("event_id").alias("seq"))


MARKED = f"""
WITH {PAGES},
marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts)
                      <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens
  FROM pages WHERE action != 'null' AND journey_code != 'null' AND session_id != 'null'),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts) AS number FROM marked),
rows AS (SELECT *, min(ts) OVER (PARTITION BY session_id, number) AS window_start FROM numbered),
sessions AS (
  SELECT window_start, max(ts) + INTERVAL 12 HOURS AS window_end, session_id, journey_code,
         location, device, count(*) AS actions_count, arg_max(cookie_id, seq) AS cookie_id,
         arg_min(millis, seq) FILTER (WHERE action = 'engaged_digital_assistant') AS earliest_da,
         arg_max(millis, seq) FILTER (WHERE action = 'engaged_digital_assistant') AS engaged_at,
         arg_max(millis, seq) FILTER (WHERE action = 'purchase') AS purchase_at
  FROM rows GROUP BY window_start, session_id, journey_code, location, device)"""

FOUND = MARKED + """,
at_time AS (
  SELECT window_start, session_id, millis, arg_max(order_value, seq) AS order_value,
         arg_max(order_currency, seq) AS order_currency, arg_max(promo_code, seq) AS promo_code,
         arg_max(scenario_id, seq) AS scenario_id
  FROM rows GROUP BY window_start, session_id, millis),
looked_up AS (
  SELECT s.*, b.order_value, b.order_currency, b.promo_code, e.scenario_id
  FROM sessions s
  JOIN at_time b ON b.session_id = s.session_id AND b.window_start = s.window_start
                AND b.millis = s.purchase_at
  LEFT JOIN at_time e ON e.session_id = s.session_id AND e.window_start = s.window_start
                     AND e.millis = s.engaged_at),
found AS (
  SELECT session_id, journey_code, location, device, window_start, purchase_at, engaged_at,
         order_value, order_currency, scenario_id
  FROM looked_up WHERE earliest_da < purchase_at
  UNION ALL
  SELECT session_id, journey_code, location, device, window_start, purchase_at, NULL, NULL, NULL,
         NULL
  FROM looked_up WHERE promo_code IS NOT NULL)"""

INVOICES = FOUND + """,
config AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS journey_code,
         arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, event_id) AS percentage
  FROM events WHERE event_type = 'signup' GROUP BY 1),
invoices AS (
  SELECT found.*, percentage, order_value * percentage AS invoice_total
  FROM found LEFT JOIN config ON found.journey_code = config.journey_code)"""


@query(MARKED + " SELECT * FROM sessions")
def attribution_sessions(spark, folder):
    return P.sessions(page_events(spark, folder), SESSION)


@query(MARKED + """,
last_times AS (SELECT window_start, session_id, action, arg_max(millis, seq) AS millis
               FROM rows GROUP BY ALL),
texts AS (SELECT window_start, session_id,
                 string_agg(action || '=' || millis, ';' ORDER BY action) AS attribution_actions
          FROM last_times GROUP BY ALL)
SELECT window_start, session_id, location, 0::BIGINT AS part,
       string_agg(action || '|' || millis, ',' ORDER BY seq) AS actions,
       string_agg(millis || '=' || scenario_id, ';' ORDER BY CAST(millis AS VARCHAR)) AS scenarios,
       string_agg(millis || '=' || coalesce(promo_code, 'null'), ';'
                  ORDER BY CAST(millis AS VARCHAR)) AS promo_codes,
       string_agg(millis || '=' || coalesce(CAST(order_value AS VARCHAR), 'null'), ';'
                  ORDER BY CAST(millis AS VARCHAR)) AS orders_value,
       string_agg(millis || '=' || coalesce(order_currency, 'null'), ';'
                  ORDER BY CAST(millis AS VARCHAR)) AS orders_currency,
       any_value(attribution_actions) AS attribution_actions
FROM rows JOIN texts USING (window_start, session_id)
GROUP BY window_start, session_id, location""")
def attribution_session_actions(spark, folder):
    parts = P.session_actions(page_events(spark, folder), SESSION)
    return parts.select(
        "window_start", "session_id", "location", "part",
        F.array_join("actions", ",").alias("actions"),
        *[E.map_text(F.col(name)).alias(name)
          for name in ("scenarios", "promo_codes", "orders_value", "orders_currency",
                       "attribution_actions")])


@query(MARKED + """,
listed AS (SELECT *, action || '|' || millis AS item,
                  row_number() OVER (PARTITION BY window_start, session_id ORDER BY seq) AS n FROM rows),
lasts AS (SELECT window_start, session_id, item, max(n) AS n FROM listed GROUP BY ALL),
nexts AS (SELECT a.window_start, a.session_id, a.item, b.item AS next_action
          FROM lasts a LEFT JOIN listed b
            ON a.window_start = b.window_start AND a.session_id = b.session_id AND b.n = a.n + 1),
times AS (SELECT window_start, session_id, action, arg_max(millis, seq) AS last_at
          FROM rows GROUP BY ALL)
SELECT l.window_start, l.session_id, l.journey_code, l.location, l.device, l.item AS action,
       next_action, last_at
FROM listed l JOIN nexts x ON l.window_start = x.window_start AND l.session_id = x.session_id
                          AND l.item = x.item
JOIN times t ON l.window_start = t.window_start AND l.session_id = t.session_id
            AND l.action = t.action""")
def exploded_actions(spark, folder):
    return P.exploded_actions(page_events(spark, folder), SESSION)


@query(FOUND + " SELECT * FROM found")
def attribution_found(spark, folder):
    return P.attributions(page_events(spark, folder), SESSION)


HEALTH_SQL = f"""
WITH {PAGES},
counted AS (
  SELECT s AS window_start, s + INTERVAL 1 MINUTE AS window_end, journey_code,
         count(session_id) AS actions_count,
         count(CASE WHEN action = 'purchase' THEN 1 END) AS purchases,
         count(CASE WHEN action = 'engaged_digital_assistant' THEN 1 END) AS engaged,
         count(CASE WHEN action = 'displayed_email' THEN 1 END) AS emails
  FROM (SELECT *, time_bucket(INTERVAL 30 SECONDS, ts) - k * INTERVAL 30 SECONDS AS s
        FROM pages, range(0, 2) r(k) WHERE action <> 'null')
  WHERE ts < s + INTERVAL 1 MINUTE GROUP BY ALL)
SELECT window_start, window_end, journey_code, actions_count,
       CAST(round(CAST(purchases AS DECIMAL(18, 6)) / actions_count, 2) AS DOUBLE)
         AS purchase_ratio,
       CAST(round(CAST(engaged AS DECIMAL(18, 6)) / actions_count, 2) AS DOUBLE)
         AS engaged_ratio,
       CAST(round(CAST(emails AS DECIMAL(18, 6)) / actions_count, 2) AS DOUBLE) AS email_ratio
FROM counted"""


RATIOS = {"purchase_ratio": P.PURCHASE, "engaged_ratio": P.ENGAGED, "email_ratio": P.DISPLAYS[1]}


@query(HEALTH_SQL)
def attribution_health(spark, folder):
    return P.health(page_events(spark, folder), HEALTH, RATIOS)


@query(HEALTH_SQL)
def stream_attribution_health(spark, folder):
    """The health table kept from a stream of several batches."""
    stream, grace = event_batches(spark, folder)
    window = W.hopping("1 MINUTE", "30 SECONDS", grace=grace)
    table = P.health(pages_of(stream), window, RATIOS)
    return plain_bounds(table_of(spark, table, "health", [*W.BOUNDS, "journey_code"]))


@query(INVOICES + """
SELECT journey_code, session_id, location, device, window_start, purchase_at, engaged_at,
       order_value, order_currency, scenario_id, percentage,
       round(invoice_total, 4) AS invoice_total
FROM invoices""")
def attribution_invoices(spark, folder):
    billed = P.invoices(P.attributions(page_events(spark, folder), SESSION),
                        config_changes(spark, folder))
    return billed.withColumn("invoice_total", F.round("invoice_total", 4))


@query(INVOICES + """
SELECT s AS window_start, s + INTERVAL 20 MINUTES AS window_end, journey_code, location, device,
       round(sum(invoice_total), 4) AS invoice_total, round(sum(order_value), 2) AS sales_generated,
       count(*) AS conversions, round(sum(order_value), 2) / count(*) AS average_order_value
FROM (SELECT *, make_timestamp(purchase_at * 1000) AS bought_at,
             time_bucket(INTERVAL 10 MINUTES, make_timestamp(purchase_at * 1000))
               - k * INTERVAL 10 MINUTES AS s
      FROM invoices, range(0, 2) r(k))
WHERE bought_at < s + INTERVAL 20 MINUTES
GROUP BY s, journey_code, location, device""")
def attribution_reporting(spark, folder):
    billed = P.invoices(P.attributions(page_events(spark, folder), SESSION),
                        config_changes(spark, folder))
    bought_at = F.timestamp_millis("purchase_at").cast("timestamp_ntz")
    totals = P.reporting(billed.withColumn("bought_at", bought_at), "bought_at", REPORTING)
    return totals.withColumns({
        "invoice_total": F.round("invoice_total", 4),
        "sales_generated": F.round("sales_generated", 2),
        "average_order_value": F.round("sales_generated", 2) / F.col("conversions")})


@query(f"""
WITH {PAGES},
counted AS (
  SELECT s AS window_start, s + INTERVAL 20 MINUTES AS window_end, journey_code, scenario_id,
         location, device, count(DISTINCT session_id) AS sessions_count,
         count(CASE WHEN action IN ('displayed_digital_assistant', 'displayed_email') THEN 1 END)
           AS displays_count,
         count(CASE WHEN action IN ('engaged_digital_assistant', 'engaged_email') THEN 1 END)
           AS engagements_count
  FROM (SELECT *, time_bucket(INTERVAL 10 MINUTES, ts) - k * INTERVAL 10 MINUTES AS s
        FROM pages, range(0, 2) r(k))
  WHERE ts < s + INTERVAL 20 MINUTES GROUP BY ALL)
SELECT *, displays_count // nullif(engagements_count, 0) AS engagements_through_rate
FROM counted""")
def attribution_engagement(spark, folder):
    return P.engagement(page_events(spark, folder), REPORTING)
