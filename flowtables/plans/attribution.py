"""The click-stream attribution program as transforms of one page-event table.

Input columns: ``session_id``, ``journey_code``, ``location``, ``device`` (the
session keys), ``ts``, ``millis`` (event time as epoch milliseconds), ``seq``
(arrival order), ``action``, ``scenario_id``, ``promo_code``, ``cookie_id``,
``order_value``, ``order_currency``.

The lists and maps of a session serve lookups only: the time of an action, then
the order or scenario at that time. Those lookups are aggregates and joins on the
event rows here, so no step needs a session's whole list; the lists themselves
are in :func:`session_actions`, in bounded parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.functions import expressions as E
from flowtables.operators import aggregates as A
from flowtables.operators import lists
from flowtables.operators import windows as W
from flowtables.operators.tables import latest_per_key
from flowtables.session import written
from flowtables.sources.topics import merged

SESSION_KEYS = ["session_id", "journey_code", "location", "device"]

# Action names and window settings of the program.
ENGAGED = "engaged_digital_assistant"
PURCHASE = "purchase"
DISPLAYS = ("displayed_digital_assistant", "displayed_email")
ENGAGEMENTS = ("engaged_digital_assistant", "engaged_email")
HEALTH_ACTIONS = {
    "add_to_basket_ratio": "add_to_basket",
    "category_page_ratio": "view_category_page",
    "product_page_ratio": "view_product_page",
    "home_page_ratio": "view_home_page",
    "checkout_ratio": "checkout",
}
SESSION = W.session("20 MINUTES", retention="30 MINUTES")
HEALTH = W.hopping("1 MINUTE", "30 SECONDS", retention="2 MINUTES")
REPORTING = W.hopping("20 MINUTES", "10 MINUTES", retention="40 MINUTES")


def valid(pages: DataFrame) -> DataFrame:
    """Events whose action and keys are not the text 'null'."""
    return pages.where((F.col("action") != "null") & (F.col("journey_code") != "null")
                       & (F.col("session_id") != "null"))


def sessions(pages: DataFrame, window: W.Window = SESSION) -> DataFrame:
    """One row per session: bounds, keys, latest cookie and the times of key actions."""
    action, millis, seq = F.col("action"), F.col("millis"), F.col("seq")
    return W.window_agg(valid(pages), "ts", window, SESSION_KEYS, [
        A.count_rows("actions_count"),
        A.latest("cookie_id", F.col("cookie_id"), seq),
        A.earliest("earliest_da", F.when(action.like(ENGAGED), millis), seq),
        A.latest("engaged_at", F.when(action == ENGAGED, millis), seq),
        A.latest("purchase_at", F.when(action == PURCHASE, millis), seq)])


def session_actions(pages: DataFrame, window: W.Window = SESSION,
                    part_size: int = lists.PART_SIZE) -> DataFrame:
    """A session's ordered action list and its maps; long sessions continue in parts.

    The whole list is the concatenation of the parts, the whole map their union in
    which the later part wins.
    """
    keys = ["window_start", *SESSION_KEYS]
    rows = written(W.with_session(valid(pages), "ts", window, SESSION_KEYS), "session-rows")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    at = F.col("millis").cast("string")
    parts = lists.list_parts(rows, keys, F.col("seq"), {
        "actions": E.joined_text(F.col("action"), F.lit("|"), at),
        "_at": at, "_action": F.col("action"), "_millis": F.col("millis"),
        "_held": F.struct("scenario_id", "promo_code", "order_value", "order_currency")},
        part_size, sizes)
    # The maps by time share their keys: one map of structs, then one field each.
    parts = parts.withColumn("_by_time", E.map_of(F.col("_at"), F.col("_held")))

    def by_time(field):
        return F.transform_values("_by_time", lambda _, held: held[field])

    return parts.select(
        *keys, "part", "actions",
        by_time("scenario_id").alias("scenarios"), by_time("promo_code").alias("promo_codes"),
        by_time("order_value").alias("orders_value"),
        by_time("order_currency").alias("orders_currency"),
        E.map_of(F.col("_action"), F.col("_millis")).alias("attribution_actions"))


def exploded_actions(pages: DataFrame, window: W.Window = SESSION) -> DataFrame:
    """One row per action of a session, with the action that follows it in the session's list and
    the last time of an action of its name.

    These are the entries of the session's two maps that belong to the row; the maps
    themselves, repeated beside each action, would be quadratic in a session's length.
    """
    keys = ["window_start", *SESSION_KEYS]
    rows = written(W.with_session(valid(pages), "ts", window, SESSION_KEYS).select(
        *keys, "seq", "millis", F.col("action").alias("name"),
        E.joined_text(F.col("action"), F.lit("|"), F.col("millis")).alias("action")), "session-rows")
    grouped = rows.select(F.struct(*keys).alias("_group"), "action", "name")
    following = lists.transitions(rows, keys, F.col("seq"), F.col("action")).select(
        F.struct(*keys).alias("_group"), F.col("item").alias("action"),
        F.col("next_item").alias("next_action"))
    last = lists.map_entries(rows, keys, F.col("name"), F.col("millis"), F.col("seq")).select(
        F.struct(*keys).alias("_group"), F.col("map_key").alias("name"),
        F.col("map_value").alias("last_at"))
    return (grouped.join(following, ["_group", "action"], "left").join(last, ["_group", "name"], "left")
            .select("_group.*", "action", "next_action", "last_at"))


def health(pages: DataFrame, window: W.Window = HEALTH,
           actions: dict[str, str] = HEALTH_ACTIONS) -> DataFrame:
    """Share of each action per window and journey.

    Exploding the collected lists gives back the events, so the events are read.
    """
    text = E.joined_text(F.col("action"), F.lit("|"), F.col("millis"))
    rows = valid(pages).select("ts", "journey_code", "session_id",
                               F.substring_index(text, "|", 1).alias("name"))
    counted = W.window_agg(rows, "ts", window, ["journey_code"], [
        A.count_values("actions_count", F.col("session_id")),
        *[A.count_when(column, F.col("name") == name) for column, name in actions.items()]])
    return counted.select(*W.BOUNDS, "journey_code", "actions_count", *[
        E.share(F.col(column), F.col("actions_count"), 2).alias(column) for column in actions])


def purchases(pages: DataFrame, window: W.Window = SESSION) -> DataFrame:
    """Sessions with a purchase and what their maps hold at the key times.

    Rows join the sessions on keys and time, so the rows of a long session spread out.
    """
    found = sessions(pages, window).where(F.col("purchase_at").isNotNull())
    times = F.array_distinct(F.array("purchase_at", "engaged_at"))
    wanted = found.select(F.struct(*SESSION_KEYS).alias("_group"), "window_start", "earliest_da",
                          "purchase_at", "engaged_at", F.explode(times).alias("millis"))
    rows = valid(pages).select(
        F.struct(*SESSION_KEYS).alias("_group"), "millis", "seq", "scenario_id", "promo_code",
        "order_value", "order_currency")
    bought = F.when(F.col("millis") == F.col("purchase_at"), F.col("seq"))
    engaged = F.when(F.col("millis") == F.col("engaged_at"), F.col("seq"))
    session = ["window_start", "earliest_da", "purchase_at", "engaged_at"]
    looked_up = rows.join(wanted, ["_group", "millis"]).groupBy("_group", *session).agg(
        F.max_by("order_value", bought).alias("order_value"),
        F.max_by("order_currency", bought).alias("order_currency"),
        F.max_by("promo_code", bought).alias("promo_code"),
        F.max_by("scenario_id", engaged).alias("scenario_id"))
    return looked_up.select("_group.*", *session, "order_value", "order_currency",
                            "promo_code", "scenario_id")


def assistant_attributions(bought: DataFrame) -> DataFrame:
    """Sessions that bought after the first engagement, with order and scenario."""
    return (bought.where(F.col("earliest_da") < F.col("purchase_at"))
            .drop("earliest_da", "promo_code"))


def promocode_attributions(bought: DataFrame) -> DataFrame:
    """Sessions whose purchase carries a promotion code."""
    return (bought.where(F.col("promo_code").isNotNull())
            .select(*SESSION_KEYS, "window_start", "purchase_at"))


def attributions(pages: DataFrame, window: W.Window = SESSION) -> DataFrame:
    """Both kinds in the one topic they share; columns one of them lacks are null."""
    bought = written(purchases(pages, window), "purchases")
    return merged(assistant_attributions(bought), promocode_attributions(bought))


def invoices(found: DataFrame, config_changes: DataFrame) -> DataFrame:
    """Attributions with their journey's percentage; the newest configuration counts."""
    config = latest_per_key(config_changes, ["journey_code"], F.col("seq")).drop("seq")
    return (found.join(config, "journey_code", "left")
            .withColumn("invoice_total", F.col("order_value") * F.col("percentage")))


def reporting(billed: DataFrame, ts: str, window: W.Window = REPORTING) -> DataFrame:
    """Invoice totals per window, journey, location and device."""
    keys = ["journey_code", "location", "device"]
    totals = W.window_agg(billed, ts, window, keys, [
        A.total("invoice_total", F.col("invoice_total")),
        A.total("sales_generated", F.col("order_value")), A.count_rows("conversions")])
    return totals.withColumn("average_order_value",
                             F.col("sales_generated") / F.col("conversions"))


def engagement(pages: DataFrame, window: W.Window = REPORTING) -> DataFrame:
    """Distinct sessions, displays, engagements and their whole ratio per window."""
    keys = ["journey_code", "scenario_id", "location", "device"]
    action = F.col("action")
    counted = pages.groupBy(window.over("ts").alias("_w"), *keys).agg(
        F.count_distinct("session_id").alias("sessions_count"),
        F.count_if(action.isin(*DISPLAYS)).alias("displays_count"),
        F.count_if(action.isin(*ENGAGEMENTS)).alias("engagements_count"))
    result = counted.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys,
        "sessions_count", "displays_count", "engagements_count",
        E.whole_ratio(F.col("displays_count"), F.col("engagements_count"))
        .alias("engagements_through_rate"))
    if window.retention and not pages.isStreaming:
        result = W.retained(result, pages.agg(F.max("ts")).scalar(), window.retention)
    return result
