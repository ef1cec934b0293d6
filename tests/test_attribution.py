from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowtables.plans import attribution as P

START = datetime(2024, 1, 1)
SCHEMA = ("session_id string, journey_code string, location string, device string, "
          "ts timestamp_ntz, millis bigint, seq bigint, action string, scenario_id string, "
          "promo_code string, cookie_id string, order_value double, order_currency string")


def event(seq, session, minute, action, scenario=None, promo=None, cookie=None, value=None,
          journey="j1", location="uk"):
    ts = START + timedelta(minutes=minute)
    millis = 1704067200000 + int(minute * 60_000)
    return (session, journey, location, "web", ts, millis, seq, action, scenario, promo, cookie,
            value, "EUR" if value is not None else None)


EVENTS = [
    event(1, "s1", 0, "displayed_digital_assistant", cookie="c1"),
    event(2, "s1", 1, "engaged_digital_assistant", scenario="sc1"),
    event(3, "s1", 5, "engaged_digital_assistant", scenario="sc2", cookie="c2"),
    event(4, "s1", 25, "purchase", promo="p1", value=100.0),  # twenty minutes later: same session
    event(5, "s1", 60, "purchase", value=7.0),                # a second session, no engagement
    event(6, "s2", 2, "purchase", promo="p2", value=50.0, journey="j2", location=None),
    event(7, "s2", 3, "engaged_digital_assistant", scenario="sc3", journey="j2", location=None),
    event(8, "s3", 4, "null", journey="j1"),
    event(9, "null", 4, "purchase", value=1.0),
    event(10, "s4", 8, "engaged_digital_assistant", scenario="sc4"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(EVENTS, SCHEMA).repartition(3)


def minute(ts):
    return (ts - START).total_seconds() / 60


def test_sessions(pages):
    found = {(r["session_id"], minute(r["window_start"])): r for r in P.sessions(
        pages, P.W.session("20 MINUTES")).collect()}
    assert set(found) == {("s1", 0), ("s1", 60), ("s2", 2), ("s4", 8)}
    first = found["s1", 0]
    assert (first["actions_count"], first["cookie_id"], minute(first["window_end"])) == (4, "c2", 45)
    assert first["earliest_da"] == 1704067260000 and first["engaged_at"] == 1704067500000
    assert found["s1", 60]["engaged_at"] is None


@pytest.mark.parametrize("part_size", [2, 100])
def test_session_actions(pages, part_size):
    found = P.session_actions(pages, P.W.session("20 MINUTES"), part_size)
    parts = sorted((r for r in found.collect() if r["session_id"] == "s1"
                    and minute(r["window_start"]) == 0), key=lambda r: r["part"])
    assert len(parts) == (2 if part_size == 2 else 1)
    assert [a for r in parts for a in r["actions"]] == [
        "displayed_digital_assistant|1704067200000", "engaged_digital_assistant|1704067260000",
        "engaged_digital_assistant|1704067500000", "purchase|1704068700000"]
    actions = {k: v for r in parts for k, v in r["attribution_actions"].items()}
    assert actions["engaged_digital_assistant"] == 1704067500000
    values = {k: v for r in parts for k, v in r["orders_value"].items()}
    assert values["1704068700000"] == 100.0 and values["1704067200000"] is None


def test_exploded_actions(pages):
    found = P.exploded_actions(pages, P.W.session("20 MINUTES")).where("session_id = 's2'")
    rows = found.orderBy(F.desc_nulls_last("next_action")).collect()
    assert [r["action"].split("|")[0] for r in rows] == ["purchase", "engaged_digital_assistant"]
    assert rows[0]["next_action"] == rows[1]["action"] and rows[1]["next_action"] is None
    assert all(r["action"].endswith(f"|{r['last_at']}") for r in rows)


def test_attributions_and_invoices(spark, pages):
    found = P.attributions(pages, P.W.session("20 MINUTES"))
    rows = sorted(((r["session_id"], r["order_value"], r["order_currency"], r["scenario_id"])
                   for r in found.collect()), key=str)
    # s1 twice: engaged before the purchase, and with a promotion code; s2 engaged too late.
    assert rows == sorted([("s1", 100.0, "EUR", "sc2"), ("s1", None, None, None),
                           ("s2", None, None, None)], key=str)
    config = spark.createDataFrame([("j1", 0.5, 1), ("j1", 0.1, 2)],
                                   "journey_code string, percentage double, seq bigint")
    billed = P.invoices(found, config)
    assert sorted(((r["session_id"], r["percentage"], r["invoice_total"])
                   for r in billed.collect()), key=str) == sorted(
        [("s1", 0.1, 10.0), ("s1", 0.1, None), ("s2", None, None)], key=str)
    bought = billed.withColumn("at", F.timestamp_millis("purchase_at").cast("timestamp_ntz"))
    totals = P.reporting(bought, "at", P.W.hopping("20 MINUTES", "10 MINUTES"))
    uk = sorted((minute(r["window_start"]), r["invoice_total"], r["sales_generated"],
                 r["conversions"], r["average_order_value"])
                for r in totals.where("journey_code = 'j1'").collect())
    assert uk == [(10, 10.0, 100.0, 2, 50.0), (20, 10.0, 100.0, 2, 50.0)]


def test_value_at_a_time_is_the_last_event_at_it(spark):
    """Two events at the purchase's millisecond: the later one's order counts, null or not."""
    rows = [event(1, "s", 0, "engaged_digital_assistant", scenario="x"),
            event(2, "s", 1, "purchase", value=5.0), event(3, "s", 1, "view")]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = P.assistant_attributions(P.purchases(pages, P.W.session("20 MINUTES"))).collect()
    assert [(r["order_value"], r["scenario_id"]) for r in found] == [(None, "x")]


def test_health(pages):
    ratios = P.health(pages, P.W.hopping("1 MINUTE", "30 SECONDS"),
                      {"engaged": "engaged_digital_assistant"})
    found = {(minute(r["window_start"]), r["journey_code"]): (r["actions_count"], r["engaged"])
             for r in ratios.collect()}
    assert found[0.5, "j1"] == (1, 1.0) and found[0, "j1"] == (1, 0.0)
    assert (4, "j1") not in found


def test_engagement(pages):
    found = P.engagement(pages.withColumn("scenario_id", F.lit("all")),
                         P.W.hopping("20 MINUTES", "10 MINUTES"))
    rows = {(minute(r["window_start"]), r["journey_code"], r["location"]): r
            for r in found.collect()}
    first = rows[0, "j1", "uk"]
    assert (first["sessions_count"], first["displays_count"], first["engagements_count"]) == (4, 1, 3)
    assert first["engagements_through_rate"] == 0
    assert rows[20, "j1", "uk"]["engagements_through_rate"] is None


def test_retention_keeps_the_newest_windows(pages):
    kept = P.health(pages, P.HEALTH, {"purchase_ratio": "purchase"})
    assert {minute(r["window_start"]) for r in kept.collect()} == {59.5, 60}
