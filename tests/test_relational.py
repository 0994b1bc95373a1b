"""Golden tests of the relational queries on the hand-checked seed (FIXTURES §1)."""

import datetime as dt

from pyspark.sql import functions as F

from rentwise.operators import relational as R
from tests.helpers import rows, with_rows

D = dt.date.fromisoformat

# booking: customer, vehicle (producer model), start, end, days, base, extras, total
GOLDEN = {
    "b1": ("Alice Example", "Ford", "Fiesta", "2026-01-05", "2026-01-10", 5, 350.0, 70.0, 420.0),
    "b2": ("Bob Sunny", "Volkswagen", "Golf", "2026-02-01", "2026-02-03", 2, 160.0, 15.0, 175.0),
    "b3": ("Clara Fast", "Toyota", "Yaris", "2026-03-10", "2026-03-15", 5, 300.0, 55.0, 355.0),
    "b4": ("Dana Dual", "Skoda", "Enyaq", "2026-04-05", "2026-04-07", 2, 190.0, 50.0, 240.0),
    "b5": ("Alice Example", "Toyota", "Yaris", "2026-05-12", "2026-05-18", 6, 360.0, 35.0, 395.0),
}


def test_r3_report_golden_and_order(seed):
    out = R.booking_cost_report(seed)
    got = rows(out, "booking_id", "customer_name", "producer", "model", "start_date", "end_date", "days",
               "base_cost", "additional_cost", "total_cost")
    assert [r[0] for r in got] == ["b5", "b4", "b3", "b2", "b1"]  # newest start first
    for r in got:
        name, prod, model, s, e, days, base, extras, total = GOLDEN[r[0]]
        assert r[1:] == (name, prod, model, D(s), D(e), days, base, extras, total)


def test_r3_filters_use_end_date_and_empty_means_none(seed):
    got = [r[0] for r in rows(R.booking_cost_report(seed, "2026-02-01", "2026-03-15"), "booking_id")]
    assert got == ["b3", "b2"]
    # b3 ends on 03-15 (kept); a booking ending after 'to' is excluded even if it starts before
    assert [r[0] for r in rows(R.booking_cost_report(seed, "", ""), "booking_id")] == ["b5", "b4", "b3", "b2", "b1"]


def test_r3_edge_days_and_no_extras(spark, seed):
    t = with_rows(spark, seed, "booking", [
        ("b6", "2026-06-01", "2026-06-01", None, "Cash", "p_cust2", "veh2"),   # same day
        ("b7", "2026-07-10", "2026-07-05", None, "Cash", "p_cust2", "veh2"),   # reversed
    ])
    got = {r[0]: r[1:] for r in rows(R.booking_cost_report(t), "booking_id", "days", "base_cost",
                                     "additional_cost", "total_cost")}
    assert got["b6"] == (1, 80.0, 0.0, 80.0)
    assert got["b7"] == (1, 80.0, 0.0, 80.0)


def test_r3_keeps_vehicle_without_retailer_r10_drops_it(spark, seed):
    t = with_rows(spark, seed, "vehicle", [("veh9", "Up", "VW", "40.00", "W-X", 4, None)])
    t = with_rows(spark, t, "booking", [("b9", "2026-08-01", "2026-08-03", None, "Cash", "p_cust1", "veh9")])
    t = with_rows(spark, t, "booking_service", [("b9", "as1")])
    assert "b9" in [r[0] for r in rows(R.booking_cost_report(t), "booking_id")]
    assert "b9" not in [r[0] for r in rows(R.service_booking_report(t), "booking_id")]


def test_r1_r5_need_account(spark, seed):
    t = with_rows(spark, seed, "person", [("p_new", "Aaron New", None, None, None, 3.0)])
    t = with_rows(spark, t, "customer", [("p_new", "C-9", "DL9")])
    r1 = rows(R.customers_with_account(t), "person_id")
    assert [r[0] for r in r1] == ["p_cust1", "p_cust2", "p_cust3", "p_both1"]  # by name, p_new dropped
    r5 = R.customer_profiles(t)
    assert r5.columns == ["person_id", "name", "eMail", "phone_number", "address", "customer_number",
                          "driver_licencse_number", "account_id", "iban", "bic"]
    assert r5.count() == 4


def test_r2_closed_window(seed):
    # b1 runs 01-05..01-10: a window starting on its last day still overlaps
    ids = [r[0] for r in rows(R.available_vehicles(seed, "2026-01-10", "2026-01-12"), "vehicle_id")]
    assert "veh1" not in ids and set(ids) == {"veh2", "veh3", "veh4"}
    ids = [r[0] for r in rows(R.available_vehicles(seed, "2026-01-11", "2026-01-12"), "vehicle_id")]
    assert ids == ["veh1", "veh4", "veh3", "veh2"]  # by producer: Ford, Skoda, Toyota, Volkswagen


def test_r2_plus_booked_is_all_vehicles(seed):
    avail = {r[0] for r in rows(R.available_vehicles(seed, "2026-03-01", "2026-05-31"), "vehicle_id")}
    booked = {r[0] for r in rows(R.booked_vehicle_ids(seed["booking"], "2026-03-01", "2026-05-31"))}
    assert avail | booked == {"veh1", "veh2", "veh3", "veh4"} and not avail & booked


def test_r6_active_bookings(seed):
    out = R.active_bookings(seed, "2026-03-10", "p_cust1")
    assert rows(out, "booking_id", "days", "base_cost", "extras_cost", "total_cost", "total_costs") == [
        ("b5", 6, 360.0, 35.0, 395.0, None)]
    assert [r[0] for r in rows(R.active_bookings(seed, "2026-03-10"), "booking_id")] == ["b3", "b4", "b5"]


def test_r7_options_and_unknown_booking(spark, seed):
    asked = spark.createDataFrame([("b1", ["as1", "as2", "as_missing"]), ("b1", ["as1"]), ("b_unknown", ["as3"]),
                                   ("b2", None)], "booking_id string, service_ids array<string>")
    got = rows(R.service_options(seed, asked), "booking_id", "additional_service_id", "status")
    assert sorted(got) == [("b1", "as1", "current"), ("b1", "as2", "available"), ("b1", "as_missing", "unknown"),
                           ("b_unknown", "as3", "available")]


def test_r7_large_catalogue(spark, seed):
    """The answer is as large as the question, whatever the catalogue's size."""
    many = spark.range(50_000).selectExpr("concat('x', id) as additional_service_id", "'d' as description",
                                          "cast(1 as decimal(10,2)) as costs")
    tables = dict(seed, additional_service=seed["additional_service"].unionByName(many))
    asked = spark.createDataFrame([("b1", ["as1", "x7"])], "booking_id string, service_ids array<string>")
    assert sorted(rows(R.service_options(tables, asked), "additional_service_id", "status")) == [
        ("as1", "current"), ("x7", "available")]


def test_one_request_one_outcome(spark, seed):
    """Equal deliveries of a request collapse; different contents under one id are rejected."""
    from rentwise.operators import jobs as J
    r = ("r1", "p_cust1", "veh1", "2026-07-01", "2026-07-03", "CARD")
    batch = spark.createDataFrame([r, r, ("r2", *r[1:]), ("r2", "p_cust1", "veh2", *r[3:])],
                                  "request_id string, customer_id string, vehicle_id string, start_date string, "
                                  "end_date string, way_of_billing string").selectExpr(
        "request_id", "customer_id", "vehicle_id", "date(start_date) start_date", "date(end_date) end_date", "way_of_billing")
    new, outcome = J.create_bookings(seed, batch)
    assert sorted(rows(outcome, "request_id", "status")) == [("r1", "accepted"), ("r2", J.CONFLICTING)]
    assert rows(new, "booking_id") == [("b_r1",)]


def test_r9_and_r11(spark, seed):
    ids = spark.createDataFrame([("b3",)], "booking_id string")
    assert rows(R.booking_totals(seed, ids), "booking_id", "base_cost", "extras_cost", "total_cost") == [
        ("b3", 300.0, 55.0, 355.0)]
    sel = spark.createDataFrame([("q1", "b3", ["as1", "as2", "as9", "as1"]), ("q2", "b_x", None)],
                                "request_id string, booking_id string, service_ids array<string>")
    got = {r[0]: r[1:] for r in rows(R.quote_services(seed, sel), "request_id", "base_cost", "booked_extras",
                                     "selected_extras", "total_cost")}
    assert got["q1"] == (300.0, 55.0, 20.0, 375.0)  # as2 already booked, as9 unknown, as1 once
    assert got["q2"] == (0.0, 0.0, 0.0, 0.0)


def test_r10_list_count_and_window(seed):
    out = R.service_booking_report(seed, "2026-01-05", "2026-03-10")
    got = rows(out, "booking_id", "additional_services_count", "additional_services_list", "total_cost",
               "customer_iban", "retailer_name")
    assert got == [
        ("b2", 1, "Navigation", 175.0, "AT021100000012345678", "Green Motors"),
        ("b1", 2, "ChildSeat, FullInsurance", 420.0, "AT611904300234573201", "Blue Cars Ltd."),
    ]  # start < to: b3 starting on 03-10 is out


def test_r10_drops_customer_without_account(spark, seed):
    t = dict(seed, bankaccount=seed["bankaccount"].filter(F.col("person_id") != "p_cust2"))
    assert "b2" not in [r[0] for r in rows(R.service_booking_report(t), "booking_id")]
