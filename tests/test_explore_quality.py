"""Sources (S1, S2, S5), explorer (S3, S4), export (R12) and audits (Q1-Q4)."""

import pytest

import __spark_entry__ as E
from rentwise import schema
from rentwise.operators import explore as X
from rentwise.operators import quality as Q
from rentwise.functions.rules import euro_text
from rentwise.operators import relational as R
from rentwise.plans.inspect import plan_text
from rentwise.sources import testdata as td
from rentwise.sources.seed import bootstrap_if_empty, seed_status, seed_tables
from rentwise.sources.tables import conform_bookings, load_tables, write_tables
from tests.helpers import rows, with_rows

SF = "/root/testdata/sf0.001"


def test_s1_write_and_load_typed(spark, seed, scratch):
    write_tables(seed, scratch + "/rel")
    back = load_tables(spark, scratch + "/rel")
    for name, df in back.items():
        extra = ["start_year"] if name == "booking" else []  # partition column of stored bookings
        assert df.schema.fieldNames() == schema.SCHEMAS[name].fieldNames() + extra, name
    assert back["booking"].count() == 5
    assert back["booking"].schema["start_date"].dataType.typeName() == "date"


def test_s2_bootstrap_only_into_empty(spark, scratch):
    target = scratch + "/boot"
    assert seed_status(spark, target) is False
    assert bootstrap_if_empty(spark, seed_tables(spark, with_bookings=False), target) is True
    assert seed_status(spark, target) is True
    assert bootstrap_if_empty(spark, seed_tables(spark, with_bookings=False), target) is False
    t = load_tables(spark, target)
    assert t["person"].count() == 6 and t["booking"].count() == 0 and t["additional_service"].count() == 5


def test_s5_conform_adds_total_costs(spark):
    old = spark.createDataFrame([("b1", "2026-01-01", "2026-01-02", "Cash", "c", "v")],
                                "booking_id string, start_date string, end_date string, way_of_billing string, "
                                "customer_id string, vehicle_id string")
    out = conform_bookings(old)
    assert out.schema.fieldNames() == schema.BOOKING.fieldNames()
    assert out.first()["total_costs"] is None
    assert conform_bookings(out).schema == out.schema


def test_s3_preview_clamp_and_allow_list(seed):
    assert X.clamp_limit(None) == 50 and X.clamp_limit("abc") == 50
    assert X.clamp_limit("0") == 1 and X.clamp_limit(10_000) == 500 and X.clamp_limit("7") == 7
    assert X.preview_table(seed, "Bookings_Services", 3).count() == 3
    assert X.preview_table(seed, "Vehicle").count() == 4
    empty = X.preview_table(dict(seed, rating=seed["rating"].limit(0)), "Rating")
    assert empty.columns == ["rater_id", "rated_id", "stars"] and empty.count() == 0
    with pytest.raises(ValueError):
        X.preview_table(seed, "mysql.user")


def test_s4_search_any_column(seed):
    assert [r[0] for r in rows(X.search_rows(seed["person"], "  GREEN "), "id")] == ["p_ret2"]
    assert X.search_rows(seed["vehicle"], "70.0").count() == 1  # decimal as text
    assert X.search_rows(seed["vehicle"], "").count() == 4
    assert rows(X.search_counts(seed["person"], "example")) == [(4, 6)]
    assert rows(X.search_counts(seed["person"], None)) == [(6, 6)]


def test_r12_export_text(spark, seed, scratch):
    rep = X.service_report_export(R.service_booking_report(seed))
    b1 = rep.filter("Booking = 'b1'").first()
    assert b1["Customer"] == "Alice Example (p_cust1)"
    assert b1["Vehicle"] == "Ford Fiesta (veh1)"
    assert b1["Bank account"] == "AT611904300234573201 / BKAUATWW"
    assert b1["Period"] == "2026-01-05 → 2026-01-10"
    assert b1["Additional services"] == "ChildSeat, FullInsurance (2)"
    assert b1["Total"] == "€\u00a0420,00"
    big = spark.createDataFrame([(1234.5,), (-3.0,), (None,)], "x double").select(euro_text("x").alias("t"))
    assert [r[0] for r in big.collect()] == ["€\u00a01.234,50", "-€\u00a03,00", "€\u00a00,00"]
    X.export_csv(rep, scratch + "/r12")
    assert spark.read.option("header", True).csv(scratch + "/r12").count() == 5


def test_q1_keys(spark, seed):
    assert Q.audit_keys(seed).count() == 0
    t = with_rows(spark, seed, "vehicle", [("veh1", "Dup", "X", "1.00", "W-AB123C", 2, None)])
    t = with_rows(spark, t, "customer", [("p_ret1", "C-1001", None), ("p_ret2", None, None)])
    t = with_rows(spark, t, "booking_service", [(None, "as1"), (None, "as2"), ("b1", None)])
    got = sorted(rows(Q.audit_keys(t), "table_name", "rule", "columns", "key_value", "n_rows"))
    assert got == [
        ("booking_service", "null primary key", "booking_id,additional_service_id", None, 3),
        ("customer", "duplicate unique value", "customer_number", "C-1001", 2),
        ("vehicle", "duplicate primary key", "vehicle_id", "veh1", 2),
        ("vehicle", "duplicate unique value", "plate_number", "W-AB123C", 2),
    ]


def test_q2_references(spark, seed):
    assert Q.audit_references(seed).count() == 0
    t = with_rows(spark, seed, "booking", [("b9", "2026-01-01", "2026-01-02", None, "x", "p_ghost", None)])
    t = with_rows(spark, t, "booking_service", [("b9", "as7")])
    got = sorted(rows(Q.audit_references(t), "table_name", "columns", "key_value", "n_rows"))
    assert got == [("booking", "customer_id", "p_ghost", 1), ("booking_service", "additional_service_id", "as7", 1)]


def test_q3_values(spark, seed):
    t = with_rows(spark, seed, "person", [("p_bad", "Bad", None, None, None, 7.5)])
    t = with_rows(spark, t, "bankaccount", [("ba9", "X", "Y", None)])
    got = sorted(rows(Q.audit_values(t), "table_name", "rule", "key_value"))
    assert got == [("bankaccount", "not null", "ba9"), ("person", "stars between 0 and 5", "p_bad")]


def test_q4_cascade_then_no_orphans(spark, seed):
    gone = spark.createDataFrame([("p_ret1",), ("p_cust2",)], "id string")
    left = Q.cascade_delete(seed, gone)
    assert sorted(r[0] for r in rows(left["vehicle"], "vehicle_id")) == ["veh2", "veh3"]
    # b1 (veh1), b4 (veh4) go with the retailer, b2 with the customer
    assert sorted(r[0] for r in rows(left["booking"], "booking_id")) == ["b3", "b5"]
    assert sorted(rows(left["booking_service"])) == [("b3", "as2"), ("b3", "as5"), ("b5", "as1"), ("b5", "as3")]
    assert left["rating"].count() == 2 and left["bankaccount"].count() == 4
    assert Q.audit_references(left).count() == 0
    counts = dict(rows(Q.table_counts(left)))
    assert counts["person"] == 4 and counts["additional_service"] == 5


def test_s1_views_answer_sql(spark, seed, scratch):
    from rentwise.sources.tables import register_views
    write_tables(seed, scratch + "/rel")
    register_views(load_tables(spark, scratch + "/rel"))
    got = spark.sql("select count(*) from rental_booking b join rental_booking_service s using (booking_id) "
                    "where b.start_date >= date'2026-03-01'").first()[0]
    assert got == 5  # b3 (2), b4 (1), b5 (2)


def test_r12_export_of_the_document_report(seed):
    from rentwise.operators import doc_queries as N
    from rentwise.operators import documents as M
    rep = X.service_report_export(N.doc_service_booking_report(M.migrate_docs(seed)))
    b5 = rep.filter("Booking = 'b5'").first()
    assert b5["Retailer"] == "Dual Mobility (p_both1)" and b5["Days"] == "6"
    assert b5["Additional services"] == "ChildSeat, Navigation (2)" and b5["Total"] == "€\u00a0395,00"


def test_s3_found_rows_need_no_pass_of_all_ids_through_one_task(spark, seed):
    facts = E._preview_facts(seed)
    assert rows(facts) == [(5, 5, 7)]
    twice = dict(seed, booking=seed["booking"].unionByName(seed["booking"]))
    assert rows(E._preview_facts(twice)) == [(10, 10, 7)]
    # the preview's rows narrow the ids before these are made distinct
    plan = plan_text(facts, "simple")
    assert "LeftSemi" in plan and "GlobalLimit" not in plan


def test_q1_reads_the_rows_that_the_other_audits_lack(spark):
    tables = td.rental_tables(spark, SF)
    added = td.added_tables(spark, SF, tables)
    assert all(added[n].count() >= tables[n].count() for n in tables)
    found = {r.key_value for r in E.queries()["Q1_audit_keys"](spark, SF).collect()}
    asked = {"b_" + r.request_id[4:] for r in td.booking_requests(spark, SF).collect()}
    stored = {r.booking_id for r in tables["booking"].where("booking_id LIKE '%33'").collect()}
    assert stored & asked and stored & asked <= found
    sql = E.oracle_sql()["Q1_audit_keys"]
    assert "not like" not in sql and "not like '%33'" in E.oracle_sql()["Q1_maintained_findings"]
