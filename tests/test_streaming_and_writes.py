"""Write jobs, partition pruning of stored bookings, streaming intake."""

import datetime as dt
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from rentwise.operators import documents as M
from rentwise.operators import jobs as J
from rentwise.operators import relational as R
from rentwise.plans.inspect import plan_text
from rentwise.sources import versions
from rentwise.sources.tables import compact_tables, load_tables, table_specs, write_tables
from rentwise.streaming.requests import read_outcomes, start_intake
from tests.helpers import rows

D = dt.date.fromisoformat


def _store(spark, seed, path):
    write_tables(seed, path)
    return load_tables(spark, path)


def test_stored_bookings_prune_by_start_year(spark, seed, scratch):
    t = _store(spark, seed, scratch + "/rel")
    plan = plan_text(R.booking_cost_report(t, "2026-03-01", None), "formatted")
    assert "PartitionFilters: [isnotnull(start_year" in plan and "(start_year" in plan and ">= 2026)" in plan
    assert [r[0] for r in rows(R.booking_cost_report(t, "2026-03-01"), "booking_id")] == ["b5", "b4", "b3"]


def test_run_create_bookings_is_idempotent(spark, seed, scratch):
    path = scratch + "/rel"
    t = _store(spark, seed, path)
    req = spark.createDataFrame([("r1", "p_cust1", "veh1", D("2026-09-01"), D("2026-09-04"), "Card"),
                                 ("r2", "p_cust1", "veh_x", D("2026-09-01"), D("2026-09-04"), "Card")],
                                "request_id string, customer_id string, vehicle_id string, start_date date, "
                                "end_date date, way_of_billing string")
    out = J.run_create_bookings(spark, t, req, path)
    assert sorted(rows(out, "request_id", "status")) == [("r1", "accepted"), ("r2", "invalid vehicle")]
    assert load_tables(spark, path)["booking"].count() == 6
    J.run_create_bookings(spark, load_tables(spark, path), req, path)
    assert load_tables(spark, path)["booking"].count() == 6


SERVICE_REQUEST = ("request_id string, booking_id string, customer_id string, service_ids array<string>, "
                   "confirm_payment boolean")


def _files(path):
    return {str(p): p.stat().st_size for p in pathlib.Path(path).rglob("*.parquet")}


def _with_old_booking(seed):
    older = seed["booking"].filter("booking_id = 'b1'").withColumns(
        {"booking_id": F.lit("b_old"), "start_date": F.lit("2020-02-01").cast("date")})
    return dict(seed, booking=seed["booking"].unionByName(older))


def test_run_add_services_writes_its_rows_and_compaction_touched_years_only(spark, seed, scratch):
    path = scratch + "/rel"
    _store(spark, _with_old_booking(seed), path)
    before = _files(path)
    req = spark.createDataFrame([("s1", "b4", "p_both1", ["as5"], True)], SERVICE_REQUEST)
    for _ in range(2):  # the second run changes nothing
        out = J.run_add_services(spark, req, "2026-04-01", path)
        assert rows(out, "status", "total_cost") == [("accepted", 265.0)]
        t = load_tables(spark, path, ["booking", "booking_service"])
        assert t["booking_service"].count() == 9 and t["booking"].count() == 6
        assert float(t["booking"].filter("booking_id = 'b4'").first()["total_costs"]) == 265.0
    after = _files(path)
    assert before.items() <= after.items()  # no stored file is touched
    assert sum(spark.read.parquet(p).count() for p in after if "/changed/booking/" in p) == 2  # one row a run
    want = [sorted(map(str, load_tables(spark, path)[n].collect())) for n in ("booking", "booking_service")]
    reader = load_tables(spark, path)
    assert compact_tables(spark, path) == ["booking", "booking_service"]
    merged = _files(path + "/merged")
    assert {re.search("start_year=([0-9]+)", p)[1] for p in merged if "/booking/" in p} == {"2026"}
    got = load_tables(spark, path)
    assert [sorted(map(str, got[n].collect())) for n in ("booking", "booking_service")] == want
    assert [sorted(map(str, reader[n].collect())) for n in ("booking", "booking_service")] == want  # opened before
    assert "/changes/" not in plan_text(got["booking"]) and compact_tables(spark, path) == []
    # the row of a year that was not merged is changed after the compaction
    J.run_add_services(spark, req.withColumn("booking_id", F.lit("b_old")).withColumn("customer_id", F.lit("p_cust1")),
                       "2019-01-01", path)
    years = load_tables(spark, path)["booking"].groupBy("start_year").count().collect()
    assert sorted(map(tuple, years)) == [(2020, 1), (2026, 5)]
    compact_tables(spark, path)
    assert sorted(map(tuple, load_tables(spark, path)["booking"].groupBy("start_year").count().collect())) == [(2020, 1), (2026, 5)]


def test_a_commit_that_dies_halfway_leaves_neither_links_nor_totals(spark, seed, scratch, monkeypatch):
    path = scratch + "/rel"
    _store(spark, seed, path)
    state = lambda: [sorted(map(str, load_tables(spark, path)[n].collect())) for n in ("booking", "booking_service")]
    before = state()
    req = spark.createDataFrame([("s1", "b4", "p_both1", ["as5"], True)], SERVICE_REQUEST)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", dies)
        with pytest.raises(RuntimeError):
            J.run_add_services(spark, req, "2026-04-01", path)
    assert state() == before and any("/changes/" in p for p in _files(path))
    J.run_add_services(spark, req, "2026-04-01", path, batch="x-1")
    after, files = state(), _files(path)
    J.run_add_services(spark, req, "2026-04-01", path, batch="x-1")  # the same batch again writes nothing
    assert state() == after != before and _files(path) == files


def test_deleted_and_changed_keys(spark, seed, scratch):
    path, specs = scratch + "/rel", table_specs()
    t = _store(spark, _with_old_booking(seed), path)
    ids = lambda name, key: sorted(r[0] for r in rows(load_tables(spark, path)[name], key))
    gone = spark.createDataFrame([("b_old",), ("b1",)], "booking_id string")
    links = t["booking_service"].join(gone, "booking_id", "left_semi")
    person = t["person"].filter("id = 'p_cust1'").withColumn("name", F.lit("New"))
    versions.commit(spark, path, specs, {"person": person}, {"booking": gone, "booking_service": links})
    for _ in range(2):  # merged on read, then compacted
        assert ids("booking", "booking_id") == ["b2", "b3", "b4", "b5"] and ids("booking_service", "booking_id") == [
            r[0] for r in sorted(rows(seed["booking_service"].filter("booking_id != 'b1'"), "booking_id"))]
        assert rows(load_tables(spark, path)["person"].filter("id = 'p_cust1'"), "name") == [("New",)]
        assert load_tables(spark, path)["person"].count() == 6
        compact_tables(spark, path)
    back = t["booking"].filter("booking_id = 'b1'")
    versions.commit(spark, path, specs, {"booking": back}, {"booking": gone})  # of both, the row counts
    assert ids("booking", "booking_id") == ["b1", "b2", "b3", "b4", "b5"]
    assert [f for f in versions.unused_folders(spark, path, 1) if "/versions/" in f and f.endswith("/person")]


def test_overlap_search_is_bounded_below_and_finds_long_rentals(spark, seed, scratch):
    path = scratch + "/rel"
    long = seed["booking"].filter("booking_id = 'b1'").withColumns(
        {"booking_id": F.lit("b_long"), "start_date": F.lit("2019-02-01").cast("date"), "vehicle_id": F.lit("veh3"),
         "end_date": F.lit("2026-11-02").cast("date")})
    t = _store(spark, _with_old_booking(seed), path)
    plan = plan_text(R.available_vehicles(t, "2026-11-01", "2026-11-05"))
    scan = [b for b in plan.split("\n\n") if "PartitionFilters" in b and "start_year" in b]
    assert not scan or "2026" in scan[0]
    free = lambda t: sorted(r[0] for r in rows(R.available_vehicles(t, "2026-11-01", "2026-11-05"), "vehicle_id"))
    assert "veh3" in free(t)
    versions.commit(spark, path, table_specs(), {"booking": long})
    for _ in range(2):
        t = load_tables(spark, path)
        assert "veh3" not in free(t) and free(t) == free(dict(t))  # without the state's bounds: the same
        compact_tables(spark, path)
    plan = plan_text(R.available_vehicles(load_tables(spark, path), "2026-02-01", "2026-03-05"))
    filters = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters") and "start_year" in ln]
    assert filters and all("<= 2026" in ln and ">= 20" in ln for ln in filters), filters


def test_streaming_doc_service_intake(spark, seed, scratch):
    from rentwise.operators.documents import load_docs, migrate_all
    docs_dir = scratch + "/docs"
    migrate_all(seed, docs_dir)
    spark.createDataFrame([("s1", "b5", "p_cust1", ["as2"], True), ("s2", "b5", "p_cust1", ["as9"], True)],
                          SERVICE_REQUEST).write.parquet(scratch + "/inbox/f1")
    q = start_intake(spark, "doc_service", scratch + "/inbox/*", docs_dir, scratch + "/out", scratch + "/ckpt",
                     as_of="2026-04-01", available_now=True)
    q.awaitTermination(120)
    got = sorted(rows(read_outcomes(spark, scratch + "/out"), "request_id", "status", "total_cost"))
    assert got == [("s1", "accepted", 425.0), ("s2", "invalid service selection", None)]
    stored = load_docs(spark, docs_dir)["bookings"]
    b5 = stored.filter("_id = 'b5'").first()
    assert "as2" in [s["service_id"] for s in b5["additionalServices"]] and b5["pricing"]["total_costs"] == "425.00"
    replay = J.run_doc_add_services(spark, spark.read.parquet(scratch + "/inbox/f1"), "2026-04-01", docs_dir)
    assert rows(replay.filter("request_id = 's1'"), "total_cost") == [(425.0,)]
    again = load_docs(spark, docs_dir)["bookings"]
    assert again.filter("_id = 'b5'").first() == b5 and again.count() == M.booking_docs(seed).count()


def test_active_from_today_by_default(spark, seed):
    far = seed["booking"].withColumns({"start_date": F.date_add(F.current_date(), 30),
                                       "end_date": F.date_add(F.current_date(), 31)})
    t = dict(seed, booking=far)
    assert R.active_bookings(t).count() == R.active_bookings(t, "1970-01-01").count() > 0
    past = dict(seed, booking=far.withColumn("start_date", F.lit("2001-01-01").cast("date")))
    assert R.active_bookings(past).count() == 0


def test_streaming_booking_intake(spark, seed, scratch):
    path = scratch + "/rel"
    _store(spark, seed, path)
    inbox = scratch + "/inbox"
    schema = ("request_id string, customer_id string, vehicle_id string, start_date date, end_date date, "
              "way_of_billing string")
    spark.createDataFrame([("r1", "p_cust2", "veh2", D("2026-10-01"), D("2026-10-03"), "Card")], schema) \
        .write.parquet(inbox + "/f1")
    spark.createDataFrame([("r2", None, "veh2", D("2026-10-01"), D("2026-10-03"), "Card")], schema) \
        .write.parquet(inbox + "/f2")
    q = start_intake(spark, "booking", inbox + "/*", path, scratch + "/out", scratch + "/ckpt", available_now=True)
    q.awaitTermination(120)
    got = sorted(rows(read_outcomes(spark, scratch + "/out"), "request_id", "status", "total_costs"))
    assert got == [("r1", "accepted", 160.0), ("r2", "missing customer", None)]
    assert load_tables(spark, path)["booking"].filter("booking_id = 'b_r1'").count() == 1


def test_streaming_service_intake(spark, seed, scratch):
    path = scratch + "/rel"
    _store(spark, seed, path)
    inbox = scratch + "/inbox"
    spark.createDataFrame([("s1", "b5", "p_cust1", ["as2"], True), ("s2", "b5", "p_cust1", ["as9"], True)],
                          "request_id string, booking_id string, customer_id string, service_ids array<string>, "
                          "confirm_payment boolean").write.parquet(inbox + "/f1")
    q = start_intake(spark, "service", inbox + "/*", path, scratch + "/out", scratch + "/ckpt",
                     as_of="2026-04-01", available_now=True)
    q.awaitTermination(120)
    got = sorted(rows(read_outcomes(spark, scratch + "/out"), "request_id", "status", "total_cost"))
    assert got == [("s1", "accepted", 425.0), ("s2", "invalid service selection", None)]
    t = load_tables(spark, path)
    links = t["booking_service"]
    assert links.count() == 9 and links.filter("booking_id = 'b5' and additional_service_id = 'as2'").count() == 1
    stored = {r[0]: r[1] for r in rows(t["booking"], "booking_id", "total_costs")}
    assert float(stored["b5"]) == 425.0 and stored["b1"] is None and len(stored) == 5


def test_streaming_doc_booking_intake(spark, seed, scratch):
    from rentwise.operators.documents import load_docs, migrate_all
    docs_dir = scratch + "/docs"
    migrate_all(seed, docs_dir)
    inbox = scratch + "/inbox"
    schema = ("request_id string, customer_id string, vehicle_id string, start_date date, end_date date, "
              "way_of_billing string")
    spark.createDataFrame([("r1", None, "veh2", D("2026-10-01"), D("2026-10-03"), "Card"),
                           ("r2", "p_cust2", "veh_x", D("2026-10-01"), D("2026-10-03"), "Card")], schema) \
        .write.parquet(inbox + "/f1")
    q = start_intake(spark, "doc_booking", inbox + "/*", docs_dir, scratch + "/out", scratch + "/ckpt",
                     available_now=True)
    q.awaitTermination(120)
    got = sorted(rows(read_outcomes(spark, scratch + "/out"), "request_id", "status", "customer_id"))
    assert got == [("r1", "accepted", "p_cust1"), ("r2", "invalid vehicle", None)]
    new = load_docs(spark, docs_dir)["bookings"].filter("_id = 'b_r1'").first()
    assert new["customer"]["name"] == "Alice Example" and new["additionalServices"] == []


def test_replayed_micro_batches_change_nothing(spark, seed, scratch):
    """At-least-once delivery: a batch handled twice leaves the same tables and outcome."""
    from rentwise.streaming.requests import handle_booking_batch, handle_service_batch
    path, out = scratch + "/rel", scratch + "/out"
    _store(spark, seed, path)
    bookings = spark.createDataFrame(
        [("r1", "p_cust2", "veh2", D("2026-10-01"), D("2026-10-03"), "Card")],
        "request_id string, customer_id string, vehicle_id string, start_date date, end_date date, "
        "way_of_billing string")
    services = spark.createDataFrame(
        [("s1", "b5", "p_cust1", ["as2", "as4"], True)],
        "request_id string, booking_id string, customer_id string, service_ids array<string>, "
        "confirm_payment boolean")
    for _ in range(2):  # the second call is the replay of the same batch id
        handle_booking_batch(spark, path, out + "/b")(bookings, 7)
        handle_service_batch(spark, path, out + "/s", "2026-04-01")(services, 7)
    t = load_tables(spark, path)
    assert t["booking"].filter("booking_id = 'b_r1'").count() == 1 and t["booking"].count() == 6
    assert t["booking_service"].count() == 10  # 8 + as2 + as4 on b5, once
    assert float(t["booking"].filter("booking_id = 'b5'").first()["total_costs"]) == 475.0
    assert read_outcomes(spark, out + "/b").count() == 1 and read_outcomes(spark, out + "/s").count() == 1


def test_streaming_intake_compacts_and_survives_a_new_checkpoint(spark, seed, scratch):
    path, inbox = scratch + "/rel", scratch + "/inbox"
    _store(spark, seed, path)
    for k, (booking, service) in enumerate((("b5", "as2"), ("b4", "as5"))):
        customer = {"b5": "p_cust1", "b4": "p_both1"}[booking]
        spark.createDataFrame([(f"s{k}", booking, customer, [service], True)], SERVICE_REQUEST).coalesce(1).write.parquet(f"{inbox}/f{k}")

    def run(checkpoint):
        start_intake(spark, "service", inbox + "/*", path, scratch + "/out", checkpoint, as_of="2026-04-01", available_now=True,
                     compact_every=1, max_files_per_trigger=1).awaitTermination(120)
        t = load_tables(spark, path)
        return sorted(map(str, t["booking_service"].collect())), sorted(map(str, t["booking"].drop("start_year").collect())), t.pieces

    links, bookings, pieces = run(scratch + "/ckpt")
    assert len(links) == 10 and {p.kind for p in pieces} == {"base"}
    batches = [r.batch for r in versions.commits(spark, path).where("batch IS NOT NULL").collect()]
    assert len(batches) == 2 and len({b.rpartition("-")[0] for b in batches}) == 1  # one query, two batches
    again = run(scratch + "/other")  # the same files under a new checkpoint: other batch ids, the same rows
    assert again[0] == links and again[1] == bookings
