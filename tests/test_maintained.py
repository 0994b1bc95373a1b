"""Maintained audits, deletion as a job, forks, and the text of numbers in searches."""

import os
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rentwise import schema
from rentwise.functions.rules import number_text
from rentwise.operators import explore as X
from rentwise.operators import key_counts as K
from rentwise.operators import quality as Q
from rentwise.plans.inspect import plan_text
from rentwise.sources import testdata as td
from rentwise.sources import versions
from rentwise.sources.tables import compact_tables, load_tables, table_specs, write_tables
from tests.helpers import rows
from tests.test_plans import settings

SF = "/root/testdata/sf0.01"


def full_audit(tables):
    """Findings of the three audits over whole tables; rows of one breaking key are one finding."""
    found = Q.audit_keys(tables).unionByName(Q.audit_references(tables)).unionByName(Q.audit_values(tables))
    return sorted(map(str, found.groupBy(*[c for c in found.columns if c != "n_rows"]).agg(F.sum("n_rows").alias("n_rows"))
                      .select("table_name", "rule", "columns", "key_value", "n_rows").collect()))


def test_counts_equal_the_full_audit_after_random_batches(spark, seed, scratch):
    rng, root = random.Random(11), scratch + "/counts"
    now = {name: [tuple(r) for r in df.collect()] for name, df in seed.items()}
    frames = lambda data: {n: spark.createDataFrame(r, schema.SCHEMAS[n], verifySchema=False) for n, r in data.items()}
    nullable = {n: [f.name not in schema.PRIMARY_KEYS[n] or n == "booking_service" for f in s.fields] for n, s in schema.SCHEMAS.items()}
    K.build_counts(spark, root, seed)
    for batch in range(10):
        gone, come = {}, {}
        for name in rng.sample(sorted(now), 3):
            gone[name] = rng.sample(now[name], min(len(now[name]), rng.randrange(3)))
            come[name] = []
            for _ in range(rng.randrange(3)):
                row = list(rng.choice(now[name] or [tuple([None] * len(nullable[name]))]))
                at = rng.randrange(len(row))
                other = rng.choice(now[name])[at] if now[name] else row[at]
                kind = schema.SCHEMAS[name].fields[at].dataType.typeName()
                row[at] = 9.5 if kind == "double" else rng.choice([other, f"x{batch}"] if kind == "string" else [other])
                come[name].append(tuple(row))
            left = list(now[name])
            for row in gone[name]:
                left.remove(row)
            now[name] = left + come[name]
        loose = lambda data: {n: v for n, v in data.items() if v}
        of_batch = K.count_batch(spark, root, frames(loose(come)), frames(loose(gone)), f"b{batch}") if loose(come) or loose(gone) else None
        if batch in (4, 7):
            K.compact_counts(spark, root)
        whole = full_audit(frames(now))
        if of_batch is not None:
            assert {str(r) for r in of_batch.collect()} <= set(whole)
            if batch in (3, 8):  # delivered twice
                again = K.count_batch(spark, root, frames(loose(come)), frames(loose(gone)), f"b{batch}")
                assert {str(r) for r in again.collect()} <= set(whole)
    assert sorted(map(str, K.findings(K.load_counts(spark, root)).collect())) == whole and whole


def test_a_batch_reads_and_writes_its_buckets_only(spark, seed, scratch):
    root = scratch + "/counts"
    K.build_counts(spark, root, seed)
    one = {"person": seed["person"].limit(1)}
    delta = K.contributions(K.signed(one)).withColumn("bucket", K.count_specs()[K.COUNTS].part_of)
    buckets = {r.bucket for r in delta.collect()}
    stored = {int(re.search(r"bucket=(\d+)", p)[1]) for p in K._stored(spark, root, delta).inputFiles() if "bucket=" in p}
    assert len(stored) > len(buckets)  # the folders at hand ...
    plan = plan_text(K._stored(spark, root, delta))
    assert re.search(r"PartitionFilters: \[.*bucket", plan)  # ... of which the scan prunes all but the batch's
    found = K.count_batch(spark, root, one, None, "twice")
    assert {(r.table_name, r.n_rows) for r in found.collect()} == {("person", 2)}
    before = {str(p) for p in pathlib.Path(root).rglob("*.parquet")}
    K.compact_counts(spark, root)
    merged = {str(p) for p in pathlib.Path(root).rglob("*.parquet")} - before
    assert {int(re.search(r"bucket=(\d+)", p)[1]) for p in merged if "bucket=" in p} == buckets


def test_q4_job_deletes_in_one_commit(spark, seed, scratch, monkeypatch):
    path = scratch + "/rel"
    write_tables(seed, path)
    gone = spark.createDataFrame([("p_ret1",), ("p_cust2",), (None,)], "id string")
    keys = lambda tables: sorted(map(tuple, Q.remaining_keys(tables).collect()))
    everything, want = keys(seed), keys(Q.cascade_delete(seed, gone))
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            Q.run_cascade_delete(spark, gone, path)
    assert keys(load_tables(spark, path)) == everything
    files = {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    Q.run_cascade_delete(spark, gone, path, "gone-1")
    assert keys(load_tables(spark, path)) == want != everything
    assert Q.audit_references(load_tables(spark, path)).count() == 0
    compact_tables(spark, path)
    assert keys(load_tables(spark, path)) == want
    assert all(pathlib.Path(p).stat().st_mtime_ns == t for p, t in files.items())  # no stored file was touched


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_q4_splits_hot_raters_and_customers(spark, scratch):
    t = td.rental_tables(spark, SF)
    third = lambda key, hot: F.when(F.abs(F.xxhash64(*t["rating"].columns[:2])) % 3 == 0, F.lit(hot)).otherwise(F.col(key))
    t["rating"].withColumn("rater_id", third("rater_id", "c_6")).repartition(8).write.parquet(scratch + "/rating")
    hot = F.when(F.abs(F.hash("booking_id")) % 3 == 0, F.lit("c_6")).otherwise(F.col("customer_id"))
    t["booking"].withColumn("customer_id", hot).repartition(8).write.parquet(scratch + "/booking")
    t = dict(t, **{n: spark.read.parquet(f"{scratch}/{n}") for n in ("rating", "booking")})
    gone = t["person"].filter("stars = 0").select("id")
    plans = []
    staged = Q.staged
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                          "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
                          "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
                          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
                          "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "32"}):
        people = staged(gone, "people")
        for name, col in (("rating", "rater_id"), ("booking", "customer_id")):
            left = t[name].join(people.select(F.col("id").alias(col)), col, "left_semi").select(*schema.PRIMARY_KEYS[name])
            left.collect()
            plans.append(left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        left = Q.cascade_delete(t, gone)
    assert all("skew=true" in p for p in plans)
    assert left["rating"].filter("rater_id = 'c_6'").count() == 0 and left["booking"].filter("customer_id = 'c_6'").count() == 0


def test_forks_share_files_and_diverge(spark, seed, scratch):
    write_tables(seed, scratch + "/a")
    versions.fork(spark, scratch + "/a", scratch + "/b")
    assert not [p for p in pathlib.Path(scratch + "/b").rglob("*.parquet") if "commits" not in str(p)]
    gone = seed["booking"].filter("booking_id = 'b1'")
    versions.commit(spark, scratch + "/b", table_specs(), deleted={"booking": gone})
    assert load_tables(spark, scratch + "/a")["booking"].count() == 5 and load_tables(spark, scratch + "/b")["booking"].count() == 4


def test_s4_numbers_are_searched_as_their_shortest_text(spark, seed, scratch):
    people = seed["person"].withColumn("stars", F.when(F.col("id") == "p_cust1", 4.0).otherwise(F.col("stars") * 0 + 2.5)) \
        .select("id", "stars")
    assert X.search_rows(people, "4.0").count() == 0
    assert [r.id for r in X.search_rows(people.filter("id in ('p_cust1', 'p_ret2')"), "4").collect()] == ["p_cust1"]
    assert X.search_rows(people, "2.5").count() == 5
    given = [4.0, -4.0, -0.0, 1e7, 0.1, 1e20, 1e21, 1.5e21, 1e-6, 1.5e-7, 0.000123, 1234567.891, 123456789012345680000.0, float("nan"), None]
    want = ["4", "-4", "0", "10000000", "0.1", "1" + "0" * 20, "1e+21", "1.5e+21", "0.000001", "1.5e-7", "0.000123", "1234567.891",
            "123456789012345680000", "NaN", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in given], "x double").select(number_text("x")).collect()] == want
    write_tables(seed, scratch + "/rel")
    found = X.search_rows(load_tables(spark, scratch + "/rel")["booking"], "2026-01-05")
    assert "start_year" not in found.columns and X.search_rows(load_tables(spark, scratch + "/rel")["booking"], "").columns == found.columns
    assert rows(found, "booking_id")


def test_s4_index_reads_fewer_files_and_finds_the_same(spark, scratch):
    from rentwise.operators import search_index as I
    names = ["Ford Fiesta", "VW Golf", "Škoda Octavia", "fiat 500", None, "", "Opel", "BMW i3", "Seat León", "Kia Rio"]
    cars = [(f"v{k}", names[k // 5], f"P{k % 7}", None, f"W-{k:03d}", k % 4, None) for k in range(50)]
    frame = spark.createDataFrame([tuple(c[:3] + (None,) + c[4:]) for c in cars], schema.VEHICLE)
    folder, index = scratch + "/vehicle", scratch + "/index"
    frame.orderBy("plate_number").repartitionByRange(10, "plate_number").write.parquet(folder)
    I.build_search_index(spark, folder, schema.VEHICLE, index)
    full = I.read_folder(spark, folder, schema.VEHICLE)
    n_files, read = len(full.inputFiles()), []
    for query in ("fiesta", "  FIAT 5", "ško", "w-0", "W-012", "león", "xyz", "3", "", None, "p3", "12 p", "golf x"):
        files = I.candidate_files(spark, folder, schema.VEHICLE, index, query)
        got = sorted(map(str, I.search_indexed(spark, folder, schema.VEHICLE, index, query).collect()))
        assert got == sorted(map(str, X.search_rows(full, query).collect())), query
        read.append(len(files))
    assert read[0] <= 2 and read[6] == 0 and read[7] == read[8] == n_files  # short queries read everything
    frame.limit(1).withColumn("model", F.lit("Fiesta ST")).write.mode("append").parquet(folder)  # not indexed yet: read
    assert len(I.search_indexed(spark, folder, schema.VEHICLE, index, "fiesta st").collect()) == 1


def test_collations_order_names_and_lists(spark, seed):
    from rentwise.functions.rules import DOCUMENT_ORDER, TABLE_ORDER, sorted_texts
    from rentwise.operators import doc_queries as N
    from rentwise.operators import documents as M
    from rentwise.operators import relational as R
    words = spark.createDataFrame([(["b", "A", "ä", "a", "Z", "é", "Äb", "ab"],)], "x array<string>")
    of = lambda c: words.select(sorted_texts(F.col("x"), c)).first()[0]
    assert of(None) == ["A", "Z", "a", "ab", "b", "Äb", "ä", "é"]
    assert of(TABLE_ORDER) == ["A", "a", "ä", "ab", "Äb", "b", "é", "Z"]
    assert of(DOCUMENT_ORDER) == ["a", "A", "ä", "ab", "Äb", "b", "é", "Z"]
    names = F.create_map(*[F.lit(x) for kv in zip(("p_cust1", "p_cust2", "p_both1", "p_both2"), ("zoe", "Émile", "Anna", "eva")) for x in kv])
    t = dict(seed, person=seed["person"].withColumn("name", F.coalesce(F.element_at(names, F.col("id")), F.col("name"))))
    docs = M.migrate_docs(t)
    for q, c in ((R.customers_with_account, TABLE_ORDER), (R.customer_profiles, TABLE_ORDER), (lambda d, c: N.doc_customers(docs, c), DOCUMENT_ORDER)):
        got = [r.name for r in q(t, c).collect()]
        assert got == sorted(got, key=lambda n: n.lower().replace("é", "e")) and len(got) > 2
    lower = dict(t, additional_service=t["additional_service"].withColumn(
        "description", F.when(F.col("additional_service_id") == "as1", "childSeat").otherwise(F.col("description"))))
    for report in (lambda c: R.service_booking_report(lower, collation=c),
                   lambda c: N.doc_service_booking_report(M.migrate_docs(lower), collation=c)):
        lists = {c: [r.additional_services_list for r in report(c).filter("booking_id = 'b1'").collect()] for c in (None, TABLE_ORDER)}
        assert lists == {None: ["FullInsurance, childSeat"], TABLE_ORDER: ["childSeat, FullInsurance"]}


def test_money_that_is_a_number_in_one_document_and_a_text_in_another(spark, scratch):
    import json

    from rentwise.operators import doc_queries as N
    from rentwise.operators import jobs as J
    from rentwise.sources.json_docs import plain_money, read_json_docs
    booking = lambda i, per_day, costs: {
        "_id": f"b{i}", "start_date": "2026-05-01", "end_date": "2026-05-03", "way_of_billing": "Card",
        "customer": {"person_id": "p1", "name": "Ann"}, "vehicle": {"vehicle_id": "v1", "costs_per_day": per_day},
        "retailer": None, "additionalServices": [{"service_id": f"s{k}", "description": "x", "costs": c} for k, c in enumerate(costs)],
        "pricing": {"total_costs": per_day}}
    money = [70, "70.00", 12.5, "abc", None, True, {"a": 1}, [1], "", "1e2", "Infinity"]
    worth = [70.0, 70.0, 12.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 100.0, 0.0]
    data = {"bookings": [booking(i, m, [m, 5, "2.5"]) for i, m in enumerate(money)],
            "persons": [{"_id": "p1", "name": "Ann", "roles": {"customer": {"customer_number": "C"}}, "bankAccount": {"account_id": "a"}}],
            "vehicles": [{"_id": "v1", "costs_per_day": "9"}], "ratings": [], "services": [{"_id": "s9", "description": "y", "costs": 4.5}]}
    for name, lines in data.items():
        pathlib.Path(scratch, name).mkdir()
        pathlib.Path(scratch, name, "a.json").write_text("\n".join(map(json.dumps, lines)))
    loose = read_json_docs(spark, scratch)
    assert loose["bookings"].schema["vehicle"].dataType["costs_per_day"].dataType.typeName() == "variant"
    docs = plain_money(loose)
    of = lambda df, col: [r[col] for r in df.orderBy(F.expr("int(substr(booking_id, 2))")).collect()]
    for report in (N.doc_booking_cost_report(docs), N.doc_service_booking_report(docs)):
        extras = "additional_cost" if "additional_cost" in report.columns else "additional_costs"
        assert of(report, extras) == [w + 7.5 for w in worth] and of(report, "base_cost") == [2 * w for w in worth]
    active = N.doc_active_bookings(docs, "2026-01-01")
    assert of(active, "costs_per_day") == [9.0 if m is None else w for m, w in zip(money, worth)]  # a missing price falls back
    asked = spark.createDataFrame([("r1", "b1", "p1", ["s9"], True)], "request_id string, booking_id string, customer_id string, "
                                  "service_ids array<string>, confirm_payment boolean")
    _, outcome = J.doc_add_services(docs, asked, "2026-01-01")
    assert outcome.select("status", "base_cost", "extras_cost").first() == ("accepted", 140.0, 82.0)


def test_counts_are_built_with_one_shuffle_and_a_batch_reads_its_rules_only(spark, seed, scratch, monkeypatch):
    root, written, refresh = scratch + "/counts", [], versions.refresh

    def spy(spark, root, tables, specs):
        written.extend(tables.values())
        return refresh(spark, root, tables, specs)

    monkeypatch.setattr(versions, "refresh", spy)
    K.build_counts(spark, root, seed)
    assert plan_text(written[0]).count("Exchange (") == 1
    one = {"person": seed["person"].limit(1)}
    delta = K.contributions(K.signed(one)).withColumn("bucket", K.count_specs()[K.COUNTS].part_of)
    found = K._touched(spark, root, delta)
    assert {r.rule for r in found.select("rule").distinct().collect()} == {r.rule for r in delta.select("rule").collect()}
    assert re.search(r"PushedFilters: \[[^\n]*rule", plan_text(found))
    monkeypatch.setattr(K, "FEW_KEYS", 0)  # as a batch of very many keys
    assert [(r.table_name, r.n_rows) for r in K.count_batch(spark, root, one, None, "large").collect()] == [("person", 2)]
    assert {(r.table_name, r.n_rows) for r in K.findings(K.load_counts(spark, root)).collect()} == {("person", 2)}
