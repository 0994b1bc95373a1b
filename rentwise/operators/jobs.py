"""Batch write jobs: create bookings (R4, N3) and add services.

Each job takes a batch of requests as a DataFrame and returns new table
contents plus an outcome row per request (``accepted`` or a reject code).
No check of one request depends on another request of the batch (they read
bookings, accounts and the catalogue only), so a batch is order-independent;
the only order-dependent value of one-at-a-time processing, the running total
of a booking, is replaced by the final total after the whole batch.

Ids are derived from request ids, so a retried task writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentwise import schema
from rentwise.functions.rules import (doc_rental_days, doc_start_window, num_or_zero, rental_days,
                                      start_date_window, today, truthy_text, where_all)
from rentwise.operators.documents import SERVICE_ENTRY, doc_specs, load_docs
from rentwise.operators.relational import extras_by_booking, one_per_request
from rentwise.plans.skew import fact_join
from rentwise.session import staged
from rentwise.sources import versions
from rentwise.sources.tables import load_tables, table_specs

# Reject codes of the request rules.
MISSING_FIELDS = "missing fields"
MISSING_CUSTOMER = "missing customer"
INVALID_VEHICLE = "invalid vehicle"
INVALID_CUSTOMER = "invalid customer"
NO_CUSTOMERS = "no customers available"
NO_SERVICES = "no services selected"
NOT_CONFIRMED = "payment not confirmed"
BOOKING_NOT_FOUND = "booking not found or inactive"
NO_BANK_ACCOUNT = "no bank account"
INVALID_SERVICES = "invalid service selection"
CONFLICTING = "conflicting requests with one id"
ACCEPTED = "accepted"


def _first_failure(rules) -> F.Column:
    """Status of a request: code of the first failing rule, else ``accepted``."""
    out = None
    for failed, code in rules:
        out = F.when(failed, F.lit(code)) if out is None else out.when(failed, F.lit(code))
    return out.otherwise(F.lit(ACCEPTED))


def _fields_missing() -> F.Column:
    """Vehicle, both dates and the billing way are required in a booking request."""
    given = (truthy_text("vehicle_id") & F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
             & truthy_text("way_of_billing"))
    return ~given


def _new_booking_id(request_id) -> F.Column:
    return F.concat(F.lit("b_"), request_id)


def materialize(df: DataFrame) -> DataFrame:
    """Store a judged request batch (or what it touches) as Parquet in the shared checkpoint folder.

    The judged batch feeds the inserted links, the repriced totals and the
    outcome; otherwise each of them would re-run the validation joins. The
    files survive the loss of the executors that computed them.
    """
    return staged(df, "requests")


def _exists_flag(df: DataFrame, key: str, alias: str) -> DataFrame:
    """Keys of ``df`` (unique there) with a TRUE flag, for a left join that tests existence."""
    return df.select(F.col(key).alias(alias)).withColumn(alias + "_ok", F.lit(True))


def near(table: DataFrame, key: str, rows: DataFrame, column: str | F.Column) -> DataFrame:
    """The rows of a table whose key a batch names.

    The small side of the semi join is the batch, so a large table is scanned once and not shuffled.
    """
    named = rows.select((F.col(column) if isinstance(column, str) else column).alias(key))
    return table.join(named, key, "left_semi")


def near_requests(tables, requests: DataFrame) -> dict:
    """The tables with vehicles and customers narrowed to a batch of booking requests."""
    return dict(tables, vehicle=near(tables["vehicle"], "vehicle_id", requests, "vehicle_id"),
                customer=near(tables["customer"], "person_id", requests, "customer_id"))


def near_doc_requests(docs, requests: DataFrame) -> dict:
    """The collections with vehicles narrowed to a batch, and persons to its customers, the vehicles' retailers and the default customer."""
    vehicles = near(docs["vehicles"], "_id", requests, "vehicle_id")
    ids = (requests.select(F.col("customer_id").alias("_id")).union(vehicles.select("retailer_id"))
           .union(first_customer(docs["persons"])))
    return dict(docs, vehicles=vehicles, persons=near(docs["persons"], "_id", ids, "_id"))


def near_service_requests(tables, requests: DataFrame) -> dict:
    """The tables with accounts narrowed to the customers of a batch of add-service requests, and services to those it names."""
    asked = one_per_request(requests)
    services = asked.select(F.explode("service_ids").alias("sid"))
    return dict(tables, bankaccount=near(tables["bankaccount"], "person_id", asked, "customer_id"),
                additional_service=near(tables["additional_service"], "additional_service_id", services, "sid"))


def near_accepted(tables, accepted: DataFrame) -> dict:
    """The tables narrowed to the accepted add-service requests: their bookings with links and vehicles, the services
    they name or the bookings have; bookings and links are staged."""
    touched = materialize(accepted.select("booking_id").distinct())
    bookings = materialize(near(tables["booking"], "booking_id", touched, "booking_id"))
    links = materialize(near(tables["booking_service"], "booking_id", touched, "booking_id"))
    services = links.select("additional_service_id").union(accepted.select(F.explode("service_ids")))
    return dict(tables, booking=bookings, booking_service=links, vehicle=near(tables["vehicle"], "vehicle_id", bookings, "vehicle_id"),
                additional_service=near(tables["additional_service"], "additional_service_id", services, "additional_service_id"))


def near_doc_service_requests(docs, requests: DataFrame) -> dict:
    """The collections with persons narrowed to the customers of a batch of add-service requests, and services to those it names."""
    asked = one_per_request(requests)
    return dict(docs, persons=near(docs["persons"], "_id", asked, "customer_id"),
                services=near(docs["services"], "_id", asked.select(F.explode("service_ids").alias("sid")), "sid"))


# --- R4 -------------------------------------------------------------------

def create_bookings(tables, requests: DataFrame):
    """Validate booking requests and price the accepted ones.

    Rules in order: vehicle, dates and billing given; customer given; vehicle
    exists; customer exists (the booking's foreign key). Overlaps are not
    checked and reversed dates cost one day, as in the source.
    Returns ``(new_bookings, outcome)``.
    """
    return bookings_from_judged(judge_booking_requests(near_requests(tables, requests), requests))


def judge_booking_requests(tables, requests: DataFrame) -> DataFrame:
    """Each booking request with its status and priced total."""
    vehicles = tables["vehicle"].select(F.col("vehicle_id").alias("v_id"), F.col("costs_per_day").alias("v_cost"),
                                        F.lit(True).alias("v_ok"))
    requests = one_per_request(requests)
    customers = _exists_flag(tables["customer"], "person_id", "c_id")
    r = fact_join(requests, vehicles, "vehicle_id", "left", "v_id")
    r = fact_join(r, customers, "customer_id", "left", "c_id")
    status = _first_failure([
        (F.col("conflicting"), CONFLICTING),
        (_fields_missing(), MISSING_FIELDS),
        (~truthy_text("customer_id"), MISSING_CUSTOMER),
        (F.col("v_ok").isNull(), INVALID_VEHICLE),
        (F.col("c_id_ok").isNull(), INVALID_CUSTOMER),
    ])
    total = F.coalesce(F.col("v_cost").cast("double"), F.lit(0.0)) * rental_days("start_date", "end_date")
    return r.select("request_id", "customer_id", "vehicle_id", "start_date", "end_date", "way_of_billing",
                    status.alias("status"), total.alias("total"))


def bookings_from_judged(judged: DataFrame):
    """New booking rows of the accepted requests, and the outcome of every request."""
    accepted = judged.filter(F.col("status") == ACCEPTED)
    new_bookings = accepted.select(
        _new_booking_id(F.col("request_id")).alias("booking_id"), "start_date", "end_date",
        F.col("total").cast(schema.MONEY).alias("total_costs"), "way_of_billing", "customer_id", "vehicle_id")
    outcome = judged.select(
        "request_id", "status",
        F.when(F.col("status") == ACCEPTED, _new_booking_id(F.col("request_id"))).alias("booking_id"),
        F.when(F.col("status") == ACCEPTED, F.col("total")).alias("total_costs"))
    return new_bookings, outcome


# --- R8 -------------------------------------------------------------------

def _service_checks(requests: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Per request: how many of its distinct requested ids exist in the catalogue."""
    picked = requests.select("request_id", F.explode(F.array_distinct("service_ids")).alias("sid"))
    known = picked.join(catalogue.select(F.col(key).alias("sid")), "sid")
    return known.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_known"))


def _booking_found(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Requests whose booking is active and belongs to the requesting customer.

    ``active`` has (b_id, b_cust).
    """
    found = fact_join(requests.select("request_id", "booking_id", "customer_id"), active, "booking_id", dim_key="b_id")
    return found.filter(F.col("customer_id") == F.col("b_cust")).select(
        "request_id", F.lit(True).alias("booking_found"))


def _judge_service_requests(requests, booking_ok: DataFrame, has_account: DataFrame, n_known: DataFrame):
    r = requests.join(booking_ok, ["request_id"], "left")
    r = fact_join(r, has_account, "customer_id", "left", "acct_id")
    r = r.join(n_known, "request_id", "left")
    ids = F.array_distinct("service_ids")
    status = _first_failure([
        (F.col("conflicting"), CONFLICTING),
        (~truthy_text("customer_id"), MISSING_CUSTOMER),
        (F.col("service_ids").isNull() | (F.size("service_ids") == 0), NO_SERVICES),
        (~F.coalesce(F.col("confirm_payment"), F.lit(False)), NOT_CONFIRMED),
        (F.col("booking_found").isNull(), BOOKING_NOT_FOUND),
        (F.col("acct_id_ok").isNull(), NO_BANK_ACCOUNT),
        (F.coalesce(F.col("n_known"), F.lit(0)) != F.size(ids), INVALID_SERVICES),
    ])
    return r.select("request_id", "booking_id", "customer_id", "service_ids", status.alias("status"))


def add_services(tables, requests: DataFrame, as_of: str | None = None, judged: DataFrame | None = None):
    """Validate add-service requests, insert links (existing ones ignored), reprice.

    Rules in order: customer given; ids given; payment confirmed; booking is
    the customer's and starts on or after ``as_of`` (default today); customer has a bank
    account; all distinct ids exist. Returns ``(links, bookings, outcome)``:
    the full new link table, the full booking table with the totals of the
    touched bookings replaced by base + extras, and one row per request.
    """
    bookings = tables["booking"]
    links = tables["booking_service"]
    if judged is None:
        judged = materialize(judge_service_requests(tables, requests, as_of))
    accepted = judged.filter(F.col("status") == ACCEPTED)
    inserted = inserted_links(links, accepted)
    new_links = links.unionByName(inserted)

    touched = accepted.select("booking_id").distinct()
    touched_bookings = bookings.join(touched, "booking_id", "left_semi")
    updated = dict(tables, booking_service=new_links)
    vehicles = tables["vehicle"].select("vehicle_id", "costs_per_day")
    # Only the links of touched bookings are re-aggregated, not the whole table.
    extras = extras_by_booking(updated, touched_bookings).select("booking_id", "extras")
    totals = (touched_bookings.join(vehicles, "vehicle_id")
              .join(extras, "booking_id", "left")
              .select("booking_id",
                      (rental_days("start_date", "end_date") * F.col("costs_per_day")).cast("double").alias("base_cost"),
                      F.coalesce(F.col("extras").cast("double"), F.lit(0.0)).alias("extras_cost")))
    totals = touched.join(totals, "booking_id", "left").select(
        "booking_id", F.coalesce("base_cost", F.lit(0.0)).alias("base_cost"),
        F.coalesce("extras_cost", F.lit(0.0)).alias("extras_cost"))
    totals = materialize(totals.withColumn("total_cost", F.col("base_cost") + F.col("extras_cost")))
    new_bookings = bookings.join(totals.select("booking_id", "total_cost"), "booking_id", "left").select(
        *[F.coalesce(F.col("total_cost").cast(schema.MONEY), F.col("total_costs")).alias("total_costs")
          if f.name == "total_costs" else F.col(f.name) for f in schema.BOOKING.fields])
    ok = F.col("status") == ACCEPTED
    outcome = fact_join(judged, totals, "booking_id", "left").select(
        "request_id", "booking_id", "status",
        *[F.when(ok, F.col(c)).alias(c) for c in ("base_cost", "extras_cost", "total_cost")])
    return new_links, new_bookings, outcome


def inserted_links(links: DataFrame, accepted: DataFrame) -> DataFrame:
    """Links the accepted requests add (insert-ignore): requested pairs not stored yet.

    The stored links are first narrowed to the batch's bookings (a semi join
    whose small side is the batch), so the anti join never shuffles the whole
    link table for a small batch.
    """
    wanted = accepted.select("booking_id", F.explode(F.array_distinct("service_ids")).alias("additional_service_id")) \
        .distinct()
    stored = links.join(wanted.select("booking_id").distinct(), "booking_id", "left_semi")
    return wanted.join(stored, ["booking_id", "additional_service_id"], "left_anti")


def judge_service_requests(tables, requests: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each add-service request with the status of its first failing rule."""
    requests = one_per_request(requests)
    bookings = tables["booking"]
    active = where_all(bookings, start_date_window(bookings, lower=as_of or today())).select(
        F.col("booking_id").alias("b_id"), F.col("customer_id").alias("b_cust"))
    booking_ok = _booking_found(requests, active)
    has_account = _exists_flag(tables["bankaccount"], "person_id", "acct_id")
    n_known = _service_checks(requests, tables["additional_service"], "additional_service_id")
    return _judge_service_requests(requests, booking_ok, has_account, n_known)


def run_create_bookings(spark, tables, requests: DataFrame, target_dir: str, batch: str | None = None) -> DataFrame:
    """R4 as a write job: publish the accepted bookings in ``target_dir``; returns the outcome.

    The judged batch is stored first, so the new rows and the returned
    outcome come from one evaluation. Booking ids already stored
    are skipped, so running the same batch again adds nothing; a ``batch`` id that
    is published already is not even written.
    """
    judged = materialize(judge_booking_requests(near_requests(tables, requests), requests))
    new_bookings, outcome = bookings_from_judged(judged)
    # Ids already stored (a rerun of the batch): found with a semi join whose
    # small side is the batch, so the stored ids are not shuffled.
    stored = tables["booking"].select("booking_id").join(new_bookings.select("booking_id"), "booking_id", "left_semi")
    fresh = new_bookings.join(stored, "booking_id", "left_anti")
    versions.commit(spark, target_dir, table_specs(), {"booking": fresh}, batch=batch)
    return outcome


def run_add_services(spark, requests: DataFrame, as_of: str | None, tables_dir: str, batch: str | None = None) -> DataFrame:
    """R8 as a write job on the stored tables; returns the outcome.

    The new links and the repriced rows of the batch's bookings are published in
    one commit: what is written follows the batch, and a job that dies before
    leaves neither. The same batch again adds no link and gives the same totals.
    """
    tables, requests = load_tables(spark, tables_dir), materialize(one_per_request(requests))
    judged = materialize(judge_service_requests(near_service_requests(tables, requests), requests, as_of))
    accepted = judged.filter(F.col("status") == ACCEPTED)
    # Rows with all columns are read for the accepted requests only; judging needs few columns of the active bookings.
    batch_tables = near_accepted(tables, accepted)
    _, repriced, outcome = add_services(batch_tables, requests, as_of, judged)
    versions.commit(spark, tables_dir, table_specs(), batch=batch, changed={
        "booking_service": inserted_links(batch_tables["booking_service"], accepted), "booking": repriced})
    return outcome


# --- N3 -------------------------------------------------------------------

def first_customer(persons: DataFrame) -> DataFrame:
    """The ``_id`` of the first customer by name (then id): one row, or none."""
    return persons.filter(F.col("roles.customer").isNotNull()) \
        .orderBy(F.asc_nulls_first("name"), F.asc("_id")).select("_id").limit(1)


def default_customer_id(persons: DataFrame) -> F.Column:
    """The first customer as a scalar subquery, evaluated once."""
    return first_customer(persons).scalar()


def doc_create_bookings(docs, requests: DataFrame):
    """Booking requests against the documents.

    The customer is optional (default: first customer by name) and must be a
    person document; the vehicle must exist; the retailer is looked up and
    embedded (NULL when the vehicle has none). The new document carries a
    vehicle snapshot without plate and seats and no extras.
    Returns ``(new_booking_docs, outcome)``.
    """
    requests = materialize(one_per_request(requests))
    docs = near_doc_requests(docs, requests)
    persons = docs["persons"]
    companies = persons.select(F.col("_id").alias("r_id"), F.col("roles.retailer.company_name").alias("r_company"))
    vehicles = docs["vehicles"].select(
        F.col("_id").alias("v_id"), F.col("_id").alias("v_key"), F.col("model").alias("v_model"),
        F.col("producer").alias("v_producer"), F.col("costs_per_day").alias("v_costs"),
        F.col("retailer_id").alias("v_retailer"))
    vehicles = fact_join(vehicles, companies, "v_retailer", "left", "r_id")
    people = persons.select(F.col("_id").alias("p_id"), F.col("_id").alias("p_key"), F.col("name").alias("p_name"))
    fallback = default_customer_id(persons)
    resolved = F.when(truthy_text("customer_id"), F.col("customer_id")).otherwise(fallback)
    # Every request without a customer resolves to the same default: a hot key by design.
    asked = one_per_request(requests).withColumn("resolved_customer", resolved)
    r = fact_join(asked, people, "resolved_customer", "left", "p_key")
    r = fact_join(r, vehicles, "vehicle_id", "left", "v_key")
    status = _first_failure([
        (F.col("conflicting"), CONFLICTING),
        (_fields_missing(), MISSING_FIELDS),
        (F.col("resolved_customer").isNull(), NO_CUSTOMERS),
        (F.col("p_id").isNull(), INVALID_CUSTOMER),
        (F.col("v_id").isNull(), INVALID_VEHICLE),
    ])
    start, end = F.col("start_date").cast("string"), F.col("end_date").cast("string")
    total = num_or_zero("v_costs") * doc_rental_days(start, end)
    retailer = F.when(truthy_text("v_retailer"), F.struct(F.col("v_retailer").alias("person_id"),
                                                          F.col("r_company").alias("company_name")))
    judged = materialize(r.select("*", status.alias("status"), total.alias("total"), retailer.alias("retailer")))
    accepted = judged.filter(F.col("status") == ACCEPTED)
    new_docs = accepted.select(
        _new_booking_id(F.col("request_id")).alias("_id"), start.alias("start_date"), end.alias("end_date"),
        "way_of_billing",
        F.struct(F.col("p_id").alias("person_id"), F.col("p_name").alias("name")).alias("customer"),
        F.struct(F.col("v_id").alias("vehicle_id"), F.col("v_model").alias("model"),
                 F.col("v_producer").alias("producer"), F.col("v_costs").alias("costs_per_day"),
                 F.lit(None).cast("string").alias("plate_number"), F.lit(None).cast("int").alias("number_of_seats"),
                 F.col("v_retailer").alias("retailer_id")).alias("vehicle"),
        "retailer",
        F.array().cast(f"array<{SERVICE_ENTRY}>").alias("additionalServices"),
        F.struct(F.col("total").cast(schema.MONEY).cast("string").alias("total_costs")).alias("pricing"),
    )
    ok = F.col("status") == ACCEPTED
    outcome = judged.select(
        "request_id", "status",
        F.when(ok, _new_booking_id(F.col("request_id"))).alias("booking_id"),
        F.when(ok, F.col("p_id")).alias("customer_id"),
        F.when(ok, F.col("total")).alias("total_costs"),
        F.when(ok, F.col("retailer.company_name")).alias("retailer_name"))
    return new_docs, outcome


# --- N8 -------------------------------------------------------------------

def judge_doc_service_requests(docs, requests: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each add-service request against the documents, with the status of its first failing rule."""
    bookings = docs["bookings"]
    requests = one_per_request(requests)
    active = where_all(bookings, doc_start_window(bookings, lower=as_of or today())).select(
        F.col("_id").alias("b_id"), F.col("customer.person_id").alias("b_cust"))
    booking_ok = _booking_found(requests, active)
    has_account = docs["persons"].filter(F.col("bankAccount").isNotNull()).select(
        F.col("_id").alias("acct_id"), F.lit(True).alias("acct_id_ok"))
    n_known = _service_checks(requests, docs["services"], "_id")
    return _judge_service_requests(requests, booking_ok, has_account, n_known)


def doc_add_services(docs, requests: DataFrame, as_of: str | None = None, judged: DataFrame | None = None):
    """Add-service requests against the booking documents.

    Same rules as R8. Accepted services not yet in a booking's array are
    appended (sorted by id after the existing entries); the stored total is
    set to base + extras of the final array. Returns ``(bookings, outcome)``.
    """
    bookings = docs["bookings"]
    if judged is None:
        judged = materialize(judge_doc_service_requests(docs, requests, as_of))
    accepted = judged.filter(F.col("status") == ACCEPTED)
    catalogue = docs["services"].select(
        F.col("_id").alias("sid"), F.struct(F.col("_id").alias("service_id"), "description", "costs").alias("entry"))
    wanted = accepted.select(F.col("booking_id").alias("_id"), F.explode(F.array_distinct("service_ids")).alias("sid")) \
        .distinct().join(catalogue, "sid")
    # One row per touched booking; the collected entries are bounded by the catalogue.
    wanted = wanted.groupBy("_id").agg(F.array_sort(F.collect_list("entry")).alias("wanted"))
    current = F.coalesce(F.col("additionalServices"), F.array().cast(f"array<{SERVICE_ENTRY}>"))
    held = F.transform(current, lambda s: s.getField("service_id"))
    fresh = F.filter(F.col("wanted"), lambda e: ~F.array_contains(held, e.getField("service_id")))
    merged = F.concat(current, fresh)
    touched = bookings.join(wanted, "_id")
    base = doc_rental_days("start_date", "end_date") * num_or_zero("vehicle.costs_per_day")
    extras = F.aggregate(merged, F.lit(0.0), lambda acc, s: acc + num_or_zero(s.getField("costs")))
    updated = touched.select(
        "_id", merged.alias("new_services"), base.alias("base_cost"), extras.alias("extras_cost"))
    updated = materialize(updated.withColumn("total_cost", F.col("base_cost") + F.col("extras_cost")))
    out = bookings.join(updated, "_id", "left")
    is_new = F.col("new_services").isNotNull()
    new_bookings = out.select(*[
        F.when(is_new, F.col("new_services")).otherwise(F.col("additionalServices")).alias("additionalServices")
        if c == "additionalServices" else
        F.when(is_new, F.struct(F.col("total_cost").cast(schema.MONEY).cast("string").alias("total_costs")))
         .otherwise(F.col("pricing")).alias("pricing") if c == "pricing" else F.col(c)
        for c in bookings.columns])
    ok = F.col("status") == ACCEPTED
    outcome = fact_join(judged, updated.withColumnRenamed("_id", "booking_id").drop("new_services"), "booking_id", "left") \
        .select("request_id", "booking_id", "status",
                *[F.when(ok, F.col(c)).alias(c) for c in ("base_cost", "extras_cost", "total_cost")])
    return new_bookings, outcome


def run_doc_create_bookings(spark, requests: DataFrame, docs_dir: str, batch: str | None = None) -> DataFrame:
    """N3 as a write job: publish the new booking documents whose id is not stored yet; returns the outcome."""
    docs = load_docs(spark, docs_dir)
    new_docs, outcome = doc_create_bookings(docs, requests)
    stored = docs["bookings"].select("_id").join(new_docs.select("_id"), "_id", "left_semi")
    versions.commit(spark, docs_dir, doc_specs(), {"bookings": new_docs.join(stored, "_id", "left_anti")}, batch=batch)
    return outcome


def run_doc_add_services(spark, requests: DataFrame, as_of: str | None, docs_dir: str, batch: str | None = None) -> DataFrame:
    """N8 as a write job: the changed documents of the batch are published in one commit; returns the outcome.

    The same batch again finds the services held and leaves the documents as they are.
    """
    docs, requests = load_docs(spark, docs_dir), materialize(one_per_request(requests))
    batch_docs = near_doc_service_requests(docs, requests)
    judged = materialize(judge_doc_service_requests(batch_docs, requests, as_of))
    # Whole documents are read for the accepted requests only; judging needs few columns of the active bookings.
    touched = materialize(judged.filter(F.col("status") == ACCEPTED).select("booking_id").distinct())
    batch_docs["bookings"] = materialize(near(docs["bookings"], "_id", touched, "booking_id"))
    bookings, outcome = doc_add_services(batch_docs, requests, as_of, judged)
    versions.commit(spark, docs_dir, doc_specs(), {"bookings": bookings}, batch=batch)
    return outcome
