"""Queries on the relational model (group R).

Every operator takes the dict of rental tables (see ``rentwise.sources``) and
returns a lazy DataFrame. Two shapes recur:

* The extras of a booking are aggregated from the link table **before** the
  wide join (one row per booking, keyed by ``booking_id``), instead of grouping
  the joined result by seven to thirteen columns.
* Anti joins are written as ``left_anti`` (never a left join + IS NULL, never
  NOT IN, which would turn null-aware).
* The booking fact is shuffled once per key at most: the tables with the
  customer's key are joined in a chain, vehicles get their retailer first;
  adaptive execution splits hot keys (:mod:`rentwise.plans.skew`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentwise.functions.rules import (START_YEAR, given, in_partitions, money, rental_days, sorted_texts, start_date_window,
                                      text_order, today, where_all)
from rentwise.plans.skew import fact_join
from rentwise.session import staged
from rentwise.sources.versions import Snapshot, earliest_start


def _date(value: str):
    return F.lit(value).cast("date")


def priced_links(tables, bookings: DataFrame | None = None) -> DataFrame:
    """Links joined to the catalogue (a small dimension: the planner broadcasts it).

    Links naming an unknown service carry no price and drop out; sums and
    counts over them are the same as with the outer joins of the reports.
    With ``bookings`` (e.g. a date window) only their links are kept, before
    any aggregation.
    """
    links = tables["booking_service"]
    if bookings is not None:
        links = links.join(bookings.select("booking_id"), "booking_id", "left_semi")
    return links.join(tables["additional_service"], "additional_service_id")


def extras_by_booking(tables, bookings: DataFrame | None = None, collation: str | None = None) -> DataFrame:
    """One row per booking with extras: sum of costs, count, sorted description list.

    Partial aggregation happens map-side, so a booking key shuffles at most one
    row per map task. The collected list is bounded by the catalogue size
    because (booking_id, additional_service_id) is the link table's key.
    Reports over a booking window pass their bookings, so a one-year report
    aggregates one year of links rather than the whole history.
    """
    return priced_links(tables, bookings).groupBy("booking_id").agg(
        F.sum("costs").alias("extras"),
        F.count("additional_service_id").alias("n_extras"),
        sorted_texts(F.collect_list("description"), collation).alias("extras_descriptions"),
    )


def with_customer(bookings: DataFrame, tables, with_account: bool = False) -> DataFrame:
    """``bookings`` of known customers with the customer's name (and account columns, inner).

    The tables are joined one by one: all of them have the booking's key, so a
    chain shuffles the bookings once, and a hot customer is split in each join. A
    dimension joined from them first could not be split (its join input would
    be no shuffle).
    """
    known = tables["customer"].select(F.col("person_id").alias("customer_id"))
    names = tables["person"].select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    out = fact_join(fact_join(bookings, known, "customer_id", "left_semi"), names, "customer_id")
    if with_account:
        accounts = tables["bankaccount"].select(F.col("person_id").alias("customer_id"),
                                                F.col("iban").alias("customer_iban"),
                                                F.col("bic").alias("customer_bic"))
        out = fact_join(out, accounts, "customer_id")
    return out


def vehicle_dim(tables, cols, with_retailer: bool = False) -> DataFrame:
    """Vehicles keyed by ``vehicle_id`` (and their retailer's name, inner)."""
    vehicles = tables["vehicle"].select("vehicle_id", *cols, *(["retailer_id"] if with_retailer else []))
    if not with_retailer:
        return vehicles
    retailers = tables["retailer"].select(F.col("person_id").alias("retailer_id"),
                                          F.col("company_name").alias("retailer_name"))
    return fact_join(vehicles, retailers, "retailer_id")


def _customers_with_account(tables) -> DataFrame:
    person = tables["person"].withColumnRenamed("id", "person_id")
    return (tables["customer"].join(person, "person_id")
            .join(tables["bankaccount"], "person_id"))


def customers_with_account(tables, collation: str | None = None) -> DataFrame:
    """Customers that have a bank account, by name (bytewise, or by a collation such as ``TABLE_ORDER``)."""
    return _customers_with_account(tables).select(
        "person_id", "name", "customer_number", "driver_licencse_number", "iban",
    ).orderBy(text_order("name", collation), "person_id")


def customer_profiles(tables, collation: str | None = None) -> DataFrame:
    """As R1 with contact and account columns."""
    return _customers_with_account(tables).select(
        "person_id", "name", "eMail", "phone_number", "address", "customer_number",
        "driver_licencse_number", "account_id", "iban", "bic",
    ).orderBy(text_order("name", collation), "person_id")


def booked_vehicle_ids(bookings: DataFrame, start: str, end: str, near=None) -> DataFrame:
    """Distinct vehicles with a booking overlapping [start, end] (closed on both ends).

    ``near`` are the start years that can hold one and the longest rental in them, where
    the stored tables know them: the scan is bounded below too, without a limit on durations.
    """
    conditions = start_date_window(bookings, upper=end) + [F.col("end_date") >= _date(start)]
    if near is not None:
        years, longest = near
        conditions += in_partitions(START_YEAR, years) + start_date_window(bookings, lower=earliest_start(start, longest))
    return where_all(bookings, conditions).select("vehicle_id").distinct()


def available_vehicles(tables, start: str, end: str, collation: str | None = None) -> DataFrame:
    """R2: vehicles without a booking overlapping the window, by producer and model."""
    near = tables.overlapping("booking", start) if isinstance(tables, Snapshot) else None
    booked = booked_vehicle_ids(tables["booking"], start, end, near)
    return tables["vehicle"].join(booked, "vehicle_id", "left_anti").select(
        "vehicle_id", "model", "producer", money("costs_per_day").alias("costs_per_day"), "plate_number",
    ).orderBy(text_order("producer", collation), text_order("model", collation), "vehicle_id")


def booking_cost_report(tables, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Cost of every booking; optional ``start >= from`` and ``end <= to`` (end date!).

    Bookings without extras are kept (left join on the pre-aggregated extras),
    bookings whose customer or vehicle is unknown are not (inner joins).
    """
    b = tables["booking"]
    bookings = where_all(b, start_date_window(b, lower=date_from) + [
        F.col("end_date") <= _date(date_to) if given(date_to) else None,
    ]).select("booking_id", "customer_id", "vehicle_id", "start_date", "end_date")
    vehicles = vehicle_dim(tables, ["producer", "model", "costs_per_day"])
    extras = extras_by_booking(tables, bookings).select("booking_id", "extras")
    days = rental_days("start_date", "end_date")
    base = F.col("costs_per_day") * F.col("days")
    additional = F.coalesce(F.col("extras"), F.lit(0).cast("decimal(10,2)"))
    joined = with_customer(bookings, tables)
    joined = (fact_join(joined, vehicles, "vehicle_id")
              .join(extras, "booking_id", "left")
              .withColumn("days", days))
    return joined.select(
        "booking_id", "customer_name", "producer", "model", "start_date", "end_date",
        money("costs_per_day").alias("costs_per_day"), "days",
        money(base).alias("base_cost"), money(additional).alias("additional_cost"),
        money(base + additional).alias("total_cost"),
    ).orderBy(F.col("start_date").desc(), "booking_id")


def active_bookings(tables, as_of: str | None = None, customer_id: str | None = None) -> DataFrame:
    """Bookings starting on or after ``as_of`` (default today; of one customer, or of all).

    Returns the stored total next to the recomputed one; the recomputed total
    is the sum of the two money values as doubles.
    """
    b = tables["booking"]
    bookings = where_all(b, start_date_window(b, lower=as_of or today()) + [
        F.col("customer_id") == F.lit(customer_id) if customer_id is not None else None,
    ])
    vehicles = vehicle_dim(tables, ["model", "producer", "costs_per_day", "plate_number", "number_of_seats"])
    extras = extras_by_booking(tables, bookings).select("booking_id", "extras")
    joined = (fact_join(bookings, vehicles, "vehicle_id").join(extras, "booking_id", "left")
              .withColumn("days", rental_days("start_date", "end_date")))
    base = money(F.col("days") * F.col("costs_per_day"))
    extras_cost = F.coalesce(money("extras"), F.lit(0.0))
    return joined.select(
        "booking_id", "start_date", "end_date", "way_of_billing", "vehicle_id",
        money("total_costs").alias("total_costs"), "model", "producer",
        money("costs_per_day").alias("costs_per_day"), "plate_number", "number_of_seats", "days",
        base.alias("base_cost"), extras_cost.alias("extras_cost"), (base + extras_cost).alias("total_cost"),
    ).orderBy("start_date", "booking_id")


def service_options(tables, asked: DataFrame, collation: str | None = None) -> DataFrame:
    """The state of the services asked for a booking.

    ``asked`` has (booking_id, service_ids). One row per distinct asked pair:
    ``current`` (on the booking), ``available`` (in the catalogue, not on the
    booking; also for an unknown booking) or ``unknown`` (not in the catalogue).
    """
    pairs = asked.select("booking_id", F.explode("service_ids").alias("additional_service_id")).distinct()
    services = tables["additional_service"].select("additional_service_id", "description", "costs",
                                                   F.lit(True).alias("listed"))
    held = tables["booking_service"].join(pairs, ["booking_id", "additional_service_id"], "left_semi").withColumn(
        "held", F.lit(True))
    status = F.when(F.col("listed").isNull(), "unknown").when(F.col("held"), "current").otherwise("available")
    return (pairs.join(held, ["booking_id", "additional_service_id"], "left").join(services, "additional_service_id", "left")
            .select("booking_id", status.alias("status"), "additional_service_id", "description",
                    money("costs").alias("costs")).orderBy("booking_id", "status", text_order("description", collation)))


def booking_totals(tables, booking_ids: DataFrame) -> DataFrame:
    """Base and extras of the given bookings; total as the sum of both doubles. Unknown bookings have zeros."""
    ids = booking_ids.select("booking_id").distinct()
    bookings = tables["booking"].select("booking_id", "start_date", "end_date", "vehicle_id").join(ids, "booking_id", "left_semi")
    vehicles = vehicle_dim(tables, ["costs_per_day"])
    # Extras are matched while the rows lie by booking, before they move to their vehicles.
    extras = extras_by_booking(tables, ids).select("booking_id", "extras")
    joined = fact_join(bookings.join(extras, "booking_id", "left"), vehicles, "vehicle_id")
    base = money(rental_days("start_date", "end_date") * F.col("costs_per_day"))
    extras_cost = F.coalesce(money("extras"), F.lit(0.0))
    totals = joined.select("booking_id", base.alias("base_cost"), extras_cost.alias("extras_cost"),
                           (base + extras_cost).alias("total_cost"))
    return ids.join(totals, "booking_id", "left").na.fill(0.0, ["base_cost", "extras_cost", "total_cost"])


def service_booking_report(tables, date_from: str | None = None, date_to: str | None = None,
                           collation: str | None = None) -> DataFrame:
    """Bookings with at least one extra; ``start >= from`` and ``start < to`` (start date!).

    The list of extras is in the order of ``collation`` (bytewise without one).

    All joins are inner: customers without account and vehicles without a
    known retailer drop out.
    """
    b = tables["booking"]
    bookings = where_all(b, start_date_window(b, lower=date_from, upper=date_to, upper_inclusive=False)) \
        .select("booking_id", "start_date", "end_date", "customer_id", "vehicle_id")
    vehicles = vehicle_dim(tables, ["model", "producer", "costs_per_day"], with_retailer=True)
    extras = extras_by_booking(tables, bookings, collation)
    joined = bookings.join(extras, "booking_id")
    joined = with_customer(joined, tables, with_account=True)
    joined = fact_join(joined, vehicles, "vehicle_id").withColumn("rental_days", rental_days("start_date", "end_date"))
    base = F.col("rental_days") * F.col("costs_per_day")
    return joined.select(
        "booking_id", "start_date", "end_date", "customer_id", "customer_name", "customer_iban", "customer_bic",
        "vehicle_id", "model", "producer", "retailer_id", "retailer_name", "rental_days",
        money("costs_per_day").alias("cost_per_day"), money(base).alias("base_cost"),
        money("extras").alias("additional_costs"), F.col("n_extras").alias("additional_services_count"),
        money(base + F.col("extras")).alias("total_cost"),
        F.array_join("extras_descriptions", ", ").alias("additional_services_list"),
    ).orderBy(F.col("start_date").desc(), "booking_id")


def one_per_request(requests: DataFrame) -> DataFrame:
    """One row per request_id, with the flag ``conflicting``.

    A request that is delivered twice with equal content is one request. Where
    one id comes with different contents, the least row stands for them and is
    marked. Rows without an id cannot be told apart and stay as they are. A batch
    that has the flag already is returned as it is.
    """
    if "conflicting" in requests.columns:
        return requests
    cols = [c for c in requests.columns if c != "request_id"]
    content = F.struct(*cols)
    known = requests.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.min(content).alias("c"), (F.min(content) != F.max(content)).alias("conflicting"))
    anonymous = requests.where(F.col("request_id").isNull()).withColumn("conflicting", F.lit(False))
    return known.select("request_id", "c.*", "conflicting").unionByName(anonymous)


def quote_services(tables, selections: DataFrame) -> DataFrame:
    """What-if price of a selection of services for a booking.

    ``selections`` has (request_id, booking_id, service_ids). Selected ids
    count only when they are in the catalogue and not yet on the booking.
    Totals add doubles in the order base + booked + selected.
    """
    sel = one_per_request(selections.select("request_id", "booking_id", "service_ids")).drop("conflicting")
    # staged, so that a booking that many requests name is split in the join below
    totals = staged(booking_totals(tables, sel), "quote-totals").select("booking_id", "base_cost", F.col("extras_cost").alias("booked_extras"))
    picked = sel.select("request_id", "booking_id",
                        F.explode(F.array_distinct("service_ids")).alias("additional_service_id"))
    new = (picked.join(tables["booking_service"], ["booking_id", "additional_service_id"], "left_anti")
           .join(tables["additional_service"], "additional_service_id")
           .groupBy("request_id").agg(F.sum(money("costs")).alias("selected_extras")))
    out = fact_join(sel, totals, "booking_id", "left").join(new, "request_id", "left")
    base = F.coalesce(F.col("base_cost"), F.lit(0.0))
    booked = F.coalesce(F.col("booked_extras"), F.lit(0.0))
    selected = F.coalesce(F.col("selected_extras"), F.lit(0.0))
    return out.select("request_id", "booking_id", base.alias("base_cost"), booked.alias("booked_extras"),
                      selected.alias("selected_extras"), (base + booked + selected).alias("total_cost"))
