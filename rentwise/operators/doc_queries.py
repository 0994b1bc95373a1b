"""The same questions answered on the nested documents (group N).

Inputs are the five collections of :mod:`rentwise.operators.documents`.
Differences from the relational twins are kept on purpose: dates compare as
text, money is converted with "0 on error", customers need no account unless
stated, and lookups that the relational model does with inner joins are left
joins with fallbacks here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentwise.functions.rules import (START_KEY, doc_rental_days, doc_start_window, given, in_partitions, num_or_zero,
                                      sorted_texts, text_order, today, where_all)
from rentwise.plans.skew import fact_join
from rentwise.sources.versions import Snapshot


def _extras_sum(arr) -> F.Column:
    """Sum of the entries' costs, each converted with 0 on error; [] and NULL give 0."""
    items = F.coalesce(arr, F.array())
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + num_or_zero(s.getField("costs")))


def doc_customers(docs, collation: str | None = None) -> DataFrame:
    """Persons with a customer role, by name; no account needed (iban may be NULL)."""
    return docs["persons"].filter(F.col("roles.customer").isNotNull()).select(
        F.col("_id").alias("person_id"), "name",
        F.col("roles.customer.customer_number").alias("customer_number"),
        F.col("roles.customer.driver_licencse_number").alias("driver_licencse_number"),
        F.col("bankAccount.iban").alias("iban"),
    ).orderBy(text_order("name", collation), "person_id")


def doc_available_vehicles(docs, start: str, end: str) -> DataFrame:
    """Vehicles whose id is not among the booked ids of the window (text dates)."""
    b = docs["bookings"]
    conditions = doc_start_window(b, upper=end) + [F.col("end_date") >= F.lit(start)]
    # stored collections know the last end text of each partition
    near = docs.overlapping("bookings", start) if isinstance(docs, Snapshot) else None
    if near is not None:
        conditions += in_partitions(START_KEY, near[0])
    booked = where_all(b, conditions).select(F.col("vehicle.vehicle_id").alias("_id")).distinct()
    return docs["vehicles"].join(booked, "_id", "left_anti").select(
        F.col("_id").alias("vehicle_id"), "model", "producer", "costs_per_day", "plate_number")


def doc_booking_cost_report(docs, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The cost report computed on the booking documents alone (no join).

    ``start_date >= from`` and ``end_date <= to`` on text; days from parsed
    dates (bad or missing text gives 1); money with 0 on error.
    """
    b = where_all(docs["bookings"], doc_start_window(docs["bookings"], lower=date_from) + [
        F.col("end_date") <= F.lit(date_to) if given(date_to) else None,
    ])
    per_day = num_or_zero("vehicle.costs_per_day")
    days = doc_rental_days("start_date", "end_date", strict=True)
    extras = _extras_sum(F.col("additionalServices"))
    base = per_day * days
    return b.select(
        "_id", F.col("_id").alias("booking_id"), F.col("customer.name").alias("customer_name"),
        F.col("vehicle.producer").alias("producer"), F.col("vehicle.model").alias("model"),
        "start_date", "end_date", per_day.alias("costs_per_day"), days.alias("days"),
        base.alias("base_cost"), extras.alias("additional_cost"), (base + extras).alias("total_cost"),
    )


def doc_customer_profiles(docs, collation: str | None = None) -> DataFrame:
    """Persons with a customer role and an account, by name."""
    return docs["persons"].filter(F.col("roles.customer").isNotNull() & F.col("bankAccount").isNotNull()).select(
        F.col("_id").alias("person_id"), "name", "eMail", "phone_number", "address",
        F.col("roles.customer.customer_number").alias("customer_number"),
        F.col("roles.customer.driver_licencse_number").alias("driver_licencse_number"),
        F.col("bankAccount.account_id").alias("account_id"), F.col("bankAccount.iban").alias("iban"),
        F.col("bankAccount.bic").alias("bic"),
    ).orderBy(text_order("name", collation), "person_id")


def doc_active_bookings(docs, as_of: str | None = None, customer_id: str | None = None) -> DataFrame:
    """Booking documents starting on or after ``as_of`` (default today); vehicle fields fall back to the vehicles collection."""
    b = where_all(docs["bookings"], doc_start_window(docs["bookings"], lower=as_of or today()) + [
        F.col("customer.person_id") == F.lit(customer_id) if customer_id is not None else None,
    ])
    ref = docs["vehicles"].select(
        F.col("_id").alias("ref_id"), F.col("model").alias("ref_model"), F.col("producer").alias("ref_producer"),
        F.col("costs_per_day").alias("ref_costs"), F.col("plate_number").alias("ref_plate"),
        F.col("number_of_seats").alias("ref_seats"))
    b = b.withColumn("__vid", F.col("vehicle.vehicle_id"))
    j = fact_join(b, ref, "__vid", "left", "ref_id").drop("__vid")
    per_day = num_or_zero(F.coalesce(F.col("vehicle.costs_per_day"), F.col("ref_costs")))
    days = doc_rental_days("start_date", "end_date")
    base = days * per_day
    extras = _extras_sum(F.col("additionalServices"))
    return j.select(
        F.col("_id").alias("booking_id"), "start_date", "end_date", "way_of_billing",
        F.col("vehicle.vehicle_id").alias("vehicle_id"), F.col("pricing.total_costs").alias("total_costs"),
        F.coalesce(F.col("vehicle.model"), F.col("ref_model")).alias("model"),
        F.coalesce(F.col("vehicle.producer"), F.col("ref_producer")).alias("producer"),
        per_day.alias("costs_per_day"),
        F.coalesce(F.col("vehicle.plate_number"), F.col("ref_plate")).alias("plate_number"),
        F.coalesce(F.col("vehicle.number_of_seats"), F.col("ref_seats")).alias("number_of_seats"),
        days.alias("days"), base.alias("base_cost"), extras.alias("extras_cost"), (base + extras).alias("total_cost"),
    ).orderBy("start_date", "booking_id")


def doc_service_options(docs, asked: DataFrame, collation: str | None = None) -> DataFrame:
    """The state of the services asked for a booking document.

    As R7, but an unknown booking gives no row at all, and a current service
    shows the description and costs stored in the booking.
    """
    pairs = asked.select(F.col("booking_id").alias("_id"), F.explode("service_ids").alias("sid")).distinct()
    held = F.filter(F.coalesce("additionalServices", F.array()), lambda s: s.getField("service_id") == F.col("sid"))
    entry = F.get(held, F.lit(0))
    services = docs["services"].select(F.col("_id").alias("sid"), F.col("description").alias("listed"),
                                       F.col("costs").alias("listed_costs"), F.lit(True).alias("known"))
    b = pairs.join(docs["bookings"].select("_id", "additionalServices"), "_id").withColumn("entry", entry)
    current = F.col("entry").isNotNull()
    status = F.when(current, "current").when(F.col("known"), "available").otherwise("unknown")
    return b.join(services, "sid", "left").select(
        F.col("_id").alias("booking_id"), status.alias("status"), F.col("sid").alias("additional_service_id"),
        F.when(current, F.col("entry.description")).otherwise(F.col("listed")).alias("description"),
        F.when(current, F.col("entry.costs")).otherwise(F.col("listed_costs")).alias("costs"),
    ).orderBy("booking_id", "status", text_order("description", collation))


def doc_service_booking_report(docs, date_from: str | None = None, date_to: str | None = None,
                               collation: str | None = None) -> DataFrame:
    """Bookings with extras, from the documents plus two person lookups.

    Account data come from the customer's person document (left: NULL kept).
    The retailer id falls back from the booking's retailer to the vehicle's,
    its name from the booking to the retailer's person document.
    """
    b = where_all(docs["bookings"], doc_start_window(docs["bookings"], date_from, date_to, upper_inclusive=False) + [
        F.size(F.coalesce(F.col("additionalServices"), F.array())) > 0])
    persons = docs["persons"]
    accounts = persons.select(F.col("_id").alias("acct_person"), F.col("bankAccount.iban").alias("customer_iban"),
                              F.col("bankAccount.bic").alias("customer_bic"))
    companies = persons.select(F.col("_id").alias("ret_person"),
                               F.col("roles.retailer.company_name").alias("ret_company"))
    retailer_id = F.coalesce(F.col("retailer.person_id"), F.col("vehicle.retailer_id"))
    b = b.withColumn("rid", retailer_id).withColumn("__cust", F.col("customer.person_id"))
    j = fact_join(b, accounts, "__cust", "left", "acct_person")
    j = fact_join(j, companies, "rid", "left", "ret_person").drop("__cust")
    days = doc_rental_days("start_date", "end_date")
    per_day = num_or_zero("vehicle.costs_per_day")
    base = days * per_day
    extras = _extras_sum(F.col("additionalServices"))
    names = F.array_join(sorted_texts(F.transform("additionalServices", lambda s: s.getField("description")), collation), ", ")
    return j.select(
        F.col("_id").alias("booking_id"), "start_date", "end_date",
        F.col("customer.person_id").alias("customer_id"), F.col("customer.name").alias("customer_name"),
        "customer_iban", "customer_bic",
        F.col("vehicle.vehicle_id").alias("vehicle_id"), F.col("vehicle.model").alias("model"),
        F.col("vehicle.producer").alias("producer"), F.col("rid").alias("retailer_id"),
        F.coalesce(F.col("retailer.company_name"), F.col("ret_company")).alias("retailer_name"),
        days.alias("rental_days"), per_day.alias("cost_per_day"), base.alias("base_cost"),
        extras.alias("additional_costs"), F.size("additionalServices").cast("bigint").alias("additional_services_count"),
        (base + extras).alias("total_cost"),
        F.when(names != "", names).alias("additional_services_list"),
    ).orderBy(F.col("start_date").desc(), "booking_id")
