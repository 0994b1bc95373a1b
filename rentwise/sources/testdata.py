"""Rental tables derived from the driver's synthetic tables.

The driver ships TPC-H-like tables (``customer supplier part orders lineitem
events``). This module maps them lazily onto the nine rental tables, so every
rental query reads the given parquet files and its work grows with them.
The mapping is fixed (it is also the ``WITH`` prefix of the SQL oracle) and
forces the edge cases of the model: customers without account, persons with
both roles, vehicles without or with an unknown retailer, same-day bookings,
bookings without extras.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentwise import schema

# Parameters of the test workload over the driver's tables.
REPORT_FROM = "1998-01-01"
REPORT_TO = "1998-12-31"
SERVICE_REPORT_TO = "1999-01-01"
WINDOW_START = "1998-03-01"
WINDOW_END = "1998-06-30"
AS_OF = "2001-01-01"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), F.col(col) if isinstance(col, str) else col)


def rental_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine rental tables as lazy DataFrames over ``sf_dir``."""
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    part = _read(spark, sf_dir, "part")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    c, s = F.col("c_custkey"), F.col("s_suppkey")

    person = customer.select(
        _id("c_", c).alias("id"), F.col("c_name").alias("name"), _id("ph_", c).alias("phone_number"),
        F.concat(F.lower("c_name"), F.lit("@x.example")).alias("eMail"),
        _id("n_", "c_nationkey").alias("address"), (c % 6).cast("double").alias("stars"),
    ).unionByName(supplier.select(
        _id("s_", s).alias("id"), F.col("s_name").alias("name"), _id("ph_s", s).alias("phone_number"),
        F.concat(F.lower("s_name"), F.lit("@x.example")).alias("eMail"),
        _id("n_", "s_nationkey").alias("address"), (s % 6).cast("double").alias("stars"),
    ))

    rental_customer = customer.select(
        _id("c_", c).alias("person_id"), _id("C-", c).alias("customer_number"),
        _id("DL", c).alias("driver_licencse_number"))

    retailer = supplier.select(
        _id("s_", s).alias("person_id"), F.col("s_name").alias("company_name"),
        _id("ATU", s).alias("tax_number"),
    ).unionByName(customer.filter(c % 50 == 0).select(
        _id("c_", c).alias("person_id"), _id("Dual ", c).alias("company_name"),
        _id("ATUC", c).alias("tax_number")))

    bankaccount = customer.filter(c % 11 != 0).select(
        _id("ba_c", c).alias("account_id"), _id("AT", c).alias("iban"),
        _id("BIC", c % 7).alias("bic"), _id("c_", c).alias("person_id"),
    ).unionByName(supplier.select(
        _id("ba_s", s).alias("account_id"), _id("ATS", s).alias("iban"),
        _id("BIC", s % 7).alias("bic"), _id("s_", s).alias("person_id")))

    p = F.col("p_partkey")
    vehicle = part.select(
        _id("v_", p).alias("vehicle_id"), F.col("p_type").alias("model"),
        F.col("p_brand").alias("producer"),
        F.col("p_retailprice").cast(schema.MONEY).alias("costs_per_day"),
        _id("W-", p).alias("plate_number"), (F.lit(2) + F.col("p_size") % 6).cast("int").alias("number_of_seats"),
        F.when(p % 37 == 0, F.lit(None).cast("string"))
         .when(p % 41 == 0, F.lit("c_0"))
         .otherwise(_id("s_", p % 10)).alias("retailer_id"),
    )

    # The vehicle of an order is spread over all parts: one count of the part
    # table (answered from Parquet footers), inlined as a literal.
    n_parts = part.count()
    o = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    booking = orders.select(
        _id("b_", o).alias("booking_id"), start.alias("start_date"),
        F.date_add(start, (o % 15).cast("int")).alias("end_date"),
        F.col("o_totalprice").cast(schema.MONEY).alias("total_costs"),
        F.col("o_orderpriority").alias("way_of_billing"), _id("c_", "o_custkey").alias("customer_id"),
        _id("v_", (o * 7) % n_parts).alias("vehicle_id"),
    )

    # Every supplier offers one extra, so the catalogue grows with the data.
    additional_service = supplier.select(
        _id("as", s).alias("additional_service_id"), F.concat(F.lit("Extra of "), "s_name").alias("description"),
        (F.lit(10) + s % 50).cast(schema.MONEY).alias("costs"))

    # lineitem repeats (orderkey, suppkey); the link table has a key, hence distinct.
    booking_service = lineitem.select(
        _id("b_", "l_orderkey").alias("booking_id"), _id("as", "l_suppkey").alias("additional_service_id"),
    ).distinct()

    rating = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(
        F.min(F.col("l_linenumber") % 6).alias("m")).select(
        _id("c_", "o_custkey").alias("rater_id"), _id("s_", "l_suppkey").alias("rated_id"),
        F.col("m").cast("double").alias("stars"))

    return {
        "person": person,
        "rating": rating,
        "customer": rental_customer,
        "retailer": retailer,
        "bankaccount": bankaccount,
        "vehicle": vehicle,
        "booking": booking,
        "additional_service": additional_service,
        "booking_service": booking_service,
    }


def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of booking requests taken from all events (with missing and unknown values)."""
    events = _read(spark, sf_dir, "events")
    part = _read(spark, sf_dir, "part")
    e = F.col("event_id")
    n_parts = part.count()
    start = F.col("ts").cast("date")
    return events.select(
        _id("req_", e).alias("request_id"),
        F.when(e % 37 == 0, F.lit(None).cast("string")).when(e % 19 == 0, F.lit("c_missing"))
         .otherwise(_id("c_", "user_id")).alias("customer_id"),
        F.when(e % 23 == 0, F.lit("v_missing")).otherwise(_id("v_", e % n_parts)).alias("vehicle_id"),
        start.alias("start_date"),
        F.when(e % 29 == 0, F.lit(None).cast("date")).otherwise(F.date_add(start, (e % 6).cast("int"))).alias("end_date"),
        F.when(e % 31 == 0, F.lit(None).cast("string")).otherwise(F.lit("BANK_TRANSFER")).alias("way_of_billing"),
    )


def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of add-service requests from all events; many name a booking that does not exist."""
    events = _read(spark, sf_dir, "events")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    e = F.col("event_id")
    ids = F.when(e % 17 == 0, F.lit(None).cast("array<string>")) \
        .when(e % 13 == 0, F.array(F.lit("as_missing"))) \
        .otherwise(F.array(_id("as", e % 5 + 1), _id("as", e % 3 + 1)))
    return events.join(orders, orders.o_orderkey == e, "left").select(
        _id("req_", e).alias("request_id"), _id("b_", e).alias("booking_id"),
        F.when(e % 37 == 0, F.lit(None).cast("string")).when(e % 7 == 0, F.lit("c_missing"))
         .otherwise(_id("c_", F.coalesce("o_custkey", "user_id"))).alias("customer_id"),
        ids.alias("service_ids"),
        (e % 19 != 0).alias("confirm_payment"),
    )


# Rows that the broken variant lacks, by the end of their key.
MISSING = [("person", "id", "7"), ("retailer", "person_id", "4"), ("additional_service", "additional_service_id", "9"),
           ("booking", "booking_id", "33")]


def dirty_batches(spark: SparkSession, sf_dir: str, tables) -> list[tuple[dict, dict]]:
    """Two batches (inserted, deleted) that break the tables for the audits.

    First parents go (each of the ten references loses some) and requests come as bookings (repeated keys,
    unknown and missing customers and vehicles, missing dates); then links come
    repeated and ratings with stars out of range.
    """
    names = [f.name for f in schema.BOOKING.fields]
    asked = booking_requests(spark, sf_dir).withColumn(
        "booking_id", F.concat(F.lit("b_"), F.expr("substr(request_id, 5)"))).withColumn(
        "total_costs", F.lit(None).cast(schema.MONEY)).select(names)
    gone = {name: tables[name].where(F.col(key).endswith(end)) for name, key, end in MISSING}
    links = _read(spark, sf_dir, "lineitem").select(
        _id("b_", "l_orderkey").alias("booking_id"), _id("as", "l_suppkey").alias("additional_service_id"))
    ratings = tables["rating"].withColumn("stars", F.col("stars") * 2 - 1)
    return [({"booking": asked}, gone),
            ({"booking_service": links, "rating": ratings}, {n: tables[n] for n in ("booking_service", "rating")})]


def added_tables(spark: SparkSession, sf_dir: str, tables) -> dict[str, DataFrame]:
    """The tables with all rows that :func:`dirty_batches` bring and none taken away, for the audit of keys."""
    (came, _), (replaced, _) = dirty_batches(spark, sf_dir, tables)
    names = [f.name for f in schema.BOOKING.fields]
    return dict(tables, **replaced) | {"booking": tables["booking"].select(names).unionByName(came["booking"])}


def dirty_tables(spark: SparkSession, sf_dir: str, tables) -> dict[str, DataFrame]:
    """The tables after :func:`dirty_batches`."""
    (came, _), (replaced, _) = dirty_batches(spark, sf_dir, tables)
    kept = {name: tables[name].where(~F.col(key).endswith(end)) for name, key, end in MISSING}
    names = [f.name for f in schema.BOOKING.fields]
    return dict(tables, **kept, **replaced) | {"booking": kept["booking"].select(names).unionByName(came["booking"])}
