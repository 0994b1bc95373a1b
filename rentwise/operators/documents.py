"""Relational → document migration (group M).

Five collections become nested DataFrames: ``persons`` (roles and account as
nullable structs), ``vehicles``, ``services``, ``ratings`` (struct key) and
``bookings`` (customer, vehicle and retailer snapshots plus an array of
extras). Dates and money are stored as text in documents, as the document
readers expect; readers convert them with the rules of
:mod:`rentwise.functions.rules`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentwise.functions.rules import START_KEY, start_key, truthy_text
from rentwise.operators.relational import with_customer
from rentwise.plans.skew import fact_join
from rentwise.sources import versions

COLLECTIONS = ["persons", "vehicles", "services", "ratings", "bookings"]

SERVICE_ENTRY = "struct<service_id:string,description:string,costs:string>"

# The stored collections, so that reading them needs no pass over the files.
DOC_SCHEMAS = {
    "persons": "_id string, name string, phone_number string, eMail string, address string, stars double, "
               "roles struct<customer:struct<customer_number:string,driver_licencse_number:string>,"
               "retailer:struct<company_name:string,tax_number:string>>, "
               "bankAccount struct<account_id:string,iban:string,bic:string>",
    "vehicles": "_id string, model string, producer string, costs_per_day string, plate_number string, "
                "number_of_seats int, retailer_id string",
    "services": "_id string, description string, costs string",
    "ratings": "_id struct<rater_id:string,rated_id:string>, stars double",
    "bookings": "_id string, start_date string, end_date string, way_of_billing string, "
                "customer struct<person_id:string,name:string>, "
                "vehicle struct<vehicle_id:string,model:string,producer:string,costs_per_day:string,"
                "plate_number:string,number_of_seats:int,retailer_id:string>, "
                f"retailer struct<person_id:string,company_name:string>, additionalServices array<{SERVICE_ENTRY}>, "
                "pricing struct<total_costs:string>",
}


def _text(col) -> F.Column:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def person_docs(tables) -> DataFrame:
    """M1: Person ⟕ Customer ⟕ Retailer ⟕ Bankaccount, folded into one document.

    A role or the account is NULL when its marker value (customer_number,
    company_name, account_id) is NULL or empty, even when the join matched.
    All four tables are keyed by the person id, so the three left joins share
    one partitioning of the person side.
    """
    person = tables["person"]
    customer = tables["customer"].withColumnRenamed("person_id", "id")
    retailer = tables["retailer"].withColumnRenamed("person_id", "id")
    account = tables["bankaccount"].withColumnRenamed("person_id", "id")
    joined = person.join(customer, "id", "left").join(retailer, "id", "left").join(account, "id", "left")
    roles = F.struct(
        F.when(truthy_text("customer_number"),
               F.struct("customer_number", "driver_licencse_number")).alias("customer"),
        F.when(truthy_text("company_name"), F.struct("company_name", "tax_number")).alias("retailer"),
    )
    bank = F.when(truthy_text("account_id"), F.struct("account_id", "iban", "bic"))
    return joined.select(
        F.col("id").alias("_id"), "name", "phone_number", "eMail", "address", "stars",
        roles.alias("roles"), bank.alias("bankAccount"),
    )


def vehicle_docs(tables) -> DataFrame:
    """M2: vehicles keyed by ``_id``; money as text."""
    return tables["vehicle"].select(
        F.col("vehicle_id").alias("_id"), "model", "producer", _text("costs_per_day").alias("costs_per_day"),
        "plate_number", "number_of_seats", "retailer_id",
    )


def service_docs(tables) -> DataFrame:
    """M3: the catalogue keyed by ``_id``; money as text."""
    return tables["additional_service"].select(
        F.col("additional_service_id").alias("_id"), "description", _text("costs").alias("costs"))


def rating_docs(tables) -> DataFrame:
    """M4: ratings with the composite key as a struct ``_id``."""
    return tables["rating"].select(F.struct("rater_id", "rated_id").alias("_id"), "stars")


def service_arrays(tables) -> DataFrame:
    """Extras of each booking as an array of entries, sorted by service id.

    Links to unknown services are skipped. The array of one booking is
    bounded by the catalogue size (the link table is keyed by booking and
    service), so collecting it per key is safe. Links are shuffled by booking as they are
    stored, two ids a row; descriptions and costs join them where they are collected.
    """
    services = tables["additional_service"]
    entry = F.struct(
        F.col("additional_service_id").alias("service_id"), "description", _text("costs").alias("costs"))
    return tables["booking_service"].repartition("booking_id").join(services, "additional_service_id").groupBy("booking_id").agg(
        F.array_sort(F.collect_list(entry)).alias("additionalServices"))


def booking_docs(tables) -> DataFrame:
    """M5: one document per booking with snapshots and an array of extras.

    Joins to customer, person, vehicle and retailer are inner, as in the
    source: bookings whose vehicle has no known retailer do not become
    documents. The extras are aggregated per booking **before** the wide join.
    """
    retailers = tables["retailer"].select(F.col("person_id").alias("retailer_id"), "company_name")
    vehicles = fact_join(tables["vehicle"], retailers, "retailer_id")
    joined = with_customer(tables["booking"], tables)
    joined = (fact_join(joined, vehicles, "vehicle_id")
              .join(service_arrays(tables), "booking_id", "left"))
    return joined.select(
        F.col("booking_id").alias("_id"),
        _text("start_date").alias("start_date"), _text("end_date").alias("end_date"), "way_of_billing",
        F.struct(F.col("customer_id").alias("person_id"), F.col("customer_name").alias("name")).alias("customer"),
        F.struct("vehicle_id", "model", "producer", _text("costs_per_day").alias("costs_per_day"),
                 "plate_number", "number_of_seats", "retailer_id").alias("vehicle"),
        F.struct(F.col("retailer_id").alias("person_id"), "company_name").alias("retailer"),
        F.coalesce(F.col("additionalServices"), F.array().cast(f"array<{SERVICE_ENTRY}>")).alias("additionalServices"),
        F.struct(_text("total_costs").alias("total_costs")).alias("pricing"),
    )


def migrate_docs(tables) -> dict[str, DataFrame]:
    return {
        "persons": person_docs(tables),
        "vehicles": vehicle_docs(tables),
        "services": service_docs(tables),
        "ratings": rating_docs(tables),
        "bookings": booking_docs(tables),
    }


def doc_specs() -> dict[str, versions.Table]:
    """How the collections are stored: bookings by the year their start text begins with, sorted by it."""
    types = {name: T.StructType.fromDDL(ddl) for name, ddl in DOC_SCHEMAS.items()}
    specs = {name: versions.Table(types[name], ("_id",)) for name in COLLECTIONS}
    specs["bookings"] = versions.Table(types["bookings"], ("_id",), START_KEY, start_key("start_date"), T.StringType(),
                                       "start_date", "end_date")
    return specs


def migrate_all(tables, out_dir: str) -> dict[str, str]:
    """M6: replace all five collections under ``out_dir`` (full refresh); returns their folders.

    Each run writes a version of its own. Readers switch to it when all five
    collections are stored, in one step; a run that dies halfway changes nothing for
    them, and a reader opened before the switch finishes on the version it began with.
    """
    spark = tables["person"].sparkSession
    return versions.refresh(spark, out_dir, migrate_docs(tables), doc_specs())


def load_docs(spark, base_dir: str) -> versions.Snapshot:
    """The collections of the last published version, with their declared schemas and all later changes."""
    return versions.load(spark, base_dir, doc_specs())


def compact_docs(spark, base_dir: str) -> list[str]:
    """Merge the changes of the write jobs into the collections; only years with a changed document are written."""
    return versions.compact(spark, base_dir, doc_specs())
