"""Relational model of the rental marketplace: nine tables and their declared rules.

Spark does not enforce keys or checks; the declarations below drive the audit
jobs in :mod:`rentwise.operators.quality` and the cascade in ``cascade_delete``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
MONEY = T.DecimalType(10, 2)


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


PERSON = _struct(("id", S, False), ("name", S, True), ("phone_number", S, True),
                 ("eMail", S, True), ("address", S, True), ("stars", T.DoubleType(), True))
RATING = _struct(("rater_id", S, False), ("rated_id", S, False), ("stars", T.DoubleType(), True))
CUSTOMER = _struct(("person_id", S, False), ("customer_number", S, True),
                   ("driver_licencse_number", S, True))
RETAILER = _struct(("person_id", S, False), ("company_name", S, True), ("tax_number", S, True))
BANKACCOUNT = _struct(("account_id", S, False), ("iban", S, True), ("bic", S, True),
                      ("person_id", S, False))
VEHICLE = _struct(("vehicle_id", S, False), ("model", S, True), ("producer", S, True),
                  ("costs_per_day", MONEY, True), ("plate_number", S, True),
                  ("number_of_seats", T.IntegerType(), True), ("retailer_id", S, True))
BOOKING = _struct(("booking_id", S, False), ("start_date", T.DateType(), False),
                  ("end_date", T.DateType(), False), ("total_costs", MONEY, True),
                  ("way_of_billing", S, True), ("customer_id", S, True), ("vehicle_id", S, True))
ADDITIONAL_SERVICE = _struct(("additional_service_id", S, False), ("description", S, True),
                             ("costs", MONEY, True))
BOOKING_SERVICE = _struct(("booking_id", S, False), ("additional_service_id", S, False))

# Table names as used by the library (lower case, one name per table).
SCHEMAS = {
    "person": PERSON,
    "rating": RATING,
    "customer": CUSTOMER,
    "retailer": RETAILER,
    "bankaccount": BANKACCOUNT,
    "vehicle": VEHICLE,
    "booking": BOOKING,
    "additional_service": ADDITIONAL_SERVICE,
    "booking_service": BOOKING_SERVICE,
}

# The declared constraints of the model.
PRIMARY_KEYS = {
    "person": ["id"],
    "rating": ["rater_id", "rated_id"],
    "customer": ["person_id"],
    "retailer": ["person_id"],
    "bankaccount": ["account_id"],
    "vehicle": ["vehicle_id"],
    "booking": ["booking_id"],
    "additional_service": ["additional_service_id"],
    "booking_service": ["booking_id", "additional_service_id"],
}

UNIQUE_COLUMNS = [
    ("customer", "customer_number"),
    ("customer", "driver_licencse_number"),
    ("retailer", "tax_number"),
    ("bankaccount", "iban"),
    ("bankaccount", "person_id"),
    ("vehicle", "plate_number"),
]

# (child table, child column, parent table, parent column); all cascade on delete.
FOREIGN_KEYS = [
    ("rating", "rater_id", "person", "id"),
    ("rating", "rated_id", "person", "id"),
    ("customer", "person_id", "person", "id"),
    ("retailer", "person_id", "person", "id"),
    ("bankaccount", "person_id", "person", "id"),
    ("vehicle", "retailer_id", "retailer", "person_id"),
    ("booking", "customer_id", "customer", "person_id"),
    ("booking", "vehicle_id", "vehicle", "vehicle_id"),
    ("booking_service", "booking_id", "booking", "booking_id"),
    ("booking_service", "additional_service_id", "additional_service", "additional_service_id"),
]

NOT_NULL_COLUMNS = [
    ("rating", "rater_id"),
    ("rating", "rated_id"),
    ("bankaccount", "person_id"),
    ("booking", "start_date"),
    ("booking", "end_date"),
]

# Columns with CHECK (value BETWEEN 0 AND 5).
STAR_COLUMNS = [("person", "stars"), ("rating", "stars")]
