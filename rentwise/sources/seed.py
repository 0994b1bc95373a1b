"""The initial data set and a load that runs only into an empty model.

The golden rows are small and fixed; they are also the hand-checked fixture of
the tests (bookings and links included).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from rentwise import schema
from rentwise.sources.tables import SERVICE_CATALOGUE, load_tables, write_tables

# The initial data set of the marketplace.
SEED_PERSONS = [
    ("p_cust1", "Alice Example", "0676123456", "alice@example.com", "Main Street 1", 4.5),
    ("p_cust2", "Bob Sunny", "0660123456", "bob@example.com", "Sunny Road 3", 4.6),
    ("p_cust3", "Clara Fast", "0677123987", "clara@example.com", "Linden Street 9", 4.4),
    ("p_ret1", "Blue Cars Ltd.", "0123456789", "office@bluecars.com", "Ring Road 2", 4.7),
    ("p_ret2", "Green Motors", "0133557799", "office@greenmotors.com", "Park Avenue 7", 4.8),
    ("p_both1", "Dana Dual", "0650444555", "dana@dual.example", "Harbor Lane 5", 4.3),
]
SEED_CUSTOMERS = [
    ("p_cust1", "C-1001", "AB1234567"),
    ("p_cust2", "C-2002", "CD7654321"),
    ("p_cust3", "C-3003", "EF1112223"),
    ("p_both1", "C-4004", "GH9988776"),
]
SEED_RETAILERS = [
    ("p_ret1", "Blue Cars Ltd.", "ATU12345678"),
    ("p_ret2", "Green Motors", "ATU23456789"),
    ("p_both1", "Dual Mobility", "ATU34567890"),
]
SEED_ACCOUNTS = [
    ("ba1", "AT611904300234573201", "BKAUATWW", "p_cust1"),
    ("ba2", "AT021100000012345678", "BKAUATWW", "p_cust2"),
    ("ba3", "AT471100000077778888", "BKAUATWW", "p_cust3"),
    ("ba4", "AT180000000000000001", "BKAUATWW", "p_ret1"),
    ("ba5", "AT900000000000000002", "BKAUATWW", "p_ret2"),
    ("ba6", "AT520000000000000003", "BKAUATWW", "p_both1"),
]
SEED_VEHICLES = [
    ("veh1", "Fiesta", "Ford", "70.00", "W-AB123C", 5, "p_ret1"),
    ("veh2", "Golf", "Volkswagen", "80.00", "W-GR2345", 5, "p_ret2"),
    ("veh3", "Yaris", "Toyota", "60.00", "W-RT7890", 5, "p_both1"),
    ("veh4", "Enyaq", "Skoda", "95.00", "W-DN4321", 5, "p_ret1"),
]
SEED_BOOKINGS = [
    ("b1", "2026-01-05", "2026-01-10", "CreditCard", "p_cust1", "veh1"),
    ("b2", "2026-02-01", "2026-02-03", "Invoice", "p_cust2", "veh2"),
    ("b3", "2026-03-10", "2026-03-15", "PayPal", "p_cust3", "veh3"),
    ("b4", "2026-04-05", "2026-04-07", "CreditCard", "p_both1", "veh4"),
    ("b5", "2026-05-12", "2026-05-18", "CreditCard", "p_cust1", "veh3"),
]
SEED_LINKS = [
    ("b1", "as1"), ("b1", "as4"), ("b2", "as3"), ("b3", "as2"),
    ("b3", "as5"), ("b4", "as4"), ("b5", "as1"), ("b5", "as3"),
]
SEED_RATINGS = [
    ("p_cust1", "p_ret1", 4.8),
    ("p_ret1", "p_cust1", 4.2),
    ("p_cust2", "p_ret2", 4.6),
    ("p_ret2", "p_cust2", 4.5),
    ("p_cust3", "p_both1", 4.1),
    ("p_both1", "p_cust3", 4.7),
]


def seed_tables(spark: SparkSession, with_bookings: bool = True) -> dict[str, DataFrame]:
    """The initial data set as DataFrames (bookings and links optional)."""
    day = dt.date.fromisoformat
    rows = {
        "person": SEED_PERSONS,
        "rating": SEED_RATINGS,
        "customer": SEED_CUSTOMERS,
        "retailer": SEED_RETAILERS,
        "bankaccount": SEED_ACCOUNTS,
        "vehicle": [(v, m, p, Decimal(c), pl, n, r) for v, m, p, c, pl, n, r in SEED_VEHICLES],
        "booking": [(b, day(s), day(e), None, w, c, v) for b, s, e, w, c, v in SEED_BOOKINGS] if with_bookings else [],
        "additional_service": [(a, d, Decimal(c)) for a, d, c in SERVICE_CATALOGUE],
        "booking_service": SEED_LINKS if with_bookings else [],
    }
    return {name: spark.createDataFrame(data, schema.SCHEMAS[name]) for name, data in rows.items()}


def seed_status(spark: SparkSession, target_dir: str) -> bool:
    """True when the model under ``target_dir`` holds data (its Person table has a row).

    ``isEmpty`` stops at the first row found, so the check reads one split;
    a missing target counts as empty.
    """
    try:
        return not load_tables(spark, target_dir, ["person"])["person"].isEmpty()
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return False


def bootstrap_if_empty(spark: SparkSession, source: dict[str, DataFrame], target_dir: str) -> bool:
    """Store ``source`` in ``target_dir`` only when its Person table has no row.

    Returns True when data was loaded and False when the model was already
    filled ("already loaded"); a second call therefore changes nothing. All
    tables become visible together, so a load that dies halfway counts as empty.
    """
    if seed_status(spark, target_dir):
        return False
    write_tables(source, target_dir)
    return True
