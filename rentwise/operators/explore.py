"""Table exploration and report export: S3 preview, S4 search, R12 display export."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentwise.functions.rules import START_KEY, START_YEAR, euro_text, number_text

# The tables a user may preview, by their display names.
PREVIEW_TABLES = {
    "Person": "person",
    "Rating": "rating",
    "Customer": "customer",
    "Retailer": "retailer",
    "Bankaccount": "bankaccount",
    "Vehicle": "vehicle",
    "Booking": "booking",
    "AdditionalService": "additional_service",
    "Bookings_Services": "booking_service",
}
DEFAULT_PREVIEW = 50
MAX_PREVIEW = 500


def clamp_limit(limit) -> int:
    """Row limit of a preview: the leading integer of the text or number, default 50, clamped to 1..500."""
    found = re.match(r"\s*([+-]?\d+)", str(limit)) if limit is not None else None
    return min(max(int(found[1]), 1), MAX_PREVIEW) if found else DEFAULT_PREVIEW


def preview_table(tables, name: str, limit=DEFAULT_PREVIEW) -> DataFrame:
    """S3: the first ``limit`` rows of an allowed table, in no defined order.

    The limit reaches the scan (``CollectLimit`` stops after enough rows);
    ``df.columns`` still lists the columns of an empty table.
    """
    key = PREVIEW_TABLES.get(name, name if name in PREVIEW_TABLES.values() else None)
    if key is None:
        raise ValueError(f"Unknown table: {name}")
    df = tables[key]
    return _model(df).limit(clamp_limit(limit))


def _model(df: DataFrame) -> DataFrame:
    """Without the columns of the storage layout, which are not part of the model."""
    return df.drop(*[c for c in (START_YEAR, START_KEY) if c in df.columns])


def _cell_text(df: DataFrame, col_name: str) -> F.Column:
    col = F.col(f"`{col_name}`")
    number = isinstance(df.schema[col_name].dataType, (T.DoubleType, T.FloatType))
    return F.lower(F.coalesce(number_text(col) if number else col.cast("string"), F.lit("")))


def cell_texts(df: DataFrame) -> F.Column:
    """The searched texts of a row, one per column of the model."""
    return F.array(*[_cell_text(df, c) for c in _model(df).columns])


def search_condition(df: DataFrame, query: str | None):
    """Row predicate: some column, as lower-case text (NULL as ''), contains the trimmed query."""
    q = (query or "").strip().lower()
    if not q:
        return None
    return reduce(lambda a, b: a | b, [F.contains(_cell_text(df, c), F.lit(q)) for c in df.columns])


def search_rows(df: DataFrame, query: str | None) -> DataFrame:
    """Rows matching the query in any column; an empty query keeps all rows."""
    df = _model(df)
    cond = search_condition(df, query)
    return df if cond is None else df.filter(cond)


def search_counts(df: DataFrame, query: str | None) -> DataFrame:
    """S4 counts: matching and total rows in one pass (one row)."""
    df = _model(df)
    cond = search_condition(df, query)
    matched = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.agg(matched.alias("matched_rows"), F.count(F.lit(1)).alias("total_rows"))


def _cell(col_name: str) -> F.Column:
    return F.coalesce(F.col(col_name).cast("string"), F.lit(""))


def service_report_export(report: DataFrame) -> DataFrame:
    """The service report (R10/N9 columns) as display text.

    Money as euro text, "name (id)" columns, "-" when a list or an account is
    missing. The result can be written with ``write.csv``.
    """
    services = F.when(F.coalesce(F.col("additional_services_list"), F.lit("")) != "",
                      F.concat(F.col("additional_services_list"), F.lit(" ("),
                               _cell("additional_services_count"), F.lit(")"))).otherwise(F.lit("-"))
    account = F.when(F.coalesce(F.col("customer_iban"), F.lit("")) != "",
                     F.concat(F.col("customer_iban"), F.lit(" / "), _cell("customer_bic"))).otherwise(F.lit("-"))
    return report.select(
        _cell("booking_id").alias("Booking"),
        F.concat(_cell("customer_name"), F.lit(" ("), _cell("customer_id"), F.lit(")")).alias("Customer"),
        F.concat(_cell("retailer_name"), F.lit(" ("), _cell("retailer_id"), F.lit(")")).alias("Retailer"),
        F.concat(_cell("producer"), F.lit(" "), _cell("model"), F.lit(" ("), _cell("vehicle_id"), F.lit(")")).alias("Vehicle"),
        account.alias("Bank account"),
        F.concat(_cell("start_date"), F.lit(" → "), _cell("end_date")).alias("Period"),
        _cell("rental_days").alias("Days"),
        euro_text("base_cost").alias("Base cost"),
        services.alias("Additional services"),
        euro_text("additional_costs").alias("Additional cost"),
        euro_text("total_cost").alias("Total"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
