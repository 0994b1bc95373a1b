"""Sources and sinks for the nine rental tables (S1, S5) and the service catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentwise import schema
from rentwise.functions.rules import START_YEAR
from rentwise.sources import versions

# The catalogue of additional services (id, description, costs).
SERVICE_CATALOGUE = [
    ("as1", "ChildSeat", "20.00"),
    ("as2", "ExtraDriver", "30.00"),
    ("as3", "Navigation", "15.00"),
    ("as4", "FullInsurance", "50.00"),
    ("as5", "WinterTires", "25.00"),
]


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def catalogue_frame(spark: SparkSession) -> DataFrame:
    """The catalogue as an inline VALUES relation.

    It is planned as a JVM-side local relation with an exact size, so the
    optimizer broadcasts it without a Python worker or a sizing job.
    """
    values = ", ".join(f"({_sql_text(sid)}, {_sql_text(desc)}, CAST({cost} AS DECIMAL(10,2)))"
                       for sid, desc, cost in SERVICE_CATALOGUE)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(additional_service_id, description, costs)")


def table_specs() -> dict[str, versions.Table]:
    """How the nine tables are stored: bookings by start year, sorted by start date; all others as plain folders."""
    specs = {name: versions.Table(schema.SCHEMAS[name], tuple(keys)) for name, keys in schema.PRIMARY_KEYS.items()}
    specs["booking"] = versions.Table(schema.BOOKING, ("booking_id",), START_YEAR, F.year("start_date"), T.IntegerType(),
                                      "start_date", "end_date")
    return {name: specs[name] for name in schema.SCHEMAS}


def load_tables(spark: SparkSession, base_dir: str, names=None) -> versions.Snapshot:
    """The rental tables of the last state published in ``base_dir``, with their declared schemas.

    An explicit schema means no inference pass over the files (and an empty
    table still reads); column pruning and filter pushdown reach the Parquet
    scan as usual. Older booking files without ``total_costs`` read it as NULL
    (S5). A folder without states is read as plain folders ``base_dir/<name>``.
    """
    return versions.load(spark, base_dir, table_specs(), names)


def register_views(tables: dict[str, DataFrame], prefix: str = "rental_") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def conform_bookings(bookings: DataFrame) -> DataFrame:
    """Add ``total_costs DECIMAL(10,2)`` as NULL when the column is missing.

    Columns are then put into the declared order and types, so every later
    union or write sees the same schema.
    """
    if "total_costs" not in bookings.columns:
        bookings = bookings.withColumn("total_costs", F.lit(None).cast(schema.MONEY))
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.BOOKING.fields]
    if START_YEAR in bookings.columns:  # keep the partition column for pruning
        cols.append(F.col(START_YEAR))
    return bookings.select(*cols)


def write_tables(tables: dict[str, DataFrame], base_dir: str) -> dict[str, str]:
    """Replace the tables under ``base_dir`` together (full refresh); ``booking`` is partitioned by start year.

    Date-range reports then prune whole years at the scan. Readers see the new
    tables when all of them are written.
    """
    spark = next(iter(tables.values())).sparkSession
    return versions.refresh(spark, base_dir, tables, table_specs())


def write_table(df: DataFrame, name: str, base_dir: str) -> None:
    """A plain folder ``base_dir/<name>``, for folders without published states."""
    versions.write_folder(df, table_specs()[name], f"{base_dir}/{name}")


def compact_tables(spark: SparkSession, base_dir: str) -> list[str]:
    """Merge the changes of the write jobs into the stored tables; only start years with a changed booking are written."""
    return versions.compact(spark, base_dir, table_specs())
