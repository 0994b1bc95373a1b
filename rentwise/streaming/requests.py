"""Request intake as Structured Streaming jobs.

Booking requests (R4) and add-service requests (R8) arrive one at a time in
the source; here they arrive as files in a folder and are handled per
micro-batch with the batch operators of :mod:`rentwise.operators.jobs`.
Each micro-batch reads the current tables, so bookings accepted in one batch
are visible to the next.

Delivery is at-least-once (``foreachBatch``), so every write of a batch is
idempotent: outcomes go to ``outcome/batch_id=<id>`` with overwrite, changes of
the stored tables are published once per batch id.
Progress is kept in ``checkpoint_location`` (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rentwise.operators import jobs
from rentwise.session import checkpoint_dir
from rentwise.operators.documents import compact_docs
from rentwise.sources.tables import compact_tables, load_tables

BOOKING_REQUEST_SCHEMA = ("request_id string, customer_id string, vehicle_id string, start_date date, "
                          "end_date date, way_of_billing string")
SERVICE_REQUEST_SCHEMA = ("request_id string, booking_id string, customer_id string, "
                          "service_ids array<string>, confirm_payment boolean")


def request_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of requests as an unbounded DataFrame (schema given, no inference)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def _write_outcome(outcome: DataFrame, out_dir: str, batch_id: int) -> None:
    outcome.write.mode("overwrite").parquet(f"{out_dir}/outcome/batch_id={batch_id}")


def _batch_name(spark: SparkSession, kind: str, batch_id: int) -> str | None:
    """A micro-batch under the id of its running query, which its checkpoint folder keeps; None outside a query.

    A query that starts with a new checkpoint has a new id, so its batches are never taken for earlier ones.
    """
    ids = [q.id for q in spark.streams.active if q.name == f"{kind}_intake"]
    return f"{ids[0]}-{batch_id}" if ids else None


def handle_booking_batch(spark: SparkSession, tables_dir: str, out_dir: str):
    """foreachBatch function for booking requests."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        tables = load_tables(spark, tables_dir)
        outcome = jobs.run_create_bookings(spark, tables, batch, tables_dir, _batch_name(spark, "booking", batch_id))
        _write_outcome(outcome, out_dir, batch_id)
    return handle


def handle_doc_booking_batch(spark: SparkSession, docs_dir: str, out_dir: str):
    """foreachBatch function for booking requests against the documents."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        name = _batch_name(spark, "doc_booking", batch_id)
        _write_outcome(jobs.run_doc_create_bookings(spark, batch, docs_dir, name), out_dir, batch_id)
    return handle


def handle_service_batch(spark: SparkSession, tables_dir: str, out_dir: str, as_of: str | None = None):
    """foreachBatch function for add-service requests (R8); ``as_of`` defaults to the day of the batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        name = _batch_name(spark, "service", batch_id)
        _write_outcome(jobs.run_add_services(spark, batch, as_of, tables_dir, name), out_dir, batch_id)
    return handle


def handle_doc_service_batch(spark: SparkSession, docs_dir: str, out_dir: str, as_of: str | None = None):
    """foreachBatch function for add-service requests against the documents."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        name = _batch_name(spark, "doc_service", batch_id)
        _write_outcome(jobs.run_doc_add_services(spark, batch, as_of, docs_dir, name), out_dir, batch_id)
    return handle


def compacting(handler, compact, every: int):
    """``handler``, with the stored tables compacted after each ``every``-th batch.

    The changes that a read has to merge stay bounded by that many batches. Compaction changes no row, so a batch that is
    replayed after it finds its rows as before.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        handler(batch, batch_id)
        if (batch_id + 1) % every == 0:
            compact()
    return handle


def start_intake(spark: SparkSession, kind: str, requests_path: str, tables_dir: str, out_dir: str,
                 checkpoint_location: str, as_of: str | None = None, available_now: bool = False,
                 compact_every: int = 100, max_files_per_trigger: int = 100) -> StreamingQuery:
    """Start the intake stream of ``kind``: 'booking' (R4), 'service' (R8), 'doc_booking' (N3) or 'doc_service' (N8).

    For the last two, ``tables_dir`` is the folder of the document collections. The changes are
    compacted after every ``compact_every`` batches.
    """
    checkpoint_dir(spark)  # judged batches are stored in the shared folder
    if kind == "booking":
        stream = request_stream(spark, requests_path, BOOKING_REQUEST_SCHEMA, max_files_per_trigger)
        handler = handle_booking_batch(spark, tables_dir, out_dir)
    elif kind == "doc_booking":
        stream = request_stream(spark, requests_path, BOOKING_REQUEST_SCHEMA, max_files_per_trigger)
        handler = handle_doc_booking_batch(spark, tables_dir, out_dir)
    elif kind == "service":
        stream = request_stream(spark, requests_path, SERVICE_REQUEST_SCHEMA, max_files_per_trigger)
        handler = handle_service_batch(spark, tables_dir, out_dir, as_of)
    elif kind == "doc_service":
        stream = request_stream(spark, requests_path, SERVICE_REQUEST_SCHEMA, max_files_per_trigger)
        handler = handle_doc_service_batch(spark, tables_dir, out_dir, as_of)
    else:
        raise ValueError(f"unknown request kind: {kind}")
    compact = (lambda: compact_docs(spark, tables_dir)) if kind.startswith("doc_") else (lambda: compact_tables(spark, tables_dir))
    writer = (stream.writeStream.foreachBatch(compacting(handler, compact, compact_every)).option("checkpointLocation", checkpoint_location)
              .queryName(f"{kind}_intake"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_outcomes(spark: SparkSession, out_dir: str) -> DataFrame:
    """All outcome rows written so far, with their batch id."""
    return spark.read.parquet(f"{out_dir}/outcome").withColumn("batch_id", F.col("batch_id").cast("long"))
