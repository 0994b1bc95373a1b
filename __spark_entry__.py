"""

value-hash). Every query reads the driver's tables through the mapping in
``rentwise.sources.testdata`` and returns a flat result (``checks.normalize``).
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import oracle  # noqa: E402
from checks.normalize import flatten  # noqa: E402
from rentwise.session import apply_scale_conf, staged, tables_dir  # noqa: E402
from rentwise.sources import testdata as td  # noqa: E402
from rentwise.sources import versions  # noqa: E402
from rentwise import schema  # noqa: E402
from rentwise.functions.rules import START_KEY, START_YEAR, TABLE_ORDER  # noqa: E402
from rentwise.sources.tables import compact_tables, conform_bookings, load_tables, write_tables  # noqa: E402
from rentwise.operators import doc_queries as N  # noqa: E402
from rentwise.operators import documents as M  # noqa: E402
from rentwise.operators import explore as X  # noqa: E402
from rentwise.operators import jobs as J  # noqa: E402
from rentwise.operators import key_counts as K  # noqa: E402
from rentwise.operators import quality as Q  # noqa: E402
from rentwise.operators import search_index as I  # noqa: E402, E741
from rentwise.operators import relational as R  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


_CACHE: dict = {}


def _stored(spark: SparkSession, sf_dir: str, what: str, build):
    """Write what ``build`` derives from the driver's tables once per session, then read it back.

    The rental model lives in stored tables (as in the source's database), so
    every query runs on Parquet scans with pushdown and pruning; the folder is the
    one configured for tables (``spark.rentwise.tables.dir``), else the session's checkpoint folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir, what)
    owner, value = _CACHE.get(key, (None, None))
    if owner is not spark:  # first use, or a new session: never reuse another session's plans
        apply_scale_conf(spark)
        base = tables_dir(spark).rstrip("/") + f"/{what}-{uuid.uuid4().hex[:12]}"
        value = build(spark, sf_dir, base)
        _CACHE[key] = (spark, value)
    return value


def _build_tables(spark, sf_dir, base):
    write_tables(td.rental_tables(spark, sf_dir), base)
    return load_tables(spark, base)


def _build_docs(spark, sf_dir, base):
    M.migrate_all(_tables(spark, sf_dir), base)
    return M.load_docs(spark, base)


def _build_requests(spark, sf_dir, base):
    td.booking_requests(spark, sf_dir).write.parquet(base + "/booking_requests")
    td.service_requests(spark, sf_dir).write.parquet(base + "/service_requests")
    return {name: spark.read.parquet(f"{base}/{name}") for name in ("booking_requests", "service_requests")}


def _build_services(spark, sf_dir, base):
    """R8 through its write job on a fork of the stored tables: outcome, and the tables merged on read."""
    versions.fork(spark, _tables(spark, sf_dir).root, base)
    outcome = J.run_add_services(spark, _service_requests(spark, sf_dir), td.AS_OF, base, "requests")
    outcome.write.parquet(base + "/outcome")
    return spark.read.parquet(base + "/outcome"), load_tables(spark, base)


def _build_compacted(spark, sf_dir, base):
    """The tables after R8's write job, compacted."""
    versions.fork(spark, _services(spark, sf_dir)[1].root, base)
    compact_tables(spark, base)
    return load_tables(spark, base)


def _build_doc_services(spark, sf_dir, base):
    """N8 through its write job on a fork of the stored collections."""
    versions.fork(spark, _docs(spark, sf_dir).root, base)
    outcome = J.run_doc_add_services(spark, _service_requests(spark, sf_dir), td.AS_OF, base, "requests")
    outcome.write.parquet(base + "/outcome")
    return spark.read.parquet(base + "/outcome"), M.load_docs(spark, base)


def _build_dirty(spark, sf_dir, base):
    """The broken variant of the tables, stored once for all audits."""
    tables = _tables(spark, sf_dir)
    dirty = td.dirty_tables(spark, sf_dir, tables)
    changed = {name: df for name, df in dirty.items() if df is not tables[name]}
    for name, df in changed.items():
        df.write.parquet(f"{base}/{name}")
    return dict(dirty, **{name: spark.read.parquet(f"{base}/{name}") for name in changed})


def _build_deleted(spark, sf_dir, base):
    """Q4 through its write job on a fork of the stored tables."""
    tables = _tables(spark, sf_dir)
    versions.fork(spark, tables.root, base)
    Q.run_cascade_delete(spark, _gone(tables), base, "zero stars")
    return load_tables(spark, base)


def _build_index(spark, sf_dir, base):
    """The search index of the stored vehicles."""
    folder = _vehicle_folder(spark, sf_dir)
    I.build_search_index(spark, folder, schema.VEHICLE, base)
    return base


def _vehicle_folder(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return next(f"{tables.root}/{p.folder}" for p in tables.pieces if p.table == "vehicle")


def _search_indexed(spark, sf_dir):
    index = _stored(spark, sf_dir, "search-index", _build_index)
    return I.search_indexed(spark, _vehicle_folder(spark, sf_dir), schema.VEHICLE, index, oracle.SEARCH_QUERY)


def _mixed_names(tables):
    """The catalogue with descriptions in mixed case and with accents."""
    start = F.element_at(F.array(*[F.lit(x) for x in ("extra", "Extra", "Éxtra", "EXTRÄ")]),
                         F.ascii(F.expr("right(additional_service_id, 1)")) % 4 + 1)
    services = tables["additional_service"].withColumn("description", F.concat(start, F.expr("substr(description, 6)")))
    return dict(tables, additional_service=services)


def _build_counts(spark, sf_dir, base):
    """Key counts of the sound tables, then the two batches that break them."""
    tables = _tables(spark, sf_dir)
    K.build_counts(spark, base, tables)
    for i, (inserted, deleted) in enumerate(td.dirty_batches(spark, sf_dir, tables)):
        K.count_batch(spark, base, inserted, deleted, f"batch-{i}")
    return K.load_counts(spark, base)


def _tables(spark: SparkSession, sf_dir: str):
    """The rental tables, derived from the driver's tables and stored (S1 layout)."""
    return _stored(spark, sf_dir, "rental", _build_tables)


def _docs(spark: SparkSession, sf_dir: str):
    """The document collections, migrated from the stored tables (M6) and read back."""
    return _stored(spark, sf_dir, "docs", _build_docs)


def _booking_requests(spark: SparkSession, sf_dir: str):
    return _stored(spark, sf_dir, "requests", _build_requests)["booking_requests"]


def _service_requests(spark: SparkSession, sf_dir: str):
    return _stored(spark, sf_dir, "requests", _build_requests)["service_requests"]


def _services(spark: SparkSession, sf_dir: str):
    return _stored(spark, sf_dir, "services", _build_services)


def _compacted(spark: SparkSession, sf_dir: str):
    return _stored(spark, sf_dir, "compacted", _build_compacted)


def _doc_services(spark: SparkSession, sf_dir: str):
    return _stored(spark, sf_dir, "doc-services", _build_doc_services)


def _dirty(spark: SparkSession, sf_dir: str):
    return _stored(spark, sf_dir, "dirty", _build_dirty)


def setup_steps():
    """(name, function): what stores tables, documents, request batches and the broken tables (done lazily otherwise)."""
    return [("store_tables", _tables), ("store_documents", _docs), ("store_requests", _booking_requests),
            ("store_broken_tables", _dirty)]


def _search_vehicles(spark, sf_dir):
    return X.search_rows(_tables(spark, sf_dir)["vehicle"], oracle.SEARCH_QUERY)


def _q(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten(fn(spark, sf_dir))
    return run


def _registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries. R8, N8 and the job form of Q4 go through their write jobs, on forks of the stored tables."""
    t = _tables
    return {
        "R1_customers_with_account": lambda s, d: R.customers_with_account(t(s, d)),
        "R2_available_vehicles": lambda s, d: R.available_vehicles(t(s, d), td.WINDOW_START, td.WINDOW_END),
        "R3_booking_cost_report": lambda s, d: R.booking_cost_report(t(s, d), td.REPORT_FROM, td.REPORT_TO),
        "R5_customer_profiles": lambda s, d: R.customer_profiles(t(s, d)),
        "R6_active_bookings": lambda s, d: R.active_bookings(t(s, d), td.AS_OF),
        "R7_service_options": lambda s, d: R.service_options(t(s, d), _service_requests(s, d)),
        "R9_booking_totals": lambda s, d: R.booking_totals(t(s, d), _service_requests(s, d)),
        "R10_service_booking_report": lambda s, d: R.service_booking_report(t(s, d), td.REPORT_FROM,
                                                                            td.SERVICE_REPORT_TO),
        "R11_quote_services": lambda s, d: R.quote_services(t(s, d), _service_requests(s, d)),
        "R12_service_report_export": lambda s, d: X.service_report_export(
            R.service_booking_report(t(s, d), td.REPORT_FROM, td.SERVICE_REPORT_TO)),
        "R4_create_bookings": lambda s, d: J.create_bookings(t(s, d), _booking_requests(s, d))[1],
        "R8_add_services": lambda s, d: _services(s, d)[0],
        "M1_person_docs": lambda s, d: M.person_docs(t(s, d)),
        "M2_vehicle_docs": lambda s, d: M.vehicle_docs(t(s, d)),
        "M3_service_docs": lambda s, d: M.service_docs(t(s, d)),
        "M4_rating_docs": lambda s, d: M.rating_docs(t(s, d)),
        "M5_booking_docs": lambda s, d: M.booking_docs(t(s, d)),
        "N1_doc_customers": lambda s, d: N.doc_customers(_docs(s, d)),
        "N2_doc_available_vehicles": lambda s, d: N.doc_available_vehicles(_docs(s, d), td.WINDOW_START,
                                                                           td.WINDOW_END),
        "N3_doc_create_bookings": lambda s, d: J.doc_create_bookings(_docs(s, d), _booking_requests(s, d))[1],
        "N4_doc_booking_cost_report": lambda s, d: N.doc_booking_cost_report(_docs(s, d), td.REPORT_FROM,
                                                                             td.REPORT_TO),
        "N5_doc_customer_profiles": lambda s, d: N.doc_customer_profiles(_docs(s, d)),
        "N6_doc_active_bookings": lambda s, d: N.doc_active_bookings(_docs(s, d), td.AS_OF),
        "N7_doc_service_options": lambda s, d: N.doc_service_options(_docs(s, d), _service_requests(s, d)),
        "N8_doc_add_services": lambda s, d: _doc_services(s, d)[0],
        "N9_doc_service_booking_report": lambda s, d: N.doc_service_booking_report(_docs(s, d), td.REPORT_FROM,
                                                                                   td.SERVICE_REPORT_TO),
        "R8_new_links": lambda s, d: _services(s, d)[1]["booking_service"],
        "R8_new_bookings": lambda s, d: _services(s, d)[1]["booking"].drop(START_YEAR),
        "R8_compacted_links": lambda s, d: _compacted(s, d)["booking_service"],
        "R8_compacted_bookings": lambda s, d: _compacted(s, d)["booking"].drop(START_YEAR),
        "N3_new_docs": lambda s, d: J.doc_create_bookings(_docs(s, d), _booking_requests(s, d))[0],
        "N8_new_docs": lambda s, d: _doc_services(s, d)[1]["bookings"].drop(START_KEY),
        "M6_migrate_all": lambda s, d: Q.table_counts(_docs(s, d)),
        "S5_conform_bookings": lambda s, d: conform_bookings(t(s, d)["booking"].drop("total_costs", START_YEAR)),
        "R4_new_bookings": lambda s, d: J.create_bookings(t(s, d), _booking_requests(s, d))[0],
        "S1_load_tables": lambda s, d: Q.table_counts(t(s, d)),
        "S3_preview_table": lambda s, d: _preview_facts(t(s, d)),
        "S4_search_rows": _search_vehicles,
        "S4_search_counts": lambda s, d: X.search_counts(t(s, d)["vehicle"], oracle.SEARCH_QUERY),
        "S4_indexed_rows": _search_indexed,
        "R10_collated_report": lambda s, d: R.service_booking_report(
            _mixed_names(t(s, d)), td.REPORT_FROM, td.SERVICE_REPORT_TO, TABLE_ORDER),
        "Q1_audit_keys": lambda s, d: Q.audit_keys(td.added_tables(s, d, t(s, d))),
        "Q2_audit_references": lambda s, d: Q.audit_references(_dirty(s, d)),
        "Q3_audit_values": lambda s, d: Q.audit_values(_dirty(s, d)),
        "Q1_maintained_findings": lambda s, d: K.findings(_stored(s, d, "counts", _build_counts)),
        "Q4_cascade_delete": lambda s, d: Q.table_counts(Q.cascade_delete(t(s, d), _gone(t(s, d)))),
        "Q4_remaining_keys": lambda s, d: Q.remaining_keys(_stored(s, d, "deleted", _build_deleted)),
    }


def _preview_facts(tables):
    """S3 in a form without order: rows and columns of the preview, and rows found in the stored table."""
    preview = staged(X.preview_table(tables, "Booking", 50), "preview")  # rows without an order: taken once
    stored = tables["booking"].select("booking_id").join(preview, "booking_id", "left_semi").distinct().withColumn("stored", F.lit(1))
    return preview.join(stored, "booking_id", "left").agg(
        F.count("*").alias("n_rows"), F.count("stored").alias("n_found")).withColumn("n_columns", F.lit(len(preview.columns)))


def _gone(tables):
    """The persons that Q4 deletes from the driver's data: those rated 0 stars."""
    return tables["person"].filter("stars = 0").select("id")


def _llm() -> tuple[dict, dict]:
    """Queries and SQL of the training-data subpackage; none where it has been removed."""
    try:
        import corpus_pipeline
        from rentwise.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "rentwise.llm"):
            raise
        return {}, {}
    names = sorted((n for n in dir(llm) if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    return ({n: getattr(llm, n) for n in names} | {"pipeline": corpus_pipeline.run},
            dict(llm.ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}))


def entry(spark: SparkSession) -> DataFrame:
    return queries()["R3_booking_cost_report"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(fn) for name, fn in _registry().items()} | _llm()[0]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each key of ``queries()`` that is SQL-expressible."""
    sql = oracle.all_sql()
    sql |= _llm()[1]
    return {name: sql[name] for name in queries() if name in sql}
