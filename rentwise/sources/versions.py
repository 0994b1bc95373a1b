"""Stored tables with published states: full refreshes, keyed changes and compaction.

The tables of a folder form one state. A state names, per table, the pieces it is
made of: folders with base rows and folders with changes (whole rows, or deleted
keys). Every write goes to a new folder first; publishing it is the append of one
row to ``commits``, so readers see all tables of a write or none, and a job that dies
before leaves only folders that no state names. A reader resolves the last state
once (:func:`load`) and finishes on its folders whatever is published later, since no
folder is ever changed.

* :func:`refresh` replaces all tables.
* :func:`commit` adds changed rows and deleted keys under a batch id. The bytes it writes
  follow the batch; a batch id that is already published is skipped.
* :func:`compact` merges the changes into base folders. Of a partitioned table only the
  partitions with a changed row are written; the others stay where they are.

Changes are merged on read: base rows whose key changed are left out by an anti join
and the last version of each changed key is added; filters reach the base scans.
For tables with dates the state also holds the last end date and the longest
duration of each partition, see :meth:`Snapshot.overlapping`.

One writer at a time publishes to a folder (a job, or a streaming query); readers
are not limited. :func:`unused_folders` lists what can be removed once its readers are done.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUND = "struct<part:string,last_end:string,longest:int>"
PIECE = f"struct<table:string,folder:string,kind:string,parts:array<string>,bounds:array<{BOUND}>>"
COMMIT = f"seq long, batch string, pieces array<{PIECE}>"
BASE, CHANGES = "base", "changes"
SEQ, GONE = "change_seq", "change_gone"  # columns of stored changes
NO_PART = "∅"  # a null partition value


@dataclass(frozen=True)
class Table:
    """How a table is stored: schema and key; for a partitioned one its partition column and the rule for it,
    the order within files, and its first and last date (dates, or ISO texts)."""

    schema: T.StructType
    keys: tuple[str, ...]
    part: str | None = None
    part_of: Column | None = None
    part_type: T.DataType | None = None
    first: str | None = None
    last: str | None = None

    def columns(self) -> list[Column]:
        return [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]

    def part_text(self) -> Column:
        return F.coalesce(F.col(self.part).cast("string"), F.lit(NO_PART))


class Snapshot(dict):
    """The tables of one state by name. A plain copy (``dict(...)``) with replaced tables drops the state."""

    def __init__(self, tables, root: str, seq: int = 0, pieces=()):
        super().__init__(tables)
        self.root, self.seq, self.pieces = root, seq, list(pieces)

    def overlapping(self, table: str, start: str) -> tuple[list[str], int | None] | None:
        """Partitions that can hold a row ending on or after ``start``, and the longest duration in them.

        None where a piece of the table has no bounds (then any row may). Bounds of merged
        pieces stay in force, so they can be too wide, never too narrow.
        """
        pieces = [p for p in self.pieces if p.table == table]
        if not pieces or any(p.bounds is None for p in pieces):
            return None
        found = [b for p in pieces for b in p.bounds if b.last_end is not None and b.last_end >= start]
        longest = [b.longest for b in found if b.longest is not None]
        return sorted({b.part for b in found}), max(longest) if longest else None


def earliest_start(start: str, longest: int | None) -> str | None:
    """First day on which a row of at most ``longest`` days that ends on or after ``start`` can begin."""
    return None if longest is None else (date.fromisoformat(start) - timedelta(days=max(longest, 0))).isoformat()


# --- states -----------------------------------------------------------------

def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The published states (seq, batch, pieces), one small row per write; None for a folder without any."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_state(spark: SparkSession, root: str) -> Row | None:
    found = commits(spark, root)
    return None if found is None else found.orderBy(F.desc("seq")).first()


def is_published(spark: SparkSession, root: str, batch: str) -> bool:
    found = commits(spark, root)
    return found is not None and not found.where(F.col("batch") == batch).isEmpty()


def _publish(spark: SparkSession, root: str, seq: int, batch: str | None, pieces: list) -> None:
    spark.createDataFrame([(seq, batch, pieces)], COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _path(root: str, folder: str) -> str:
    """A folder of a state: relative to its root, or whole where the state was forked."""
    return folder if folder.startswith("/") or ":/" in folder else f"{root}/{folder}"


def fork(spark: SparkSession, source: str, root: str) -> None:
    """Publish the last state of ``source`` as the first one of the new folder ``root``, without copying a file.

    Writes to either do not show in the other. Folders that a fork names must outlive it.
    """
    state = last_state(spark, source)
    pieces = [Row(**{**p.asDict(), "folder": _path(source, p.folder)}) for p in state.pieces]
    _publish(spark, root, 1, None, pieces)


def unused_folders(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Folders named by earlier states, but by none of the last ``keep`` ones."""
    found = commits(spark, root)
    if found is None:
        return []
    kept = found.orderBy(F.desc("seq")).limit(keep)
    names = lambda df: df.select(F.explode("pieces.folder").alias("folder")).distinct()
    return sorted(_path(root, r.folder) for r in names(found).join(names(kept), "folder", "left_anti").collect())


# --- reading ----------------------------------------------------------------

def load(spark: SparkSession, root: str, specs: dict[str, Table], names=None) -> Snapshot:
    """The tables of the last published state; plain folders ``root/<name>`` where none is published."""
    state = last_state(spark, root)
    pieces = state.pieces if state else []
    tables = {}
    for name in names or specs:
        own = [p for p in pieces if p.table == name]
        tables[name] = _merged(spark, root, specs[name], own) if own else _scan(spark, specs[name], f"{root}/{name}")
    return Snapshot(tables, root, state.seq if state else 0, pieces)


def _scan(spark: SparkSession, spec: Table, path: str) -> DataFrame:
    rows = spark.read.schema(spec.schema).parquet(path)
    if spec.part is None:
        return rows
    if spec.part not in rows.columns:  # an empty folder, or one that is not laid out
        return rows.withColumn(spec.part, spec.part_of)
    return spark.read.schema(T.StructType([*spec.schema.fields, T.StructField(spec.part, spec.part_type)])).parquet(path)


def _base(spark: SparkSession, root: str, spec: Table, pieces) -> DataFrame:
    """The base rows: a later folder that lists partitions stands for these in all earlier ones."""
    taken, scans = set(), []
    for piece in reversed([p for p in pieces if p.kind == BASE]):
        rows = _scan(spark, spec, _path(root, piece.folder))
        if piece.parts is None:
            scans.append(rows.where(~spec.part_text().isin(*sorted(taken))) if taken else rows)
        elif set(piece.parts) - taken:
            scans.append(rows.where(spec.part_text().isin(*sorted(set(piece.parts) - taken))))
            taken |= set(piece.parts)
    return reduce(DataFrame.unionByName, scans)


def _latest(spark: SparkSession, root: str, spec: Table, pieces) -> DataFrame | None:
    """The last change of each changed key, with the flag ``GONE``; all change folders are one scan."""
    folders = [_path(root, p.folder) for p in pieces if p.kind == CHANGES]
    if not folders:
        return None
    stored = T.StructType([*spec.schema.fields, T.StructField(SEQ, T.LongType()), T.StructField(GONE, T.BooleanType())])
    rows = spark.read.schema(stored).parquet(*folders)
    rest = [c for c in rows.columns if c not in (*spec.keys, SEQ)]
    last = rows.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), F.struct(SEQ, ~F.col(GONE))).alias("last"))
    return last.select(*spec.keys, "last.*")


def _merged(spark: SparkSession, root: str, spec: Table, pieces) -> DataFrame:
    base, latest = _base(spark, root, spec, pieces), _latest(spark, root, spec, pieces)
    if latest is None:
        return base
    kept = latest.where(~F.col(GONE)).select(*spec.columns())
    if spec.part:
        kept = kept.withColumn(spec.part, spec.part_of)
    return base.join(latest.select(*spec.keys), list(spec.keys), "left_anti").select(base.columns).unionByName(kept)


# --- writing ----------------------------------------------------------------

def write_folder(rows: DataFrame, spec: Table, path: str) -> None:
    """A base folder; rows are sorted by first date within each task (no shuffle), so scans can skip row groups."""
    rows = rows.select(*spec.columns())
    if spec.part is None:
        rows.write.parquet(path)
    else:
        rows.withColumn(spec.part, spec.part_of).sortWithinPartitions(spec.part, spec.first) \
            .write.partitionBy(spec.part).parquet(path)


def _bounds(spark: SparkSession, spec: Table, path: str) -> list | None:
    """Last end and longest duration per partition of a folder just written, from its date columns."""
    if spec.last is None:
        return None
    texts = spec.schema[spec.last].dataType == T.StringType()
    longest = F.lit(None).cast("int") if texts else F.max(F.datediff(spec.last, spec.first))
    return _scan(spark, spec, path).groupBy(spec.part_text().alias("part")).agg(
        F.max(spec.last).cast("string").alias("last_end"), longest.alias("longest")).collect()  # a row per partition


def _base_piece(spark: SparkSession, root: str, name: str, spec: Table, rows: DataFrame, folder: str, parts=None) -> Row:
    write_folder(rows, spec, f"{root}/{folder}/{name}")
    return Row(table=name, folder=f"{folder}/{name}", kind=BASE, parts=parts, bounds=_bounds(spark, spec, f"{root}/{folder}/{name}"))


def refresh(spark: SparkSession, root: str, tables: dict[str, DataFrame], specs: dict[str, Table]) -> dict[str, str]:
    """Write all tables to new folders, then publish them together; returns the folders."""
    state, folder = last_state(spark, root), f"versions/{uuid.uuid4().hex}"
    pieces = [_base_piece(spark, root, name, specs[name], rows, folder) for name, rows in tables.items()]
    _publish(spark, root, state.seq + 1 if state else 1, None, pieces)
    return {p.table: _path(root, p.folder) for p in pieces}


def commit(spark: SparkSession, root: str, specs: dict[str, Table], changed: dict[str, DataFrame] | None = None,
           deleted: dict[str, DataFrame] | None = None, batch: str | None = None) -> bool:
    """Publish changed rows and deleted keys of any tables together; False if the batch is published already.

    Of a key that is both deleted and changed in one commit the changed row counts.
    """
    if batch is not None and is_published(spark, root, batch):
        return False
    state, folder = last_state(spark, root), f"changes/{uuid.uuid4().hex}"
    seq = state.seq + 1 if state else 1
    pieces = list(state.pieces) if state else [Row(table=n, folder=n, kind=BASE, parts=None, bounds=None) for n in specs]
    for gone, frames in ((True, deleted or {}), (False, changed or {})):
        for name, rows in frames.items():
            spec, path = specs[name], f"{folder}/{'deleted' if gone else 'changed'}/{name}"
            if gone:
                rows = rows.select(*[F.col(f.name) if f.name in spec.keys else F.lit(None).alias(f.name) for f in spec.schema.fields])
            rows.select(*spec.columns(), F.lit(seq).cast("long").alias(SEQ), F.lit(gone).alias(GONE)).write.parquet(f"{root}/{path}")
            pieces.append(Row(table=name, folder=path, kind=CHANGES, parts=None,
                              bounds=[] if gone else _bounds(spark, spec, f"{root}/{path}")))
    _publish(spark, root, seq, batch, pieces)
    return True


def compact(spark: SparkSession, root: str, specs: dict[str, Table]) -> list[str]:
    """Merge the changes of all tables into base folders and publish them; returns the tables written.

    A table without partitions is written anew if a stored row changed; rows that are only new become one more folder.
    """
    state = last_state(spark, root)
    names = sorted({p.table for p in state.pieces if p.kind == CHANGES}) if state else []
    folder, pieces = f"merged/{uuid.uuid4().hex}", [p for p in (state.pieces if state else []) if p.table not in names]
    for name in names:
        spec, own = specs[name], [p for p in state.pieces if p.table == name]
        bases = [p for p in own if p.kind == BASE]
        latest, merged = _latest(spark, root, spec, own), _merged(spark, root, spec, own)
        stored = _base(spark, root, spec, own).join(latest.select(*spec.keys), list(spec.keys), "left_semi")
        kept = latest.where(~F.col(GONE)).select(*spec.columns())
        if spec.part:
            texts = stored.select(spec.part_text().alias("p")).union(
                kept.withColumn(spec.part, spec.part_of).select(spec.part_text().alias("p")))
            parts = sorted(r.p for r in texts.distinct().collect())  # at most as many as there are partitions
            if parts:
                bases.append(_base_piece(spark, root, name, spec, merged.where(spec.part_text().isin(*parts)), folder, parts))
        elif stored.isEmpty():
            bases.append(_base_piece(spark, root, name, spec, kept, folder))
        else:
            bases = [_base_piece(spark, root, name, spec, merged, folder)]
        pieces += bases
    if names:
        _publish(spark, root, state.seq + 1, None, pieces)
    return names
