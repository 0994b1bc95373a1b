"""Helpers that several operators share: staged tables, size-checked broadcasts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentwise.session import checkpoint_dir

# A set of ids is broadcast only after counting it: 2 million longs are 16 MB.
# Larger sets take the shuffle join, with the same result.
BROADCAST_IDS = 2_000_000
# A table of keys with a few short values, likewise counted before it is broadcast.
BROADCAST_ROWS = 100_000
# Read when an action begins; off by default.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def source(docs: DataFrame, **columns: str) -> DataFrame:
    """Pick the named input columns under fixed names; any other column of the input is left out."""
    return docs.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage without tying results to an executor: the files live in the
    folder that ``spark.checkpoint.dir`` names. A job's folders can be removed
    once its results are written. The shuffle files of the write go when it ends: nothing reads them
    again, and those of all steps together would be several times the input.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "32MB") -> None:
    """Bound the rows and bytes of an Arrow batch, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ids_join(df: DataFrame, ids: DataFrame, key: str, how: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join with a staged table of distinct ids, broadcast only if it is counted as small.

    Null keys match nothing: a semi join drops them and an anti join keeps them.
    """
    side = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull())
    return df.join(F.broadcast(side) if side.count() <= bound else side, key, how)


def text_hash(text: str) -> Column:
    """Names a row's text: with the doc_id it tells rows apart that repeat an id, or have none."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_hash")


def without_rows(docs: DataFrame, gone: DataFrame, key: str, text: str, bound: int = BROADCAST_IDS // 2) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, text_hash) names, null ids included; all columns as they were.

    The names are broadcast only after counting them; more take the shuffle join, with the same result.
    """
    names = staged(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone-rows")
    same = F.col(f"`{key}`").eqNullSafe(F.col("gone_id")) & (text_hash(text) == F.col("gone_hash"))
    return docs.join(F.broadcast(names) if names.count() <= bound else names, same, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def bucket_of(key: Column, modulus: int) -> Column:
    """The crc32 of an id's decimal text, modulo a number: the fixed folds of the label tables."""
    return F.crc32(key.cast("string")) % modulus


def hashed_share(key: Column, share: float) -> Column:
    """About the given share of the keys: those with the smallest ``xxhash64``.

    Before a ranking by that hash it bounds the rows that the ranking task gets.
    """
    return F.xxhash64(key) <= F.lit(min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63))


def components(edges: DataFrame, what: str) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, root), root the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014):
    every step groups by node with partial minima, so a node with very many
    links costs each task one row, and paths shorten by halves.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), f"{what}-links")
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{what}-low")
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = staged(large, f"{what}-large")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), f"{what}-low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = staged(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{what}-links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def join_counted(rows: DataFrame, side: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a table of distinct non-null keys, broadcast only if it is counted as small.

    The side is staged first, so that adaptive execution can split a hot key's rows beyond the bound.
    """
    side = staged(side, "side")
    return rows.join(F.broadcast(side) if side.count() <= bound else side, key, "left")


def join_hot(rows: DataFrame, groups: DataFrame, key: str, tracked: int = 1000) -> DataFrame:
    """Left join with ``groups`` (distinct keys, ``n`` rows of each key), null keys equal, safe under hot keys.

    Keys that hold at least the ``tracked``-th part of all rows are at most ``tracked``: they are
    broadcast and need no shuffle. No other key can fill a task, those go by an ordinary join.
    ``rows`` is read three times.
    """
    groups = staged(groups.withColumnRenamed(key, "group_key"), "groups")
    total, same = rows.count(), F.col(key).eqNullSafe(F.col("group_key"))
    hot, rest = (groups.where(c) for c in (F.col("n") * tracked >= total, F.col("n") * tracked < total))
    found = rows.join(F.broadcast(hot), same)
    cold = rows.join(F.broadcast(hot.select("group_key")), same, "left_anti").join(rest, same, "left")
    return found.unionByName(cold).drop("group_key")
