"""Exact duplicates with a heavy-hitter split (DataFrame and SQL functions only).

A Misra-Gries summary finds the digests that may be frequent; their exact
counts verify them. The verified ones are at most ``tracked`` rows: they are
broadcast, and every row of such a group gets its decision on the map side,
without a shuffle. All remaining digests are too rare to be a hot key and go
through an ordinary shuffle.

Defined cases: a null text counts as empty, so null and empty texts form one
group. Rows that repeat a doc_id with an equal text are the same document and
share its fate. A null doc_id sorts after every other id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import source, staged, text_hash, without_rows

SPACE = ("\x20", "\x09", "\x0A", "\x0B", "\x0C", "\x0D")
TRACKED = 2048  # counters of the summary, and the proven bound of the broadcast


def text_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_sha256 (of the text without white space), n_points (code points of the original), text_hash (of it)."""
    rows = source(docs, doc_id=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    bare = F.col("text")
    for char in SPACE:
        bare = F.replace(bare, F.lit(char), F.lit(""))
    return rows.select("doc_id", F.sha2(bare.cast("binary"), 256).alias("text_sha256"),
                       F.length("text").cast("long").alias("n_points"), text_hash("text"))


def frequent_digests(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Verified frequent digests with their group: at most ``tracked`` rows.

    ``approx_top_k_accumulate`` keeps a mergeable frequent-items summary of the
    Misra-Gries family; partial summaries meet in a few hundred groups first, so
    no single task merges one summary per input file. A summary never misses a
    digest held by more than total / tracked rows.
    """
    digests.createOrReplaceTempView("llm_digests")
    spark = digests.sparkSession
    found = spark.sql(f"""
        SELECT inline(approx_top_k_estimate(approx_top_k_combine(part, {tracked}), {tracked}))
        FROM (SELECT approx_top_k_accumulate(xxhash64(text_sha256), {tracked}) AS part, slot
              FROM (SELECT text_sha256, pmod(spark_partition_id(), 256) AS slot FROM llm_digests) GROUP BY slot)
        GROUP BY pmod(slot, 1)""")  # a group, so that a task without summaries adds no empty one
    likely = staged(found.select(F.col("item").alias("h")).distinct(), "dedup-likely")  # <= tracked rows
    exact = (digests.withColumn("h", F.xxhash64("text_sha256")).join(F.broadcast(likely), "h", "left_semi")
             .groupBy("text_sha256").agg(*group_columns()).where("group_size > 1"))
    return exact


def group_columns():
    """Of equal texts the one with the most code points, then the smallest doc_id stays."""
    order = F.struct("n_points", -F.col("doc_id"))
    return (F.count("*").alias("group_size"), F.max_by("n_points", order).alias("keep_points"),
            F.max_by("doc_id", order).alias("keep_id"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, hot (decided on the map side)."""
    return decided(docs, key, text, tracked).drop("text_hash")


def decided(docs: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The result of ``exact_dedup`` with the hash of every row's text."""
    digests = staged(text_digests(docs, key, text), "dedup-digests")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "hot", "text_hash"]
    winners = staged(frequent_digests(digests, tracked), "dedup-winners")
    stays = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
    hot = digests.join(F.broadcast(winners), "text_sha256").withColumn("hot", F.lit(True))
    same = Window.partitionBy("text_sha256")
    first = same.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    rest = (digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
            .withColumn("keep_id", F.first("doc_id").over(first))
            .withColumn("keep_points", F.first("n_points").over(first))
            .withColumn("group_size", F.count("*").over(same)).withColumn("hot", F.lit(False)))
    return hot.withColumn("kept", stays).select(out).union(rest.withColumn("kept", stays).select(out))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns as they were; of rows that repeat an id each is judged by its own text."""
    return without_rows(docs, decided(docs, key, text).where("NOT kept"), key, text)
