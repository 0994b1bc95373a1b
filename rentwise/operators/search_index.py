"""S4 at scale: a search that reads only files which can hold the text.

The index of a stored folder lists, for each file, the distinct three-character
sequences of its cells' lower-case texts. A query of three characters or more can only
be found in a file that has all of its sequences; the rows of these files are then
filtered as in the full search, so the result is the same. Shorter queries
read everything. Files that came after the index was built are always read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentwise.operators.explore import cell_texts, search_rows

BUCKETS = 64  # folders of the index, by a hash of the sequence
GRAM = 3


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, files: list[str] | None = None) -> DataFrame:
    """The rows of a stored folder, or of some of its files (partition columns come from the folder names)."""
    return spark.read.schema(schema).option("basePath", folder).parquet(*(files or [folder]))


def build_search_index(spark: SparkSession, folder: str, schema: T.StructType, index_dir: str) -> None:
    """Write the index: (gram, file) pairs, distinct within tasks before they are shuffled."""
    rows = read_folder(spark, folder, schema)
    grams = F.array_distinct(F.flatten(F.transform(cell_texts(rows), lambda t: F.when(
        F.length(t) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda i: F.substr(t, i, F.lit(GRAM))))
        .otherwise(F.array().cast("array<string>")))))
    pairs = rows.select(F.explode(grams).alias("gram"), F.col("_metadata.file_path").alias("file")).distinct()
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
    pairs.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index_dir}/grams")
    seen = rows.select(F.col("_metadata.file_path").alias("file")).distinct()
    seen.write.mode("overwrite").parquet(f"{index_dir}/files")


def candidate_files(spark: SparkSession, folder: str, schema: T.StructType, index_dir: str, query: str | None) -> list[str]:
    """Files that can hold the query: at most as many as the folder has, which its listing holds anyway."""
    q = (query or "").strip().lower()
    files = sorted(read_folder(spark, folder, schema).inputFiles())
    grams = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
    if not grams:
        return files
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").withColumn(
        "bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    hits = (spark.read.schema("gram string, file string, bucket int").parquet(f"{index_dir}/grams")
            .where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams))
            .groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)))
    norm = lambda f: f.replace("file:///", "file:/")
    found = {norm(r.file) for r in hits.collect()}
    known = {norm(r.file) for r in spark.read.schema("file string").parquet(f"{index_dir}/files").collect()}
    return [f for f in files if norm(f) in found or norm(f) not in known]


def search_indexed(spark: SparkSession, folder: str, schema: T.StructType, index_dir: str, query: str | None) -> DataFrame:
    """S4 through the index: the rows of the full search, from the candidate files."""
    files = candidate_files(spark, folder, schema, index_dir, query)
    rows = read_folder(spark, folder, schema, files) if files else read_folder(spark, folder, schema).where(F.lit(False))
    return search_rows(rows, query)
