"""Token counts as delta-maintained rollups.

A ledger folder holds two additive tables, both written batch by batch:

* ``counts/batch=<id>``: signed counts per document (doc_id, source, lang,
  version, docs, tokens): +n for an insert, -n for a delete, both for a revision;
* ``deltas/batch=<id>``: the batch's sums by source, language and tokenizer version.

Totals are sums over the deltas. A batch is committed by replacing its two
partitions: counts first, then the deltas that make it visible, so a batch that is
delivered again, or that failed half-way, ends in the same state. What a delete or
a revision takes back is the document's own balance in all *earlier* batches, which
does not change when the batch is repeated; batches are committed in order. Of the earlier
counts only those of the batch's documents are grouped.

Defined cases: null and empty texts have 0 tokens and count as a document. A
null source or language is a group of its own. Within a batch one document
has one event: of several, the one with the greatest ``event`` text stays
(revise, insert, delete in falling order). A delete of an unknown document, or an
insert of a known one, changes nothing; a revision of an unknown one inserts it.
Rows with a null doc_id are left out: they could never be revised.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, source, staged

COUNTS = "doc_id long, source string, lang string, version string, docs long, tokens long, batch int"
DELTAS = "source string, lang string, version string, docs long, tokens long, batch int"


# fixed values: the characters that \s stands for in the published pattern, and the run length beyond which
# its backtracking over them is avoided
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{BLANKS}]{{1000,}}")


def number_of_tokens(encoding, text: str) -> int:
    """Tokens of a text under a pattern that takes a run of white space, but for its last character before other
    text, as one piece.

    Long runs are cut out at these places and encoded as the pieces they are, without the pattern (which recurses once per
    character there).
    """
    total, at = 0, 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at:run.start()]))
        total += len(encoding._encode_single_piece(text[run.start():end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, ranks: str, pattern: str, version: str) -> DataFrame:
    """``docs`` (with a column text) plus version and tokens; ``ranks`` is a byte-pair rank file on every machine."""
    def run(batches):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            at = batch.schema.get_field_index("text")
            counts = [number_of_tokens(encoding, t) if t else 0 for t in batch.column(at).to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(counts, pa.int64())],
                                             [*kept, "tokens"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "tokens long"])).withColumn("version", F.lit(version))


class TokenLedger:
    """Rollups below ``path``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        exists = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}") if exists else (
            self.spark.createDataFrame([], schema))

    def commit(self, batch: int, events: DataFrame) -> None:
        """Apply ``events``: event (insert, delete, revise), doc_id, source, lang, version, tokens (new count)."""
        if not self._read("merged", "batch int").where(f"batch >= {int(batch)}").isEmpty():
            return
        first = F.max_by(F.struct("event", "source", "lang", "tokens"), F.struct("event", "tokens", "source", "lang"))
        events = (events.where("doc_id IS NOT NULL").groupBy("doc_id", "version").agg(first.alias("e"))
                  .select("doc_id", "version", "e.*"))
        events = staged(events, "token-events")
        named = events.select("doc_id", "version")
        before = (self._read("counts", COUNTS).where(f"batch < {int(batch)}").join(named, ["doc_id", "version"], "left_semi")
                  .groupBy("doc_id", "source", "lang", "version")
                  .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0"))
        known = before.select("doc_id", "version", F.lit(True).alias("known")).distinct()
        judged = events.join(known, ["doc_id", "version"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        plus = judged.where("event = 'revise' OR (event = 'insert' AND NOT known)").select(
            "doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("docs"), "tokens")
        gone = events.where("event IN ('delete', 'revise')").select("doc_id", "version")
        minus = before.join(gone, ["doc_id", "version"]).select(
            "doc_id", "source", "lang", "version", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        counts = f"{self.path}/counts/batch={int(batch)}"
        plus.union(minus).write.mode("overwrite").parquet(counts)
        written = self.spark.read.schema(COUNTS.rpartition(",")[0]).parquet(counts)
        (written.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/deltas/batch={int(batch)}"))

    def compact(self, path: str) -> "TokenLedger":
        """A new ledger at ``path`` with the sums of all committed batches; this one stays as it is.

        To be run between commits. In the new ledger the merged batches count as committed: they change nothing
        when they are delivered again. A run that dies leaves a folder without the table ``merged``, to be written anew.
        """
        deltas, target = self._read("deltas", DELTAS), TokenLedger(self.spark, path)
        last = deltas.agg(F.max("batch")).first()[0]
        sums = lambda df, *keys: df.where(F.col("batch") <= last).groupBy(*keys).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        if last is not None:
            merged = {"counts": sums(self._read("counts", COUNTS), "doc_id", "source", "lang", "version"),
                      "deltas": sums(deltas, "source", "lang", "version")}
            for name, rows in merged.items():
                rows.write.mode("overwrite").parquet(f"{target.path}/{name}/batch={last}")
            self.spark.createDataFrame([(last,)], "batch int").write.mode("overwrite").parquet(f"{target.path}/merged")
        return target

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over the committed batches; groups that went back to 0 are left out."""
        return (self._read("deltas", DELTAS).groupBy("source", "lang", "version")
                .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
                .where("n_docs <> 0 OR n_tokens <> 0"))


def events_of(docs: DataFrame, event: str, ranks: str, pattern: str, version: str, key: str = "doc_id",
              text: str = "text", origin: str = "source", lang: str = "lang") -> DataFrame:
    """Insert or revise events with the token counts of the documents' whole texts."""
    bound_batches(docs.sparkSession)
    rows = source(docs, doc_id=key, source=origin, lang=lang, text=text).select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.col("text").cast("string"))
    return count_tokens(rows, ranks, pattern, version).withColumn("event", F.lit(event))
