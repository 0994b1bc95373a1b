"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for secrets by fixed patterns, and for other opaque tokens
that may be one. The values' hashes are aggregated over the whole corpus by
documents, distinct repositories and distinct owners. A value that is spread widely is a
copied example: held by ``OWNERS`` owners, or by ``REPOS`` repositories in ``DOCS``
documents, or in ``MANY`` documents, whoever owns them. Any other that looks random is a
live-looking credential, also where two owners hold it. The spans of the fixed patterns always stay; of the other
tokens those become spans that turn out live-looking.

Defined cases: a null text counts as empty and has no spans. A null repository or
owner is one of its own. Rows that repeat a doc_id with an equal text get the
same result and count as one document: a document that is delivered often is not
copied widely. With another text each gets its own result.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, source, staged

# fixed values: the patterns of the base spans, in the order of their kinds
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, so the same spans as runs of any length that are then measured
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# other opaque tokens: long runs of letters and digits, both cases and digits
OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}(?![A-Za-z0-9_+/-])")

OWNERS = 3       # owners from which a value is a copied example
REPOS, DOCS = 3, 10  # repositories, with so many documents among them, from which it is one
MANY = 100       # documents from which it is one
ENTROPY = 3.0    # bits per character from which a value looks random


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in (value.count(x) for x in set(value)))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in the order of start and kind; kind 3 are the other opaque tokens."""
    found = []
    folded = text.lower()
    if any(h in folded for h in HINTS) or "K" in text or "ſ" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken, at, reach = sorted((a, b) for a, _, b, _ in found), 0, 0
    for m in OPAQUE.finditer(text):
        # both lists run from left to right: reach is the end of the taken spans that begin before this token's end
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][1]), at + 1
        value = m[0]
        if (reach <= m.start() and any(c.isdigit() for c in value) and any(c.islower() for c in value)
                and any(c.isupper() for c in value)):
            found.append((m.start(), 3, m.end(), value))
    return sorted(found)


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, repo, owner, text_hash and the candidates as arrays, for every row."""
    def run(batches):
        for batch in batches:
            rows = [candidates(t or "") for t in batch.column(3).to_pylist()]
            pick = lambda f, kind: pa.array([[f(x) for x in r] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pick(lambda x: x[0], pa.int64()),
                 pick(lambda x: x[1], pa.int32()), pick(lambda x: x[2], pa.int64()),
                 pick(lambda x: f"{xxhash.xxh3_128_hexdigest(x[3])}", pa.string()),
                 pick(lambda x: entropy(x[3]) >= ENTROPY, pa.bool_())],
                ["doc_id", "repo", "owner", "text_hash", "start", "kind", "stop", "value", "random"])

    return docs.mapInArrow(run, "doc_id long, repo string, owner string, text_hash long, start array<long>, "
                                "kind array<int>, stop array<long>, value array<string>, random array<boolean>")


def ownership(found: DataFrame) -> DataFrame:
    """value -> n_docs, n_repos, n_owners, from rows (value, repo, owner, doc_id, text_hash).

    A document's repeated values and rows meet first, spread over all tasks; then copies per value,
    repository and owner, with partial sums, so a value copied into a third of all
    documents is a few rows per task.
    """
    held = (found.select("value", "owner", "repo", "doc_id", "text_hash").distinct()
            .groupBy("value", "owner", "repo").agg(F.count("*").alias("docs")))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("docs").alias("docs"))
    return by_owner.groupBy("value").agg(F.sum("docs").alias("n_docs"), F.sum("repos").alias("n_repos"),
                                         F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "source",
                 owner: str = "source") -> DataFrame:
    """One row per document: the base spans' counts and digest, all spans, and how the values are owned.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans of
    live-looking values), n_copied (candidates whose value several owners hold),
    n_examples (candidates whose value is a copied example).
    """
    bound_batches(docs.sparkSession)
    rows = source(docs, doc_id=key, repo=repo, owner=owner, text=text).select(
        F.col("doc_id").cast("long"), F.col("repo").cast("string"), F.col("owner").cast("string"),
        F.col("text").cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = staged(_scanned(rows), "secret-candidates")
    each = found.select("doc_id", "text_hash", "repo", "owner", F.posexplode("value").alias("spot", "value"))
    owned = staged(ownership(each), "secret-values")
    # only values that are spread are looked up; all others have one owner and are no examples
    example = F.expr(f"n_owners >= {OWNERS} OR (n_repos >= {REPOS} AND n_docs >= {DOCS}) OR n_docs >= {MANY}")
    spread = staged(owned.select("value", (F.col("n_owners") > 1).alias("several"), example.alias("example"))
                    .where("several OR example"), "secret-spread")
    spots = lambda where: F.collect_set(F.when(F.col(where), F.col("spot")))
    hits = (each.join(spread, "value").groupBy("doc_id", "text_hash")
            .agg(spots("several").alias("copied"), spots("example").alias("examples")))
    hits = staged(hits, "secret-hits")
    same = (found["doc_id"].eqNullSafe(hits["doc_id"])) & (found["text_hash"] == hits["text_hash"])
    spans = F.arrays_zip("start", "kind", "stop", "random", F.sequence(F.lit(0), F.size("start") - 1).alias("spot"))
    listed = (found.join(hits, same, "left")
              .select(found["doc_id"], "start", "kind", "stop", "random",
                      *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("copied", "examples")]))
    listed = listed.withColumn("x", F.when(F.size("start") > 0, spans).otherwise(F.array()))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])
    base = F.filter("x", lambda x: x["kind"] < 3)
    live = lambda x: x["random"] & ~F.array_contains("examples", x["spot"])
    kept = F.filter("x", lambda x: (x["kind"] < 3) | live(x))
    count = lambda k: F.size(F.filter("kind", lambda x: x == k)).cast("long")
    return listed.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(kept, shown), ",").alias("spans"),
        F.size(F.filter("x", live)).cast("long").alias("n_live"), F.size("copied").cast("long").alias("n_copied"),
        F.size("examples").cast("long").alias("n_examples"))
