"""Language of pages by Bayesian fusion of evidence.

    P(l | page)  ~  P(l | host) * P(markup | l) * P(suffix | l) * P(text | l)

* text: naive Bayes over hashed character trigrams, tempered, because trigrams of
  one text are not independent. The likelihoods are learned from documents with a
  known language, at most ``SAMPLE`` of each (those with the smallest id hash).
* markup: the ``lang`` attribute that the page declares; suffix: the language
  that the address names, as its first path step, its host's first label or its
  country's domain. How far each can be trusted is a table P(declared | l) over the
  whole corpus, by grouped aggregation of the text-only decisions.
* host: hierarchically smoothed priors. Every suffix of a host's labels is a level, from its
  last label to the whole host; the counts of text-only decisions of a level
  are mixed with the prior of the level above it, the last label's with the whole corpus'
  (Dirichlet priors of weight ``PULL``), all by grouped aggregation. So a new host has the prior of its nearest known level.

Defined cases: a null or empty page has no text evidence and is decided by the
others; without any evidence the corpus prior decides. A null address has the
empty host, a host of its own. Ties go to the language first in the alphabet. Without
labelled documents, and on an empty table, the result is empty. Rows that repeat
a page_id are decided each.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, join_counted, join_hot, source, staged
from .html_text import NEVER, parse

SAMPLE = 2_000      # labelled documents of each language
BUCKETS = 1 << 15
TEMPER = 0.05       # weight of one trigram's log likelihood
MOST = 40.0         # of the text's log odds, in nats: the other evidence keeps a say in short texts only
PULL = 10.0         # pages that a prior one level up weighs
SMOOTH = 1.0

DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})\b", re.I)


def trigram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of letters (lower-cased, one space between words)."""
    folded = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not folded:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA6B) + points[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)


def visible(page: str) -> str:
    """A page's text outside of menus, headers, footers and the like."""
    paths, found = parse(page)
    hidden = paths.within(NEVER)
    return " ".join(text for node, text in found if not hidden[node])


def text_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of every trigram bucket in each, from a bounded sample of labelled rows."""
    rows = source(docs, doc_id=key, text=text, lang=lang).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    # the smallest hashes of every language, in 64 slots of the hash, so that no task ranks a whole language
    slot = Window.partitionBy("lang", "slot").orderBy("h", "doc_id")
    picked = (rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("slot", F.pmod("h", F.lit(64)))
              .withColumn("k", F.row_number().over(slot)).where(f"k <= {max(1, SAMPLE // 64)}"))
    picked = staged(picked.select("doc_id").distinct(), "lang-sample")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.bincount(trigram_buckets(text or ""), minlength=BUCKETS)
                sums[lang] = sums.get(lang, 0) + counts
        if sums:
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(np.repeat(list(sums), BUCKETS)), "bucket": pa.array(np.tile(np.arange(BUCKETS), len(sums))),
                "n": pa.array(np.concatenate(list(sums.values())))})

    counts = (rows.join(F.broadcast(picked), "doc_id").select("text", "lang")  # at most SAMPLE rows of a language
              .mapInArrow(run, "lang string, bucket long, n long").where("n > 0")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts.lang.unique())
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    table[counts.bucket.to_numpy(), [langs.index(x) for x in counts.lang]] += counts.n.to_numpy()
    return langs, np.log(table / table.sum(0))


def _text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, url, host, markup, suffix, ll (log likelihoods of the text, relative to the best), guess."""
    shipped = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known = {x: x for x in langs}
        for batch in batches:
            out = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = page or ""
                found = trigram_buckets(visible(page))
                ll = TEMPER * shipped.value[found].sum(0) if len(found) else np.zeros(len(langs))
                ll = np.maximum(ll - ll.max(), -MOST)
                declared = DECLARED.search(page)
                markup = known.get(declared[1].lower(), "other") if declared else "none"
                _, _, rest = (url or "").partition("://")
                host, _, path = rest.partition("/")
                labels = host.lower().split("@")[-1].split(":")[0].split(".")
                steps = [re.split(r"[/?#]", path.lower())[0], labels[0], labels[-1]]
                suffix = next((known[s] for s in steps if s in known), "none")
                out.append((".".join(labels), markup, suffix, ll.tolist(), langs[int(np.argmax(ll))] if len(found) else None))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["page_id", "url", "host", "markup", "suffix", "ll", "guess"])

    return pages.mapInArrow(run, "page_id long, url string, host string, markup string, suffix string, "
                                 "ll array<double>, guess string")


def _counts(rows: DataFrame, keys: list[str], langs: list[str], name: str) -> DataFrame:
    """Per key the number of text-only decisions for each language, as an array column."""
    sums = [F.sum((F.col("guess") == x).cast("int")).cast("double") for x in langs]
    return rows.groupBy(*keys).agg(F.array(*sums).alias(name))


def levels(host: str) -> Column:
    """The suffixes of a host's labels, the last label first and the whole host last."""
    labels, n = F.split(host, r"\."), F.size(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when((n <= 127) & (F.length(host) <= 253), suffixes).otherwise(F.array(host))


def host_priors(seen: DataFrame, langs: list[str], prior: list[float]) -> DataFrame:
    """host, prior (of every language): for all hosts of ``seen`` (host, guess), smoothed from level to level."""
    level = F.explode(levels("host")).alias("level")
    counts = _counts(seen.where("guess IS NOT NULL").select(level, "guess"), ["level"], langs, "c")
    chain = staged(seen.select("host").distinct().select("host", F.posexplode(levels("host")).alias("depth", "level")), "lang-levels")
    groups = chain.groupBy("level").agg(F.count("*").alias("n")).join(counts, "level", "left")
    steps = (join_hot(chain, groups, "level").groupBy("host")  # as many as the host has labels
             .agg(F.array_sort(F.collect_list(F.struct("depth", "c"))).alias("steps")))
    none = F.array(*[F.lit(0.0)] * len(langs))

    def mixed(above, step):
        """(counts + PULL * prior above) / (sum + PULL)"""
        own = F.coalesce(step["c"], none)
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda c, p: (c + PULL * p) / (size + PULL))

    return steps.select("host", F.aggregate("steps", F.array(*map(F.lit, prior)), mixed).alias("prior"))


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, lang, probability, text_lang, markup_lang, suffix_lang for every row of ``pages``."""
    bound_batches(pages.sparkSession, rows=500)
    langs, table = text_model(docs)
    rows = source(pages, page_id=key, url=url, html=markup).select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    if not langs:
        return rows.limit(0).select("page_id", "url", F.lit("").alias("lang"), F.lit(0.0).alias("probability"),
                                    *[F.lit("").alias(f"{x}_lang") for x in ("text", "markup", "suffix")])
    seen = staged(_text_evidence(rows, langs, table), "lang-evidence")
    decided = seen.where("guess IS NOT NULL")
    n = len(langs)
    total = [float(decided.where(F.col("guess") == x).count()) for x in langs]
    prior = [(t + SMOOTH) / (sum(total) + SMOOTH * n) for t in total]

    def trust(column: str):
        """log P(what is declared | l) for every declared value, as one array per value (few values)."""
        found = {r[0]: r[1] for r in _counts(decided, [column], langs, "c").collect()}
        values = sorted({*found, *langs} - {"none", "other"})  # what is not declared tells nothing
        return {v: [float(np.log((found.get(v, [0] * n)[k] + SMOOTH) / (total[k] + SMOOTH * len(values))))
                    for k in range(n)] for v in values}

    def looked_up(column: str):
        table = trust(column)
        return reduce(lambda rest, v: F.when(F.col(column) == v, F.array(*map(F.lit, table[v]))).otherwise(rest),
                      table, F.array(*[F.lit(0.0)] * n))

    names = F.array(*map(F.lit, langs))
    logs = lambda c: F.transform(c, lambda x: F.log(x))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = (join_counted(seen, host_priors(seen.select("host", "guess"), langs, prior), "host")
             .withColumn("s", add(add(F.col("ll"), logs(F.col("prior"))), add(looked_up("markup"), looked_up("suffix"))))
             .withColumn("best", F.array_max("s")))
    weight = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return fused.select("page_id", "url", F.element_at(names, F.array_position("s", F.col("best")).cast("int")).alias("lang"),
                        (1 / weight).alias("probability"), F.col("guess").alias("text_lang"),
                        F.col("markup").alias("markup_lang"), F.col("suffix").alias("suffix_lang"))
