"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

A document's failures are five bits. A subset of filters lets it survive when none
of the subset's filters fails it, so every document becomes a 32-bit word with one
bit per subset: its truth table of survival. How many documents survive a subset,
per part and label, is a positional popcount over those words: tasks add them with
carry-save adders into one word per binary digit and count bits only in those. Every figure of every order then follows from the
32 sums of a part by inclusion: a step removes the survivors of the filters before
it less those of the filters up to it.

Defined cases: a null text counts as empty, a null part as the empty string. A
null doc_id has no labels, is no other row's original and is itself no copy. Rows that repeat
the smallest doc_id of a text are all originals. Several labels of one doc_id: it
is good (toxic) if one of them says 1. An empty table gives no rows. One text's words are
held in its row.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, source, staged

SPACE = r"[\x20\x09-\x0D]"
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
BLOCK = 63  # words that add up to six binary digits
GROUPS = 4096  # groups a task keeps counters of before it hands them on
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text and failed: bits of the filters A to D that fail it."""
    rows = source(docs, doc_id=key, text=text, part=part).select(
        "doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", f"{SPACE}+"), ""))
    n, points = F.size("words"), F.length("text")
    upper = points - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * upper.cast("long") > 10 * points,
             F.col("text").rlike(r"[#$%&*|]")]
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("failed"))


def copies_marked(rows: DataFrame) -> DataFrame:
    """``failed`` with the bit of E: the text is that of a smaller doc_id."""
    groups = (rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
              .where("n > 1 AND first IS NOT NULL"))
    marked = join_hot(rows, groups, "digest")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return marked.select("doc_id", "part", (F.col("failed") + F.when(late, 16).otherwise(0)).alias("failed"))


def labels_joined(rows: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, failed, good and toxic (booleans) of every row."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = (source(labels, doc_id=key, good=good, toxic=toxic).where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(said("good"), said("toxic")))
    known = rows.where("doc_id IS NOT NULL").join(staged(marks, "audit-labels"), "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    none = rows.where("doc_id IS NULL").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.select("part", "failed", flag("good"), flag("toxic")).union(none)


def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three words, bit by bit."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set.

    ``BLOCK`` words at a time (lane by lane) are added into one word per binary
    digit; only those digits are then counted bit by bit, with their weights.
    """
    lanes = -(-len(words) // BLOCK)
    digits = [list(np.concatenate([words, np.zeros(lanes * BLOCK - len(words), np.uint32)]).reshape(BLOCK, lanes))]
    out, place = np.zeros(32, np.int64), 0
    while place < len(digits):
        here = digits[place]
        if len(here) > 1 and place + 1 == len(digits):
            digits.append([])
        while len(here) > 1:
            third = here.pop() if len(here) > 2 else np.zeros(lanes, np.uint32)
            total, carry = add(here.pop(), here.pop(), third)
            here.append(total)
            digits[place + 1].append(carry)
        bits = np.unpackbits(here[0].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64) << place
        place += 1
    return out


def survivors(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, alive): alive[s] counts the rows that no filter of the subset s fails; partial sums of tasks."""
    def run(batches):
        sums: dict = {}

        def hand_on():
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            alive = pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))
            sums.clear()
            return pa.RecordBatch.from_arrays([*columns, alive], ["part", "good", "toxic", "alive"])

        for batch in batches:
            part = batch.column(0).dictionary_encode()
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            group = part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + good * 2 + toxic
            words, names = WORDS[batch.column(1).to_numpy()], part.dictionary.to_pylist()
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0]) if len(order) else []
            for members in np.split(order, starts[1:]) if len(order) else []:
                g = int(group[members[0]])
                key = (names[g // 4], bool(g & 2), bool(g & 1))
                sums[key] = sums.get(key, 0) + positional_popcount(words[members])
            if len(sums) > GROUPS:
                yield hand_on()
        yield hand_on()

    return rows.select("part", "failed", "good", "toxic").mapInArrow(
        run, "part string, good boolean, toxic boolean, alive array<long>")


def orders() -> list[tuple[str, int, int, int, int]]:
    """(filter_order, step, filter bit, subset before, subset after) of all orders."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, bit in enumerate(order, 1):
            out.append(("".join(FILTERS[b] for b in order), step, 1 << bit, before, before | 1 << bit))
            before |= 1 << bit
    return out


def _at(alive: str, subset) -> Column:
    return F.get(F.col(alive), subset)


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang",
                  good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order and step with what the step's filter removes there."""
    rows = copies_marked(staged(failures(docs, key, text, part), "audit-failures"))
    counted = survivors(labels_joined(rows, labels, key, good, toxic))
    sums = lambda name, of=None: F.array(*[
        F.sum(F.when(F.lit(True) if of is None else F.col(of), F.get("alive", F.lit(s))).otherwise(0)) for s in range(SUBSETS)]
        ).alias(name)
    table = staged(counted.groupBy("part").agg(sums("all"), sums("of_good", "good"), sums("of_toxic", "toxic")), "audit-parts")
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(n).alias("step"), F.lit(bit).alias("bit"),
                               F.lit(b).alias("before"), F.lit(a).alias("after")) for o, n, bit, b, a in orders()])
    gone = lambda name: _at(name, F.col("x.before")) - _at(name, F.col("x.after"))
    whole = F.lit(SUBSETS - 1)
    out = table.select("*", F.explode(steps).alias("x")).select(
        "part", "x.filter_order", "x.step", "x.bit", _at("all", F.col("x.after")).alias("kept"), gone("all").alias("removed"),
        (_at("all", F.lit(0)) - _at("all", F.col("x.bit")) - gone("all")).alias("redundant"),
        (_at("all", whole.bitwiseXOR(F.col("x.bit"))) - _at("all", whole)).alias("unique_fails"),
        gone("of_good").alias("good_lost"), gone("of_toxic").alias("toxic_lost"), "all")
    return out.withColumn("shapley", F.element_at(shapley(F.col("all")), F.col("bit"))).drop("all", "bit")


def shapley(alive: Column) -> Column:
    """Map from a filter's bit to what it removes, summed over all orders."""
    weights: dict = {1 << b: {} for b in range(len(FILTERS))}
    for _, _, bit, before, after in orders():
        for subset, sign in ((before, 1), (after, -1)):
            weights[bit][subset] = weights[bit].get(subset, 0) + sign
    total = lambda of: sum((w * F.get(alive, F.lit(s)) for s, w in of.items()), F.lit(0).cast("long"))
    return F.create_map(*[x for bit, of in weights.items() for x in (F.lit(bit), total(of))])
