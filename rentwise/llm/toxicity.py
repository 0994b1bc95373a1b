"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words and the distinct character sequences of
lengths ``GRAMS`` inside them (lower-cased, so inflected forms share terms),
hashed into ``2 ** BITS`` slots. The machine (Rendle, ICDM 2010) scores

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the present terms: a weight per term, and for every two terms the product of
their factors, learned without ever listing the pairs. So a group's mention
counts with an insult beside it and not alone, which weights of single terms
cannot express. The machine knows the ``TERMS`` slots with the clearest relation
to the label in the sample, if it is beyond chance (likelihood ratio), and the words whose pairs tell it
though neither does alone; weights carry an L1 penalty. So a long text gathers no noise from
thousands of ordinary terms, and nothing is learned by heart through them.

The model is fitted on at most ``SAMPLE`` labelled rows of each class (those with
the smallest hash of doc_id), class weights restoring the classes' true shares.

Defined cases: a null or empty text has no terms and scores the bias alone.
Several labels of one doc_id count as their maximum. Without both classes among
the labels every document scores their share (0 without labels). Rows that
repeat a doc_id are scored each; one of them teaches.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bucket_of, source, staged

SAMPLE = 3_000       # labelled rows of each class
BITS, FACTORS = 20, 4
GRAMS = (5, 6)
SUPPORT = 3          # sample rows of a term that gets a weight
TERMS = 4096         # terms with the clearest relation to the label, by likelihood ratio
CLEAR = 10.0         # least likelihood ratio of a term the machine knows
PAIR_SUPPORT = 10    # sample rows of a word, and of two words together, whose pair is looked at
PAIR_WORDS = 8192    # words with the most sample rows, whose pairs are looked at
PAIRS = 512          # clearest pairs whose words the machine knows besides
STRIP = 1024         # words whose pairs are counted at a time
EPOCHS, BATCH, RATE = 30, 32, 0.2
L1, L2 = 0.02, 0.01
CACHE = 300_000
WORD = re.compile(r"\w+")


class Terms(dict):
    """Word -> slots of its terms, forgotten when it has grown past ``CACHE`` words."""

    def __init__(self, place: np.ndarray | None = None):
        super().__init__()
        self.place = place  # where given, slots are turned into a machine's rows, and unknown ones left out

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        marked = f"<{word}>"
        grams = {marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)} | {marked}
        slots = [xxhash.xxh3_64_intdigest(g) & ((1 << BITS) - 1) for g in grams]
        if self.place is not None:
            slots = [int(r) for r in self.place[slots] if r]
        self[word] = slots
        return slots

    def words_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct slots of a text's whole words."""
        words = set(WORD.findall(text.lower())) if text else ()
        return np.unique(np.array([xxhash.xxh3_64_intdigest(f"<{w}>") & ((1 << BITS) - 1) for w in words], np.int32))

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct slots (or rows) of a text's terms."""
        words = set(WORD.findall(text.lower())) if text else ()
        return np.unique(np.array([s for w in words for s in self[w]], np.int32))


def _likelihood_ratio(held: np.ndarray, bad: np.ndarray, rows: int, bad_rows: int) -> np.ndarray:
    """G statistic of the two-by-two table of holding a term and being labelled 1."""
    def part(n, expected):
        return np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(expected, 1e-12)), 0)

    share = bad_rows / max(1, rows)
    return 2 * (part(bad, held * share) + part(held - bad, held * (1 - share))
                + part(bad_rows - bad, (rows - held) * share)
                + part(rows - bad_rows - held + bad, (rows - held) * (1 - share)))


def pair_vocabulary(held: np.ndarray) -> np.ndarray:
    """Word slots whose pairs are looked at, of those that ``held`` sample rows have."""
    known = np.flatnonzero(held >= PAIR_SUPPORT)
    return known[np.argsort(-held[known], kind="stable")[:PAIR_WORDS]]


def pair_slots(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Slots of the words whose pairs tell the label though neither word alone does.

    For every two words with enough common rows the labelled share among these is set against the greater (or lesser)
    share of the two words' own rows, in standard errors; of the pairs beyond what chance gives
    among all pairs tried, the ``PAIRS`` clearest count. Counted strip by strip, so memory holds no table of all pairs.
    """
    held = np.bincount(np.concatenate([np.empty(0, np.int32), *words]), minlength=1 << BITS)
    known = pair_vocabulary(held)
    if len(known) < 2 or not 0 < y.mean() < 1:
        return np.empty(0, np.int64)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    has = np.zeros((len(words), len(known)), np.uint8)
    for i, row in enumerate(words):
        at = place[row]
        has[i, at[at >= 0]] = 1
    bad = has[y > 0]
    share = (bad.sum(0, dtype=np.int64) + 0.5 * y.mean()) / (held[known] + 0.5)
    level, found = (2 * np.log(len(known) * (len(known) - 1) / 2)) ** 0.5 + 1, []
    for a in range(0, len(known), STRIP):
        left, left_bad = has[:, a:a + STRIP].astype(np.float32), bad[:, a:a + STRIP].astype(np.float32)
        for b in range(a, len(known), STRIP):
            both = left.T @ has[:, b:b + STRIP].astype(np.float32)
            both_bad = left_bad.T @ bad[:, b:b + STRIP].astype(np.float32)
            one, two = share[a:a + STRIP, None], share[None, b:b + STRIP]
            high, low = np.maximum(one, two), np.minimum(one, two)
            error = lambda p: np.sqrt(np.maximum(both * p * (1 - p), 0.25))
            z = np.maximum((both_bad - both * high) / error(high), (both * low - both_bad) / error(low))
            z[(both < PAIR_SUPPORT) | (np.arange(a, a + len(z))[:, None] >= np.arange(b, b + z.shape[1])[None, :])] = 0
            at = np.argwhere(z > level)
            found += [(float(z[i, j]), a + int(i), b + int(j)) for i, j in at]
            found = sorted(found, reverse=True)[:PAIRS]
    return known[np.unique([k for _, i, j in found for k in (i, j)])] if found else np.empty(0, np.int64)


def clear_slots(held: np.ndarray, bad: np.ndarray, rows: int, bad_rows: int) -> np.ndarray:
    """Slots with a relation to the label beyond what chance gives the best of so many terms, ``TERMS`` at most."""
    known = np.flatnonzero(held >= SUPPORT)
    ratio = _likelihood_ratio(held[known], bad[known], rows, bad_rows)
    clear = int((ratio >= max(CLEAR, 2 * np.log(max(1, len(known))))).sum())
    return np.sort(known[np.argsort(-ratio, kind="stable")[:min(TERMS, clear)]])


class FactorizationMachine:
    """Weights and factors of the slots that the sample supports; other slots count nothing."""

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, share: float,
            known: np.ndarray | None = None) -> "FactorizationMachine":
        """``rows`` hold the slots of each row's terms; ``known`` are the slots to learn (else those that tell something)."""
        self.place = np.zeros(1 << BITS, np.int32)  # slot -> row of the tables; row 0 is "no weight"
        if known is None:
            count = lambda of: np.bincount(np.concatenate([np.empty(0, np.int32), *of]), minlength=1 << BITS)
            known = clear_slots(count(rows), count([r for r, label in zip(rows, y) if label]), len(rows), int(y.sum()))
        self.place[known] = np.arange(1, len(known) + 1)
        self.w = np.zeros(len(known) + 1)
        self.v = np.random.default_rng(7).normal(0, 0.01, (len(known) + 1, FACTORS))
        self.v[0] = 0
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not 0 < share < 1:
            self.w[:] = self.v[:] = 0
            return self
        rows = [self._known(r) for r in rows]
        gw, gv, gb = np.ones(len(self.w)), np.ones(self.v.shape), 1.0
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                sizes = np.array([len(rows[i]) for i in pick])
                cols = np.concatenate([rows[i] for i in pick])
                doc = np.repeat(np.arange(len(pick)), sizes)
                v = self.v[cols]
                total = np.stack([np.bincount(doc, v[:, f], len(pick)) for f in range(FACTORS)], 1)
                margin = self.bias + np.bincount(doc, self.w[cols], len(pick)) + 0.5 * (
                    (total ** 2).sum(1) - np.bincount(doc, (v ** 2).sum(1), len(pick)))
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) * weight[pick]
                touched, back = np.unique(cols, return_inverse=True)
                grad = np.bincount(back, err[doc])
                gw[touched] += grad ** 2
                step = RATE / np.sqrt(gw[touched])
                moved = self.w[touched] - step * grad
                self.w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1 * np.bincount(back), 0)
                by_factor = err[doc][:, None] * (total[doc] - v)
                grad = np.stack([np.bincount(back, by_factor[:, f]) for f in range(FACTORS)], 1) + L2 * self.v[touched]
                gv[touched] += grad ** 2
                self.v[touched] -= 0.2 * RATE * grad / np.sqrt(gv[touched])
                gb += err.sum() ** 2
                self.bias -= RATE * err.sum() / np.sqrt(gb)
        return self

    def _known(self, slots: np.ndarray) -> np.ndarray:
        at = self.place[slots]
        return at[at > 0]

    def score(self, at: np.ndarray) -> float:
        """Score of a text whose terms have the given (distinct) rows."""
        v = self.v[at]
        margin = self.bias + self.w[at].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v ** 2).sum())
        return 1 / (1 + np.exp(-min(60.0, max(-60.0, margin))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """slots, words, y, n (labelled rows of that class) of at most ``SAMPLE`` labelled documents of each class, staged.

    The smallest hashes of a class by a top-k over its labels; of rows that repeat an id the least text is taken.
    """
    counts = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two classes
    first = [labels.where(F.col("y") == y).select("doc_id", "y", F.lit(n).cast("long").alias("n"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y, n in counts.items()]
    none = labels.limit(0).select("doc_id", "y", F.lit(0).cast("long").alias("n"))
    picked = staged(reduce(DataFrame.union, first, none), "toxic-sample")

    def run(batches):
        terms = Terms()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            slots, words = (pa.array([of(t).tobytes() for t in texts], pa.binary()) for of in (terms.of, terms.words_of))
            yield pa.RecordBatch.from_arrays([slots, words, batch.column(1), batch.column(2)], ["slots", "words", "y", "n"])

    rows = (docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "n").agg(F.min("text").alias("text"))
            .select("text", "y", "n"))  # at most 2 * SAMPLE rows
    return staged(rows.mapInArrow(run, "slots binary, words binary, y int, n long"), "toxic-terms")


def _slot_counts(sample: DataFrame) -> np.ndarray:
    """(3, 2 ** BITS) sample rows of every slot as a term, as one with label 1, and as a whole word: a table of fixed size."""
    def run(batches):
        counts = np.zeros((3, 1 << BITS), np.int64)
        for batch in batches:
            for slots, words, y, _ in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(slots, np.int32)
                counts[0, at] += 1
                counts[1, at] += y > 0
                counts[2, np.frombuffer(words, np.int32)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *counts[:, at])], ["slot", "held", "bad", "words"])

    found = sample.mapInArrow(run, "slot long, held long, bad long, words long").groupBy("slot").agg(
        *[F.sum(c).alias(c) for c in ("held", "bad", "words")]).where(f"held >= {SUPPORT}").toPandas()
    out = np.zeros((3, 1 << BITS), np.int64)
    out[:, found.slot.to_numpy()] = found[["held", "bad", "words"]].to_numpy().T
    return out


def _known_rows(sample: DataFrame, terms: np.ndarray, words: np.ndarray):
    """The sample's rows with their slots among ``terms`` and ``words`` only: bounded by rows times known slots."""
    keep = [np.zeros(1 << BITS, bool) for _ in range(2)]
    keep[0][terms] = keep[1][words] = True
    shipped = sample.sparkSession.sparkContext.broadcast(keep)

    def run(batches):
        for batch in batches:
            cut = []
            for column, known in zip(batch.columns[:2], shipped.value):
                rows = [np.frombuffer(r, np.int32) for r in column.to_pylist()]
                cut.append(pa.array([r[known[r]].tobytes() for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays([*cut, *batch.columns[2:]], batch.schema.names)

    return sample.mapInArrow(run, sample.schema).collect()


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "toxic", held_out=None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ``held_out`` labels are not learned from."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0 if held_out is None else held_out, F.lit(False))
    docs = source(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = (source(labels, doc_id=key, y=label).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held)
             .groupBy("doc_id").agg(F.max("y").cast("int").alias("y")))
    # labels of documents that are not here (any more) take no part
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = _sample(docs, staged(marks, "toxic-labels"))
    held_by, bad_by, words_by = _slot_counts(sample)
    sizes = {r.y: r.c for r in sample.groupBy("y").agg(F.count("*").alias("c")).collect()}
    clear = clear_slots(held_by, bad_by, sum(sizes.values()), sizes.get(1, 0))
    vocabulary = pair_vocabulary(words_by)
    sample = _known_rows(sample, np.union1d(clear, vocabulary), vocabulary)
    total = {r.y: r.n for r in sample}
    y = np.array([r.y for r in sample], np.float64)
    weight = np.array([total[r.y] / sizes[r.y] for r in sample])
    share = total.get(1, 0) / max(1, sum(total.values()))
    rows, words = ([np.frombuffer(r[c], np.int32) for r in sample] for c in ("slots", "words"))
    known = np.union1d(clear, pair_slots(words, y) if len(y) else clear).astype(np.int64)
    machine = FactorizationMachine().fit(rows, y, weight / max(weight.mean(), 1e-9) if len(weight) else weight, share, known)
    tables = spark.sparkContext.broadcast((machine.place, machine.w, machine.v, machine.bias))

    def run(batches):
        model = FactorizationMachine()
        model.place, model.w, model.v, model.bias = tables.value
        terms = Terms(model.place)
        for batch in batches:
            scores = [model.score(terms.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
