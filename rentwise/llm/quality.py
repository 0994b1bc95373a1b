"""Document quality: an additive model of per-feature lookup tables and pairwise tables.

Every feature is cut into quantile bins. Cyclic boosting visits the features in
turn and fits a shallow regression tree (``LEAVES`` leaves over the bins) to the
current residuals, with a small step, so that correlated features share their
effect; the trees of a feature add up to one lookup table. The strongest pairs
of features then get two-dimensional tables on coarse bins in the same manner
(Lou et al., KDD 2013). A score is a sum of table entries: vectorised lookups.

The model is fitted on at most ``SAMPLE`` labelled rows (those with the smallest
hash of doc_id); features are computed for every document, from its whole text.

Defined cases: null and empty texts have all features 0 and are scored like any
other. Several labels of one doc_id count as their mean, rounded. Without both
classes among the labels every document scores the labels' share (0.5 without
labels). Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bucket_of, hashed_share, source, staged, text_hash, without_rows

SAMPLE = 20_000
BINS, PAIR_BINS, LEAVES = 64, 8, 4
ROUNDS, PAIR_ROUNDS, PAIRS, STEP = 120, 40, 5, 0.1
MIN_LEAF, RIDGE = 8, 1.0
THRESHOLD = 0.7

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "space", "punctuation", "symbol", "bang",
            "pipe", "other", "distinct_words", "top_word", "repeats", "distinct_lines", "line_length", "marked_words",
            "entropy")


def _table() -> np.ndarray:
    """Byte classes as indicator columns: upper, digit, space, punctuation, symbol, bang, pipe, other."""
    of = np.zeros((256, 8))
    groups = (range(65, 91), range(48, 58), (32, 9, 10, 11, 12, 13), b".,;:?'\"()-", b"#$%&*@+=<>~^_/\\[]{}`", b"!", b"|",
              range(128, 256))
    for column, members in enumerate(groups):
        of[list(members), column] = 1
    return of


CLASS = _table()


def features(text: bytes | None) -> np.ndarray:
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / len(text)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[0], out[1] = np.log1p(len(text)), np.log1p(len(words))
    out[3:11] = share @ CLASS
    seen = share[share > 0]
    out[17] = -(seen * np.log2(seen)).sum()
    if words:
        n, times = len(words), {}
        for w in words:
            times[w] = times.get(w, 0) + 1
        out[2] = (len(text) - counts[[32, 9, 10, 11, 12, 13]].sum()) / n
        out[11], out[12] = len(times) / n, max(times.values()) / n
        out[13] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[14] = len(set(lines)) / len(lines)
        out[15] = np.log1p(n / len(lines))
        out[16] = sum(counts[list(b"!#$%&*|")]) / n
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, f (the features) for every document."""
    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(2).to_pylist()]
            flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "text_hash", "f"])

    rows = docs.select("doc_id", text_hash("text"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, f array<float>")


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, size: int) -> np.ndarray:
    """Leaf value per bin of a best-first regression tree over ordered bins."""
    g, h = np.bincount(bins, grad, size), np.bincount(bins, hess, size)
    n = np.bincount(bins, minlength=size)
    gain_of = lambda a, b: a * a / (b + RIDGE)

    def best(lo, hi):
        if hi - lo < 2:
            return 0.0, lo
        gl, hl, nl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1], np.cumsum(n[lo:hi])[:-1]
        gt, ht, nt = g[lo:hi].sum(), h[lo:hi].sum(), n[lo:hi].sum()
        gain = gain_of(gl, hl) + gain_of(gt - gl, ht - hl) - gain_of(gt, ht)
        gain = np.where((nl >= MIN_LEAF) & (nt - nl >= MIN_LEAF), gain, 0)
        at = int(np.argmax(gain))
        return float(gain[at]), lo + at + 1

    leaves = [(0, size, best(0, size))]
    while len(leaves) < LEAVES:
        leaves.sort(key=lambda leaf: -leaf[2][0])
        lo, hi, (gain, cut) = leaves[0]
        if gain <= 0:
            break
        leaves[:1] = [(lo, cut, best(lo, cut)), (cut, hi, best(cut, hi))]
    out = np.zeros(size)
    for lo, hi, _ in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


class AdditiveModel:
    """base + sum of one table per feature + sum of one table per chosen pair."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        width, share = x.shape[1], float(y.mean()) if len(y) else 0.5
        self.cuts = [_cuts(x[:, j], BINS) if len(y) else np.empty(0) for j in range(width)]
        self.coarse = [_cuts(x[:, j], PAIR_BINS) if len(y) else np.empty(0) for j in range(width)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs, self.pair_tables = [], []
        self.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not 0 < share < 1:
            self.base = 0.0 if not len(y) else self.base
            return self
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        margin = np.full(len(y), self.base)

        def slope():
            p = 1 / (1 + np.exp(-margin))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j in range(width):
                step = STEP * _tree(bins[j], *slope(), len(self.tables[j]))
                self.tables[j] += step
                margin += step[bins[j]]
        small = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        grad, hess = slope()
        found = []
        for a in range(width):
            for b in range(a):
                size = len(self.coarse[b]) + 1
                cell = small[a] * size + small[b]
                g, h = np.bincount(cell, grad), np.bincount(cell, hess)
                found.append((float((g * g / (h + RIDGE)).sum()), a, b))
        for _, a, b in sorted(found, reverse=True)[:PAIRS]:
            self.pairs.append((a, b))
            self.pair_tables.append(np.zeros((len(self.coarse[a]) + 1) * (len(self.coarse[b]) + 1)))
        for _ in range(PAIR_ROUNDS):
            for k, (a, b) in enumerate(self.pairs):
                cell = small[a] * (len(self.coarse[b]) + 1) + small[b]
                grad, hess = slope()
                size = len(self.pair_tables[k])
                step = STEP * np.bincount(cell, grad, size) / (np.bincount(cell, hess, size) + RIDGE)
                self.pair_tables[k] += step
                margin += step[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for j, cuts in enumerate(self.cuts):
            margin += self.tables[j][np.searchsorted(cuts, x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            width = len(self.coarse[b]) + 1
            margin += table[np.searchsorted(self.coarse[a], x[:, a], "right") * width
                            + np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "quality", held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``held_out`` is a condition on doc_id: its labels are not learned from.
    """
    return scored_rows(docs, labels, key, text, label, held_out, threshold).drop("text_hash")


def scored_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "quality", held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """The result of ``score_quality`` with the hash of every row's text."""
    bound_batches(docs.sparkSession)
    held = bucket_of(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    held = F.coalesce(held, F.lit(False))
    rows = staged(feature_rows(source(docs, doc_id=key, text=text).withColumn(
        "doc_id", F.col("doc_id").cast("long"))), "quality-features")
    marks = (source(labels, doc_id=key, y=label).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held)
             .groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y")))
    # labels of documents that are not here (any more) take no part
    marks = staged(marks.join(rows.select("doc_id"), "doc_id", "left_semi"), "quality-labels")
    # four times the sample by hash: neither the join nor the ranking grows with the labels
    few = marks.where(hashed_share(F.col("doc_id"), 4 * SAMPLE / max(1, marks.count())))
    sample = (rows.join(few, "doc_id").dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("f", "y").toPandas())
    x = np.stack(sample.f.to_list()).astype(np.float32) if len(sample) else np.empty((0, len(FEATURES)), np.float32)
    model = AdditiveModel().fit(x, sample.y.to_numpy(np.float64))  # a few thousand numbers, sent with the task

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            scores = model.score(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["doc_id", "text_hash", "score"])

    scored = rows.mapInArrow(run, "doc_id long, text_hash long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts (score >= THRESHOLD), all columns as they were."""
    return without_rows(docs, scored_rows(docs, labels).where("predicted = 0"), "doc_id", "text")
