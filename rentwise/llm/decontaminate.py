"""Benchmark passages inside documents: size-partitioned MinHash containment search.

Items are partitioned by their shingle count. From every item a bottom-k MinHash
sketch is taken: its k smallest shingle hashes, with k set by the partition's
largest size. A document of any length is probed with all of its shingles, so a
short item is found inside a long document, where the Jaccard similarity of the
two would be close to 0. Of an item with ``u`` shingles, of which a share ``c``
is required, u - ceil(c u) + 1 sketch values include at least one that the
document holds: up to that k the search misses nothing; beyond ``MAX_SKETCH``
values the chance of a miss is below (1 - c) ** MAX_SKETCH. Candidates are
verified by exact shingle containment in the same task.

Defined cases: null or empty texts match nothing, on either side. An item of
fewer than five words has its whole sequence as its only shingle, and so matches
only a document of exactly these words. Repeated items are searched and reported
under each item_id; repeated documents are reported row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, source, staged, text_hash, without_rows
from .shingles import Hasher

CONTAINMENT_PERCENT = 75
MAX_SKETCH = 256
BLOCK_ITEMS = 50_000  # items broadcast at once; more items take further passes over the documents
BLOCK_SHINGLES = 4_000_000  # and their shingles, some 100 MB of index; a block holds one item at least
HITS = "doc_id long, item_id long, n_item long, n_shared long, containment double, text_hash long"


def sketch_size(n: int, percent: int) -> int:
    """Bottom-k size of an item's partition: sizes up to the next power of two share one k."""
    top = 1 << max(0, int(n - 1).bit_length())
    return min(n, MAX_SKETCH, top - -(-percent * top // 100) + 1)


def item_sets(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, n, shingles (sorted hashes as bytes), block; items without words are left out."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, sets = batch.column(0), [hasher.shingles(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "item_id": ids.take(pa.array(keep, pa.int64())), "n": pa.array([len(sets[i]) for i in keep], pa.int64()),
                "shingles": pa.array([sets[i].tobytes() for i in keep], pa.binary())})

    rows = source(items, item_id=key, text=text).select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "item_id long, n long, shingles binary")


def _index(rows, percent: int):
    """Sketch values and full sets of one block of items, as flat sorted arrays."""
    sets = [np.frombuffer(r.shingles, np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    sketch = [s[:sketch_size(len(s), percent)] for s in sets]

    def flat(parts):
        values = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    return np.array([r.item_id for r in rows], object), sizes, flat(sketch), flat(sets)


def _owners(shingles: np.ndarray, index) -> np.ndarray:
    """The items that hold each of the (distinct) shingles, once per shingle."""
    values, owner = index
    lo, hi = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
    spans = [owner[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo])]
    return np.concatenate(spans) if spans else np.empty(0, np.int32)


def contained_items(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT_PERCENT, key: str = "doc_id",
                    text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every pair (document, item) of which the document holds at least ``percent`` of the item's shingles."""
    return hits_of_rows(docs, items, percent, key, text, item_key, item_text).drop("text_hash")


def hits_of_rows(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT_PERCENT, key: str = "doc_id",
                 text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The result of ``contained_items`` with the hash of the row's text."""
    spark = docs.sparkSession
    bound_batches(spark)
    sets = staged(item_sets(items, item_key, item_text), "decontam-items")
    rows = source(docs, doc_id=key, text=text).select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"), text_hash("text"))
    size = sets.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    blocks = max(1, -(-size.items // BLOCK_ITEMS), -(-size.shingles // BLOCK_SHINGLES))
    out = None
    for block in range(blocks):
        part = sets.where(F.pmod(F.xxhash64("shingles", "item_id"), F.lit(blocks)) == block).collect()
        hits = _search(rows, part, percent)
        out = hits if out is None else out.union(hits)
    return out


def _search(rows: DataFrame, part, percent: int) -> DataFrame:
    spark = rows.sparkSession
    if not part:
        return spark.createDataFrame([], HITS)
    shipped = spark.sparkContext.broadcast(_index(part, percent))  # about a block's items and shingles

    def run(batches):
        hasher = Hasher()
        ids, sizes, sketch, full = shipped.value
        for batch in batches:
            out = []
            for doc_id, text, named in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = hasher.shingles(text)
                likely = np.unique(_owners(own, sketch)) if len(own) else ()
                if not len(likely):
                    continue
                shared = np.bincount(_owners(own, full), minlength=len(sizes))
                for i in likely[100 * shared[likely] >= percent * sizes[likely]]:
                    out.append((doc_id, ids[i], int(sizes[i]), int(shared[i]), shared[i] / sizes[i], named))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "item_id", "n_item", "n_shared", "containment", "text_hash"])

    return rows.mapInArrow(run, HITS)


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    return without_rows(docs, hits_of_rows(docs, items, key=key, text=text), key, text)
