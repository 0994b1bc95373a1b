"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its groups.

Two documents link when the Jaccard similarity of their shingle sets is at least
75 percent. Documents with equal sets form a class; the join works on classes.

1. One pass gives every document its class, and the corpus a table of shingle
   counts in ``2 ** ORDER_BITS`` hash buckets. The table has a fixed size, so in a large corpus
   a bucket's other shingles hide one that hundreds of classes hold; a sample of the classes finds
   those. Both only order the shingles, rare ones first: any order gives the same result.
2. Of n shingles, an l-prefix holds the first n - ceil(0.75 n) + l. Two linked
   sets share at least l of their l-prefixes (Wang et al., SIGMOD 2012). l grows
   with the document's estimated candidate cost: its size, which a verification
   reads, and the list entries that the count table lets expect. A pair must
   share as many prefix shingles as the smaller of its two l, and as many as its
   two sizes ask for if all that may follow the prefixes is shared as well.
3. Prefix shingles held by one class only are dropped. Those held by at most
   ``LIST`` classes produce pairs, at most LIST / 2 per row; pairs with too few
   shared prefix shingles are dropped. The others connect classes to clusters. A cluster within
   the size of a block meets in one task, where all its sets are compared, so each text moves once
   whatever the number of pairs. In a larger cluster single pairs are verified on their whole sets:
   first every class's likeliest pair, then all pairs not yet in one component.
4. A prefix shingle in more classes than ``LIST`` produces no pairs, and the rows of one that
   very many hold are dealt over slots, so that they never meet in one task. The classes
   that such shingles connect form regions. A region within one block's size is compared as
   clusters are. In a larger one
   all classes are first compared with a few pivots (the class with the most
   such shingles and some by hash): those that link with a pivot are in its component and need
   no comparison with each other, which settles most of a large group of near
   copies in linear work. The rest is split into blocks bounded in shingles and in classes, and every
   two blocks that a pivot has not settled are compared exactly inside one task,
   which returns a spanning forest of the links it finds. No link is lost and no
   list of all pairs is ever written.
5. Components over the verified links.

Shingles and classes are compared as 64-bit hashes.

Defined cases: a text without words has no shingles and links with nothing, as
does a row with a null doc_id (its component_id is null). Rows that repeat a
doc_id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bound_batches, components, ids_join, join_counted, source, staged, text_hash, without_rows
from .shingles import Hasher

PERCENT = 75
ORDER_BITS = 18
LIST = 64                  # classes of a prefix shingle that produce pairs directly
COST_STEP = 32             # shingles to read in verifications for which one more shared shingle is asked
BLOCK_SHINGLES = 800_000   # shingles of one block of a dense region
BLOCK_CLASSES = 2_000      # classes of one, as two blocks are compared by a matrix of classes: some 150 MB
STRIP = 512                # rows of that matrix that are computed at a time
PIVOTS = 4                 # classes of a large region that all of it is compared with
SHARE = 8                  # of so many classes one is looked at for shingles that many hold
HELD = 3                   # of the classes looked at hold a shingle that is ordered by its own count
KNOWN = 1_000_000          # shingles ordered by their own counts at most, the most frequent ones (16 MB)
BIN_SHINGLES = 400_000     # shingles of the small clusters that meet in one group
SLOT_ROWS = 4_096          # rows of such a shingle that meet in one slot
SEEN = 100_000             # classes a task remembers, to send a copied class's prefix only once


NOTHING = (np.empty(0, np.uint64), np.empty(0, np.int64))


def _bytes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_hash("text"))


def _classes_and_counts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, cls, text_hash), and per task the non-zero shingle counts in 64 blocks of buckets."""
    def run(batches):
        hasher, counts = Hasher(), np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            sets = [hasher.shingles(text) for text in batch.column(1).to_pylist()]
            cls = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            ns, size = [len(s) for s in sets], len(sets)
            if size:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - ORDER_BITS)).astype(np.int64),
                                      minlength=1 << ORDER_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int32()), pa.array(np.array(cls, np.uint64).view(np.int64)),
                 pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), batch.column(2)], NAMES)
        at = np.flatnonzero(counts)
        cut = np.searchsorted(at, np.arange(65) << (ORDER_BITS - 6))
        parts = [(b, at[cut[b]:cut[b + 1]]) for b in range(64) if cut[b] < cut[b + 1]]
        size = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()),
             pa.array([b for b, _ in parts], pa.int32()),
             pa.array([i.astype(np.uint32).tobytes() for _, i in parts], pa.binary()),
             pa.array([counts[i].astype(np.uint32).tobytes() for _, i in parts], pa.binary()), pa.nulls(size, pa.int64())], NAMES)

    NAMES = ["doc_id", "n", "cls", "block", "buckets", "counts", "text_hash"]
    return _bytes_of(docs).mapInArrow(
        run, "doc_id long, n int, cls long, block int, buckets binary, counts binary, text_hash long")


def _order_table(found: DataFrame) -> np.ndarray:
    """The summed count table: 2 ** ORDER_BITS numbers, whatever the input's size."""
    def total(parts):
        # streams the task's parts, so memory holds one table and one part
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for pdf in parts:
            for i, c in zip(pdf.buckets, pdf.counts):
                counts[np.frombuffer(i, np.uint32)] += np.frombuffer(c, np.uint32)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at, "n": counts[at]})

    parts = found.where("block IS NOT NULL").select("block", "buckets", "counts").repartition(64, "block")
    sums = parts.select("buckets", "counts").mapInPandas(total, "bucket long, n long")
    table = np.zeros(1 << ORDER_BITS, np.int64)
    pdf = sums.toPandas()
    table[pdf.bucket.to_numpy()] = pdf.n.to_numpy()
    return np.minimum(table, 0xFFFFFFFF).astype(np.uint64)


def prefix_of(s: np.ndarray, table: np.ndarray, ground: float, known=NOTHING) -> tuple[np.ndarray, int]:
    """The adaptive prefix of a sorted set, and the matches (l) it asks for. ``known``: sorted shingles that many
    classes hold, and their numbers; they come after all others."""
    n = len(s)
    count = table[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
    met = np.maximum(count.astype(np.float64) - ground, 0)  # expected list entries
    tokens, held = known
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        found = tokens[at] == s
        met[found] = held[at[found]]
        count = np.minimum(count, np.uint64(1 << 31))
        count[found] = np.uint64(1 << 31) + held[at[found]].astype(np.uint64)
    order = np.argsort((count << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF)), kind="stable")
    need = -(-PERCENT * n // 100)
    cost = n + met[order[:n - need + 1]].sum()  # a candidate costs the reading of a set
    match = int(min(need, max(8, n // 20), 1 + cost // COST_STEP))
    return s[order[:n - need + match]], match


def _prefix_rows(docs: DataFrame, table: np.ndarray, known=NOTHING) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((table, known))

    def run(batches):
        (counts, frequent), hasher, seen = shipped.value, Hasher(), set()
        middle = counts[counts > 0]
        level = float(np.median(middle)) if len(middle) else 0.0
        ground = level + 2 * level ** 0.5  # what a bucket holds besides a shingle of its own
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                tokens, cls, ns, ls = [np.empty(0, np.uint64)], [], [], []
                for text in batch.column(1).slice(at, 100).to_pylist():
                    s = hasher.shingles(text)
                    key = xxhash.xxh3_64_intdigest(s.tobytes())
                    if not len(s) or key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    prefix, match = prefix_of(s, counts, ground, frequent)
                    tokens.append(prefix), cls.append(key), ns.append(len(s)), ls.append(match)
                reps = [len(t) for t in tokens[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)),
                     pa.array(np.repeat(np.array(cls, np.uint64).view(np.int64), reps)),
                     pa.array(np.repeat(np.array(ns, np.int32), reps)),
                     pa.array(np.repeat(np.array(ls, np.int32), reps))], ["token", "cls", "n", "match"])

    return _bytes_of(docs).mapInArrow(run, "token long, cls long, n int, match int")


def _one_of_each(docs: DataFrame, own: DataFrame, reps: DataFrame) -> DataFrame:
    """``docs`` without the copies of classes, as far as a small table names the rows to keep or to leave out."""
    copies = staged(own.where("n > 0 AND doc_id IS NOT NULL").join(reps, "cls").where("doc_id <> rep")
                    .select("doc_id", "text_hash").distinct(), "ngram-copies")
    n = copies.count()
    if 0 < n <= BROADCAST_IDS // 2:
        return without_rows(docs, copies, "doc_id", "text")
    if n and reps.count() <= BROADCAST_IDS:
        return ids_join(docs, reps.select("rep"), "doc_id", "left_semi")
    return docs  # copies only cost time: no step relies on their absence


def _frequent_shingles(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(token, n) of shingles that at least ``HELD`` of every ``SHARE``-th class hold."""
    some = reps.where(F.pmod(F.xxhash64("cls"), F.lit(SHARE)) == 0).select("cls")
    held = _sets(docs, reps, some).select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return staged(held.where(F.col("n") >= HELD), "ngram-frequent")


def _known(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the classes expected to hold each: ``KNOWN`` at most, whatever the input's size."""
    numbers = frequent.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, total = None, 0
    for r in numbers:
        total += r["count"]
        if total > KNOWN:
            break
        least = r["n"]
    if least is None:
        return NOTHING
    pdf = frequent.where(F.col("n") >= least).toPandas()
    tokens = pdf.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], pdf.n.to_numpy(np.int64)[order] * SHARE


def _hot_shingles(frequent: DataFrame) -> DataFrame:
    """(token, slots) of shingles that very many classes hold, and into how many slots their rows are dealt.

    Rows of other shingles are a few thousand at most, with overwhelming probability; whatever the sample does not show
    is only not dealt out.
    """
    slots = F.ceil(F.col("n") * SHARE / SLOT_ROWS).cast("int").alias("slots")
    return frequent.where(F.col("n") * SHARE > max(SLOT_ROWS, LIST)).select("token", slots)


def _meetings(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """What meets in the prefix shingles that at least two rows hold, from one sort by shingle.

    Rows (a, b, matches, need) for every pair that shares shingles of short
    lists, and rows (token, b, n) for every class in a long list. Rows of the shingles ``hot`` are dealt over slots, and
    no list of neighbours is made of them.
    """
    rows = join_counted(rows, hot, "token").withColumn("slot", F.pmod(F.xxhash64("cls"), F.coalesce("slots", F.lit(1))))
    by = Window.partitionBy("token", "slot")
    before = by.orderBy("n", "cls").rowsBetween(1 - LIST, -1)
    near = F.filter("before", lambda x: (x["cls"] != F.col("cls")) & (100 * x["n"] >= PERCENT * F.col("n")))
    least_shared = lambda n: F.ceil(F.lit(PERCENT) * n / 100)  # noqa: E731  by any set similar to one of n shingles
    # shingles past the one prefix or the other can add no more than the larger rest to the matches
    past = lambda x: F.greatest(least_shared(x["n"]) - x["match"], least_shared(F.col("n")) - F.col("match"))
    asked = lambda x: F.greatest(
        F.least(x["match"], "match"), F.ceil(PERCENT * (x["n"] + F.col("n")) / (100 + PERCENT)) - past(x)).cast("int")
    pair = F.transform(near, lambda x: F.struct(
        F.lit(None).cast("long").alias("token"), F.least(x["cls"], "cls").alias("a"), F.greatest(x["cls"], "cls").alias("b"),
        F.lit(0).alias("n"), asked(x).alias("need")))
    alone = F.array(F.struct(F.col("token"), F.lit(None).cast("long").alias("a"), F.col("cls").alias("b"), "n",
                             F.lit(0).alias("need")))
    met = (rows.withColumn("held", F.count("*").over(by))
           .withColumn("before", F.collect_list(F.when(F.col("slots").isNull(), F.struct("cls", "n", "match"))).over(before))
           .where("held > 1 OR slots IS NOT NULL")
           .select(F.explode(F.when(F.col("slots").isNull() & (F.col("held") <= LIST), pair).otherwise(alone)).alias("x"))
           .select("x.*"))
    return met.groupBy("token", "a", "b").agg(F.count("*").alias("matches"), F.min("need").alias("need"),
                                              F.max("n").alias("n"))


def _sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """cls, shingles (sorted hashes) of the classes given (cls), read again from their representatives' texts."""
    named = staged(reps.join(nodes, "cls").select("rep", "cls"), "ngram-named")
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            sets = [hasher.shingles(t) for t in batch.column(1).to_pylist()]
            cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             ["cls", "shingles"])

    rows = ids_join(docs, named.select("rep"), "doc_id", "left_semi")
    return _bytes_of(rows).mapInArrow(run, "cls long, shingles array<long>")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a square boolean adjacency matrix."""
    left, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(linked[u] & left)
            left[found] = False
            edges += [(u, int(v)) for v in found]
            queue += found.tolist()
    return edges


def _linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """All links between the sets, as a spanning forest."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if (100 + PERCENT) * shared >= PERCENT * sizes.sum() else []
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    _, column = np.unique(column[common], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[common][order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    strips = [slice(at, at + STRIP) for at in range(0, len(sets), STRIP)]
    for at in range(0, int(column.max(initial=-1)) + 1, 1024):
        here = slice(*np.searchsorted(column, (at, at + 1024)))
        held = np.zeros((len(sets), 1024), np.float32)
        held[row[here], column[here] - at] = 1
        for strip in strips:
            shared[strip] += held[strip] @ held.T
    linked = np.empty(shared.shape, bool)
    for strip in strips:
        part = shared[strip].astype(np.int64)
        linked[strip] = (100 + PERCENT) * part >= PERCENT * (sizes[strip, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    return _forest(linked)


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links between the sets of two blocks (or inside one), as a spanning forest."""
    pdf = pdf.drop_duplicates("cls")
    ids, edges = pdf.cls.to_numpy(), _linked([np.asarray(s, np.int64) for s in pdf.shingles])
    return pd.DataFrame({"a": ids[[a for a, _ in edges]], "b": ids[[b for _, b in edges]]}, dtype="int64")


def _bin_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links inside each of the clusters (root) of one bin, as spanning forests, from the texts of their classes."""
    hasher, found = Hasher(), []
    for _, texts in pdf.groupby("root").text:
        sets = {xxhash.xxh3_64_intdigest(s.tobytes()): s for s in map(hasher.shingles, texts)}
        if len(sets) > 1:
            ids = np.array(list(sets), np.uint64).view(np.int64)
            found += [(ids[a], ids[b]) for a, b in _linked(list(sets.values()))]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _cluster_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame) -> DataFrame:
    """All links inside the clusters (root, cls, n), each of which fits a block. A class moves as its text, once per cluster."""
    bins = F.greatest(F.ceil(F.sum("n") / BIN_SHINGLES), F.lit(1)).cast("int").alias("bins")
    held = clusters.join(reps, "cls").join(F.broadcast(clusters.agg(bins)))
    held = staged(held.select(F.col("rep").alias("doc_id"), "root", F.pmod(F.xxhash64("root"), F.col("bins")).alias("bin")), "ngram-bins")
    texts = docs.join(F.broadcast(held) if held.count() <= BROADCAST_IDS // 2 else held, "doc_id")
    return (texts.select("bin", "root", F.col("text").cast("binary").alias("text")).groupBy("bin")
            .applyInPandas(_bin_links, "a long, b long"))


def _regions(dense: DataFrame) -> DataFrame:
    """The regions (node, root) that prefix shingles of many classes connect; ``dense``: (token, b, n)."""
    first = staged(dense.groupBy("token").agg(F.min("b").alias("a")), "ngram-first")
    return staged(components(dense.select("token", "b").join(first, "token").select("a", "b"), "ngram-region"),
                  "ngram-region")


def _similar(a, b) -> Column:
    """Whether two columns with sets link."""
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= PERCENT * (F.size(a) + F.size(b) - shared)


def _pivot_links(sets: DataFrame) -> DataFrame:
    """(pivot, cls) of the classes that link with a pivot: the first of its
    region's pivots that they link with. ``sets``: (root, cls, heavy, shingles)."""
    chosen = sets.groupBy("root").agg(
        F.max_by("cls", F.struct("heavy", "cls")).alias("p0"),
        *[F.min_by("cls", F.xxhash64("cls", F.lit(i))).alias(f"p{i}") for i in range(1, PIVOTS)])
    chosen = staged(chosen.select("root", F.posexplode(F.array_distinct(F.array([f"p{i}" for i in range(PIVOTS)])))
                                  .alias("rank", "cls")), "ngram-pivots")
    pivots = (sets.select("cls", "shingles").join(chosen, "cls").groupBy("root")
              .agg(F.array_sort(F.collect_set(F.struct("rank", "cls", "shingles"))).alias("pivots")))  # PIVOTS sets
    first = F.get(F.filter("pivots", lambda p: _similar(F.col("shingles"), p["shingles"])), F.lit(0))
    return (sets.join(staged(pivots, "ngram-pivots"), "root").select(first["cls"].alias("pivot"), "cls")
            .where("pivot IS NOT NULL").distinct())


def _blocks() -> Column:
    return F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks")


def _by_size(members: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """``members`` (root, n, ...) of the groups that fit one block, and of the larger ones."""
    large = staged(members.groupBy("root").agg(_blocks()).where("blocks > 1").select("root"), f"{what}-large")
    return ids_join(members, large, "root", "left_anti"), ids_join(members, large, "root", "left_semi")


def _dense_links(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """All links inside large regions (root, cls, heavy, n), but for those between classes that one pivot already connects."""
    members, blocks = staged(members, "ngram-members"), _blocks()
    sets = staged(_sets(docs, reps, members.select("cls")).join(members, "cls"), "ngram-dense-sets")
    links = staged(_pivot_links(sets), "ngram-star")
    # blocks by region and pivot; the classes without a pivot have blocks of their own
    held = members.join(links, "cls", "left")
    weight = staged(held.groupBy("root", "pivot").agg(blocks), "ngram-weight")
    block = lambda number: F.struct("pivot", number.cast("int").alias("number"))
    every = weight.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), block)).alias("block"))
    every = every.groupBy("root").agg(F.collect_list("block").alias("all"))  # an entry for 800,000 shingles or 2,000 classes
    sizes = staged(weight.join(every, "root"), "ngram-blocks").select(
        F.col("root").alias("r"), F.col("pivot").alias("p"), "blocks", "all")
    cut = (held.join(sizes, (F.col("root") == F.col("r")) & F.col("pivot").eqNullSafe(F.col("p")))
           .withColumn("number", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("own", block(F.col("number"))))
    # a row goes to as many tasks as its region has blocks, other than its pivot's
    met = (cut.withColumn("other", F.explode("all"))
           .where("own.pivot IS NULL OR other.pivot IS NULL OR own.pivot <> other.pivot")
           .select("root", "cls", F.xxhash64(F.least("own", "other"), F.greatest("own", "other")).alias("blocks")))
    compared = (met.join(sets.select("cls", "shingles"), "cls").groupBy("root", "blocks")
                .applyInPandas(lambda pdf: _block_links(pdf), "a long, b long"))
    return compared.union(links.where("pivot <> cls").select("pivot", "cls"))


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    nodes = staged(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ngram-nodes")
    sets = staged(_sets(docs, reps, nodes), "ngram-sets")
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b"))
    return both.where(_similar("sa", "sb")).select("a", "b")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    return (pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            .where("NOT coalesce(ra, a) = coalesce(rb, b)").select("a", "b"))


def class_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) -> components of classes (node, root), and members (doc_id, n, cls, text_hash)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = staged(_classes_and_counts(docs), "ngram-classes")
    own = found.where("block IS NULL").select("doc_id", "n", "cls", "text_hash")
    reps = staged(own.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep")), "ngram-reps")
    docs = _one_of_each(docs.where("doc_id IS NOT NULL"), own, reps)
    frequent = _frequent_shingles(docs, reps)
    met = staged(_meetings(_prefix_rows(docs, _order_table(found), _known(frequent)), _hot_shingles(frequent)), "ngram-met")
    dense = met.where("token IS NOT NULL").select("token", "b", "n")
    regions = _regions(dense)
    # a pair inside a region is compared there; any other shares no shingle of a long list, so its count is whole
    pairs = (met.where("token IS NULL")
             .join(regions.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
             .join(regions.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
             .where("matches >= need AND (ra IS NULL OR rb IS NULL OR ra <> rb)").select("a", "b", "matches"))
    pairs = staged(pairs, "ngram-pairs")
    heavy = dense.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("heavy"), F.max("n").alias("n"))
    region, wide = _by_size(regions.join(heavy, "node").select("root", F.col("node").alias("cls"), "heavy", "n"), "ngram-region")
    sizes = own.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.max("n").alias("n"))
    clusters = staged(components(pairs, "ngram-cluster").withColumnRenamed("node", "cls").join(sizes, "cls"), "ngram-cluster")
    cluster, scattered = _by_size(clusters.select("root", "cls", "n"), "ngram-cluster")
    small = staged(cluster.unionByName(region.select("root", "cls", "n")), "ngram-small")
    links = _cluster_links(docs, reps, small)
    if not wide.isEmpty():
        links = links.union(_dense_links(docs, reps, wide))
    pairs = pairs.join(scattered.select(F.col("cls").alias("a")), "a", "left_semi")  # of clusters beyond a block
    some = not scattered.isEmpty()
    if some:
        pairs = staged(pairs, "ngram-pairs")
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")).select("a", "b")
        links = links.union(_verified(docs, reps, staged(best, "ngram-best")))
    roots = staged(components(links, "ngram"), "ngram-roots")
    if some:
        rest = staged(_across(pairs, roots), "ngram-rest")
        more = staged(_verified(docs, reps, rest), "ngram-more")
        if not more.isEmpty():
            roots = staged(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more),
                                      "ngram"), "ngram-roots")
    return roots, own


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, n, text_hash and root (of its component) of every row of ``docs`` (doc_id, text)."""
    roots, own = class_roots(docs)
    own = own.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return staged(own, "ngram-own")


def ngram_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    own = _members(source(docs, doc_id=key, text=text))
    # documents without shingles are alone; all others get their component's smallest id
    low = staged(own.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("low")), "ngram-low-ids")
    return own.join(low, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")))
        .alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group stays (the one with the smallest id, then the smallest hash of its text), all columns as they were.

    A row without an id takes part under a number that comes after all usual ids.
    """
    late = F.lit(1 << 62) + F.pmod(text_hash(text), F.lit(1 << 62))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), late).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = _members(rows).where("n > 0")
    low = staged(own.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("low")), "ngram-low-rows")
    gone = own.join(low, "root").where("doc_id <> low.doc_id OR text_hash <> low.text_hash")
    unnamed = F.col("doc_id") == F.lit(1 << 62) + F.pmod("text_hash", F.lit(1 << 62))
    return without_rows(docs, gone.select(F.when(~unnamed, F.col("doc_id")).alias("doc_id"), "text_hash"), key, text)
