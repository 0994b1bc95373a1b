"""Quality rules (op11), filter audit (op12) and vector codes (op13) against brute force and odd input."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentwise.llm import audit, codes, rules
from tests.llm.test_operators import ODD, docs_of

LABELS = "doc_id long, quality int, toxic int, text string"


def words_of(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts_of(text):
    words, lines = words_of(text), (text or "").split("\n")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, again = set(), 0
    for line in lines:
        again += bool(words_of(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


# --- op11 -------------------------------------------------------------------

def test_op11_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [t if t != ODD[5] else "word " * 300 for t in ODD] + ["a a a a", "a b c a b c", "x y z\nx y z\n\n \nx y z", "a b c d a b c", "é☃ é☃ é☃"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) + rng.choice(["", "\n", "\x0b#", "\x85 <|>"]) for _ in range(60)]
    texts += ["\n".join(rng.choice(["one", "two ", "", "\t"]) for _ in range(12)) for _ in range(10)]
    got = {r.doc_id: tuple(r[c] for c in rules.COUNTS) for r in rules.text_counts(docs_of(spark, texts)).collect()}
    assert got == {i: counts_of(t) for i, t in enumerate(texts)}


def test_op11_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (0, 1, 7, 60, 300, 4000) for k in (0, 1, 2, 5, 40, 150) if k <= n]
    frame = spark.createDataFrame(cases, "k long, n long")
    got = frame.select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for k, n, p in got:
        want = sum(math.comb(n, i) * 0.05 ** i * 0.95 ** (n - i) for i in range(k + 1)) if n and k < 0.05 * n else 1.0
        assert p == pytest.approx(want, rel=1e-9), (k, n)
    big = spark.createDataFrame([(499_000, 10_000_000)], "k long, n long")  # normal approximation: z = -1.4502
    assert big.select(rules.binomial_tail(F.col("k"), F.col("n"), 0.05)).first()[0] == pytest.approx(0.0735, abs=0.0005)


def corpus(n, langs, seed, bad_share=0.25):
    """Good prose, and junk full of symbols; labels of all."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        bad = rng.random() < bad_share
        words = [f"w{rng.randrange(5000)}" + ("#$%" if bad else "") for _ in range(60 + rng.randrange(60))]
        docs.append((i, " ".join(words), rng.choice(langs), "src"))
        labels.append((i, int(not bad), 0, "clash"))
    return docs, labels


def test_op11_certifies_per_stratum_and_keeps_clean_documents(spark):
    docs, labels = corpus(900, ["en"] * 6 + ["fr"] * 3 + [None], 5)
    docs += [(None, docs[0][1], "en", "x"), (900, None, "en", "x"), (901, "short one", None, "x"), (0, docs[0][1], "en", "x")]
    labels += [(None, 1, 0, ""), (1, None, 0, ""), (2, labels[2][1], 0, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, quality string")
    got = rules.judge_quality(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    bad = {i for i, q, _, _ in labels if q == 0}
    for r in got:
        if r.doc_id is not None and r.doc_id < 900 and r.stratum in ("en", "fr"):
            assert r.kept == (r.doc_id not in bad), r
    none = [r for r in got if r.stratum == "" and not r.base_failed]
    assert none and all(r.kept and r.rejected_by == "" for r in none)  # too few labels there to certify anything
    assert {(r.kept, r.base_failed) for r in got if r.doc_id in (900, 901)} == {(False, True)}
    assert rules.judge_quality(frame.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    without = rules.judge_quality(frame, spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept == (not r.base_failed) for r in without)


def test_op11_no_configuration_beyond_the_risk_is_certified(spark):
    # one rule's score is noise: any cutoff on it would reject good documents as often as bad ones
    rng = random.Random(9)
    rows = [(i, "en", [rng.randrange(1000)] + [0] * (len(rules.RULES) - 1), rng.randrange(2), i % 2 == 0) for i in range(4000)]
    known = spark.createDataFrame(rows, "doc_id long, stratum string, scores array<int>, good long, tune boolean")
    for r in rules.certified_cutoffs(known).collect():
        out = [row for row in rows if row[3] and not row[4] and any(s > c for s, c in zip(row[2], r.cutoffs))]
        assert r.k_good == len(out) and r.n_good == sum(row[3] and not row[4] for row in rows)
        assert len(out) <= rules.RISK * r.n_good and r.p_value <= rules.DELTA


# --- op12 -------------------------------------------------------------------

def test_op12_popcount_equals_counting():
    rng = np.random.default_rng(4)
    for n in (0, 1, 62, 63, 64, 500, 5000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(sum((int(w) >> b) & 1 for w in words)) for b in range(32)]
        assert audit.positional_popcount(words).tolist() == want
    for failed in range(32):
        assert all(((int(audit.WORDS[failed]) >> s) & 1) == (not s & failed) for s in range(32))


def fails(docs):
    out = []
    for doc_id, text, *_ in docs:
        t = text or ""
        w = words_of(t)
        out.append([len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                    any(c in "#$%&*|" for c in t),
                    doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs)])
    return out


def test_op12_equals_brute_force(spark):
    rng, docs = random.Random(6), []
    for i in range(120):
        words = [rng.choice(["Word", "word", "LOUD", "a#b"] if i % 3 else [f"v{rng.randrange(900)}"]) for _ in range(rng.choice([5, 110, 130]))]
        docs.append((i, " ".join(words), rng.choice(["en", "de", "", None]), "x"))
    docs += [(200 + k, docs[k % 7][1], rng.choice(["en", "fr"]), "x") for k in range(30)]
    docs += [(300, None, "en", "x"), (301, "", None, "x"), (302, " ", "en", "x"), (None, docs[0][1], "en", "x"), (None, None, "de", "x"),
             (0, docs[0][1], "de", "x"), (5, "other text", "fr", "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "") for i in range(0, 320, 2)] + [(4, 1, 1, ""), (4, 0, 0, ""), (None, 1, 1, "")]
    got = audit.audit_filters(spark.createDataFrame(docs, "doc_id long, text string, lang string, failed string"),
                              spark.createDataFrame(labels, LABELS)).collect()
    bad, parts = fails(docs), sorted({d[2] or "" for d in docs})
    of = lambda i, at: any(l[0] == docs[i][0] and l[at] == 1 for l in labels) and docs[i][0] is not None
    assert len(got) == 600 * len(parts)
    seen, removed_by = {}, {}
    for part in parts:
        ids = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            alive = set(ids)
            for step, name in enumerate(order, 1):
                at = "ABCDE".index(name)
                out = {i for i in alive if bad[i][at]}
                alone = sum(bad[i][at] and sum(bad[i]) == 1 for i in ids)
                redundant = sum(bad[i][at] for i in ids) - len(out)
                alive -= out
                seen[part, "".join(order), step] = (len(alive), len(out), redundant, alone, sum(of(i, 1) for i in out), sum(of(i, 2) for i in out))
                removed_by[part, name] = removed_by.get((part, name), 0) + len(out)
    for r in got:
        assert seen[r.part, r.filter_order, r.step] == (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost)
        assert r.shapley == removed_by[r.part, r.filter_order[r.step - 1]]
    assert audit.audit_filters(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).count() == 0


def test_op12_hot_copies_stay_off_the_shuffle(spark):
    docs = [(i, "the same words", "en") for i in range(400)] + [(400 + i, f"own words {i}", "en") for i in range(200)]
    rows = audit.copies_marked(audit.staged(audit.failures(spark.createDataFrame(docs, "doc_id long, text string, lang string")), "t"))
    assert rows.where("failed >= 16").count() == 399
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [coalesce(digest" in plan  # winners of hot groups meet their rows without a shuffle


# --- op13 -------------------------------------------------------------------

def coded(vectors, entries=codes.ENTRIES):
    """Codes by plain loops: (vec_id, code, error) and the codebooks' digest."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 16
    part = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (gap(part(v, p), books[p][e]), e))
    for _ in range(2):
        new = []
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p), []).append(part(v, p))
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else books[p][e] for e in range(len(books[p]))])
        books = new
    out = []
    for i, v, lab in kept:
        at = [near(v, p) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for e in at), sum(gap(part(v, p), books[p][e]) for p, e in enumerate(at)), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(((i, c, e, total[lab]) for i, c, e, lab in out), key=str), hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("n, dimension, scale", [(150, 32, 0.3), (40, 16, 0.01), (90, 32, 1e6), (90, 32, 3e9)])
def test_op13_equals_brute_force(spark, n, dimension, scale):
    rng = np.random.default_rng(n)
    vectors = [(i, (rng.standard_normal(dimension) * scale).astype(np.float32).tolist(), [0, 1, 1, None][i % 4]) for i in range(n)]
    vectors += [(n + k, vectors[3][1], 1) for k in range(20)] + [(2, vectors[9][1], 1), (None, vectors[4][1], None)]
    vectors += [(1000, None, 1), (1001, [float("nan")] * dimension, 1), (1002, [None] + [0.0] * (dimension - 1), 1),
                (-5, [float("inf")] * dimension, 1)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash"))
    got = codes.compress_vectors(frame).collect()
    want, digest = coded(vectors)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == [
        tuple(x if not isinstance(x, int) or abs(x) < 2 ** 63 else None for x in row) for row in want]
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_op13_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.compress_vectors(spark.createDataFrame([], schema)).count() == 0
    assert codes.compress_vectors(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    rows = [(1, [0.5] * 20, 1), (2, [0.25] * 7, 1), (3, [0.1] * 20, 2)]
    got = {r.vec_id: r for r in codes.compress_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got[2].code is None and got[2].error is None and got[1].error == got[3].error == 0  # another length; padded parts
    empty = codes.compress_vectors(spark.createDataFrame([(1, [], 1)], schema)).collect()
    assert empty[0].error == 0 and empty[0].code == "00" * 16


def test_op13_search_expands_no_further_than_needed():
    rng = np.random.default_rng(3)
    entries = rng.integers(-80, 80, (16, 64, 4))
    parts = rng.integers(-80, 80, (300, 16, 4))
    books = codes.Codebooks(entries)
    got, far = books.nearest(parts)
    full = ((parts[:, :, None, :] - entries[None]) ** 2).sum(-1)
    assert (got == full.argmin(axis=2)).all() and (far == full.min(axis=2)).all()
    ties = codes.Codebooks(np.zeros((16, 5, 4), np.int64))
    assert (ties.nearest(parts)[0] == 0).all()  # equal distances: the lower index
