"""Operators that SQL cannot express, against plain loops over small inputs."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rentwise.llm import html_text, language, quality, secret_scan
from rentwise.llm import queries as Q
from tests.llm.test_operators import SF, groups_of, sets_of


def test_op4_ownership_by_plain_counts(spark):
    rng = random.Random(17)
    pool = [f"Zx9Kq2Lm7Pw4Rt8Vb3Nc6Yd{k:02d}" for k in range(40)]
    rows = []
    for i in range(400):
        held = [rng.choice(pool[: 1 + int(rng.random() ** 2 * 40)]) for _ in range(rng.randrange(4))]
        owner = rng.choice([None, "a", "b", "c", "d"][: rng.choice([1, 2, 5])])
        rows.append((rng.choice([i, i, None, 7]), " and ".join(["key"] + held), owner, None if owner is None else f"{owner}/{rng.randrange(4)}"))
    rows += rows[:50]  # delivered again
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = secret_scan.scan_secrets(docs, repo="repo").collect()
    documents, repos, owners = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text, owner, repo in rows:
        for value in [w for w in text.split() if w in pool]:
            documents[value].add((i, text, owner, repo)), repos[value].add((owner, repo)), owners[value].add(owner)
    n_docs = {v: sum(Counter((o, r) for _, _, o, r in d).values()) for v, d in documents.items()}
    example = {v for v in pool if len(owners[v]) >= 3 or (len(repos[v]) >= 3 and n_docs.get(v, 0) >= 10) or n_docs.get(v, 0) >= 100}
    assert 0 < len(example) < len([v for v in pool if documents[v]])
    want = Counter()
    for i, text, _, _ in rows:
        spans, at = [], 0
        for word in text.split(" "):
            if word in pool and word not in example:
                spans.append(f"token:{at}:{at + len(word)}")
            at += len(word) + 1
        words = [w for w in text.split() if w in pool]
        # a row is named by id and text: where equal ones have several owners, all get one result
        want[i, ",".join(spans), sum(w in example for w in words), sum(len(owners[w]) > 1 for w in words)] += 1
    assert Counter((r.doc_id, r.spans, r.n_examples, r.n_copied) for r in got) == want


def plain_paths(node, path, out):
    """Text blocks of a tree of (tag, children), by recursion; texts are strings."""
    for child in node:
        if isinstance(child, str):
            out.append((path, child))
        else:
            plain_paths(child[1], f"{path}/{child[0]}" if path else child[0], out)
    return out


def markup(node):
    return "".join(c if isinstance(c, str) else f"<{c[0]}>{markup(c[1])}</{c[0]}>" for c in node)


def tree(rng, depth):
    out = []
    for _ in range(rng.randrange(1, 4)):
        if depth and rng.random() < 0.6:
            out.append((rng.choice(["div", "section", "article", "ul", "blockquote"]), tree(rng, depth - 1)))
        elif not out or not isinstance(out[-1], str):
            out.append(rng.choice(["Some words, and more.", "one", "Two; three: four!"]))
    return out


def test_op5_path_figures_by_recursion(spark):
    rng = random.Random(23)
    trees = [[("body", tree(rng, 4))] for _ in range(60)]
    bodies = [markup(t) for t in trees]
    totals = defaultdict(lambda: [0, 0, 0])
    for t, body in zip(trees, bodies):
        plain = plain_paths(t, "", [])
        assert html_text.blocks(body) == plain
        for path, text in plain:
            mine = totals[path]
            mine[0] += 1
            mine[1] += len(text)
            mine[2] += sum(c in ".,;:!?" for c in text)

    def key(path):
        paths, node = html_text.Paths(), 0
        for step in path.split("/"):
            node = paths.below(node, step)
        return paths.key[node]

    pages = spark.createDataFrame([(b,) for b in bodies], "html string")
    got = {r.path: (r.n, r.chars, r.marks) for r in html_text.path_ratios(pages).collect()}
    assert got == {key(p): (n, pytest.approx(c / n), pytest.approx(m / n)) for p, (n, c, m) in totals.items()}


def test_op5_wrappers_and_weights_by_plain_prefixes():
    rng = random.Random(29)
    steps = ["div", "div.content", "div.sidebar", "section.post-comments", "article", "nav", "form", "p", "li", "div.menu"]
    for _ in range(300):
        paths, own = html_text.Paths(), {}
        for _ in range(rng.randrange(1, 12)):
            node = paths.below(0, "body")
            for _ in range(rng.randrange(5)):
                node = paths.below(node, rng.choice(steps))
            own[node] = [1, rng.randrange(1, 200), 1]
        prefixes = {n: [paths.text(n).split("/")[:k] for k in range(1, len(paths.text(n).split("/")) + 1)] for n in range(1, len(paths.parent))}
        tag = lambda step: step.split(".")[0]
        plain = {n for n in own if not any(tag(s) in html_text.NEVER - html_text.AROUND for s in prefixes[n][-1])}
        total = sum(own[n][1] for n in plain)
        article = lambda s: tag(s) in ("article", "main") or s == "div.content"
        around = html_text.wrappers(paths, own)
        told = html_text.said(paths, around)
        for n in range(1, len(paths.parent)):
            path = prefixes[n][-1]
            held = sum(own[m][1] for m in plain if prefixes[m][-1][:len(path)] == path)
            beside = sum(own[m][1] for m in plain if prefixes[m][-1][:len(path)] != path and any(map(article, prefixes[m][-1])))
            assert around[n] == (2 * held > total and 10 * beside < total)
            weight = 2.0 if any(map(article, path)) else 1.0
            for k, step in enumerate(path):
                at = next(m for m in range(1, len(paths.parent)) if prefixes[m][-1] == path[:k + 1])
                if tag(step) == "body" or (around[at] and (tag(step) not in html_text.NEVER or tag(step) in html_text.AROUND)):
                    continue
                if tag(step) in html_text.NEVER:
                    weight = 0.0
                elif step in ("div.sidebar", "section.post-comments", "div.menu"):
                    weight = min(weight, (2.0 if any(map(article, path)) else 1.0) * html_text.LOWERED)
            assert told[n] == pytest.approx(weight), paths.text(n)


def test_pipeline_equals_brute_force(spark):
    """Every stage by plain loops, given the quality model's verdicts; then the library's ids."""
    import corpus_pipeline

    sentencepiece = pytest.importorskip("sentencepiece")
    if not os.path.exists(Q.PIECES):
        pytest.skip("no model file")
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == docs.count()
    good = sorted(r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted)
    groups = defaultdict(list)
    for i in good:
        groups["".join((texts[i] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))].append(i)
    single = sorted(min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in groups.values())
    roots = groups_of([texts[i] for i in single])
    apart = [i for k, i in enumerate(single) if roots[k] == k]
    bench = [s for s in sets_of([r.text for r in items.collect()]) if s]
    clean = [i for i, own in zip(apart, sets_of([texts[i] for i in apart])) if not any(100 * len(own & s) >= 75 * len(s) for s in bench)]
    assert len(texts) > len(good) > len(single) >= len(apart) >= len(clean) > 50
    lib = sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: lib.encode(texts[i] or "") for i in clean}


def test_op1_fuses_by_plain_sums(spark):
    """Without text the answer is that of the declared language, the address and the host's smoothed prior; ties go to the first language."""
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the house and the garden with the old tree", "en"), ("das Haus und der Garten mit dem alten Baum", "de")] * 30)],
        "doc_id long, text string, lang string")
    page = "<html lang={}><body><p>{}</p></body></html>"
    de, en = "der alte Garten und das Haus mit dem Baum", "the garden with the old house and tree"
    rows = [(i, f"http://{h}.site.example/{i}", page.format(lang, t)) for i, (h, lang, t) in enumerate(
        [("a", "de", de)] * 8 + [("b", "en", en)] * 8)]
    rows += [(100, "http://a.site.example/none", "<p></p>"), (101, "http://b.site.example/none", "<p></p>"),
             (102, "http://a.site.example/none", "<p></p>"), (100, "http://b.site.example/again", "<p></p>"), (None, None, None)]
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert len(got) == len(rows)
    of = lambda i: sorted(r.lang for r in got if r.page_id == i)
    assert of(101) == ["en"] and of(102) == ["de"] and of(100) == ["de", "en"]  # rows that repeat a page_id are judged each
    assert all(of(i) == [["de", "en"][i >= 8]] for i in range(16))
    assert all(0 < r.probability <= 1 for r in got)


def test_op1_host_priors_by_recursion(spark):
    rng = random.Random(31)
    hosts = ["en.site.com", "de.site.com", "www.site.com", "site.com", "a.b.c.d.org", "c.d.org", "", "com", ".".join("x" * 200), "new.site.com"]
    rows = [(rng.choice(hosts[:-1]), rng.choice(["de", "en", "en", None])) for _ in range(200)] + [("new.site.com", None)]
    prior = [0.25, 0.75]
    seen = spark.createDataFrame(rows, "host string, guess string")
    got = {r.host: r.prior for r in language.host_priors(seen, ["de", "en"], prior).collect()}
    suffixes = lambda h: [".".join(h.split(".")[-k:]) for k in range(1, len(h.split(".")) + 1)] if len(h) <= 253 else [h]

    def smoothed(chain):
        above = smoothed(chain[:-1]) if len(chain) > 1 else prior
        own = [sum(g == x and chain[-1] in suffixes(h) for h, g in rows) for x in ("de", "en")]
        return [(c + language.PULL * p) / (sum(own) + language.PULL) for c, p in zip(own, above)]

    assert got.keys() == {h for h, _ in rows}
    for host in got:
        assert got[host] == pytest.approx(smoothed(suffixes(host))), host
    assert got["new.site.com"] == pytest.approx(got["site.com"])  # nothing known of itself
