"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text; every block has its root-to-leaf path of tags
(with class, role and the telling words of ids, numbers folded). Text length and punctuation are aggregated per path, over
the page and, by grouped aggregation, over all pages. A path's ratio is its text
per block; the page's own figures are smoothed towards those of the same path in
the whole corpus, so that a short page is judged with its template's help. The
text ratio and the punctuation ratio are fused by their product (Wu et al.,
WWW 2013), weighted by what the path's tags and names say (names lower the marked
subtree, unless it holds most of the page's text). The threshold comes from the
distribution of the page's scores: paths half a deviation above the mean, or near the
best one, are content, inside article and main too; so are the headings, items and cells
beside them. Their blocks are returned in page order.

Defined cases: a null or empty page, or one without visible text, has an empty
text. Unclosed and crossing tags are repaired as far as the paths need it: a block tag
closes an open paragraph, an end tag closes everything above its start, and an
end tag without a start is ignored. The work of a page grows with its length, however deep its tags are. Rows that repeat a page_id are extracted each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from statistics import mean, pstdev

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, source, staged

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "select", "button")
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split())
NEVER = frozenset("nav header footer aside form menu dialog head fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = HEADINGS | frozenset("""ul ol li dl dt dd table caption thead tbody tfoot tr th td blockquote pre figure
    figcaption""".split())
AROUND = frozenset("form dialog fieldset".split())  # of these, such as are also put around a whole page
# words of class and id names, and of roles, that mark what is not the article
NAMES = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies discuss disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination
    popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe
    toolbar widget alert""".split())
CONTENT = frozenset("article main post content story entry".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|"
                   r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
MARKS = re.compile(r"[.,;:!?…。，！？]")

LOWERED = 0.2   # weight of paths below a name of NAMES
PRIOR = 3.0     # blocks of the corpus that a page's own path figures are mixed with
SPREAD = 0.5    # deviations above the mean of a page's scores, from which a path is content
SHARE = 0.4     # of the best path's score, from which it is content in any case: a page may hold nothing else
EASED = 0.4     # of that threshold, for items beside chosen paragraphs outside article and main


class Paths:
    """The tag paths of a page as a tree: node 0 is the page, every node knows its parent and its step, parents come first.

    A path's key is a digest that continues its parent's, so it costs the same at any depth.
    """

    def __init__(self):
        self.parent, self.step, self.key = [0], [""], [""]
        self._nodes: dict[tuple[int, str], int] = {}

    def below(self, node: int, step: str) -> int:
        """The child of ``node`` with this step, made where there is none yet."""
        found = self._nodes.get((node, step))
        if found is None:
            found = self._nodes[node, step] = len(self.parent)
            self.parent.append(node)
            self.step.append(step)
            self.key.append(xxhash.xxh3_128_hexdigest(f"{self.key[node]}/{step}"))
        return found

    def text(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return "/".join(reversed(steps))

    def within(self, names: frozenset) -> list[bool]:
        """Whether a node, or one above it, is a tag of ``names``."""
        out = [False]
        for node in range(1, len(self.parent)):
            out.append(out[self.parent[node]] or _words(self.step[node])[0] in names)
        return out


def parse(page: str) -> tuple[Paths, list[tuple[int, str]]]:
    """The page's paths and its (node, text) blocks in page order; text is decoded, with single spaces.

    One pass: the open tags, how many there are of each name and where the
    open blocks are on the stack are kept up to date, so unclosed tags cost nothing more.
    """
    paths, out, text, at = Paths(), [], [], 0
    stack: list[tuple[str, int]] = []  # open tags with their node; inline tags have that of the block around them
    open_names: Counter = Counter()
    open_blocks: list[int] = []  # positions on the stack

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((stack[-1][1] if stack else 0, joined))
        text.clear()

    def close(size):
        """Pop the open tags beyond ``size``."""
        while len(stack) > size:
            open_names[stack.pop()[0]] -= 1
        while open_blocks and open_blocks[-1] >= size:
            open_blocks.pop()

    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        text.append(page[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCK:
                flush()
            if open_names[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            elif name == "br":
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
            if open_blocks and name not in ("html", "body"):  # a block closes an open paragraph, an item the item before it
                last = stack[open_blocks[-1]][0]
                if last == "p" or (last == name and name in ("li", "td", "th", "tr", "dd", "dt")):
                    close(open_blocks[-1])
        if name in VOID:
            text.append(" ")
            continue
        if name in RAW:
            ends = END[name].search(page, at)
            at = ends.end() if ends else len(page)
            continue
        node = stack[-1][1] if stack else 0
        if name in BLOCK:  # inline tags do not make a path of their own
            node = paths.below(node, name + "".join(_label(*x) for x in NAMED.findall(found[3] or "")))
            open_blocks.append(len(stack))
        open_names[name] += 1
        stack.append((name, node))
    flush()
    return paths, out


def blocks(page: str) -> list[tuple[str, str]]:
    """(path, text) of the text blocks in page order, with the paths written out."""
    paths, found = parse(page)
    return [(paths.text(node), text) for node, text in found]


@lru_cache(100_000)
def _label(kind: str, value: str) -> str:
    """A class, id or role as part of a path: numbers are folded, and of ids only the words that tell something stay."""
    words = set(re.sub(r"[0-9]+", "0", value.strip("\"'").lower()).split())
    if kind.lower() == "id":
        words = {w for word in words for w in _parts(word)} & (NAMES | CONTENT)
    return "".join("." + w for w in sorted(words))


def _parts(word: str) -> list[str]:
    return re.split(r"[-_]|(?<=[a-z])(?=[0-9])", word)


@lru_cache(100_000)
def _words(step: str) -> tuple[str, tuple[frozenset, ...]]:
    """The tag of a step, and the words of each of its names."""
    name, *names = step.split(".")
    return name, tuple(frozenset(_parts(n)) for n in names)


@lru_cache(100_000)
def _is_article(step: str) -> bool:
    """An article by its tag, or by a name that says so and nothing else."""
    name, names = _words(step)
    return name in ("article", "main") or any(n & CONTENT and not n & NAMES for n in names)


@lru_cache(100_000)
def _is_other(step: str) -> bool:
    """Another part by a name, of which a word counts more than those of content beside it (``post-comments``)."""
    names = _words(step)[1]
    return any(n & NAMES for n in names) and not any(n & CONTENT and not n & NAMES for n in names)


def wrappers(paths: Paths, own: dict[int, list[int]]) -> list[bool]:
    """Which nodes hold most of the page's text, so that their names tell nothing about it.

    A subtree beside which an article (by tag or name) has a part of the text is none: long comments stay comments.
    """
    size, never = len(paths.parent), paths.within(NEVER - AROUND)
    article, held, inside = [False] * size, [0] * size, [0] * size
    for node in range(1, size):
        article[node] = article[paths.parent[node]] or _is_article(paths.step[node])
    for node, (_, chars, _) in own.items():
        if not never[node]:
            held[node] = chars
            inside[node] = chars if article[node] else 0
    for node in range(size - 1, 0, -1):
        held[paths.parent[node]] += held[node]
        inside[paths.parent[node]] += inside[node]
    return [2 * held[n] > held[0] and 10 * (inside[0] - inside[n]) < held[0] for n in range(size)]


def said(paths: Paths, around: list[bool]) -> list[float]:
    """What the tags and names of every path tell: 0 below tags that are never the article, little below names of other parts.

    Names of html, body and of the ancestors ``around`` (see ``wrappers``) lower nothing.
    """
    weight, lowered = [1.0], [1.0]
    for node in range(1, len(paths.parent)):
        step, above = paths.step[node], paths.parent[node]
        name = _words(step)[0]
        weight.append(2.0 if _is_article(step) else weight[above])
        low = lowered[above]
        if name not in ("html", "body") and not (around[node] and (name not in NEVER or name in AROUND)):
            low = 0.0 if name in NEVER else min(low, LOWERED) if _is_other(step) else low
        lowered.append(low)
    return [w * x for w, x in zip(weight, lowered)]


def path_totals(found: list[tuple[int, str]]) -> dict[int, list[int]]:
    """node -> [blocks, characters, punctuation marks]."""
    totals: dict[int, list[int]] = {}
    for node, text in found:
        t = totals.setdefault(node, [0, 0, 0])
        t[0] += 1
        t[1] += len(text)
        t[2] += len(MARKS.findall(text))
    return totals


def content_paths(paths: Paths, own: dict[int, list[int]], corpus: dict[str, tuple[float, float]]) -> set[int]:
    """Nodes whose smoothed and fused ratio stands out among the page's; ``corpus`` has figures by path key."""
    told = said(paths, wrappers(paths, own))
    scores = {}
    for node, (n, chars, marks) in own.items():
        mean_chars, mean_marks = corpus.get(paths.key[node], (chars / n, marks / n))
        ratio = (chars + PRIOR * mean_chars) / (n + PRIOR)
        punctuation = (marks + PRIOR * mean_marks) / (n + PRIOR)
        scores[node] = told[node] * (ratio * (1 + punctuation)) ** 0.5
    known = [x for x in scores.values() if x > 0]
    if not known:
        return set()
    level = min(mean(known) + SPREAD * pstdev(known), SHARE * max(known))
    chosen = {p for p, x in scores.items() if x >= level}
    # headings, items and cells beside chosen paragraphs belong to the same article, however short they are
    homes = {paths.parent[p] or p for p in chosen}
    above = set()
    for home in homes:
        while home not in above:
            above.add(home)
            home = paths.parent[home] or home  # the page itself is no article's container
    outside = _containers(paths)
    for node in own.keys() - chosen:
        home, heading = _home(paths, outside, node)
        if home is None or told[node] < 1:
            continue
        if told[node] > 1 and home in above:
            chosen.add(node)
        elif home in homes and (heading or scores[node] >= EASED * level):
            chosen.add(node)
    return chosen


def _containers(paths: Paths) -> list[int]:
    """For every node the nearest one, itself included, that is no item."""
    out = [0]
    for node in range(1, len(paths.parent)):
        out.append(out[paths.parent[node]] if _words(paths.step[node])[0] in ITEMS else node)
    return out


def _home(paths: Paths, outside: list[int], node: int) -> tuple[int | None, bool]:
    """The container of a heading, list item, cell or quotation, and whether it is a heading; None for other blocks."""
    name = _words(paths.step[node])[0]
    item = paths.parent[node] if name == "p" else node
    return (outside[item] if outside[item] != item else None), name in HEADINGS


def _pages(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    return source(pages, page_id=key, url=url, html=markup).select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))


def path_ratios(pages: DataFrame) -> DataFrame:
    """path (its key), chars, marks: means per block over all pages that have the path; ``pages`` has a column html."""
    def run(batches):
        for batch in batches:
            totals: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                paths, found = parse(page or "")
                for node, t in path_totals(found).items():
                    mine = totals.setdefault(paths.key[node], [0, 0, 0])
                    for k in range(3):
                        mine[k] += t[k]
            yield pa.RecordBatch.from_pydict({
                "path": pa.array(list(totals), pa.string()),
                **{n: pa.array([t[k] for t in totals.values()], pa.int64()) for k, n in enumerate(("n", "chars", "marks"))}})

    sums = pages.select("html").mapInArrow(run, "path string, n long, chars long, marks long")
    return sums.groupBy("path").agg((F.sum("chars") / F.sum("n")).alias("chars"),
                                    (F.sum("marks") / F.sum("n")).alias("marks"), F.sum("n").alias("n"))


COMMON = 50_000  # paths whose corpus figures are sent to every task; those of rarer paths reach their pages by a shuffle


def _text(paths: Paths, found: list[tuple[int, str]], own: dict[int, list[int]], corpus: dict[str, tuple[float, float]]) -> str:
    chosen = content_paths(paths, own, corpus)
    return "\n".join(text for node, text in found if node in chosen)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    spark = pages.sparkSession
    bound_batches(spark, rows=500)
    rows = _pages(pages, key, url, markup)
    ratios = staged(path_ratios(rows), "html-paths")
    common = ratios.orderBy(F.desc("n"), "path").limit(COMMON).collect()
    corpus = spark.sparkContext.broadcast({r.path: (r.chars, r.marks) for r in common})
    more = ratios.count() > len(common)

    def run(batches):
        # a page with rarer paths keeps its markup, named by its digest, instead of getting a text
        for batch in batches:
            texts, markups, names, rare = [], [], [], []
            for page in batch.column(2).to_pylist():
                paths, found = parse(page or "")
                own = path_totals(found)
                missing = [paths.key[p] for p in own if paths.key[p] not in corpus.value] if more else []
                texts.append(None if missing else _text(paths, found, own, corpus.value))
                markups.append(page if missing else None)
                names.append(xxhash.xxh3_128_hexdigest(page) if missing else None)
                rare.append(missing)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(markups, pa.string()),
                 pa.array(names, pa.string()), pa.array(rare, pa.list_(pa.string()))], TRIED.names)

    def again(batches):
        for batch in batches:
            texts = []
            for page, figures in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                paths, found = parse(page)
                own = path_totals(found)
                known = {k: corpus.value[k] for k in (paths.key[p] for p in own) if k in corpus.value}
                texts.append(_text(paths, found, own, known | {x["path"]: (x["chars"], x["marks"]) for x in figures}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    TRIED = StructType.fromDDL("page_id long, url string, text string, html string, name string, rare array<string>")
    tried = rows.mapInArrow(run, TRIED)
    done = lambda df: df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    if not more:
        return done(tried)
    tried = staged(tried, "html-tried")
    # equal markup has equal paths: the figures meet once per digest, and only pages that need some are shuffled
    asked = tried.where("html IS NOT NULL").select("name", F.explode("rare").alias("path")).distinct()
    figures = (asked.join(ratios.select("path", "chars", "marks"), "path").groupBy("name")
               .agg(F.collect_list(F.struct("path", "chars", "marks")).alias("figures")))
    rest = (tried.where("html IS NOT NULL").join(staged(figures, "html-figures"), "name")
            .select("page_id", "url", "html", "figures").mapInArrow(again, "page_id long, url string, text string"))
    return done(tried.where("html IS NULL")).union(done(rest))
