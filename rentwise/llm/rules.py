"""Quality rules whose cutoffs carry a guarantee against false rejection (DataFrame and SQL functions only).

Every text gets a few counts, and from them one score from 0 to 10,000 per rule,
higher being worse. Cutoffs come from labelled documents, for each stratum
(language) on its own:

1. One half of the labelled documents proposes. For each share of ``LADDER`` a
   rule's cutoff lies half way between the last score within that share of the
   good documents and the next score seen; a rule that does not catch bad
   documents ``LIFT`` times as often as good ones is off. The cutoffs of all rules
   at one share are a configuration, and a stratum's configurations form a fixed
   sequence from lenient to strict.
2. The other half certifies. With k of its n good documents rejected by any rule of
   a configuration, the exact binomial tail P(X <= k), X ~ Bin(n, ``RISK``), is the
   p-value of "more than ``RISK`` of the good documents are rejected". Fixed-sequence
   testing needs no further correction within a stratum; the strata share the
   error ``DELTA`` equally (Bonferroni). So with probability 1 - ``DELTA`` no chosen
   configuration of any stratum rejects more than ``RISK`` of the good documents there.
3. Of the certified configurations the one with the best difference between the
   proposing half's bad and good rejections is taken, of equal ones the most lenient.

A stratum without enough labels certifies nothing and its rules stay off. The
guarantee is about good documents that pass the base rules, drawn as the labelled
ones are.

Defined cases: a null text has no words and fails the base rules. A null stratum
is the empty string. Several labels of one doc_id count as their mean, at least one
half being good; null ids and labels teach nothing. Of labelled rows that repeat a
doc_id the one with the smallest (stratum, scores) teaches; every row is judged on its own. Without
labels no rule is on. One text's windows are sorted inside its row, about 150
bytes a word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, source, staged

RISK, DELTA = 0.05, 0.05
LADDER = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
LIFT = 5
MIN_WORDS, MAX_REPEATED = 50, 50
TOP = 10_000

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = ("symbols", "duplicate_lines", "repeated_words", "short_words", "long_words", "upper_case", "marks")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: windows sorted, equal neighbours, positions covered."""
    n = F.size(words)
    windows = F.sort_array(F.arrays_zip(
        F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c"),
        F.sequence(F.lit(0), n - 3).alias("at")))
    return F.when(n < 4, F.array().cast("array<struct<a:string,b:string,c:string,at:int>>")).otherwise(windows)


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts of ``COUNTS`` and of lines, upper-case letters and marks."""
    rows = source(docs, doc_id=key, text=text, stratum=stratum).select(
        "doc_id", F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "stratum", "text", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.withColumn("windows", _repeat_words(F.col("words")))
    same = F.filter(F.arrays_zip(F.col("windows").alias("x"), F.slice("windows", 2, F.size("words")).alias("y")),
                    lambda p: (p.x.a == p.y.a) & (p.x.b == p.y.b) & (p.x.c == p.y.c))
    covered = F.flatten(F.transform(same, lambda p: F.array(*[s + k for s in (p.x["at"], p.y["at"]) for k in range(3)])))
    return rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), _without(F.col("text"), UPPER).alias("n_upper"),
        _without(F.col("text"), "!?").alias("n_marks"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def rule_scores() -> list[Column]:
    """The scores of ``RULES``, integers from 0 to ``TOP``."""
    share = lambda part, whole: F.expr(f"{TOP} * {part} DIV greatest({whole}, 1)").cast("int")
    return [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
            share("n_words", "word_chars"), TOP - share("n_words", "word_chars"), share("n_upper", "word_chars"),
            share("n_marks", "word_chars")]


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Bin(n, p), summed term by term down from k; 1 where k / n reaches p (no test can pass there).

    The logarithm of the term at k is a sum of k logarithms, so large n neither under- nor overflows.
    """
    one = F.lit(1).cast("long")
    logs = F.aggregate(F.sequence(one, k), F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))
    first = F.when(k > 0, logs).otherwise(0.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    step = lambda s, i: F.struct((s.term * i * (1 - p) / ((n - i + 1) * p)).alias("term"),
                                 (s.total + s.term * i * (1 - p) / ((n - i + 1) * p)).alias("total"))
    sums = F.aggregate(F.sequence(k, one), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step,
                       lambda s: s.total)
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(F.exp(first) * F.when(k > 0, sums).otherwise(1.0))


def labelled(counts: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """doc_id, stratum, scores, good and tune (the proposing half, by the id's digest) of the labelled documents that pass the base rules."""
    marks = (source(labels, doc_id=key, y=label).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id")
             .agg((F.avg("y") >= 0.5).cast("long").alias("good")))
    rows = counts.where(~base_failed()).select("doc_id", F.struct("stratum", F.array(*rule_scores()).alias("scores")).alias("s"))
    return (rows.join(marks, "doc_id").groupBy("doc_id").agg(F.min("s").alias("s"), F.max("good").alias("good"))
            .select("doc_id", "s.stratum", "s.scores", "good", (F.md5(F.col("doc_id").cast("string")) < "8").alias("tune")))


def configurations(known: DataFrame) -> DataFrame:
    """(stratum, level, cutoffs): the proposing half's cutoffs of all rules at each share of ``LADDER``.

    The histograms by score have at most ``TOP`` + 1 rows for a rule of a stratum, so a window over one is bounded.
    """
    bars = (known.where("tune").select("stratum", "good", F.posexplode("scores").alias("rule", "score"))
            .groupBy("stratum", "rule", "score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    rule = Window.partitionBy("stratum", "rule")
    above = rule.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.select(
        "stratum", "rule", "score", F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_above"),
        F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_above"),
        F.lag("score").over(rule.orderBy(F.desc("score"))).alias("next"),
        F.sum("good").over(rule).alias("n_good"), F.sum("bad").over(rule).alias("n_bad"))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(e)).alias("share")) for i, e in enumerate(LADDER)])
    cut = (bars.select("*", F.explode(levels).alias("l")).where("good_above <= l.share * n_good")
           .groupBy("stratum", "rule", "l.level").agg(F.min_by(F.struct("*"), "score").alias("c")))
    useful = F.expr(f"c.next IS NOT NULL AND c.bad_above * c.n_good >= {LIFT} * (c.good_above + 1) * c.n_bad AND c.bad_above > 0")
    cut = cut.select("stratum", "level", "rule", F.when(useful, F.expr("(c.score + c.next) DIV 2").cast("int")).otherwise(TOP)
                     .alias("cutoff"))
    return cut.groupBy("stratum", "level").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rule", "cutoff"))), lambda x: x.cutoff).alias("cutoffs"))


def over(scores: Column, cutoffs: Column) -> Column:
    """Names of the rules whose score lies above their cutoff."""
    return F.array_compact(F.array(*[F.when(F.get(scores, F.lit(i)) > F.get(cutoffs, F.lit(i)), F.lit(name))
                                     for i, name in enumerate(RULES)]))


def certified_cutoffs(known: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified configuration: stratum, level, cutoffs, n_good, k_good, p_value."""
    sets = staged(configurations(known), "rules-configurations")
    strata = known.where("NOT tune AND good = 1").select("stratum").distinct().count()
    tried = staged(known.join(sets, "stratum").select(
        "stratum", "level", "tune", "good", (F.size(over(F.col("scores"), F.col("cutoffs"))) > 0).cast("long").alias("out"))
        .groupBy("stratum", "level").agg(
            F.sum(F.expr("if(NOT tune AND good = 1, 1, 0)")).alias("n_good"),
            F.sum(F.expr("if(NOT tune AND good = 1, out, 0)")).alias("k_good"),
            F.avg(F.expr("if(tune AND good = 1, out, null)")).alias("good_share"),
            F.avg(F.expr("if(tune AND good = 0, out, null)")).alias("bad_share")), "rules-tried")
    tested = tried.withColumn("p_value", binomial_tail(F.col("k_good"), F.col("n_good"), risk))
    path = Window.partitionBy("stratum").orderBy("level")
    passed = tested.withColumn("worst", F.max("p_value").over(path)).where(F.col("worst") <= delta / max(1, strata))
    gain = F.coalesce("bad_share", F.lit(0.0)) - F.coalesce("good_share", F.lit(0.0))
    best = passed.groupBy("stratum").agg(F.max_by(
        F.struct("level", "n_good", "k_good", "p_value"), F.struct(gain, -F.col("level"))).alias("b")).select("stratum", "b.*")
    return best.join(sets, ["stratum", "level"])


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
                  label: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, rejected_by (rules, comma-joined) and its stratum."""
    counts = staged(text_counts(docs, key, text, stratum), "rules-counts")
    cutoffs = certified_cutoffs(staged(labelled(counts, labels, key, label), "rules-labelled"), risk, delta)
    judged = join_counted(counts, cutoffs.select("stratum", "cutoffs"), "stratum")
    judged = judged.withColumn("broken", F.coalesce(over(F.array(*rule_scores()), F.col("cutoffs")), F.array().cast("array<string>")))
    failed = base_failed()
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.size("broken") == 0)).alias("kept"),
                         F.array_join("broken", ",").alias("rejected_by"), "stratum")
