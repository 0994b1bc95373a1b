"""DuckDB SQL for the operators that SQL can express, written from the contracts."""

_SPACE = r"[\x20\x09-\x0D]"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS points, sha256(regexp_replace(text, '{_SPACE}', '', 'g')) AS text_sha256 FROM d),
g AS (SELECT text_sha256, count(*) AS group_size,
             first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str) -> str:
    """(key, shingle) rows, distinct: five words, or the whole sequence of a shorter text."""
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
      FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '{_SPACE}+'), lambda x: x <> '') AS w FROM {table}))"""


DECONTAMINATION = f"""
WITH d AS {_shingles('documents', 'doc_id')}, b AS {_shingles('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM h JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item"""

# Equal sets are one class; links join classes through all shared shingles.
NGRAM_GROUPS = f"""
WITH RECURSIVE s AS {_shingles('documents', 'doc_id')},
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY doc_id),
reps AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY k),
rs AS (SELECT rep, n, s FROM reps JOIN s ON rep = doc_id),
pairs AS (SELECT a.rep AS x, b.rep AS y FROM rs a JOIN rs b ON a.s = b.s AND a.rep < b.rep
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
walk AS (SELECT rep, rep AS root FROM reps UNION SELECT l.x, w.root FROM walk w JOIN links l ON l.y = w.rep),
roots AS (SELECT rep, min(root) AS root FROM walk GROUP BY rep)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(roots.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (k) LEFT JOIN roots USING (rep)"""

# Risk, error, ladder, lift and base limits are the operator's parameters.
_RULES = ("symbols", "duplicate_lines", "repeated_words", "short_words", "long_words", "upper_case", "marks")
_SCORES = ", ".join(f"CAST({x} AS INTEGER)" for x in (
    "10000 * n_symbols // greatest(word_chars, 1)", "10000 * n_dup_lines // greatest(n_lines, 1)",
    "10000 * n_repeat_words // greatest(n_words, 1)", "10000 * n_words // greatest(word_chars, 1)",
    "10000 - 10000 * n_words // greatest(word_chars, 1)", "10000 * n_upper // greatest(word_chars, 1)",
    "10000 * n_marks // greatest(word_chars, 1)"))
_TAIL = """CASE WHEN n = 0 OR k >= n * 0.05 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) END"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, a, b, c FROM win GROUP BY ALL HAVING count(*) >= 2),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
          FROM win JOIN again USING (doc_id, a, b, c)) GROUP BY doc_id),
m AS (SELECT d.doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(cover.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(translate(t, '{_UPPER}', '')) AS n_upper,
        length(t) - length(translate(t, '!?', '')) AS n_marks FROM d LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{_SCORES}] AS scores FROM m),
y AS (SELECT doc_id, (avg(quality) >= 0.5)::INTEGER AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT doc_id, stratum, scores, good, md5(doc_id::VARCHAR) < '8' AS tune FROM f JOIN y USING (doc_id) WHERE NOT base_failed),
bars AS (SELECT stratum, rule, score, sum(good) AS good, sum(1 - good) AS bad FROM (
           SELECT stratum, good, unnest(scores) AS score, unnest(range(7)) AS rule FROM known WHERE tune) GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(good) OVER above, 0) AS ga, coalesce(sum(bad) OVER above, 0) AS ba,
           lag(score) OVER (PARTITION BY stratum, rule ORDER BY score DESC) AS nxt,
           sum(good) OVER (PARTITION BY stratum, rule) AS ng, sum(bad) OVER (PARTITION BY stratum, rule) AS nb
        FROM bars WINDOW above AS (PARTITION BY stratum, rule ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT stratum, rule, level, arg_min(CASE WHEN nxt IS NOT NULL AND ba > 0 AND ba * ng >= 5 * (ga + 1) * nb
           THEN (score + nxt) // 2 ELSE 10000 END, score) AS cutoff
        FROM cum, (VALUES (0, 0.0), (1, 0.0005), (2, 0.001), (3, 0.002), (4, 0.005), (5, 0.01), (6, 0.02)) s(level, share)
        WHERE ga <= CAST(share AS DOUBLE) * ng GROUP BY ALL),
sets AS (SELECT stratum, level, list(cutoff ORDER BY rule) AS cutoffs FROM cut GROUP BY ALL),
tried AS (SELECT stratum, level, count(*) FILTER (NOT tune AND good = 1) AS n, coalesce(sum(o) FILTER (NOT tune AND good = 1), 0)::BIGINT AS k,
            coalesce(avg(o) FILTER (tune AND good = 0), 0) - coalesce(avg(o) FILTER (tune AND good = 1), 0) AS gain
          FROM (SELECT stratum, level, tune, good,
                  list_bool_or(list_transform(range(1, 8), lambda i: scores[i] > cutoffs[i]))::INTEGER AS o
                FROM known JOIN sets USING (stratum)) GROUP BY ALL),
tested AS (SELECT *, max({_TAIL}) OVER (PARTITION BY stratum ORDER BY level) AS worst FROM tried),
best AS (SELECT stratum, arg_max(level, (gain, -level)) AS level FROM tested
         WHERE worst <= 0.05 / greatest(1, (SELECT count(DISTINCT stratum) FROM known WHERE NOT tune AND good = 1)) GROUP BY stratum),
final AS (SELECT f.*, coalesce(list_filter(range(1, 8), lambda i: scores[i] > cutoffs[i]), []) AS broken
          FROM f LEFT JOIN (SELECT stratum, cutoffs FROM best JOIN sets USING (stratum, level)) USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(broken) = 0 AS kept,
  array_to_string(list_transform(broken, lambda i: {list(_RULES)}[i]), ',') AS rejected_by, stratum
FROM final"""

FILTER_AUDIT = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
        100 * (length(t) - length(translate(t, '{_UPPER}', ''))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
        doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM d),
y AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt
      FROM f LEFT JOIN y USING (doc_id) GROUP BY ALL),
orders AS (SELECT '' AS o, 0 AS len UNION ALL SELECT o || c, len + 1 FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) l(c)
           WHERE len < 5 AND NOT contains(o, c)),
steps AS (SELECT o AS filter_order, s.step, ascii(o[s.step]) - 64 AS pos,
            list_transform(range(1, s.step), lambda i: ascii(o[i]) - 64) AS before
          FROM orders, range(1, 6) s(step) WHERE len = 5),
x AS (SELECT part, filter_order, step, pos, n, ng, nt, fails[pos] AS bad, coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) AS gone,
        list_sum(list_transform(fails, lambda b: b::INTEGER)) AS n_fails FROM m, steps),
r AS (SELECT part, filter_order, step, pos, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (bad AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(ng) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost,
        coalesce(sum(nt) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, pos))::BIGINT AS shapley FROM r"""


def _assigned(books: str) -> str:
    """Nearest entry of every part by its codebook, ties to the lower index."""
    return f"""(SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
      SELECT v.vec_id, v.part, b.entry,
             list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM v JOIN {books} b USING (part)) GROUP BY vec_id, part)"""


def _mean(books: str) -> str:
    """The next codebooks: floor of the mean of an entry's parts, unused entries as they were."""
    return f"""(SELECT b.part, b.entry, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM {books} b LEFT JOIN (
      SELECT part, entry, list(floor_mean ORDER BY place) AS x FROM (
        SELECT part, entry, place, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
        FROM (SELECT a.part, a.entry, unnest(v.x) AS c, unnest(range(1, len(v.x) + 1)) AS place
              FROM {books}_near a JOIN v USING (vec_id, part)) GROUP BY ALL) GROUP BY part, entry) m
      ON m.part = b.part AND m.entry = b.entry)"""


VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, part, q[part * len(q) // 16 + 1 : (part + 1) * len(q) // 16] AS x FROM k, range(16) r(part)),
b0 AS (SELECT part, entry, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k
       ORDER BY vec_id LIMIT 64) USING (vec_id)),
b0_near AS {_assigned('b0')}, b1 AS {_mean('b0')}, b1_near AS {_assigned('b1')}, b2 AS {_mean('b1')}, b2_near AS {_assigned('b2')},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM b2_near GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM (
     SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS place FROM b2)) AS codebooks_sha256
FROM c JOIN k USING (vec_id)"""

ORACLES = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op8_ngram_jaccard_join": NGRAM_GROUPS,
    "op11_quality_rules": QUALITY_RULES,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_vector_codes": VECTOR_CODES,
    "op10_benchmark_decontamination": DECONTAMINATION,
}
