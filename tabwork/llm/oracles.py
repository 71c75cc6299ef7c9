"""SQL (DuckDB) for queries whose results follow from the tables and the fixed values of the operators alone."""

from __future__ import annotations

from .mixing import Mix
from .quality_rules import COMMON_WORDS, Rules
from .secret_scan import EntropyRules


def quality_sql(rules: Rules = Rules()) -> str:
    """The counts by unnesting words and windows; the distances by a row per document and class."""
    listed = ", ".join(f"('{lang}', {k}, '{w}')" for lang, words in COMMON_WORDS.items() for k, w in enumerate(words))
    forms = ", ".join(f"'{x}'" for x in sorted({f for v in COMMON_WORDS.values() for w in v for f in (w, w.capitalize())}))

    def left(pattern: str) -> str:
        return f"length(regexp_replace(t, '{pattern}', '', 'g'))"

    return rf"""
WITH list(lang, k, word) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT rid, sum(least(5, coalesce(after - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM twice) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, {left('[\\x20\\x09-\\x0D]+')}::BIGINT AS word_chars,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n_bare, {left('[^#*$%&|<>]+')}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    length(t)::BIGINT AS chars, {left('[^a-z]+')} AS lower_, {left('[^A-Z]+')} AS upper_, {left('[^0-9]+')} AS digit_, {left('[\\x00-\\x7F]+')} AS other_
  FROM w LEFT JOIN repeats ON w.rid = repeats.rid),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m),
class AS (
  SELECT rid, lang, base_failed, unnest(range(7)) AS k,
    unnest([lower_, chars - word_chars, upper_, digit_, n_symbols, word_chars - lower_ - upper_ - digit_ - n_symbols - other_, other_]) AS c FROM b),
spoken AS (SELECT rid, lower(x) AS x, count(*) AS c FROM (SELECT rid, unnest(w) AS x FROM w) WHERE x IN ({forms}) GROUP BY rid, lower(x)),
word AS (
  SELECT b.rid, b.lang, b.base_failed, list.k, coalesce(spoken.c, 0) AS c FROM b JOIN list ON b.lang = list.lang LEFT JOIN spoken ON spoken.rid = b.rid AND spoken.x = list.word),
words AS (
  SELECT * FROM word UNION ALL SELECT rid, lang, base_failed, -2, n_bare FROM b UNION ALL
  SELECT b.rid, b.lang, b.base_failed, -1, b.n_words - b.n_bare - coalesce(s.c, 0) FROM b LEFT JOIN (SELECT rid, sum(c) AS c FROM word GROUP BY rid) s ON s.rid = b.rid),
every AS (SELECT 'class' AS part, * FROM class UNION ALL SELECT 'word', * FROM words),
refs AS (SELECT part, lang, k, sum(c) AS r FROM every WHERE NOT base_failed GROUP BY part, lang, k),
meant AS (SELECT lang, sum(r) AS meant FROM refs WHERE part = 'word' AND k <> -2 GROUP BY lang),
held AS (
  SELECT e.*, CASE WHEN e.k = -2 THEN least(r, meant * (b.n_bare::DOUBLE / nullif(b.n_words - b.n_bare, 0))) ELSE r END AS r
  FROM every e JOIN b USING (rid) LEFT JOIN refs ON refs.part = e.part AND refs.k = e.k AND refs.lang IS NOT DISTINCT FROM e.lang LEFT JOIN meant ON meant.lang IS NOT DISTINCT FROM e.lang),
shares AS (
  SELECT part, rid, coalesce(c / nullif(sum(c) OVER (PARTITION BY part, rid), 0), 0)::DOUBLE AS p, coalesce(r / nullif(sum(r) OVER (PARTITION BY part, rid), 0), 0)::DOUBLE AS q, r FROM held),
apart AS (
  SELECT part, rid, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p * 2 / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q * 2 / (p + q)) ELSE 0 END) / 2), 0)) AS js, bool_or(r IS NOT NULL) AS known, count(*) AS classes
  FROM shares GROUP BY part, rid),
far AS (
  SELECT b.*, CASE WHEN c.known AND chars >= {rules.guard_chars} THEN c.js ELSE 0 END AS class_d, CASE WHEN v.known AND n_words >= {rules.guard_words} THEN v.js ELSE 0 END AS word_d, v.classes
  FROM b JOIN apart c ON c.rid = b.rid AND c.part = 'class' JOIN apart v ON v.rid = b.rid AND v.part = 'word')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND class_d <= {rules.max_class_distance} AND word_d <= least({rules.max_word_distance}, {rules.word_margin} + sqrt((classes - 1) / (8 * ln(2) * greatest(n_words, 1)))) AS kept,
  round(class_d, 6)::DOUBLE AS class_distance, round(word_d, 6)::DOUBLE AS word_distance
FROM far"""


def secrets_sql(rules: EntropyRules = EntropyRules()) -> str:
    """Spans from the pieces between matches, entropy of each window on its own (no counts carried along)."""
    w = rules.window

    def spans(kind: int, pattern: str) -> str:
        # matches and the pieces before them, in order
        return rf"""SELECT rid, {kind} AS kind, m, (sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m))::BIGINT AS s FROM (
  SELECT rid, unnest(ms) AS m, unnest(range(len(ms))) AS i, unnest(ps[:len(ms)]) AS p FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')))"""

    name = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
    run = r"[A-Za-z0-9+/_.=-]"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    # RE2 has no back references: eight of a kind, spelled out
    repeats = "|".join(f"[{c}{c.swapcase()}]{{8}}" if c.isalpha() else f"[{c}]{{8}}" for c in dict.fromkeys(alphabet.lower()))
    allowed = rules.allowed.replace(r"|(.)\1{7}", "|" + repeats)
    least = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {bits}" for _, p, bits in rules.classes)
    needs = " AND ".join(f"regexp_matches(m, '{p}')" for p in rules.needs)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
assigned AS ({spans(0, name + run + "+")}),
base AS (
  SELECT rid, kind, s, s + length(m) AS e FROM assigned WHERE length(regexp_replace(m, '^{name}', '')) >= 12 UNION ALL
  SELECT rid, kind, s, s + length(m) FROM ({spans(1, "AKIA[A-Z0-9]+")}) WHERE length(m) >= 18 UNION ALL
  SELECT rid, kind, s, s + length(m) FROM ({spans(2, "[0-9a-f]+")}) WHERE length(m) >= 16),
runs AS ({spans(3, rules.candidate)}),
marks AS (
  SELECT r.rid, r.s AS cs, r.m, b.s, b.e FROM runs r JOIN base b ON r.rid = b.rid AND b.s < r.s + length(r.m) AND r.s < b.e UNION ALL
  SELECT rid, s, m, s + length(m), s + length(m) FROM runs),
pieces AS (SELECT rid, m, cs, greatest(cs, coalesce(max(e) OVER (PARTITION BY rid, cs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cs)) AS st, s AS en FROM marks),
left_ AS (SELECT rid, st AS s, substr(m, (st - cs + 1)::BIGINT, (en - st)::BIGINT) AS m FROM pieces WHERE en - st >= {w}),
candidates AS (SELECT rid, s, m, CASE {least} END AS least FROM left_ WHERE {needs} AND NOT regexp_matches(m, '{allowed}')),
tried AS (SELECT rid, s, least, i, list_aggregate(string_split(substr(m, i + 1, {w}), ''), 'entropy') AS bits FROM (SELECT *, unnest(range(length(m) - {w} + 1)) AS i FROM candidates)),
found AS (SELECT rid, 3 AS kind, s + min(i) AS st, s + max(i) + {w} AS e FROM tried WHERE bits >= least - 1e-10 GROUP BY rid, s),
spans AS (SELECT rid, kind, s, e, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS x FROM (SELECT rid, kind, s, e FROM base UNION ALL SELECT * FROM found))
SELECT doc_id, count(*) FILTER (kind = 0)::BIGINT AS n_assign, count(*) FILTER (kind = 1)::BIGINT AS n_access, count(*) FILTER (kind = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN spans ON d.rid = spans.rid GROUP BY d.rid, doc_id"""


def mixing_sql(mix: Mix = Mix()) -> str:
    """The level of the targets by trying every number of capped sources, the thresholds from sorted digests."""
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mix.weights)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [{weights}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mix.weights)}] AS weight FROM d GROUP BY source),
tried AS (
  SELECT {mix.max_copies} * source_size / weight AS ratio, row_number() OVER w AS n, coalesce(sum({mix.max_copies} * source_size) OVER w, 0) AS full_, (SELECT sum(weight) FROM per) - coalesce(sum(weight) OVER w, 0) AS open_ FROM per
  WINDOW w AS (ORDER BY {mix.max_copies} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by(l, n) AS l FROM (SELECT ((SELECT sum(source_size) FROM per) * {mix.share} - full_) / open_ AS l, ratio, n FROM tried) WHERE l < ratio),
aims AS (SELECT source, source_size, least({mix.max_copies}.0 * source_size, coalesce((SELECT l FROM level), 1e300) * weight)::DOUBLE AS target FROM per),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {mix.max_copies})::BIGINT ELSE 0 END AS whole FROM aims),
keys AS (SELECT source, key, sum(size) AS held FROM d GROUP BY source, key),
sums AS (SELECT k.*, greatest(target - whole * source_size, 0.0) AS budget, sum(held) OVER (PARTITION BY k.source ORDER BY key) AS upto FROM keys k JOIN plans p ON k.source IS NOT DISTINCT FROM p.source),
hits AS (SELECT source, coalesce(min(key) FILTER (upto >= budget), max(key)) AS key FROM sums GROUP BY source),
ends AS (SELECT s.source, s.key, abs(budget - upto) < abs(budget - (upto - held)) AS over_ FROM sums s JOIN hits h ON s.source IS NOT DISTINCT FROM h.source AND s.key = h.key)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN whole < {mix.max_copies} AND source_size > 0 AND (d.key < ends.key OR (d.key = ends.key AND over_)) THEN 1 ELSE 0 END))::BIGINT AS taken, d.source
FROM d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source JOIN ends ON d.source IS NOT DISTINCT FROM ends.source"""
