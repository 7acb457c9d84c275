"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from remitframe.llm import fill_middle, filter_audit, line_dedup, quality, queries

SPACE = r"[\x20\x09-\x0D]"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256
           FROM documents),
k AS (SELECT text_sha256, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN k USING (text_sha256)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines
           FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
t AS (SELECT *, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS trimmed FROM l),
often AS (SELECT source, trimmed, count(DISTINCT doc_id) AS pages FROM t
          WHERE trimmed <> '' GROUP BY ALL),
hosts AS (SELECT source, count(*) AS host_pages FROM d GROUP BY 1),
bad AS (SELECT source, trimmed FROM often JOIN hosts USING (source)
        WHERE pages >= {line_dedup.MIN_PAGES} AND pages > host_pages * {line_dedup.RATIO}::DOUBLE),
marked AS (SELECT t.*, bad.trimmed IS NOT NULL AS gone FROM t LEFT JOIN bad
           ON t.source = bad.source AND t.trimmed = bad.trimmed)
SELECT doc_id, source,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
       count(*) FILTER (trimmed <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM marked GROUP BY doc_id, source
"""


def _texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_sql() -> str:
    both = (*quality.COMMON_WORDS, *(w.capitalize() for w in quality.COMMON_WORDS))
    left, steps = "in_words", []
    for k, pattern in enumerate(quality.CHAR_CLASSES):
        pattern = pattern.replace("'", "''")
        steps.append(f"regexp_replace({left}, '{pattern}', '', 'g') AS left{k}")
        left = f"left{k}"
    sizes = ", ".join(f"length({a}) - length({b})" for a, b in zip(
        ["in_words", *(f"left{k}" for k in range(len(steps) - 1))],
        [f"left{k}" for k in range(len(steps))], strict=True))
    counts = ", ".join(f"len(list_filter(common, lambda w: w = '{w}'))" for w in quality.COMMON_WORDS)

    def shares(column, n):
        parts = ", ".join(
            f"sum(CASE WHEN list_sum({column}) > 0 THEN floor({column}[{k}] * {quality._PARTS} "
            f"/ list_sum({column})::DOUBLE) ELSE 0 END)::BIGINT" for k in range(1, n + 1))
        return f"[{parts}] AS ref_{column}"

    def limit(name, spreads, fixed):
        return f"""CASE WHEN max(texts) < {quality.MIN_TEXTS} THEN {fixed}::DOUBLE
            ELSE max(mid_{name}) + {spreads} * greatest(quantile_cont(round(abs({name} - mid_{name}),
                 {quality._DECIMALS}), 0.5), {quality.LEAST_SPREAD}::DOUBLE) END AS {name}_limit"""

    def distance(p, q):
        return f"""(SELECT sqrt(greatest(0, sum(
            (CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END
             + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)))
            FROM (SELECT unnest({p}) / list_sum({p})::DOUBLE AS a,
                         unnest({q}) / list_sum({q})::DOUBLE AS b))"""
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             regexp_replace(text, '{SPACE}+', '', 'g') AS in_words,
             list_filter(string_split(text, chr(10)),
                         lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
c AS (SELECT *, {', '.join(steps)},
             list_transform(list_filter(words, lambda x: x IN ({_texts(both)})), lambda x: lower(x))
             AS common FROM w),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i
                  FROM w WHERE len(words) >= {quality.WINDOW})),
repeated AS (SELECT doc_id, i FROM (
                 SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
                SELECT doc_id, i + unnest(range({quality.WINDOW})) AS p FROM repeated) GROUP BY 1),
f AS (SELECT doc_id, lang, text, len(words) AS n_words, length(in_words) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             [{sizes}, length({left})] AS class_counts,
             [{counts}, len(words) - len(common)] AS word_counts
      FROM c LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS}
             OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
t AS (SELECT DISTINCT lang, text, n_words, class_counts, word_counts FROM b WHERE NOT base_failed),
r AS (SELECT lang, {shares('class_counts', len(quality.CHAR_CLASSES) + 1)},
             {shares('word_counts', len(quality.COMMON_WORDS) + 1)}
      FROM t GROUP BY lang),
k AS (SELECT DISTINCT lang, n_words, class_counts, word_counts FROM b),
s AS (SELECT k.*, CASE WHEN list_sum(class_counts) > 0 AND list_sum(ref_class_counts) > 0 THEN
                  {distance('class_counts', 'ref_class_counts')} END AS class_distance,
             CASE WHEN list_sum(word_counts) > 0 AND list_sum(ref_word_counts) > 0 THEN
                  {distance('word_counts', 'ref_word_counts')} END AS word_distance
      FROM k LEFT JOIN r ON k.lang IS NOT DISTINCT FROM r.lang),
x AS (SELECT *, class_distance - {quality.SHORT_CLASS_ALLOWANCE}::DOUBLE / sqrt(n_words) AS class,
             word_distance - {quality.SHORT_TEXT_ALLOWANCE}::DOUBLE / sqrt(n_words) AS word FROM s),
e AS (SELECT t.lang, round(x.class, {quality._DECIMALS}) AS class,
             round(x.word, {quality._DECIMALS}) AS word
      FROM t JOIN x ON t.lang IS NOT DISTINCT FROM x.lang AND t.n_words = x.n_words
           AND t.class_counts = x.class_counts AND t.word_counts = x.word_counts
      WHERE t.n_words >= {quality.MIN_JUDGED_WORDS}),
m AS (SELECT lang, count(*) AS texts, quantile_cont(class, 0.5) AS mid_class,
             quantile_cont(word, 0.5) AS mid_word FROM e GROUP BY lang),
l AS (SELECT e.lang, max(texts) AS texts,
             {limit('class', quality.CLASS_SPREADS, quality.MAX_CLASS_DISTANCE)},
             {limit('word', quality.WORD_SPREADS, quality.MAX_WORD_DISTANCE)}
      FROM e JOIN m ON e.lang IS NOT DISTINCT FROM m.lang GROUP BY e.lang)
SELECT doc_id, b.n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (b.n_words >= {quality.MIN_JUDGED_WORDS} AND (
           coalesce(CASE WHEN texts < {quality.MIN_TEXTS} THEN class_distance ELSE class END
                    > class_limit, false) OR coalesce(word > word_limit, false))) AS kept
FROM b JOIN x ON b.lang IS NOT DISTINCT FROM x.lang AND b.n_words = x.n_words
     AND b.class_counts = x.class_counts AND b.word_counts = x.word_counts
LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang
"""


def _share_sql(level: str, parent: str, name: str) -> str:
    """Budgets of the children of each parent, from ``n_<level>`` to ``b_<level>``."""
    return f"""
o_{level} AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY CASE WHEN weight > 0
        THEN capacity / weight ELSE 'inf'::DOUBLE END, {name}) AS place FROM n_{level}),
u_{level} AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
        sum(weight) OVER (PARTITION BY {parent} ORDER BY place
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM o_{level}),
m_{level} AS (SELECT *, weight > 0 AND (parent_budget - taken)::HUGEINT * weight
        >= capacity::HUGEINT * onward AS filled FROM u_{level}),
r_{level} AS (SELECT *, parent_budget - coalesce(sum(capacity) FILTER (filled) OVER (
        PARTITION BY {parent}), 0) AS rest, sum(weight) FILTER (NOT filled) OVER (
        PARTITION BY {parent}) AS others FROM m_{level}),
b_{level} AS (SELECT *, CASE WHEN filled THEN capacity WHEN weight > 0
        THEN (rest::HUGEINT * weight::HUGEINT) // others::HUGEINT ELSE 0 END AS budget
        FROM r_{level}),"""


def mixing_sql(share: float = 0.75, epochs: int = 2, seed: int = 17) -> str:
    a, b, c = queries.DOMAIN_WEIGHTS
    langs = " ".join(f"WHEN '{k}' THEN {v}" for k, v in queries.LANG_WEIGHTS.items())
    return f"""
WITH d AS (SELECT doc_id, lang, source,
        ceil(strlen(coalesce(text, '')) / 4.0)::BIGINT AS n_tokens,
        coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS HUGEINT) % 3, 0)
        ::VARCHAR AS l1, coalesce(lang, '') AS l2, coalesce(source, '') AS l3 FROM documents),
leaves AS (SELECT l1, l2, l3, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs}
        AS capacity FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * {share}::DOUBLE)::BIGINT AS budget FROM leaves),
n_1 AS (SELECT l1, sum(capacity) AS capacity, CASE l1 WHEN '0' THEN {a} WHEN '1' THEN {b}
        ELSE {c} END AS weight, least(any_value(total.budget), sum(sum(capacity)) OVER ())
        AS parent_budget FROM leaves, total GROUP BY l1),
{_share_sql('1', '1', 'l1')}
n_2 AS (SELECT l1, l2, sum(leaves.capacity) AS capacity, CASE l2 {langs} ELSE 1 END AS weight,
        any_value(b_1.budget) AS parent_budget FROM leaves JOIN b_1 USING (l1) GROUP BY l1, l2),
{_share_sql('2', 'l1', 'l2')}
n_3 AS (SELECT l1, l2, l3, leaves.capacity, 1 AS weight, b_2.budget AS parent_budget, tokens
        FROM leaves JOIN b_2 USING (l1, l2)),
{_share_sql('3', 'l1, l2', 'l3')}
plan AS (SELECT l1, l2, l3, budget, CASE WHEN tokens > 0 THEN (budget // tokens)::BIGINT
        ELSE {epochs} END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part
        FROM b_3),
placed AS (SELECT d.*, budget, epochs, part, md5(concat_ws(':', '{seed}', epochs::VARCHAR,
        coalesce(doc_id::VARCHAR, ''))) AS place FROM d JOIN plan USING (l1, l2, l3)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY l1, l2, l3 ORDER BY place
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, lang, source, n_tokens,
       (epochs + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END)::BIGINT AS copies,
       budget::BIGINT AS leaf_budget FROM summed
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT *, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY sha256(payload)) AS low
      FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(
             ('0x' || substr(digest, i, 1))::INTEGER + 16), 4)), '') AS b FROM q)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5),
           lambda k: substr(b, (i * 5 + k + 1)::INTEGER, 1)::INTEGER * (16 // (2 ** k)::INTEGER)))
           ::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM bits
"""

NEAR_DUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(words) - 3)),
        lambda i: array_to_string(words[i:i + 4], ' '))) AS grams FROM w WHERE len(words) > 0),
s AS (SELECT doc_id, len(grams) AS n, list_sort(grams) AS grams FROM g),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY grams) AS copy_of FROM s),
r AS (SELECT doc_id, n, unnest(grams) AS gram FROM c WHERE doc_id = copy_of),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx,
        any_value(b.n) AS ny FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id
        GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE common / (nx + ny - common)::DOUBLE >= 0.8),
linked AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS node, x AS root FROM linked UNION
        SELECT linked.y, reach.root FROM reach JOIN linked ON linked.x = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
degree AS (SELECT x AS node, count(*) AS n_links FROM linked GROUP BY 1),
classes AS (SELECT d.doc_id, coalesce(c.copy_of, d.doc_id) AS copy_of
        FROM documents d LEFT JOIN c USING (doc_id))
SELECT doc_id, coalesce(root, copy_of) AS class_id, copy_of,
       coalesce(n_links, 0)::BIGINT AS n_links
FROM classes LEFT JOIN roots ON roots.node = copy_of LEFT JOIN degree ON degree.node = copy_of
"""


FILL_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  sha256('{fill_middle.SEED}:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '{SPACE}*[^\x20\x09-\x0D]+|{SPACE}+') AS units,
             [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS hs FROM d),
c AS (SELECT *, len(units) AS n, least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS a,
             greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                       OR contains(text, '<M>') OR hs[3] % 100 >= {fill_middle.CHANGED_PERCENT}
                  THEN 'plain' WHEN hs[4] % 100 < {fill_middle.SPM_PERCENT} THEN 'spm'
                  ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix,
             array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
             bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {{
             'A': len(words) < {filter_audit.MIN_WORDS},
             'B': 100 * len(list_distinct(words))
                  < {filter_audit.MIN_DISTINCT_PERCENT} * len(words),
             'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g'))
                  > {filter_audit.MAX_CAPITALS_PERCENT} * length(text),
             'D': regexp_matches(text, '[#$%&*|]'),
             'E': doc_id > first_id}} AS failed
      FROM w LEFT JOIN l USING (doc_id)),
kinds AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
           FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own,
                 string_split(filter_order[1:step - 1], '') AS earlier,
                 string_split(replace('ABCDE', filter_order[step], ''), '') AS others
          FROM orders, range(1, 6) AS r(step)),
s AS (SELECT part, filter_order, step, own, good, toxic, n, failed[own] AS fails,
             step > 1 AND list_bool_or([failed[e] FOR e IN earlier]) AS gone,
             list_bool_or([failed[e] FOR e IN others]) AS elsewhere FROM kinds, steps),
t AS (SELECT part, filter_order, step, own,
             sum(n) FILTER (NOT gone AND NOT fails) AS kept,
             sum(n) FILTER (NOT gone AND fails) AS removed,
             sum(n) FILTER (gone AND fails) AS redundant,
             sum(n) FILTER (fails AND NOT elsewhere) AS unique_fails,
             sum(n) FILTER (NOT gone AND fails AND good) AS good_lost,
             sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op4_quality": quality_sql(),
            "op5_exact_dedup": EXACT_DEDUP, "op6_near_dup": NEAR_DUP,
            "op7_mixing": mixing_sql(), "op8_warc": WARC,
            "op12_fill_middle": FILL_MIDDLE, "op13_filter_audit": FILTER_AUDIT}
