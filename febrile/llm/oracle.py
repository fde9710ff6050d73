"""Independent DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens, md5('17|' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT skey, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY skey),
r AS (SELECT max(tokens) FILTER (tokens > 0) / min(tokens) FILTER (tokens > 0) AS r FROM s),
e AS (SELECT greatest(1, CASE WHEN r > 3 THEN ceil((1 - ln(3.0) / ln(r)) * 16777216) ELSE 1 END) / 16777216.0::DOUBLE AS a FROM r),
z AS (SELECT a, sum(pow(tokens::DOUBLE, a)) FILTER (tokens > 0) AS z, min(pow(tokens::DOUBLE, a - 1)) FILTER (tokens > 0) AS slowest
      FROM s, e GROUP BY a),
p AS (SELECT skey, tokens, n_docs, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) / z ELSE 0 END AS weight,
             floor(tokens * CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a - 1) / slowest ELSE 1 END + 0.5)::BIGINT AS budget,
             ceil(sqrt(n_docs))::BIGINT AS nb
      FROM s, z),
b AS (SELECT d.*, weight, budget, tokens, (('0x' || substr(k, 1, 12))::BIGINT % nb)::INTEGER AS block FROM d JOIN p USING (skey)),
t AS (SELECT skey, block, budget, tokens, sum(n_tokens)::BIGINT AS held FROM b GROUP BY ALL),
x AS (SELECT *, unnest(range(0, 1 + CASE WHEN tokens > 0 THEN greatest((budget - 1) // tokens, 0) ELSE 0 END)) AS epoch FROM t),
y AS (SELECT *, epoch * tokens + coalesce(sum(held) OVER (
        PARTITION BY skey, epoch ORDER BY md5('17|' || skey || '|' || epoch || '|' || block), block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start FROM x),
m AS (SELECT b.doc_id, b.source, b.skey, b.n_tokens, b.weight, b.budget, y.epoch, b.block, y.block_start, y.tokens, y.held,
             md5(b.k || '|' || y.epoch) AS doc_key
      FROM b JOIN y ON b.skey = y.skey AND b.block = y.block
      WHERE y.block_start < b.budget OR y.tokens = 0 OR y.block_start + y.held <= b.budget),
c AS (SELECT *, block_start + sum(n_tokens) OVER (PARTITION BY skey, epoch, block ORDER BY doc_key, n_tokens
        ROWS UNBOUNDED PRECEDING) AS upto FROM m)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, round(weight, 9) AS weight, budget, epoch::BIGINT AS epoch, block, block_start, doc_key
FROM c WHERE block_start + held <= budget OR upto <= budget
"""

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS s
      FROM d WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS rep, count(*) AS copies, len(s) AS n FROM g GROUP BY s),
i AS (SELECT rep, n, copies, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.copies AS ca, b.copies AS cb, a.n + b.n AS bothn, count(*) AS common
      FROM i a JOIN i b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT * FROM p WHERE 100 * common >= 80 * (bothn - common)),
e AS (SELECT a, b, cb AS far FROM l UNION ALL SELECT b, a, ca FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
top AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a),
n AS (SELECT a, sum(far) AS docs, count(*) AS classes FROM e GROUP BY a)
SELECT d.doc_id, coalesce(top.root, c.rep, d.doc_id) AS class_id, coalesce(c.rep, d.doc_id) AS set_id,
       (coalesce(n.docs, 0) + coalesce(c.copies - 1, 0))::BIGINT AS n_links, coalesce(n.classes, 0)::BIGINT AS n_class_links
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN c ON g.s = c.s LEFT JOIN top ON top.a = c.rep LEFT JOIN n ON n.a = c.rep
"""

_WORDS8 = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM q),
o AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
h AS (SELECT o.doc_id, o.i, o.n, q.item_id FROM o JOIN q ON o.k = q.k),
f AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(f.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(f.n_hit > 0 AND 20 * f.n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op9_sql() -> str:
    from febrile.llm.line_clean import BOILERPLATE, SEPARATORS, SYMBOLS, WINDOW, LineRules
    r = LineRules()
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    bars = ", ".join(f"'{s}'" for s in SEPARATORS)
    words = f"regexp_extract_all(x, '{WORD}')"
    signs = f"(length(x) - length(translate(x, '{SYMBOLS}', '')))"
    bangs = f"len(list_filter({words}, lambda w: regexp_matches(w, '[!?][!?]$')))"
    seps = f"len(list_filter({words}, lambda w: w IN ({bars})))"
    same = f"len(list_filter(range(2, len({words}) + 1), lambda i: {words}[i] = {words}[i - 1]))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
k AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
m AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
        SELECT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1)
      GROUP BY doc_id),
x AS (SELECT doc_id, unnest(l) AS x FROM w),
f AS (SELECT doc_id, x, {signs} > {r.max_symbol_share} * length(x) OR {phrases}
        OR {bangs} > {r.max_bang_share} * len({words}) OR {same} > {r.max_echo_share} * len({words})
        OR ({seps} >= {r.nav_separators} AND {seps} > {r.max_separator_share} * len({words})) AS fails FROM x),
g AS (SELECT doc_id, count(*) FILTER (fails) AS n, coalesce(sum(length(x)) FILTER (fails), 0) AS gone, sum(length(x)) AS total FROM f GROUP BY doc_id),
o AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(m.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_lines_removed, coalesce(gone, 0) AS chars_removed, coalesce(total, 0) AS total
      FROM w LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND chars_removed <= {r.max_lost_share} * total AS kept,
       n_lines_removed::BIGINT AS n_lines_removed, chars_removed::BIGINT AS chars_removed
FROM (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed FROM o)
"""


OP11 = """
WITH e AS (
  SELECT DISTINCT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b AS positive_id, score AS p FROM (
        SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, positive_id, p, b, score, row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, b) AS r
      FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * p <= 100 * score AND 100 * score <= 100 * p)
SELECT a AS anchor_id, positive_id, CAST(r AS INTEGER) AS rank, b AS negative_id, p AS positive_score, score AS negative_score
FROM n WHERE r <= 5
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (z.total + 5 * v.v)::HUGEINT AS p,
             1 + (1000000000 * (k.n + 5)::HUGEINT) // (v.total + 5 * v.v)::HUGEINT AS q
      FROM z JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN x y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
items AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM x WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_temperature": OP2, "op4_ngram_join": OP4, "op8_decontaminate": OP8, "op9_line_clean": op9_sql(),
            "op11_hard_negatives": OP11, "op13_source_divergence": OP13}
