"""DuckDB SQL for those queries that SQL can express. Where there is none, tests/llm holds a brute-force version."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"

OP1_EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

OP6_LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UP}', '{_LOW}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.first_doc IS NOT NULL AND r.first_doc <> k.doc_id AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: Of rows with shares a and b in each bin.
_JS = "sqrt(greatest(sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2, 0))"


def _op2() -> str:
    from foretable.llm import quality as q

    langs = ", ".join(f"'{k}'" for k in q.COMMON)
    classes = " UNION ALL ".join(f"SELECT doc_id, lg, n_words, 'c' AS h, {i} AS bin, len(regexp_extract_all(t, '{c.replace(chr(39), chr(39) * 2)}')) AS x FROM w" for i, c in enumerate(q.CLASSES))
    fixed = ", ".join(f"('{k}', '{h}', {99 if i == len(v) - 1 else i}, {x}::DOUBLE)" for k, both in q.REFERENCES.items() for h, v in zip("cw", both, strict=True) for i, x in enumerate(v))
    common = ", ".join(f"('{k}', {i}, '{w}')" for k, ws in q.COMMON.items() for i, w in enumerate(ws))
    return f"""
WITH w AS (
  SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lg, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_words
  FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(n_words - 4)) AS i FROM w WHERE n_words >= 5)),
starts AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1),
rep AS (SELECT doc_id, sum(least(5, i - prev)) AS n FROM (SELECT doc_id, i, lag(i, 1, -10) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM starts) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
vocabulary(lg, bin, word) AS (VALUES {common}),
tokens AS (SELECT doc_id, lg, unnest(ws) AS word FROM w),
hits AS (SELECT t.doc_id, v.bin, count(*) AS x FROM tokens t JOIN vocabulary v ON v.lg = t.lg AND (t.word = v.word OR t.word = upper(v.word[1]) || v.word[2:]) GROUP BY ALL),
classes AS ({classes}),
bins AS (
  SELECT * FROM classes
  UNION ALL SELECT doc_id, any_value(lg), any_value(n_words), 'c', 99, (SELECT length(t) FROM w WHERE w.doc_id = classes.doc_id) - sum(x) FROM classes GROUP BY doc_id
  UNION ALL SELECT w.doc_id, w.lg, n_words, 'w', v.bin, coalesce(x, 0) FROM w JOIN vocabulary v USING (lg) LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.bin = v.bin
  UNION ALL SELECT w.doc_id, w.lg, n_words, 'w', 99, n_words - coalesce((SELECT sum(x) FROM hits h WHERE h.doc_id = w.doc_id), 0) FROM w WHERE lg <> ''),
f AS (
  SELECT w.doc_id, n_words, length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')) AS word_chars, len(regexp_extract_all(t, '{q.SYMBOLS}')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY doc_id, h) AS a FROM bins WHERE n_words >= {q.MIN_WORDS}),
good AS (SELECT p.* FROM p JOIN f USING (doc_id) WHERE 100 * n_repeat_words <= 20 * f.n_words),
r0 AS (SELECT lg, h, bin, avg(a) AS b FROM good GROUP BY lg, h, bin),
js0 AS (SELECT doc_id, h, {_JS} AS d FROM good JOIN r0 USING (lg, h, bin) GROUP BY doc_id, h),
learned AS (SELECT lg, h, bin, sum(a / (1 + (d / {q.UNLIKE}::DOUBLE) ** 2)) / sum(1 / (1 + (d / {q.UNLIKE}::DOUBLE) ** 2)) AS a FROM good JOIN js0 USING (doc_id, h) GROUP BY lg, h, bin),
fixed(lg, h, bin, b) AS (VALUES {fixed}),
believed AS (SELECT lg, h FROM learned JOIN fixed USING (lg, h, bin) GROUP BY lg, h HAVING round({_JS}, 6) <= {q.UNLIKE}),
r AS (SELECT lg, h, bin, CASE WHEN k.lg IS NULL THEN x.b ELSE l.a END AS b FROM fixed x LEFT JOIN believed k USING (lg, h) LEFT JOIN learned l USING (lg, h, bin)),
js AS (SELECT doc_id, h, round({_JS}, 6) AS d FROM p JOIN r USING (lg, h, bin) GROUP BY doc_id, h)
SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, c.d AS chars_distance, v.d AS words_distance,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(c.d, 0) <= {q.MAX_CHARS} AND coalesce(v.d, 0) <= {q.MAX_WORDS} + {q.SLACK} / sqrt(greatest(n_words, 1)) AS kept
FROM f LEFT JOIN js c ON c.doc_id = f.doc_id AND c.h = 'c' LEFT JOIN js v ON v.doc_id = f.doc_id AND v.h = 'w'
"""


def _op5() -> str:
    from foretable.llm.secret_scan import BASE, MORE

    def rule(no: int, r) -> str:
        p = r.regex.replace("'", "''")
        size = f"length(regexp_extract_all(t, '{p}', {r.group})[i])" if r.group else "length(m[i])"
        return f"""SELECT doc_id, {no} AS no, '{r.kind}' AS kind, i, (list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS s, length(m[i]) AS n, {size} AS counted, {r.least} AS least
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS gaps FROM d))"""

    every = " UNION ALL ".join(rule(i, r) for i, r in enumerate(BASE + MORE))
    n = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || s + n, ',' ORDER BY s, no){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT * FROM ({every}) WHERE counted >= least)
SELECT doc_id, {n}, sha256({joined.format(f" FILTER (no < {len(BASE)})")}) AS base_sha256, {joined.format(" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""


def _op9() -> str:
    from foretable.llm.url_filter import RULES, TRACKING

    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    host = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), '{_UP}', '{_LOW}')"
    path = lambda u: f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"
    query = lambda u: f"array_to_string([x for x in string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&') if not regexp_matches(x, '^(({TRACKING})=.*)?$')], '&')"
    form = lambda u: f"'//' || regexp_replace({host(u)}, '^www\\.', '') || regexp_replace({path(u)}, '/$', '') || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce({host("url")}, '') AS host, coalesce({path("url")}, '') AS path, html FROM pages),
rules(rh, rp, v) AS (VALUES {rules}),
own AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE contains(url, '://')),
named AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']canonical') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']([^"'']*)', 1)
                   WHEN regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']refresh') THEN regexp_extract(tag, '(?i)url\\s*=\\s*([^\\s"'']+)', 1) END AS target FROM tags),
e AS (SELECT url AS a, {form("url")} AS b FROM p WHERE contains(url, '://') UNION SELECT url, {form("target")} FROM named WHERE contains(target, '://')),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON seen = a),
bad AS (SELECT DISTINCT node FROM reach JOIN p ON p.url = seen JOIN own USING (page_id) WHERE v = 'block')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN own USING (page_id) LEFT JOIN bad ON bad.node = p.url
"""


OP2_QUALITY_RULES, OP5_SECRET_SCAN, OP9_URL_FILTER = _op2(), _op5(), _op9()

OP7_NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT node, b FROM reach JOIN both_ways ON seen = a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP8_SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i + 1, i + 35), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
starts AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM v) WHERE k > 1),
edges AS (SELECT doc_id, i AS place, 1 AS step FROM starts UNION ALL SELECT doc_id, i + 35, -1 FROM starts),
t AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w),
steps AS (SELECT doc_id, place, sum(step) AS step FROM edges GROUP BY ALL),
c AS (SELECT t.doc_id, t.i, word, sum(coalesce(step, 0)) OVER (PARTITION BY t.doc_id ORDER BY t.i) > 0 AS gone FROM t LEFT JOIN steps s ON s.doc_id = t.doc_id AND s.place = t.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13_LEXICAL_SEARCH = f"""
WITH i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_TERM}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS uses FROM i GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_TERM}') AS ws FROM documents),
c AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS length FROM d),
h AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM h, c GROUP BY term),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // length))) AS score FROM h JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, sum(score * uses)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(score * uses) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s QUALIFY rank <= 20
"""
