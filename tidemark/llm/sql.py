"""DuckDB SQL for those of the operators that SQL can express."""

from __future__ import annotations

from tidemark.llm import license_scan as lic
from tidemark.llm import collocation, line_dedup, mixing, quality, spelling
from tidemark.llm.common import SPACES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[ \t\n\x0b\f\r]"
_WORDS = "regexp_extract_all({}, '[^ \\t\\n\\x0b\\f\\r]+')"


def _list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def op1() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = []
    for label, text in sorted(lic.TEMPLATES.items()):
        words = sorted(set(lic.WORD.findall(text.translate(lic.LOWER))))
        rows.append(f"('{label}', {_list(words)}, {lic.needed(len(words), lic.THRESHOLD)})")
    places = []
    for label, phrase in lic.PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        places.append(f"SELECT doc_id, '{label}' AS label, i - 1 AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {same}")
    return f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
t(label, words, least) AS (VALUES {", ".join(rows)}),
b AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS words FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(b.words, t.words)) / len(t.words)::DOUBLE AS containment FROM b, t WHERE len(list_intersect(b.words, t.words)) >= t.least),
p AS ({" UNION ALL ".join(places)}),
p1 AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list_distinct(list(label)) AS l FROM p GROUP BY doc_id),
m1 AS (SELECT doc_id, count(*) AS n_blocks, max(containment) AS best, list_distinct(list(label)) AS l FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(p1.l), ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(p1.l, []), coalesce(m1.l, [])))), ',') AS labels,
 CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM d LEFT JOIN p1 USING (doc_id) LEFT JOIN m1 USING (doc_id)"""


_HOST = f"""nullif({_LOWER.format(r"regexp_replace(regexp_extract(url, '^[ \t]*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$|\.(:[0-9]*)?$', '', 'g')")}, '')"""


def op2() -> str:
    digit = lambda v, n: f"('0x' || substr(md5({v}), {n}, 1))::INT"
    begin = f"(DATE '2024-01-01' + ({digit('host', 2)} * 16 + {digit('host', 3)}))"
    name = f"(['adult', 'malware', 'spam'])[{digit('host', 4)} % 3 + 1]"
    shift = f"{digit('parent', 2)} * 8"
    return f"""
WITH c AS (SELECT page_id, {_HOST} AS host, DATE '2024-01-01' + ((page_id * 7919 % 366 + 366) % 366)::INT AS fetched FROM pages),
h AS (SELECT DISTINCT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS parent FROM c WHERE host IS NOT NULL),
e AS (
 SELECT {name} AS list_name, 'block' AS kind, host AS key, {begin} AS d, 'add' AS action FROM h WHERE {digit("host", 1)} < 8
 UNION SELECT {name}, 'block', host, {begin} + (20 + {digit("host", 5)} * 4), 'remove' FROM h WHERE {digit("host", 1)} < 6
 UNION SELECT {name}, 'block', host, {begin} + 120, 'add' FROM h WHERE {digit("host", 1)} < 2
 UNION SELECT 'trusted', 'allow', host, {begin} + 10, 'add' FROM h WHERE {digit("host", 6)} < 3
 UNION SELECT 'spam', 'block', host, DATE '2024-01-01', 'add' FROM h WHERE starts_with(host, 'spam-farm.')
 UNION SELECT 'parents', 'block', parent, DATE '2024-01-01' + {shift}, 'add' FROM h WHERE {digit("parent", 1)} < 6
 UNION SELECT 'parents', 'block', parent, DATE '2024-03-01' + {shift}, 'remove' FROM h WHERE {digit("parent", 1)} < 6),
days AS (SELECT list_name, kind, key, d, bool_and(action = 'add') AS added FROM e GROUP BY ALL),
v AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY list_name, kind, key ORDER BY d), DATE '9999-12-31') AS until FROM days),
hit AS (SELECT c.host, c.fetched, v.* FROM (SELECT DISTINCT host, fetched FROM c) c JOIN v ON (c.host = v.key OR ends_with(c.host, '.' || v.key)) AND v.added AND c.fetched >= v.d AND c.fetched < v.until),
j AS (SELECT host, fetched, count(*) AS n_active, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS active_lists, arg_max(key, length(key)) AS matched_key,
 coalesce(max(length(key)) FILTER (kind = 'block'), 0) > coalesce(max(length(key)) FILTER (kind = 'allow'), 0) AS blocked FROM hit GROUP BY host, fetched)
SELECT page_id, c.host, strftime(c.fetched, '%Y-%m-%d') AS fetched_on, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(active_lists, '') AS active_lists, matched_key, coalesce(blocked, false) AS blocked
FROM c LEFT JOIN j ON c.host = j.host AND c.fetched = j.fetched"""


def op4() -> str:
    unit = lambda v: f"((('0x' || substr(md5({v}), 1, 13))::UBIGINT)::DOUBLE + 0.5) / {2**52}::DOUBLE"
    key = "coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))"
    return f"""
WITH d AS (SELECT doc_id, source, lang, text, coalesce(source, '') AS s, {key} AS id, {unit(f"'{mixing.SEED}:' || {key} || ':1'")} AS u FROM documents),
n AS (SELECT s, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM d GROUP BY s),
r AS (SELECT s, CASE WHEN chars = 0 THEN 1.0 ELSE pow(chars, {mixing.TEMPERATURE}) / (SELECT sum(pow(chars, {mixing.TEMPERATURE})) FROM n) * (SELECT sum(chars) FROM n) / chars END AS rate FROM n),
p AS (SELECT s, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p FROM (SELECT s, rate, unnest(range(0, (rate + 10 * sqrt(rate) + 30)::INT)) AS k FROM r)),
c AS (SELECT s, list(cdf ORDER BY k) AS cdf FROM (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM p) GROUP BY s),
x AS (SELECT d.*, unnest(range(0, len(list_filter(cdf, lambda q: q <= u)))) AS copy FROM d JOIN c USING (s))
SELECT doc_id, source, lang, text, copy::INT AS copy, {unit(f"'{mixing.SEED}:order:' || id || ':' || copy")} AS shuffle_key FROM x"""


def op5() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m::BIGINT AS component_id, d.doc_id = m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""


def op6() -> str:
    q = quality
    says = lambda x: " OR ".join(f"contains({_LOWER.format(x)}, '{p.replace(chr(39), chr(39) * 2)}')" for p in q.BOILERPLATE)
    marks = q.PUNCTUATION
    words = lambda x: _WORDS.format(x)
    menu = f"len(list_filter({words('x')}, lambda y: list_contains({_list(q.SEPARATORS)}, y)))"
    terminal = q.TERMINAL.replace("'", "''")
    fails = f"""(len({words("x")}) < {q.LONG_LINE} AND NOT regexp_matches(x, '{terminal}'))
 OR 100 * len(regexp_extract_all(x, '{marks}')) > {q.MAX_MARKS} * length(x) OR 100 * {menu} > {q.MAX_SEPARATORS} * len({words("x")}) OR {says("x")}"""
    solid = lambda x: f"coalesce(length(array_to_string({words(x)}, '')), 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) x(k) GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, {solid("t")} AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 list_filter(lines, lambda x: regexp_matches(x, '{q.WORD}')) AS worded, coalesce(c.n, 0) AS n_repeat_words, lines,
 list_filter(lines, lambda x: NOT regexp_matches(x, '{q.WORD}') OR NOT ({fails})) AS good FROM d LEFT JOIN c USING (doc_id)),
h AS (SELECT *, {solid("array_to_string(good, chr(10))")} AS chars_left, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines,
 n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * chars_left >= {q.MIN_LEFT} * word_chars AS kept, (len(lines) - len(good))::BIGINT AS n_bad_lines, chars_left::BIGINT AS chars_left FROM h"""


def op11() -> str:
    ends = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT doc_id, line, place, {_LOWER.format(f"trim(line, {ends})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= {line_dedup.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS}),
m AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def op12() -> str:
    """CRC-32 goes over a text's bytes by a table of the remainders of 0 to 255, which are made from its polynomial."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    parts = ["b0 AS (SELECT i, i::BIGINT AS c FROM range(256) t(i))"]
    for k in range(8):
        parts.append(f"b{k + 1} AS (SELECT i, {step.format('c')} AS c FROM b{k})")
    least, most = spelling.LEAST_LETTERS, spelling.LEAST_COUNT
    return f"""
WITH RECURSIVE {", ".join(parts)},
r AS (SELECT list(c ORDER BY i) AS remainders FROM b8),
o AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM o WHERE length(run) >= {least} GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda j: ('0x' || substr(x, (j + 1)::INT, 2))::BIGINT)),
 lambda a, b: xor(a >> 8, remainders[(xor(a, b) & 255) + 1]))) AS h FROM u, r),
s AS (SELECT n, CASE WHEN h % {spelling.SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {most}),
d AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT DISTINCT word, n, rest FROM d),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION ALL SELECT e.word, w.word, w.n FROM e JOIN w ON e.rest = w.word
 UNION ALL SELECT w.word, e.word, e.n FROM e JOIN w ON e.rest = w.word),
q AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {spelling.TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {spelling.TIMES} * w.n THEN other_n END::BIGINT AS form_n
 FROM w LEFT JOIN q ON w.word = q.word AND place = 1),
c AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word) USING (word)"""


def op13() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS length, array_to_string(w[i + 1:i + {k}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(len(w) - {k - 1})) AS i FROM p)" for k in range(1, collocation.LONGEST + 1))
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, length, phrase, count(*) AS f FROM ({grams}) GROUP BY lang, length, phrase HAVING count(*) >= {collocation.LEAST}),
x AS (SELECT lang, length, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE length > 1),
k AS (SELECT DISTINCT s.lang, s.phrase FROM x s JOIN x b ON s.lang = b.lang AND s.length < b.length AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.f >= 100 * s.f),
c AS (SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, length)) AS k FROM x ANTI JOIN k USING (lang, phrase))),
s AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
 FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= {collocation.TOP}"""
