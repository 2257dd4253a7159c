"""DuckDB SQL for the corpus queries that SQL can express: each is the plain definition over whole tables and texts."""

from __future__ import annotations

from .licences import KNOWN, LEAST, MARKS, TEMPLATES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LETTERS = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(3, len(ws)) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

_OP8 = f"""WITH iw AS (SELECT item_id, {_LETTERS.format(_LOWER.format('text'))} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, least(len(ws), 1)) + 1)) AS i FROM iw)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_LETTERS.format(_LOWER.format('text'))} AS ws FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i : i + 34], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, word, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM p),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 34 PRECEDING) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

_OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(encode(html)) AS h, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (j // 4), 5))::BIGINT >> (15 - 5 * (j % 4))::BIGINT) & 31)::BIGINT, 1), '' ORDER BY j) FROM range(32) r(j)) AS payload_digest,
CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM s"""

_OP12 = """WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, 0 AS step, 4294967295::BIGINT AS v FROM ids UNION ALL SELECT c, step + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
FROM (SELECT c, step, CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(c::VARCHAR, step // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE step < 8 * length(c::VARCHAR))),
h AS (SELECT c, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE step = 8 * length(c::VARCHAR)),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, strlen(role) || ':' || role || text AS item, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos FROM r),
b AS (SELECT c, 0 AS own, pos, item, chars FROM h JOIN o ON conv_id = c - c % 100 AND pos <= h UNION ALL SELECT c, 1, pos, item, chars FROM h JOIN o ON conv_id = c AND pos > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, item, chars FROM b),
p AS (SELECT c, 0 AS d, 0 AS chars, '' AS k FROM ids UNION ALL SELECT c, d, chars, md5(array_to_string(list(md5(item)) OVER (PARTITION BY c ORDER BY d), ' ')) FROM s),
u AS (SELECT x.c, x.d, x.chars, x.k, y.k AS pk, x.d = max(x.d) OVER (PARTITION BY x.c) AS ends FROM p x LEFT JOIN p y ON y.c = x.c AND y.d = x.d - 1),
n AS (SELECT d, k, min(pk) AS pk, min(chars) AS chars, count(*) AS n, min(c) AS c, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM u GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS m FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT n.*, coalesce(m, 0) AS m, q.c AS pc FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.pk),
t AS (SELECT u.d, u.k, sum((a.n - 1) * a.chars) AS saved, count(*) FILTER (a.m = 0) AS leaves FROM a JOIN u ON u.c = a.c AND u.d <= a.d GROUP BY 1, 2)
SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, a.pc::BIGINT AS parent_conv_id, a.n::BIGINT AS n_convs, a.m::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, e AS ends_sha256 FROM a JOIN t ON t.d = a.d AND t.k = a.k"""

_OP13 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, g, f, string_split(g, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, k, g, f, j, array_to_string(ws[: j], ' ') AS x, array_to_string(ws[j + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.k, cut.g, cut.f AS a, j, fx.f AS l, fy.f AS r, (2000000::HUGEINT * cut.f) // (fx.f + fy.f) AS score FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.g = x JOIN f fy ON fy.lang = cut.lang AND fy.g = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(ws[j : j + m - 1], ' ') AS g, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000"""


def _licence_words(text: str) -> str:
    """Two passes take away runs of dots, as the pattern language has no look-ahead."""
    plain = rf"regexp_replace({_LOWER.format(text)}, '[\x00-\x2c\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')"
    for _ in range(2):
        plain = rf"regexp_replace({plain}, '[.]([^0-9]|$)', ' \1', 'g')"
    return f"regexp_extract_all({plain}, '[^ ]+')"


_NOTICES = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES.items())
_LIKE = f"10 * len(list_filter({{0}}, lambda x: list_contains(vocabulary, x))) >= {KNOWN} * len({{0}})"
_OP5 = f"""WITH t AS (SELECT licence, {_licence_words('notice')} AS ws FROM (VALUES {_NOTICES}) v(licence, notice)),
tg AS (SELECT DISTINCT licence, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT licence, ws, unnest(range(1, len(ws))) AS i FROM t)),
tn AS (SELECT licence, count(*) AS m FROM tg GROUP BY 1),
vo AS (SELECT list(DISTINCT w) AS vocabulary FROM (SELECT unnest(ws) AS w FROM t)),
sg AS (SELECT doc_id, i, s, {_licence_words('s')} AS ws FROM (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM documents WHERE regexp_matches(text, '(?i){MARKS}')))),
re AS (SELECT doc_id, unnest(string_split(string_agg(CASE WHEN {_LIKE.format('ws')} THEN s ELSE chr(1) END, chr(10) ORDER BY i), chr(1))) AS u FROM sg, vo GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents UNION ALL SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, u FROM re),
u AS (SELECT doc_id, ws, row_number() OVER () AS unit FROM (SELECT DISTINCT doc_id, {_licence_words('u')} AS ws FROM l), vo WHERE {_LIKE.format('ws')}),
ug AS (SELECT DISTINCT doc_id, unit, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, unit, ws, unnest(range(1, len(ws))) AS i FROM u)),
un AS (SELECT doc_id, unit, count(*) AS n FROM ug GROUP BY 1, 2),
d AS (SELECT doc_id, unit, licence, 2.0::DOUBLE * k / (n + m) AS dice FROM (SELECT doc_id, unit, licence, count(*) AS k FROM ug JOIN tg USING (g) GROUP BY 1, 2, 3) JOIN un USING (doc_id, unit) JOIN tn USING (licence)),
b AS (SELECT doc_id, licence, dice, count(DISTINCT unit) OVER (PARTITION BY doc_id) AS n_units, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) AS r FROM d WHERE dice >= {LEAST})
SELECT doc_id, licence, round(dice, 6) AS dice, coalesce(n_units, 0)::BIGINT AS n_units FROM documents LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op5_licence_scan": _OP5, "op8_decontamination": _OP8, "op9_substring_dedup": _OP9, "op10_warc": _OP10, "op12_conversation_trie": _OP12, "op13_phrase_collocations": _OP13}
