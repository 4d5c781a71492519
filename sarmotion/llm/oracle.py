"""SQL for the queries that SQL can express whole. The other queries are tested against brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = "coalesce(text, '')"
_FOLDED = f"translate({_TEXT}, '{_UPPER}', '{_LOWER}')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

EXACT_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, length({_TEXT}) AS chars, sha256(regexp_replace({_TEXT}, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

DECONTAMINATION = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLDED}, {_ITEM_WORD}) AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_ITEM_WORD}) AS w FROM documents),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_TEXT}, {_WORD}) AS w FROM documents),
win AS (
  SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM again),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS words, count(*) AS n
  FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS shingle
  FROM d WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM pair JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
  WHERE 100 * c >= 85 * (sx.n + sy.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN size ON size.doc_id = r.doc_id GROUP BY r.doc_id
"""


def _crc32(decimal: str) -> str:
    """The unsigned CRC-32 of a string of digits, a step for each byte and bit."""
    steps = f"flatten(list_transform(regexp_extract_all({decimal}, '.'), lambda d: [ord(d), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    full = "CAST(4294967295 AS BIGINT)"
    return f"xor(list_reduce(list_transform({steps}, lambda s: CAST(s AS BIGINT)), lambda a, s: {step}, {full}), {full})"


_ROLE = "coalesce(role, '')"
_MARK = f"md5(concat(length({_ROLE}), ':', {_ROLE}, {_TEXT}))"

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, {_MARK} AS mark, length({_TEXT}) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_MARK}) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
id AS (SELECT c, c - c % 100 AS base, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
took AS (SELECT id.c, base, h, count(t.c) AS taken FROM id LEFT JOIN t ON t.c = base AND pos < h GROUP BY ALL),
path AS (
  SELECT took.c, pos + 1 AS depth, mark, chars FROM took JOIN t ON t.c = base AND pos < h
  UNION ALL SELECT t.c, pos - h + taken + 1, mark, chars FROM t JOIN took USING (c) WHERE pos >= h),
named AS (
  SELECT c, depth, chars, string_agg(mark, '') OVER (PARTITION BY c ORDER BY depth) AS name FROM path
  UNION ALL SELECT c, 0, 0, '' FROM id),
node AS (SELECT depth, name, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM named GROUP BY depth, name),
kids AS (SELECT left(name, 32 * (depth - 1)) AS name, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT left(name, CAST(32 * up AS INT)) AS name, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node.name, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved,
               unnest(range(0, depth + 1)) AS up FROM node LEFT JOIN kids USING (name)) GROUP BY 1),
ends AS (
  SELECT name, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY c ORDER BY depth DESC) = 1) GROUP BY name)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (name) LEFT JOIN kids USING (name) LEFT JOIN ends USING (name)
LEFT JOIN node up ON up.depth = node.depth - 1 AND up.name = left(node.name, 32 * (node.depth - 1))
"""

PERIODIC_RUNS = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, {_WORD}) AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
each AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM e)),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM each x JOIN each y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
  WHERE 3 * (y.i - x.i) <= x.n AND x.n >= 24),
stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM equal) GROUP BY doc_id, p, island
  HAVING count(*) + p >= greatest(24, 3 * p)),
run AS (
  SELECT * FROM stretch s WHERE NOT EXISTS (
    SELECT 1 FROM stretch q WHERE q.doc_id = s.doc_id AND q.p < s.p AND s.p % q.p = 0 AND q.start <= s.start
      AND q.start + q.length >= s.start + s.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + p, start + length)) AS i FROM run),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS words FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
  GROUP BY e.doc_id),
best AS (
  SELECT * FROM run r WHERE NOT EXISTS (
    SELECT 1 FROM run o WHERE o.doc_id = r.doc_id AND (o.length * r.p > r.length * o.p
      OR o.length * r.p = r.length * o.p AND (o.start < r.start OR o.start = r.start AND o.p < r.p)))),
lines AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', p, chr(10)), '' ORDER BY start, p) AS line
  FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, p AS period, 1000 * length // p AS exponent_milli,
       sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# What SQL can tell of operators whose whole result it cannot.

BASE_SCORES = f"""
WITH d AS (
  SELECT doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 1 AS held_out,
         list_append(regexp_extract_all({_FOLDED}, {_WORD}), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) FILTER (WHERE NOT held_out) AS c FROM t GROUP BY token),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (WHERE c > 0) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(n) AS train_tokens,
       floor(sum(log10((c + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))) * 1e3::DOUBLE + 0.5) / 1e3::DOUBLE AS base_score
FROM t JOIN c USING (token), n GROUP BY doc_id, held_out
"""

SHARD_LAW = """
WITH n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT CAST(s AS INT) AS shard, n // 16 + CASE WHEN s < n % 16 THEN 1 ELSE 0 END AS n_rows FROM n, range(16) r(s))
SELECT shard, n_rows, n_rows AS n_slots, CAST(0 AS BIGINT) AS first_slot, n_rows - 1 AS last_slot FROM s
"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN ({_DIGITS})[-k]::INT "
    f"ELSE (2 * ({_DIGITS})[-k]::INT) // 10 + (2 * ({_DIGITS})[-k]::INT) % 10 END)) % 10 = 0"
)
_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "list_max(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 1000))) <= 255"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_COUNTS = ",\n       ".join(
    f"CAST(len(list_filter(regexp_extract_all({_TEXT}, '{pattern}'), lambda x: {valid})) AS BIGINT) AS n_{kind}"
    for kind, (pattern, valid) in _PATTERNS.items()
)
BASE_COUNTS = f"SELECT doc_id, {_COUNTS} FROM documents"
