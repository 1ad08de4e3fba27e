"""SQL that gives the rows of queries whose operators it can express."""

from __future__ import annotations

from . import chat, licenses, secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


def _templates() -> str:
    rows = []
    for t, (text, label) in enumerate((*licenses.PHRASES, *licenses.NOTICES)):
        phrase = t < len(licenses.PHRASES)
        rows.append(f"({t}, '{text}', '{label}', {licenses.PHRASE_K if phrase else licenses.NOTICE_K}, {phrase})")
    return ", ".join(rows)


LICENSES = rf"""
WITH w AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT *, string_split(text, ' ') AS words FROM (VALUES {_templates()}) AS v(template, text, label, k, phrase)),
tg AS (SELECT template, label, k, phrase, len(words) - k + 1 AS n_grams, i - 1 AS tpos, array_to_string(words[i:i + k - 1], ' ') AS gram FROM t, unnest(range(1, len(words) - k + 2)) AS u(i)),
g AS (SELECT key, k, i - 1 AS pos, array_to_string(words[i:i + k - 1], ' ') AS gram FROM w, (VALUES ({licenses.PHRASE_K}), ({licenses.NOTICE_K})) AS v(k), unnest(range(1, len(words) - k + 2)) AS u(i)),
hits AS (SELECT key, template, label, phrase, n_grams, pos, tpos, pos - tpos AS diagonal FROM g JOIN tg USING (gram, k)),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER d > CASE WHEN phrase THEN 0 ELSE {licenses.DRIFT} END THEN 1 ELSE 0 END AS fresh FROM hits WINDOW d AS (PARTITION BY key, template ORDER BY diagonal, pos)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY key, template ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS grp FROM marked),
ranked AS (SELECT *, tpos > coalesce(max(tpos) OVER (PARTITION BY key, template, grp ORDER BY pos, tpos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS later FROM grouped),
spans AS (SELECT key, label, phrase, n_grams, count(*) AS votes, min(pos) AS lo, (count(*) FILTER (later))::DOUBLE / n_grams AS score FROM ranked GROUP BY key, template, grp, label, phrase, n_grams),
kept AS (SELECT * FROM spans WHERE CASE WHEN phrase THEN votes = n_grams ELSE score >= {licenses.COVERAGE} END)
SELECT any_value(doc_id) AS doc_id, any_value(len(words))::BIGINT AS n_words, count(*) FILTER (phrase)::BIGINT AS n_base, (min(lo) FILTER (phrase))::BIGINT AS first_word, (max(lo) FILTER (phrase))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(score), 0.0)::DOUBLE AS score
FROM w LEFT JOIN kept USING (key) GROUP BY key"""


def _secrets() -> str:
    quoted = {name: pattern.replace("'", "''") for name, pattern in secret_scan.KINDS}
    # Without look-around: a bare key ends a whole run of these characters, but for a full stop, after one = or nothing.
    quoted["key"] = "[A-Za-z0-9+/=_.-]+"
    bare = "(?:^|^=|[^=]=)[A-Za-z0-9+/]{{40}}[.]?$"
    kinds = " UNION ALL ".join(f"SELECT key, {k} AS kind, regexp_extract_all(text, '{quoted[name]}') AS found, string_split_regex(text, '{quoted[name]}') AS pieces FROM w" for k, (name, _) in enumerate(secret_scan.KINDS))
    at = {name: k for k, (name, _) in enumerate(secret_scan.KINDS)}
    names = ", ".join(f"'{name}'" for name, _ in secret_scan.KINDS)
    listing = f"string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"

    def near(*kinds: str, table: str = "p") -> str:
        gap = f"(b.s BETWEEN a.e AND a.e + {secret_scan.LINK_CHARS} OR b.e BETWEEN a.s - {secret_scan.LINK_CHARS} AND a.s)"
        return f"EXISTS (SELECT 1 FROM {table} b WHERE b.key = a.key AND b.kind IN ({', '.join(str(at[k]) for k in kinds)}) AND {gap})"

    secret = near("assign", "hex", "key")
    return rf"""
WITH w AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({kinds}),
m AS (SELECT key, kind, i, found[i] AS f, sum(length(pieces[i]) + length(found[i])) OVER (PARTITION BY key, kind ORDER BY i) AS e FROM x, unnest(range(1, len(found) + 1)) AS u(i)),
c AS (SELECT key, kind, f, (e - CASE WHEN kind = {at["key"]} AND f LIKE '%.' THEN 1 ELSE 0 END)::BIGINT AS e FROM m
  WHERE CASE kind WHEN {at["assign"]} THEN length(regexp_extract(f, '{quoted["assign"]}', 1)) >= {secret_scan.LEAST_VALUE} WHEN {at["key"]} THEN regexp_matches(f, '{bare.format()}') ELSE true END),
p AS (SELECT key, kind, (e - CASE WHEN kind = {at["key"]} THEN 40 ELSE length(f) END)::BIGINT AS s, e FROM c),
linked AS (SELECT * FROM p a WHERE kind IN ({at["access"]}, {at["id"]}) AND {secret}),
r AS (SELECT * FROM p a WHERE kind < {len(secret_scan.STRONG)} OR kind = {at["id"]} AND {secret} OR kind = {at["key"]} AND {near("access", "id")} OR kind = {at["url"]} AND {near("access", "id", table="linked")} AND {secret})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = {k})::BIGINT AS n_{name}" for k, (name, _) in enumerate(secret_scan.STRONG))},
  sha256(coalesce({listing} FILTER (kind < {len(secret_scan.STRONG)}), '')) AS base_sha256, coalesce({listing} FILTER (kind IS NOT NULL), '') AS spans
FROM w LEFT JOIN r USING (key) GROUP BY key"""


SECRETS = _secrets()


def _chat(max_tokens: int = 1024, history_tokens: int = 256) -> str:
    probe = chat.PROBE.replace("'", "''")
    piece = lambda role, text: f"length('### ' || {role} || ':' || chr(10) || {text} || chr(10) || '</turn>' || chr(10))"
    escaped = lambda c: f"regexp_replace({c}, '(\\\\|###|</turn>)', '\\\\\\1', 'g')"
    return f"""
WITH c AS (SELECT conv_id, coalesce('=' || conv_id, '-') AS key, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{probe}'), (-7, 1, 'assistant', '{probe}'))),
n AS (SELECT *, (strlen(text) + 3) // 4 + {chat.TURN_TOKENS} AS n, {piece(escaped("role"), escaped("text"))} AS chars FROM c),
o AS (SELECT *, row_number() OVER s - 1 AS idx, sum(n) OVER (s ROWS UNBOUNDED PRECEDING) AS upto FROM n WINDOW s AS (PARTITION BY key ORDER BY turn NULLS FIRST, role, text)),
y AS (SELECT key, n AS system_n, chars AS system_chars FROM o WHERE idx = 0 AND role = 'system'),
r AS (SELECT o.*, upto - n AS began, greatest({max_tokens} - coalesce(system_n, 0), 1) AS room, system_n, system_chars FROM o LEFT JOIN y USING (key)),
p AS (SELECT *, least({history_tokens}, room // 4) AS hist, greatest(room - least({history_tokens}, room // 4), 1) AS stride FROM r),
b AS (SELECT *, (upto - 1) // stride AS bucket FROM p),
a AS (SELECT *, began < bucket * stride AND sum(n) OVER (PARTITION BY key, bucket) > stride AS alone FROM b),
w AS (SELECT *, min(began) OVER (PARTITION BY key, bucket, alone) AS win, sum(n) OVER (PARTITION BY key, bucket, alone) AS own_n FROM a),
starts AS (SELECT * FROM w WHERE began = win),
extra AS (SELECT s.key, sum(h.chars) AS chars FROM starts s JOIN p h ON h.key = s.key AND h.n <= {history_tokens} AND NOT (h.idx = 0 AND h.role = 'system') AND s.win >= h.upto AND s.win - h.began <= greatest(0, least(s.hist, s.room - s.own_n)) GROUP BY s.key),
again AS (SELECT key, sum(system_chars) AS chars FROM starts WHERE idx > 0 AND system_chars IS NOT NULL GROUP BY key),
d AS (SELECT key, any_value(conv_id) AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM o GROUP BY key)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (d.chars + coalesce(extra.chars, 0) + coalesce(again.chars, 0))::BIGINT AS formatted_chars FROM d LEFT JOIN extra USING (key) LEFT JOIN again USING (key)"""


CHAT = _chat()

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM r),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
often AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
k AS (SELECT row, count(*) AS n_dropped FROM l WHERE key IN (FROM often) GROUP BY row),
t AS (SELECT row, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE key NOT IN (FROM often) GROUP BY row)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row) LEFT JOIN t USING (row)"""
